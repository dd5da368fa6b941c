"""Colour adjustments: hue and saturation, balance, mixing to grey, transfer of statistics; the global wand.

Steps that use a value several times pass it on as a column, so expressions
stay as long as their formulas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.blend import clamp
from pixelloom.functions.color import cmyk, hex_code, hsb, hsl, hsl_rgb, lab, web_safe
from pixelloom.operators.raster import RGB, half_up, point
from pixelloom.operators.tone import byte, color_stats

def _unit() -> tuple[Column, Column, Column]:
    return tuple(F.col(c) / 255 for c in RGB)


def _hsl_frame(px: DataFrame) -> DataFrame:
    return px.withColumns(dict(zip(("h", "s", "l"), hsl(_unit()), strict=True)))


def _light(v: Column, amount: float) -> Column:
    """Lightness mixed towards white or black."""
    return v + (1 - v) * (amount / 100) if amount > 0 else v * (1 + amount / 100)


def hue_saturation(px: DataFrame, hue: float = 40, saturation: float = 25, lightness: float = -10) -> DataFrame:
    """Master sliders: the hue turns, the saturation scales, the lightness mixes."""
    new = _hsl_frame(px).withColumns({"h": (F.col("h") + hue + 720) % 360, "s": clamp(F.col("s") * (1 + saturation / 100)), "l": _light(F.col("l"), lightness)})
    return point(new, lambda *_: [byte(v) for v in hsl_rgb(F.col("h"), F.col("s"), F.col("l"))])


def colorize(px: DataFrame, hue: float = 210, saturation: float = 40) -> DataFrame:
    """One hue and saturation for all; the lightness stays."""
    return point(_hsl_frame(px), lambda *_: [byte(v) for v in hsl_rgb(F.lit(float(hue)), F.lit(saturation / 100), F.col("l"))])


def vibrance(px: DataFrame, amount: float = 60, saturation: float = 10) -> DataFrame:
    """Raises weak saturation most, skin hues (about 35 degrees) half as much."""
    skin = F.greatest(F.lit(0.0), 1 - F.abs(F.col("h") - 35) / 35)
    more = F.col("s") * (1 + amount / 100 * ((1 - F.col("s")) * (1 - 0.5 * skin))) * (1 + saturation / 100)
    return point(_hsl_frame(px).withColumn("s", clamp(more)), lambda *_: [byte(v) for v in hsl_rgb(F.col("h"), F.col("s"), F.col("l"))])


def color_balance(px: DataFrame, shadows: tuple = (20, 0, -10), midtones: tuple = (0, 30, 0), highlights: tuple = (-15, 0, 25)) -> DataFrame:
    """Sliders of three overlapping tone ranges, without preserving luminosity."""

    def one(v: Column, low: float, mid: float, high: float) -> Column:
        dark, bright = clamp(0.5 - (v - 0.333) / 0.25), clamp((v - (1 - 0.333)) / 0.25 + 0.5)
        middle = clamp((v - 0.333) / 0.25 + 0.5) * clamp(0.5 - (v + 0.333 - 1) / 0.25)
        return byte(v + (dark * (low / 100) + middle * (mid / 100) + bright * (high / 100)) * 0.7)

    return point(px, lambda *_: [one(*of) for of in zip(_unit(), shadows, midtones, highlights, strict=True)])


def black_white(px: DataFrame, reds: int = 40, yellows: int = 60, greens: int = 40, cyans: int = 60, blues: int = 20, magentas: int = 80) -> DataFrame:
    """Grey by the hue family: that of the highest channel, and the pair above the lowest."""
    r, g, b = (F.col(c) for c in RGB)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    first = F.when(r == high, reds).when(g == high, greens).otherwise(blues)
    pair = F.when(r == high, F.when(b == low, yellows).otherwise(magentas)).when(g == high, F.when(b == low, yellows).otherwise(cyans)).otherwise(F.when(r == low, cyans).otherwise(magentas))
    mid = r + g + b - high - low
    grey = byte((low * 100 + (mid - low) * pair + (high - mid) * first) / 25500)
    return point(px, lambda *_: [grey] * 3)


def replace_color(px: DataFrame, color: tuple = (120, 90, 60), fuzziness: float = 80, hue: float = 60, saturation: float = 20, lightness: float = 10) -> DataFrame:
    """Hue, saturation and lightness of pixels near a colour, weighted by their distance to it."""
    far = F.sqrt(sum((F.col(c) - k) * (F.col(c) - k) for c, k in zip(RGB, color, strict=True)).cast("double"))
    new = _hsl_frame(px).withColumns({"w": clamp(1 - far / (fuzziness * 1.5)), "h": (F.col("h") + hue + 720) % 360, "s": clamp(F.col("s") * (1 + saturation / 100)), "l": _light(F.col("l"), lightness)})
    return point(new, lambda *c: [half_up(v + (n * 255 - v) * F.col("w")) for v, n in zip(c, hsl_rgb(F.col("h"), F.col("s"), F.col("l")), strict=True)])


def match_color(px: DataFrame, source: DataFrame, fade: float = 0.25, luminance: float = 100, intensity: float = 100, neutralize: bool = False, selection: DataFrame | None = None, source_selection: DataFrame | None = None) -> DataFrame:
    """Gives pixels the opponent-colour means and deviations of another raster; each side's statistics are one broadcast row.

    ``luminance`` and ``intensity`` scale the result's light and colour in
    percent, ``neutralize`` drops the other raster's cast, and selections narrow
    what the statistics of either side are of.
    """
    own, other = color_stats(px, selection), color_stats(source, source_selection)
    both = px.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(other.select(*(F.col(c).alias(f"to_{c}") for c in other.columns))))
    r, g, b = _unit()
    opp = {"lum": 0.3 * r + 0.59 * g + 0.11 * b, "rg": r - g, "yb": (r + g) / 2 - b}
    to = lambda k: F.lit(0.0) if neutralize and k != "lum" else F.col(f"to_mean_{k}")
    scaled = lambda k, v: v * ((luminance if k == "lum" else intensity) / 100)
    both = both.withColumns({k: scaled(k, (v - F.col(f"mean_{k}")) / F.col(f"std_{k}") * F.col(f"to_std_{k}") + to(k)) for k, v in opp.items()})
    both = both.withColumn("ng", F.col("lum") - 0.3 * F.col("rg") - 0.11 * (F.col("rg") / 2 - F.col("yb")))
    new = (F.col("ng") + F.col("rg"), F.col("ng"), F.col("ng") + F.col("rg") / 2 - F.col("yb"))
    return point(both, lambda *_: [byte(n + (v - n) * fade) for n, v in zip(new, _unit(), strict=True)])


def wand(px: DataFrame, x: int = 50, y: int = 5, tolerance: int = 96) -> DataFrame:
    """Coverage by the largest channel difference to a seed pixel, anywhere; its last quarter fades. One broadcast row."""
    seed = px.where((F.col("x") == x) & (F.col("y") == y)).limit(1).select(*(F.col(c).alias(f"s{c}") for c in (*RGB, "a")))
    far, soft = F.greatest(*(F.abs(F.col(c) - F.col(f"s{c}")) for c in (*RGB, "a"))), tolerance * 0.75
    fading = half_up(255 * (1 - (far - soft) / (tolerance - soft))) if tolerance else F.lit(255)
    return px.crossJoin(F.broadcast(seed)).select("x", "y", F.when(far > tolerance, 0).when(far <= soft, 255).otherwise(fading).cast("long").alias("cov"))


def readout(px: DataFrame) -> DataFrame:
    """Each pixel's colour in other models, rounded to 6 places, its code and nearest web-safe value."""
    names = dict(zip(("hue", "sat", "bright"), hsb(_unit()), strict=True)) | dict(zip(("lab_l", "lab_a", "lab_b"), lab(_unit()), strict=True)) | dict(zip(("cyan", "magenta", "yellow", "black"), cmyk(_unit()), strict=True))
    c = tuple(F.col(v) for v in RGB)
    return px.select("x", "y", *((F.round(v, 6) + 0.0).alias(k) for k, v in names.items()), hex_code(c).alias("code"), *(web_safe(v).alias(f"web_{k}") for k, v in zip(RGB, c, strict=True)))
