"""Raster operators: adjustments, statistics, selections, windows and geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.blend import blend_frame, clamp, source_over

RGB = ("r", "g", "b")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def luminance(scale: float = 1.0) -> Column:
    return (0.3 * F.col("r") + 0.59 * F.col("g") + 0.11 * F.col("b")) * scale


# Adjustments: a function of the channel columns; transparent pixels stay as they are.


def point(px: DataFrame, fn) -> DataFrame:
    new = fn(*(F.col(c) for c in RGB))
    return px.select("x", "y", *(F.when(F.col("a") == 0, F.col(c)).otherwise(v.cast("long")).alias(c) for c, v in zip(RGB, new, strict=True)), "a")


def invert(px: DataFrame) -> DataFrame:
    return point(px, lambda *c: [255 - v for v in c])


def posterize(px: DataFrame, levels: int = 4) -> DataFrame:
    return point(px, lambda *c: [half_up(F.floor(v * levels / 256) * 255 / (levels - 1)) for v in c])


def threshold(px: DataFrame, level: int = 128) -> DataFrame:
    white = F.when(luminance() + 1e-3 >= level, 255).otherwise(0)
    return point(px, lambda *c: [white] * 3)


def desaturate(px: DataFrame) -> DataFrame:
    return point(px, lambda *c: [half_up((F.greatest(*c) + F.least(*c)) / 2)] * 3)


def channel_mixer(px: DataFrame, rows: tuple = ((80, 30, -10, 0), (10, 90, 0, 5), (0, 20, 70, 10))) -> DataFrame:
    """Percent of each channel and a constant."""
    mix = lambda k, c: half_up(255 * clamp((c[0] * k[0] + c[1] * k[1] + c[2] * k[2]) / 25500 + k[3] / 100))
    return point(px, lambda *c: [mix(k, c) for k in rows])


def levels(px: DataFrame, in_black: int = 20, gamma: float = 1.0, in_white: int = 220, out_black: int = 10, out_white: int = 245) -> DataFrame:
    def one(v: Column) -> Column:
        t = clamp((v - in_black) / max(1e-6, in_white - in_black))
        return half_up(out_black + (out_white - out_black) * (t if gamma == 1 else F.power(t, F.lit(1 / max(0.01, gamma)))))

    return point(px, lambda *c: [one(v) for v in c])


def brightness_contrast(px: DataFrame, brightness: int = 20, contrast: int = 30) -> DataFrame:
    """The legacy form; contrast below 100."""
    k = 100 / (100 - contrast) if contrast > 0 else (100 + contrast) / 100
    return point(px, lambda *c: [half_up(255 * clamp((127.5 + (v + brightness - 127.5) * k) / 255)) for v in c])


def photo_filter(px: DataFrame, color: tuple = (236, 138, 0), density: float = 0.25) -> DataFrame:
    """Without preserving luminosity."""
    return point(px, lambda *c: [half_up(v + (v * k / 255 - v) * density) for v, k in zip(c, color, strict=True)])


# Statistics.


def histogram(px: DataFrame) -> DataFrame:
    """(channel, level, n) over pixels that are not transparent, with rounded luminance."""
    bins = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("level")) for c in RGB), F.struct(F.lit("lum").alias("channel"), half_up(luminance()).alias("level")))
    return px.where("a <> 0").select(F.explode(bins).alias("e")).groupBy("e.channel", "e.level").agg(F.count("*").alias("n"))


def equalize(px: DataFrame) -> DataFrame:
    """(level, cdf) of luminance: running counts over at most 256 rows."""
    return histogram(px).where("channel = 'lum'").select("level", F.sum("n").over(Window.partitionBy("channel").orderBy("level")).alias("cdf"))


def bounds(px: DataFrame) -> DataFrame:
    return px.where("a <> 0").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def color_sums(px: DataFrame) -> DataFrame:
    return px.where("a <> 0").agg(*(F.sum(F.col(c) * F.col("a")).alias(f"sum_{c}") for c in RGB), F.sum("a").alias("sum_a"), F.count("*").alias("n"))


def downsample(px: DataFrame) -> DataFrame:
    """Half size: colour means weighted by alpha, alpha over four."""
    cell = [F.floor(F.col(c) / 2).alias(c) for c in ("x", "y")]
    g = px.groupBy(*cell).agg(*(F.sum(F.col(c) * F.col("a")).alias(c) for c in RGB), F.sum("a").alias("a"))
    return g.select("x", "y", *(F.when(F.col("a") == 0, F.lit(0)).otherwise(F.floor(F.col(c) / F.col("a") + 0.5)).cast("long").alias(c) for c in RGB), half_up(F.col("a") / 4).alias("a"))


# Selections: (x, y, cov 0...255); absent pixels have coverage 0.


def circle(px: DataFrame, cx: int = 50, cy: int = 50, radius: int = 30) -> DataFrame:
    inside = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= radius * radius
    return px.select("x", "y", F.when(inside, 255).otherwise(0).cast("long").alias("cov"))


def rectangle(px: DataFrame, x0: float = 10.25, y0: float = 5.5, x1: float = 60.75, y1: float = 40.5) -> DataFrame:
    """Fractional coverage at the edges: overlap in x times overlap in y."""
    over = lambda c, a, b: F.greatest(F.lit(0.0), F.least(F.col(c) + 1.0, F.lit(b)) - F.greatest(F.col(c) * 1.0, F.lit(a)))
    return px.select("x", "y", half_up(255 * over("x", x0, x1) * over("y", y0, y1)).alias("cov"))


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """add, subtract or intersect of fuzzy selections."""
    both = a.join(b.withColumnRenamed("cov", "other"), ["x", "y"], "full_outer")
    d, s = F.coalesce("cov", F.lit(0)), F.coalesce("other", F.lit(0))
    out = {"add": F.greatest(d, s), "subtract": F.greatest(F.lit(0), d - s), "intersect": F.least(d, s)}[op]
    return both.select("x", "y", out.cast("long").alias("cov"))


def through(px: DataFrame, adjusted: DataFrame, selection: DataFrame) -> DataFrame:
    """An adjustment through a selection: v + (f(v) - v) * cov / 255, rounded."""
    new = adjusted.select("x", "y", *(F.col(c).alias(f"new_{c}") for c in RGB))
    both = px.join(new, ["x", "y"]).join(selection, ["x", "y"], "left")
    cov = F.coalesce("cov", F.lit(0))
    return both.select("x", "y", *(half_up(F.col(c) + (F.col(f"new_{c}") - F.col(c)) * cov / 255).alias(c) for c in RGB), "a")


# Windows along rows and columns; edges repeat the border pixel.


def _axis(axis: str) -> Window:
    return Window.partitionBy("y" if axis == "x" else "x").orderBy(axis)


def edges(px: DataFrame) -> DataFrame:
    """Absolute differences of luminance to the next pixel in x and y."""
    lum = half_up(luminance())
    px = px.select("x", "y", lum.alias("l"))
    diff = lambda axis: F.abs(F.coalesce(F.lead("l").over(_axis(axis)), F.col("l")) - F.col("l"))
    return px.select("x", "y", diff("x").alias("dx"), diff("y").alias("dy"))


# Geometry.


def _sized(px: DataFrame) -> DataFrame:
    """Adds w and h, the size of the raster: one aggregated row, broadcast."""
    return px.join(F.broadcast(px.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))))


def offset(px: DataFrame, dx: int, dy: int) -> DataFrame:
    """Moves a raster; what leaves it comes in at the other side."""
    return _sized(px).select(F.pmod(F.col("x") + dx, F.col("w")).alias("x"), F.pmod(F.col("y") + dy, F.col("h")).alias("y"), *RGB, "a")


def flip(px: DataFrame, vertical: bool = False) -> DataFrame:
    at = _sized(px)
    return at.select("x", (F.col("h") - 1 - F.col("y")).alias("y"), *RGB, "a") if vertical else at.select((F.col("w") - 1 - F.col("x")).alias("x"), "y", *RGB, "a")


def rotate(px: DataFrame, degrees: int) -> DataFrame:
    """A quarter, half or three-quarter turn clockwise."""
    x, y, right, low = F.col("x"), F.col("y"), F.col("w") - 1, F.col("h") - 1
    to = {90: (low - y, x), 180: (right - x, low - y), 270: (y, right - x)}[degrees]
    return _sized(px).select(to[0].alias("x"), to[1].alias("y"), *RGB, "a")


def crop(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return px.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), *RGB, "a")


# Compositing.


def flatten(layers: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """Folds layers, lowest first, over transparency: (raster, mode, opacity) each.

    Layers meet by (x, y) alone, so all joins share one partitioning; the fold
    itself is one expression per layer, built with the plan.
    """

    def over(below: DataFrame, layer: tuple[DataFrame, str, float]) -> DataFrame:
        px, mode, opacity = layer
        new = px.select("x", "y", *(F.col(c).alias(f"s{c}") for c in (*RGB, "a")))
        both = below.join(new, ["x", "y"], "full_outer").fillna(0)
        b, s = tuple(F.col(c) for c in RGB), tuple(F.col(f"s{c}") / 255 for c in RGB)
        both, mixed = blend_frame(both, mode, b, s)
        rgb, a = source_over(mixed, b, F.col("a"), s, F.col("sa") / 255 * opacity)
        return both.select("x", "y", *(v.alias(c) for v, c in zip(rgb, RGB, strict=True)), a.alias("a"))

    first, mode, opacity = layers[0]
    start = first.select("x", "y", *((F.col(c) / 255).alias(c) for c in RGB), (F.col("a") / 255 * opacity).alias("a"))
    start = start.select("x", "y", *(F.when(F.col("a") <= 0, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in RGB), "a")
    out = reduce(over, layers[1:], start)
    return out.select("x", "y", *(half_up(255 * F.col(c)).alias(c) for c in (*RGB, "a")))
