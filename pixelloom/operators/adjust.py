"""Adjustments with all their parameters: tables per channel, hue bands, kept luminosity, selective colour, 3-D tables, gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import ramps
from pixelloom.functions.blend import Rgb, clamp
from pixelloom.functions.color import hsl, hsl_rgb, hue_weight, luma
from pixelloom.operators.raster import RGB, half_up, histogram, point
from pixelloom.operators.tone import byte, clip_ranges

#: Edges of the six hue ranges, in degrees.
HUE_BANDS = {
    "reds": (315, 345, 15, 45), "yellows": (15, 45, 75, 105), "greens": (75, 105, 135, 165),
    "cyans": (135, 165, 195, 225), "blues": (195, 225, 255, 285), "magentas": (255, 285, 315, 345),
}


def unit() -> Rgb:
    return tuple(F.col(c) / 255 for c in RGB)


def apply_tables(px: DataFrame, red: list[int], green: list[int], blue: list[int]) -> DataFrame:
    """A table of 256 levels per channel; identities leave their channel out of the plan."""
    return point(px, lambda *c: [v if ramps.is_identity(t) else ramps.looked_up(t, v) for v, t in zip(c, (red, green, blue), strict=True)])


def levels(px: DataFrame, master: tuple, red: tuple, green: tuple, blue: tuple) -> DataFrame:
    """Levels (black, gamma, white, out black, out white) per channel, then of all: two tables made one."""
    last = ramps.levels_table(*master)
    return apply_tables(px, *(ramps.composed(ramps.levels_table(*of), last) for of in (red, green, blue)))


def curves(px: DataFrame, master: list, red: list | None = None, green: list | None = None, blue: list | None = None) -> DataFrame:
    """A spline through points (0...1) per channel, or a drawn table of 256 levels, then the master's."""
    table = lambda of: list(range(256)) if not of else of if len(of) == 256 else ramps.curve_table(of)
    return apply_tables(px, *(ramps.composed(table(of), table(master)) for of in (red, green, blue)))


def with_luminance(px: DataFrame, target: Column) -> DataFrame:
    """Columns nr, ng, nb moved to a luminance, then drawn towards it where a channel leaves 0...1, step by step."""
    c = tuple(F.col(f"n{k}") for k in RGB)
    px = px.withColumns({"n_by": target - luma(c)}).withColumns({f"n{k}": v + F.col("n_by") for k, v in zip(RGB, c, strict=True)})
    y, low, high = (F.col(f"n_{k}") for k in ("y", "low", "high"))
    px = px.withColumns({"n_y": luma(c), "n_low": F.least(*c), "n_high": F.greatest(*c)})
    px = px.withColumns({f"n{k}": F.when(low < 0, y + (v - y) * y / (y - low)).otherwise(v) for k, v in zip(RGB, c, strict=True)})
    return px.withColumns({f"n{k}": F.when(high > 1, y + (v - y) * (1 - y) / (high - y)).otherwise(v) for k, v in zip(RGB, c, strict=True)})


def _kept(px: DataFrame, new: Rgb, keep: bool) -> DataFrame:
    """Bytes of new unit colours, with the luminance of the old ones if it is kept."""
    px = px.withColumns({f"n{c}": v for c, v in zip(RGB, new, strict=True)})
    px = with_luminance(px, luma(unit())) if keep else px
    return point(px, lambda *_: [byte(F.col(f"n{c}")) for c in RGB])


def color_balance(px: DataFrame, shadows: tuple, midtones: tuple, highlights: tuple, preserve: bool = True) -> DataFrame:
    """Sliders (red, green, blue; percent) of three overlapping ranges of tones."""
    # Where the ranges meet (a third), how steep they are, how much a slider moves.
    dark = lambda v: clamp((v - 0.333) / -0.25 + 0.5)
    light = lambda v: clamp((v - (1 - 0.333)) / 0.25 + 0.5)
    middle = lambda v: clamp((v - 0.333) / 0.25 + 0.5) * clamp((v + 0.333 - 1) / -0.25 + 0.5)
    new = tuple(clamp(v + (dark(v) * (s / 100) + middle(v) * (m / 100) + light(v) * (h / 100)) * 0.7) for v, s, m, h in zip(unit(), shadows, midtones, highlights, strict=True))
    return _kept(px, new, preserve)


def photo_filter(px: DataFrame, color: tuple, density: float = 25, preserve: bool = True) -> DataFrame:
    d = min(1.0, max(0.0, density / 100))
    return _kept(px, tuple(v + (v * k - v) * d for v, k in zip(unit(), color, strict=True)), preserve)


def hue_bands(px: DataFrame, master: tuple = (0, 0, 0), bands: dict[str, tuple] | None = None) -> DataFrame:
    """Hue, saturation and lightness of all colours and of ranges of hues, each by its membership; greys have none."""
    px = px.withColumns(dict(zip(("h", "s", "l"), hsl(unit()), strict=True)))
    weights = {n: hue_weight(F.col("h"), HUE_BANDS[n]) for n in bands or ()}
    total = [F.lit(float(m)) + sum((F.when(F.col("s") > 0, weights[n] * of[k]).otherwise(0.0) for n, of in (bands or {}).items()), F.lit(0.0)) for k, m in enumerate(master)]
    px = px.withColumns({"th": total[0], "ts": F.greatest(F.lit(-100.0), F.least(F.lit(100.0), total[1])), "tl": F.greatest(F.lit(-100.0), F.least(F.lit(100.0), total[2]))})
    light = F.when(F.col("tl") > 0, F.col("l") + (1 - F.col("l")) * (F.col("tl") / 100)).otherwise(F.col("l") * (1 + F.col("tl") / 100))
    new = hsl_rgb((F.col("h") + F.col("th") + 720) % 360, clamp(F.col("s") * (1 + F.col("ts") / 100)), light)
    return point(px, lambda *_: [byte(v) for v in new])


def black_white(px: DataFrame, tint: tuple, reds: int = 40, yellows: int = 60, greens: int = 40, cyans: int = 60, blues: int = 20, magentas: int = 80) -> DataFrame:
    """Grey by the hue family, coloured with the hue and saturation of a tint (0...1)."""
    c = r, g, b = unit()
    high, low = F.greatest(*c), F.least(*c)
    first = F.when(r == high, reds).when(g == high, greens).otherwise(blues) / 100
    pair = F.when(r == high, F.when(b == low, yellows).otherwise(magentas)).when(g == high, F.when(b == low, yellows).otherwise(cyans)).otherwise(F.when(r == low, cyans).otherwise(magentas)) / 100
    px = px.withColumn("grey", clamp(low + (r + g + b - high - low - low) * pair + (high - (r + g + b - high - low)) * first))
    h, s, _ = hsl(tuple(F.lit(float(v)) for v in tint))
    return point(px, lambda *_: [byte(v) for v in hsl_rgb(h, s, F.col("grey"))])


def selective_color(px: DataFrame, ranges: dict[str, tuple], relative: bool = True) -> DataFrame:
    """Ink (cyan, magenta, yellow, black; percent) added to the colours of nine ranges, by how far a pixel belongs to them."""
    r, g, b = (F.col(c) for c in RGB)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    mid = r + g + b - high - low
    member = {
        "reds": (r == high, high - mid), "greens": (g == high, high - mid), "blues": (b == high, high - mid),
        "yellows": (b == low, mid - low), "cyans": (r == low, mid - low), "magentas": (g == low, mid - low),
        "whites": ((r > 128) & (g > 128) & (b > 128), 2 * low - 255), "blacks": ((r < 128) & (g < 128) & (b < 128), 255 - 2 * high),
        "neutrals": ((high > 0) & (low < 255), (510 - (F.abs(2 * high - 255) + F.abs(2 * low - 255))) / 2),
    }

    def one(v: Column, k: int) -> Column:
        u, total = v / 255, F.lit(0.0)
        for name, ink in ranges.items():
            a, black = ink[k] / 100, ink[3] / 100
            change = ((-1 - a) * black - a) * (1 - u) if relative else F.lit((-1 - a) * black - a)
            belongs, scale = member[name]
            total = total + F.when(belongs & (scale > 0), F.least(1 - u, F.greatest(-u, change)) * scale).otherwise(0.0)
        return byte((v + total) / 255)

    return point(px, lambda *c: [one(v, k) for k, v in enumerate(c)])


def color_lookup(px: DataFrame, size: int, values: list[float]) -> DataFrame:
    """Colours through a table of size x size x size (red fastest), which every task is sent once: 1 MB at 33 entries a side, 7 at 65.

    Interpolated in the tetrahedron of the cell: from its first corner along
    the axis of the largest fraction, then the next, then the least.
    """
    table = px.sparkSession.sparkContext.broadcast(np.array(values).reshape(-1, 3))
    axes = np.array([size**n for n in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cube = table.value
        for b in batches:
            old = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in RGB])
            at = np.clip(old / 255, 0, 1) * (size - 1)
            low = np.minimum(size - 2, np.floor(at)).astype(np.int64)
            share = at - low
            corner = axes @ low
            new = cube[corner]
            for axis in np.argsort(-share, axis=0, kind="stable"):
                onward = corner + axes[axis]
                new = new + share[axis, np.arange(len(axis))][:, None] * (cube[onward] - cube[corner])
                corner = onward
            new = np.floor(np.clip(new.T, 0, 1) * 255 + 0.5).astype(np.int64)
            a = b.column("a").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), *(pa.array(v) for v in np.where(a == 0, old, new)), b.column("a")], names=["x", "y", *RGB, "a"])

    return px.select("x", "y", *RGB, "a").mapInArrow(run, "x long, y long, r long, g long, b long, a long")


def gradient_map(px: DataFrame, colors: list[tuple], reverse: bool = False) -> DataFrame:
    """The colour of a gradient at the pixel's luminance, from a ramp of 256."""
    ramp = [ramps.gradient_at(colors, [(0, 1.0), (1, 1.0)], 1 - i / 255 if reverse else i / 255) for i in range(256)]
    at = F.floor(clamp(luma(unit())) * 255 + 0.5)
    return point(px.withColumn("at", at), lambda *_: [half_up(ramps.looked_up([float(v[k]) for v in ramp], F.col("at")) * 255) for k in range(3)])


def gradient_fill(px: DataFrame, style: str, line: tuple, colors: list[tuple], opacities: list[tuple], reverse: bool = False) -> DataFrame:
    """Each pixel of a raster's grid painted with a gradient along a line (x0, y0, x1, y1)."""
    t = clamp(ramps.gradient_place(style, *line, F.col("x") + 0.5, F.col("y") + 0.5))
    at = F.floor((1 - t if reverse else t) * 255 + 0.5)
    table = ramps.gradient_table(colors, opacities)
    px = px.select("x", "y", at.alias("at"))
    return px.select("x", "y", *(ramps.looked_up([v[k] for v in table], F.col("at")).cast("long").alias(c) for k, c in enumerate((*RGB, "a"))))


def auto_color_levels(px: DataFrame, clip: float = 0.001) -> DataFrame:
    """(channel, lo, hi, gamma): each channel stretched, its mean brought to that of all three; from the histogram's 768 rows."""
    hist = histogram(px).where("channel <> 'lum'")
    ranges = clip_ranges(hist, clip)
    span = clamp((F.col("level") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    means = hist.join(ranges, "channel").groupBy("channel", "lo", "hi").agg((F.sum(span * F.col("n")) / F.sum("n")).alias("m"))
    means = means.withColumn("target", F.avg("m").over(Window.partitionBy(F.lit(0))))  # three rows
    usable = (F.col("m") > 0) & (F.col("m") < 1) & (F.col("target") > 0) & (F.col("target") < 1)
    gamma = F.floor(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.log("m") / F.log("target"))) * 100 + 0.5) / 100
    return means.select("channel", "lo", "hi", F.when(usable, gamma).otherwise(1.0).alias("gamma"))


def auto_color(px: DataFrame, clip: float = 0.001) -> DataFrame:
    """The levels that ``auto_color_levels`` finds, broadcast as one row."""
    of = auto_color_levels(px, clip)
    row = of.agg(*(F.max(F.when(F.col("channel") == c, F.struct("lo", "hi", "gamma"))).alias(f"of_{c}") for c in RGB))
    one = lambda c: half_up(255 * F.power(clamp((F.col(c) - F.col(f"of_{c}.lo")) / (F.col(f"of_{c}.hi") - F.col(f"of_{c}.lo"))), 1 / F.col(f"of_{c}.gamma")))
    return point(px.join(F.broadcast(row)), lambda *_: [one(c) for c in RGB])
