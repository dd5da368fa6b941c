"""Filters on neighbourhoods in premultiplied colour, over tiles with halos.

Pixels are dealt once by tile, those near an edge to the neighbouring tiles as
well; rows and columns of a tile are then window partitions of bounded size.
Premultiplied values are whole numbers: colour times alpha, and alpha times 255.
Edges of the raster repeat the border pixel. Results are straight bytes, rounded
to even; without alpha there is no colour.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.blend import clamp
from pixelloom.functions.color import hsb, hsb_rgb, hsl, hsl_rgb, luma
from pixelloom.functions.painting import noise
from pixelloom.operators.raster import RGB
from pixelloom.operators.tiled import box_blur, convolve, dust_and_scratches, extreme, median  # noqa: F401
from pixelloom.operators.tiles import filtered, to_tiles

RGBA = (*RGB, "a")
TILE = 256


def haloed(px: DataFrame, reach: int, tile: int = TILE) -> DataFrame:
    """Adds tx, ty and ``own``: each pixel in its tile and, not as its own, in those within ``reach``."""
    near = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    at = px.withColumn("tx", F.explode(near("x"))).withColumn("ty", F.explode(near("y")))
    return at.repartition("tx", "ty").withColumn("own", (F.col("tx") == F.floor(F.col("x") / tile)) & (F.col("ty") == F.floor(F.col("y") / tile)))


def _line(axis: str) -> Window:
    return Window.partitionBy("tx", "ty", "y" if axis == "x" else "x").orderBy(axis)


def _beside(c: str, k: int, axis: str, repeat: bool = True) -> Column:
    """The value k pixels on along an axis; beyond the raster the border's, or null."""
    w = _line(axis)
    v = F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.col(c) if k == 0 else F.coalesce(v, (F.first if k < 0 else F.last)(c).over(whole)) if repeat else v


def around(px: DataFrame, columns: tuple, reach: int, repeat: bool = True) -> DataFrame:
    """Adds n_<column>: the square of values around each pixel, row by row (nulls beyond the raster unless repeated)."""
    at = haloed(px, reach)
    steps = range(-reach, reach + 1)
    at = at.select("*", *(F.array(*(_beside(c, k, "x", repeat) for k in steps)).alias(f"h_{c}") for c in columns))
    none = F.array(*([F.lit(None).cast("double")] * (2 * reach + 1)))
    row = lambda c, k: _beside(f"h_{c}", k, "y", repeat) if repeat else F.coalesce(_beside(f"h_{c}", k, "y", False).cast("array<double>"), none)
    at = at.select("*", *(F.concat(*(row(c, k) for k in steps)).alias(f"n_{c}") for c in columns))
    return at.where("own").drop("tx", "ty", "own", *(f"h_{c}" for c in columns))


def premultiplied(px: DataFrame) -> DataFrame:
    return px.select("x", "y", *((F.col(c) * F.col("a")).alias(c) for c in RGB), (F.col("a") * 255).alias("a"))


def straight(px: DataFrame) -> DataFrame:
    """Colour without alpha is none."""
    return px.select("x", "y", *(F.when(F.col("a") == 0, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in RGB), "a")


def to_bytes(px: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Straight bytes of premultiplied values, which colour keeps within alpha."""
    px = px.select("x", "y", *(values[c].alias(c) for c in RGBA))
    empty = F.col("a") <= 127.5
    return px.select("x", "y", *(F.when(empty, 0).otherwise(F.rint(F.least(F.col("a"), F.greatest(F.lit(0), F.col(c))) * 255 / F.col("a"))).cast("long").alias(c) for c in RGB), F.when(empty, 0).otherwise(F.rint(F.col("a") / 255)).cast("long").alias("a"))


def points(px: DataFrame, fn: Callable[[tuple], tuple]) -> DataFrame:
    """New unit colours of straight ones; alpha stays."""
    new = fn(tuple(F.col(c) / 255 for c in RGB))
    return px.select("x", "y", *(F.when(F.col("a") == 0, 0).otherwise(F.rint(clamp(v) * 255)).cast("long").alias(c) for c, v in zip(RGB, new, strict=True)), "a")


def _median(c: str, reach: int) -> Column:
    return F.get(F.sort_array(f"n_{c}"), F.lit((2 * reach + 1) ** 2 // 2))


def blur(px: DataFrame) -> DataFrame:
    return convolve(px, [1, 2, 1, 2, 4, 2, 1, 2, 1], 16, alpha=True)


def blur_more(px: DataFrame) -> DataFrame:
    row = (1, 4, 6, 4, 1)
    return convolve(px, [p * q for p in row for q in row], 256, alpha=True)


def fragment(px: DataFrame, step: int = 4) -> DataFrame:
    """The mean of four copies, moved along the axes."""
    at = haloed(premultiplied(px), step)
    at = at.select("x", "y", "own", *(sum(_beside(c, k, axis) for axis in ("x", "y") for k in (-step, step)).alias(c) for c in RGBA))
    return to_bytes(at.where("own"), {c: F.col(c) / 4 for c in RGBA})


def mosaic(px: DataFrame, cell: int = 8) -> DataFrame:
    """The premultiplied mean of all four channels of each cell, by a window over the cell's rows: one shuffle."""
    w = Window.partitionBy(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell))
    return to_bytes(premultiplied(px), {c: F.avg(c).over(w) for c in RGBA})


def average(px: DataFrame) -> DataFrame:
    """The mean colour, weighted by alpha, at each pixel's alpha: one aggregated row, broadcast."""
    mean = px.agg(*((F.sum(F.col(c) * F.col("a")) / F.sum("a")).alias(f"m{c}") for c in RGB))
    return px.join(F.broadcast(mean)).select("x", "y", *(F.when(F.col("a") == 0, 0).otherwise(F.rint(f"m{c}")).cast("long").alias(c) for c in RGB), "a")



def diffuse(px: DataFrame, mode: str = "normal", seed: int = 1) -> DataFrame:
    """Each pixel takes a neighbour by chance (if darker or lighter), or the one most like it."""
    base = straight(px).withColumn("l", F.col("r") * 30 + F.col("g") * 59 + F.col("b") * 11)
    at = around(base, (*RGBA, "l"), 1)
    of = lambda c, k: F.get(f"n_{c}", k.cast("int"))
    if mode == "anisotropic":
        places = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
        likes = [F.struct((F.abs(F.get("n_l", F.lit((dy + 1) * 3 + dx + 1)) - F.col("l")) / 25500 + noise(F.col("x"), F.col("y"), seed + k) * 1e-3).alias("d"), F.lit(k).alias("k"), F.lit((dy + 1) * 3 + dx + 1).alias("i")) for k, (dx, dy) in enumerate(places)]
        at = at.withColumn("i", F.least(*likes)["i"])
    else:
        at = at.withColumn("i", F.floor(noise(F.col("x"), F.col("y"), seed + 1) * 3) * 3 + F.floor(noise(F.col("x"), F.col("y"), seed) * 3))
    take = {"darken": of("l", F.col("i")) < F.col("l"), "lighten": of("l", F.col("i")) > F.col("l")}.get(mode, F.lit(True))
    return straight(at.select("x", "y", *(F.when(take, of(c, F.col("i"))).otherwise(F.col(c)).alias(c) for c in RGBA)))


def trace_contour(px: DataFrame, level: int = 128, lower: bool = True) -> DataFrame:
    """Black where a channel lies on one side of a level and a neighbour on the other; else white."""
    at = around(straight(px), RGB, 1)
    mine = (lambda v: v < level) if lower else (lambda v: v >= level)

    def one(c: str) -> Column:
        other = [~mine(F.get(f"n_{c}", F.lit(i))) for i in (1, 3, 5, 7)]
        return F.when(mine(F.col(c)) & (other[0] | other[1] | other[2] | other[3]), 0).otherwise(255).cast("long")

    return straight(at.select("x", "y", *(one(c).alias(c) for c in RGB), "a"))


def kuwahara(px: DataFrame, radius: int = 2) -> DataFrame:
    """The mean of that quadrant around the pixel whose colours vary least; of equals the first."""
    at = around(straight(px), RGB, radius, repeat=False)
    size, quads = 2 * radius + 1, []
    for n, (qx, qy) in enumerate(((0, 0), (radius, 0), (0, radius), (radius, radius))):
        cells = [(qy + i) * size + qx + j for i in range(radius + 1) for j in range(radius + 1)]
        part = lambda c: F.filter(F.array(*(F.get(f"n_{c}", F.lit(k)) for k in cells)), lambda v: v.isNotNull())  # noqa: B023, E731
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
        square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)
        quads.append(F.struct(F.size(part("r")).alias("n"), *(total(part(c)).alias(c) for c in RGB), (square(part("r")) + square(part("g")) + square(part("b"))).alias("q"), F.lit(n).alias("k")))
    at = at.select("x", "y", "a", F.array(*quads).alias("z"))
    spread = lambda z: z["q"] / z["n"] - ((z["r"] / z["n"]) * (z["r"] / z["n"]) + (z["g"] / z["n"]) * (z["g"] / z["n"]) + (z["b"] / z["n"]) * (z["b"] / z["n"]))
    best = F.array_min(F.transform("z", lambda z: F.struct(spread(z).alias("v"), z["k"].alias("k"), z.alias("z"))))["z"]
    at = at.withColumn("z", best)
    return straight(at.select("x", "y", *(F.rint(F.col(f"z.{c}") / F.col("z.n")).alias(c) for c in RGB), "a"))


def emboss(px: DataFrame, angle: float = 135, height: float = 3, amount: float = 100) -> DataFrame:
    """Grey by the difference of luminance between two points on both sides, each between four pixels."""
    dx, dy = math.cos(math.radians(angle)) * height / 2, -math.sin(math.radians(angle)) * height / 2
    reach = math.ceil(height / 2) + 1
    at = around(premultiplied(px), RGBA, reach)
    size = 2 * reach + 1

    def light(ox: float, oy: float) -> Column:
        x0, y0 = math.floor(ox), math.floor(oy)
        tx, ty = ox - x0, oy - y0
        v = lambda c, i, j: F.get(f"n_{c}", F.lit((y0 + j + reach) * size + x0 + i + reach)).cast("double")
        mix = lambda p, q, t: p + (q - p) * t
        s = {c: mix(mix(v(c, 0, 0), v(c, 1, 0), tx), mix(v(c, 0, 1), v(c, 1, 1), tx), ty) for c in RGBA}
        return F.when(s["a"] > 0, (0.3 * s["r"] + 0.59 * s["g"] + 0.11 * s["b"]) / s["a"]).otherwise(0.0)

    at = at.select("x", "y", (F.col("a") / 255).cast("long").alias("a"), light(-dx, -dy).alias("l1"), light(dx, dy).alias("l2"))
    grey = F.rint(clamp(0.5 + amount / 100 * (F.col("l1") - F.col("l2"))) * 255).cast("long")
    return straight(at.select("x", "y", *(grey.alias(c) for c in RGB), "a"))


def deinterlace(px: DataFrame, odd: bool = True, interpolate: bool = True) -> DataFrame:
    """Rows of one field (the first row is odd) from the row above, or from both beside them."""
    at = haloed(premultiplied(px), 1)
    new = lambda c: (_beside(c, -1, "y") + _beside(c, 1, "y")) / 2 if interpolate else _beside(c, -1, "y").cast("double")
    gone = (F.col("y") % 2 == 0) == F.lit(odd)
    at = at.select("x", "y", "own", *(F.when(gone, new(c)).otherwise(F.col(c)).alias(c) for c in RGBA))
    return to_bytes(at.where("own"), {c: F.col(c) for c in RGBA})


def add_noise(px: DataFrame, amount: float = 40, mono: bool = False, seed: int = 1, gaussian: bool = False) -> DataFrame:
    """Noise by position: uniform, of up to half the amount (percent) each way, or normal, of a quarter of it as deviation."""

    def one(k: int) -> Column:
        u = lambda n: noise(F.col("x"), F.col("y"), seed * 7 + (0 if mono else 2 * k) + n)
        if not gaussian:
            return (u(0) - 0.5) * (amount / 100)
        return F.sqrt(-2 * F.log(F.greatest(F.lit(1e-12), u(0)))) * F.cos(2 * math.pi * u(1)) * (amount / 400)

    return points(px, lambda c: tuple(v + one(k) for k, v in enumerate(c)))


#: Width of the grains of each kind of mezzotint, and length of its runs.
GRAINS = {"fineDots": 1, "mediumDots": 2, "coarseDots": 3}
RUNS = {"shortLines": 4, "mediumLines": 10, "longLines": 24, "shortStrokes": 4, "mediumStrokes": 10, "longStrokes": 24}


def mezzotint(px: DataFrame, kind: str = "fineDots", seed: int = 1) -> DataFrame:
    """Each channel full or empty, by noise in grains, along rows, or along diagonals."""
    x, y = F.col("x"), F.col("y")

    def level(k: int) -> Column:
        if kind == "grainyDots":
            return 0.5 * noise(x, y, seed + k) + 0.5 * noise(F.floor(x / 2), F.floor(y / 2), seed + k + 9)
        if kind in GRAINS:
            return noise(F.floor(x / GRAINS[kind]), F.floor(y / GRAINS[kind]), seed + k)
        strokes = kind.endswith("Strokes")
        return noise(F.floor((x + y if strokes else x) / RUNS[kind]), x - y if strokes else y, seed + 3 * k)

    return points(px, lambda c: tuple((v > level(k)).cast("double") for k, v in enumerate(c)))


def ntsc(px: DataFrame) -> DataFrame:
    """Colour drawn in where it would leave the broadcast range around its luma."""
    r, g, b = (F.col(c) / 255 for c in RGB)
    at = px.withColumns({"luma": 0.299 * r + 0.587 * g + 0.114 * b, "chroma_i": 0.596 * r - 0.274 * g - 0.322 * b, "chroma_q": 0.211 * r - 0.523 * g + 0.312 * b})
    chroma, limit = F.sqrt(F.col("chroma_i") * F.col("chroma_i") + F.col("chroma_q") * F.col("chroma_q")), F.least(1.2 - F.col("luma"), F.col("luma") + 0.2)
    at = at.withColumn("k", F.when((chroma > limit) & (chroma > 0), F.greatest(F.lit(0.0), limit) / chroma).otherwise(1.0))
    y, i, q = F.col("luma"), F.col("chroma_i") * F.col("k"), F.col("chroma_q") * F.col("k")
    return points(at, lambda _: (y + 0.956 * i + 0.621 * q, y - 0.272 * i - 0.647 * q, y - 1.106 * i + 1.703 * q))


def hsb_hsl(px: DataFrame, read: str = "rgb", write: str = "hsb") -> DataFrame:
    """Channels read as one colour model and written as another, hue as 0...1."""

    def fn(c: tuple) -> tuple:
        h, s, v = c
        rgb = {"rgb": c, "hsb": hsb_rgb(h * 360, s * 100, v * 100), "hsl": hsl_rgb(h * 360, s, v)}[read]
        if write == "rgb":
            return rgb
        h, s, v = hsb(rgb) if write == "hsb" else hsl(rgb)
        return (h / 360, s / 100, v / 100) if write == "hsb" else (h / 360, s, v)

    return points(px, fn)


def offset(px: DataFrame, dx: int, dy: int, edge: str = "wrap") -> DataFrame:
    """Moves a raster; what comes free is wrapped, repeated from the border, or transparent. Its size is one aggregated row."""
    size = F.broadcast(px.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")))
    at = straight(px).join(size)
    if edge == "wrap":
        return at.select(F.pmod(F.col("x") + dx, F.col("w")).alias("x"), F.pmod(F.col("y") + dy, F.col("h")).alias("y"), *RGBA)
    # A border pixel stands for all places beyond it.
    to = lambda c, d, n: F.when(F.lit(edge == "repeat") & (F.col(c) == 0) & F.lit(d > 0), F.sequence(F.lit(0).cast("long"), F.least(F.lit(d).cast("long"), F.col(n) - 1))).when(F.lit(edge == "repeat") & (F.col(c) == F.col(n) - 1) & F.lit(d < 0), F.sequence(F.greatest(F.lit(0).cast("long"), F.col(c) + d), F.col(c))).otherwise(F.array(F.col(c) + d))
    moved = at.withColumn("nx", F.explode(to("x", dx, "w"))).withColumn("ny", F.explode(to("y", dy, "h"))).where("nx >= 0 and nx < w and ny >= 0 and ny < h").select(F.col("nx").alias("x"), F.col("ny").alias("y"), *RGBA)
    if edge == "repeat":
        return moved
    free = straight(px).select("x", "y").join(moved, ["x", "y"], "left")
    return free.select("x", "y", *(F.coalesce(c, F.lit(0)).alias(c) for c in RGBA))


def despeckle(px: DataFrame) -> DataFrame:
    """The median of 3 x 3 where luminance varies little there, fading out towards edges."""
    base = straight(px).withColumn("l", F.col("r") * 30 + F.col("g") * 59 + F.col("b") * 11)
    at = around(base, (*RGB, "l"), 1)
    k = F.greatest(F.lit(0.0), 1 - (F.array_max("n_l") - F.array_min("n_l")) / 25500 / 0.25)
    return straight(at.select("x", "y", *(F.rint(F.col(c) + (_median(c, 1) - F.col(c)) * k).cast("long").alias(c) for c in RGB), "a"))


def surface_blur(px: DataFrame, radius: int = 5, threshold: int = 15) -> DataFrame:
    """Each channel's mean over a square, weighted by alpha and by how near a value is to the pixel's own."""
    def run(block: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        h, w = len(ys), len(xs)
        own = block[:3, radius : radius + h, radius : radius + w]
        sums, weights = np.zeros(own.shape), np.zeros(own.shape)
        for j in range(2 * radius + 1):
            for i in range(2 * radius + 1):
                v = block[:3, j : j + h, i : i + w]
                weight = np.maximum(0.0, 1 - np.abs(v - own) / (2.5 * threshold)) * block[3, j : j + h, i : i + w]
                sums, weights = sums + v * weight, weights + weight
        new = np.where(weights > 0, np.rint(sums / np.where(weights > 0, weights, 1)), own)
        return np.concatenate([new, block[3:, radius : radius + h, radius : radius + w]])

    return straight(filtered(to_tiles(straight(px)), radius, run))


def wind(px: DataFrame, blast: bool = False, from_right: bool = True, seed: int = 1) -> DataFrame:
    """Brightness carried along a row and fading: a running maximum of levels weighed by their distance.

    A row is a window partition. Levels are compared by their logarithms, so
    that long rows do not overflow.
    """
    fade = F.lit(math.log(0.985)) if blast else F.log(0.93 + noise(F.lit(1), F.col("y"), seed) * 0.05)
    w = Window.partitionBy("y").orderBy(F.desc("x") if from_right else F.col("x")).rowsBetween(Window.unboundedPreceding, 0)
    k = -F.col("x") if from_right else F.col("x")
    at = straight(px).withColumn("fade", fade).withColumn("k", k)
    carried = lambda c: F.exp(F.max(F.when(F.col(c) > 0, F.log(F.col(c) * 1.0) - F.col("k") * F.col("fade"))).over(w) + F.col("k") * F.col("fade"))
    return straight(at.select("x", "y", *(F.rint(F.coalesce(F.greatest(F.col(c) * 1.0, carried(c)), F.lit(0.0))).cast("long").alias(c) for c in RGB), "a"))


def stagger(px: DataFrame, from_right: bool = True, seed: int = 1) -> DataFrame:
    """Rows moved by up to 11 pixels, each by its own noise; the border pixel repeats."""
    by = F.floor(noise(F.lit(0), F.col("y"), seed) * 12) * (-1 if from_right else 1)
    at = straight(px).join(F.broadcast(px.agg((F.max("x") + 1).alias("w")))).withColumn("by", by)
    to = F.when((F.col("x") == 0) & (F.col("by") > 0), F.sequence(F.lit(0).cast("long"), F.col("by"))).when((F.col("x") == F.col("w") - 1) & (F.col("by") < 0), F.sequence(F.col("x") + F.col("by"), F.col("x"))).otherwise(F.array(F.col("x") + F.col("by")))
    return at.withColumn("x", F.explode(to)).where("x >= 0 and x < w").select("x", "y", *RGBA)


def _lattice(x: Column, y: Column, seed: float) -> Column:
    """Noise between the corners of a lattice that repeats after 256 cells."""
    x0, y0 = F.floor(x), F.floor(y)
    ease = lambda t: t * t * (3 - 2 * t)
    corner = lambda i, j: noise(F.pmod(x0 + i, F.lit(256)), F.pmod(y0 + j, F.lit(256)), int(seed))
    mix = lambda p, q, t: p + (q - p) * t
    sx, sy = ease(x - x0), ease(y - y0)
    return mix(mix(corner(0, 0), corner(1, 0), sx), mix(corner(0, 1), corner(1, 1), sx), sy)


def fractal(x: Column, y: Column, scale: int, seed: int, sx: float = 1, sy: float = 1) -> Column:
    """Octaves of lattice noise, each half as large and half as strong as the last."""
    steps = [scale >> k for k in range(scale.bit_length())]
    total = sum(0.5 ** (k + 1) for k in range(len(steps)))
    return sum((_lattice(x * sx / s, y * sy / s, seed + s) * 0.5 ** (k + 1) for k, s in enumerate(steps)), F.lit(0.0)) / total


def _painted(px: DataFrame, t: Column, front: tuple, back: tuple) -> DataFrame:
    at = px.withColumn("t", t)
    return at.select("x", "y", *(F.rint((f + (b - f) * F.col("t")) * 255).cast("long").alias(c) for c, f, b in zip(RGB, front, back, strict=True)), F.lit(255).cast("long").alias("a"))


def clouds(px: DataFrame, front: tuple = (0, 0, 0), back: tuple = (1, 1, 1), seed: int = 1, contrast: bool = False) -> DataFrame:
    """Opaque clouds between two colours, whatever was there."""
    return _painted(px, clamp(0.5 + (fractal(F.col("x"), F.col("y"), 256, seed) - 0.5) * (4 if contrast else 2.2)), front, back)


def difference_clouds(px: DataFrame, front: tuple = (0, 0, 0), back: tuple = (1, 1, 1), seed: int = 1) -> DataFrame:
    """How far each channel is from clouds."""
    at = px.withColumn("t", clamp(0.5 + (fractal(F.col("x"), F.col("y"), 256, seed) - 0.5) * 2.2))
    return points(at, lambda c: tuple(F.abs(v - (f + (b - f) * F.col("t"))) for v, f, b in zip(c, front, back, strict=True)))


def fibers(px: DataFrame, variance: float = 16, strength: float = 4, front: tuple = (0, 0, 0), back: tuple = (1, 1, 1), seed: int = 1) -> DataFrame:
    """Noise drawn out along columns."""
    v = fractal(F.col("x"), F.col("y"), 32, seed, 4, 1 / (strength * (1 + 16 / variance)))
    return _painted(px, clamp(0.5 + (v - 0.5) * (1.5 + variance / 16)), front, back)
