"""Inverse mapping: each target pixel names a place in the source and meets the block of pixels there; its taps are summed in order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.painting import noise
from pixelloom.operators.raster import RGB, half_up
from pixelloom.operators.effects import position_hash
from pixelloom.operators.stencils import RGBA, premultiplied, to_bytes

#: How far the cubic kernels of image resampling, and that of distortions, swing over.
SHARPNESS = {"bicubic": -0.75, "bicubicSmoother": -0.4, "bicubicSharper": -1.0, "distort": -0.5}
#: Side of a block of the source, in pixels.
BLOCK = 64
#: Wavelengths of ripples.
RIPPLES = {"small": 8, "medium": 16, "large": 32}


def size_of(px: DataFrame) -> DataFrame:
    """One row (w, h), to be broadcast."""
    return F.broadcast(px.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")))


def _copies(c: str, n: str, edge: str, lo: int, hi: int) -> Column:
    """Where a source pixel also stands beyond the raster, so that all taps find it in place."""
    at, last = F.col(c), F.col(n) - 1
    if edge == "repeat":
        few, many = F.when(at == 0, lo - hi).otherwise(at), F.when(at == last, last + hi - lo).otherwise(at)
        return F.sequence(few.cast("long"), many.cast("long"))
    if edge == "wrap":
        first = F.ceil((lo - at) / F.col(n))
        return F.transform(F.sequence(first, F.floor((last + hi - at) / F.col(n))), lambda k: at + k * F.col(n))
    return F.array(at)


def _block(c: Column, n: str) -> Column:
    return F.floor(F.greatest(F.lit(0), F.least(F.col(n) - 1, c)) / BLOCK)


def _weights(d: np.ndarray, method: str, k: int) -> np.ndarray:
    """The share of the tap ``k`` pixels on, at a distance ``d`` past the first."""
    if method == "nearest":
        return np.ones(len(d))
    if method == "bilinear":
        return d if k else 1 - d
    a, t = SHARPNESS[method], np.abs(d - k)
    return np.where(t <= 1, (a + 2) * t * t * t - (a + 3) * t * t + 1, np.where(t < 2, a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a, 0.0))


def gather(at: DataFrame, px: DataFrame, method: str, edge: str = "repeat") -> DataFrame:
    """Premultiplied sums (x, y, r, g, b, a) of the source about (u, v) of each target ``at`` (x, y, u, v, w, h).

    u and v count from pixel centres. Beyond the source (w x h) the border
    repeats, the source wraps, or nothing is; targets without a tap are left out.

    A target is one row, sent to the block of the source that it falls on; a
    block's pixels and the few around it stand before its targets, so a task
    holds one block and one batch of targets, however many fall on it.
    """
    lo, hi = {"nearest": (0, 0), "bilinear": (0, 1)}.get(method, (-1, 2))
    base = {c: F.floor(F.col(c) + 0.5) if method == "nearest" else F.floor(c) for c in "uv"}
    size = {"u": F.col("w"), "v": F.col("h")}
    at = at.select("x", "y", *(base[c].alias(f"{c}0") for c in "uv"), *((F.col(c) - base[c]).alias(f"{c}d") for c in "uv"), "w", "h")
    if edge == "transparent":
        at = at.where(" and ".join(f"{c}0 >= {-hi} and {c}0 <= {n} - 1 - {lo}" for c, n in (("u", "w"), ("v", "h"))))
    place = {"repeat": lambda c: F.greatest(F.lit(-hi), F.least(size[c] - 1 - lo, F.col(f"{c}0"))), "wrap": lambda c: F.pmod(F.col(f"{c}0"), size[c]), "transparent": lambda c: F.col(f"{c}0")}[edge]
    at = at.withColumns({f"{c}0": place(c).cast("long") for c in "uv"})
    rows = at.select(_block(F.col("u0"), "w").alias("bx"), _block(F.col("v0"), "h").alias("by"), F.lit(1).alias("target"), "x", "y", F.col("u0").alias("i"), F.col("v0").alias("j"), F.col("ud").alias("p"), F.col("vd").alias("q"))

    source = px.join(size_of(px)).select("w", "h", F.col("x").alias("x_"), F.col("y").alias("y_"), *RGBA)
    for c, n in (("x", "w"), ("y", "h")):
        source = source.withColumn(c, F.explode(_copies(f"{c}_", n, edge, lo, hi))).withColumn(f"b{c}", F.explode(F.sequence(_block(F.col(c) - hi, n), _block(F.col(c) - lo, n))))
    source = source.select("bx", "by", F.lit(0).alias("target"), "x", "y", F.col("r").alias("i"), F.col("g").alias("j"), F.col("b").cast("double").alias("p"), F.col("a").cast("double").alias("q"))

    pad, side = hi - lo, BLOCK + 2 * (hi - lo)
    taps = [(j, i) for j in range(lo, hi + 1) for i in range(lo, hi + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, planes, there = None, np.zeros((len(RGBA), side * side)), np.zeros(side * side, bool)
        for b in batches:
            bx, by, target, x, y, i, j, p, q = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            ends = np.flatnonzero((np.diff(bx) != 0) | (np.diff(by) != 0) | (np.diff(target) != 0)) + 1
            for s, e in zip([0, *ends.tolist()], [*ends.tolist(), len(bx)]):
                if s == e:
                    continue
                if here != (bx[s], by[s]):
                    here = (bx[s], by[s])
                    planes[:], there[:] = 0, False
                left, top = here[0] * BLOCK - pad, here[1] * BLOCK - pad
                if not target[s]:
                    spot, a = (y[s:e] - top) * side + x[s:e] - left, q[s:e]
                    for k, c in enumerate((i, j, p)):
                        planes[k, spot] = c[s:e] * a
                    planes[3, spot], there[spot] = a * 255, True
                    continue
                spot = (j[s:e] - top) * side + i[s:e] - left
                wu, wv = ({k: _weights(d[s:e], method, k) for k in range(lo, hi + 1)} for d in (p, q))
                sums, some = np.zeros((len(RGBA), e - s)), np.zeros(e - s, bool)
                for dj, di in taps:
                    tap = spot + dj * side + di
                    sums += wu[di] * wv[dj] * planes[:, tap]
                    some |= there[tap]
                yield pa.RecordBatch.from_pydict({"x": x[s:e][some], "y": y[s:e][some]} | dict(zip(RGBA, sums[:, some])))

    met = rows.unionByName(source).repartition("bx", "by").sortWithinPartitions("bx", "by", "target")
    return met.mapInArrow(run, "x long, y long, " + ", ".join(f"{c} double" for c in RGBA))


def distort(px: DataFrame, to: Callable[..., tuple[Column, Column, Column]], edge: str = "repeat") -> DataFrame:
    """``to`` gives, of a pixel centre (x, y) in a raster (w, h), where to sample and whether to; else the pixel stays."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    at = px.join(size_of(px))
    u, v, moved = to(F.col("x") + 0.5, F.col("y") + 0.5, w, h)
    # Tested apart from the places: under a condition, what u and v share would be worked out anew each time.
    made = gather(at.where(moved).select("x", "y", (u - 0.5).alias("u"), (v - 0.5).alias("v"), "w", "h"), px, "distort", edge)
    made = made.withColumn("a", F.least(F.lit(65025.0), F.greatest(F.lit(0.0), F.col("a"))))
    stays = premultiplied(at.where(~F.coalesce(moved, F.lit(False)))).select("x", "y", *(F.col(c).cast("double").alias(c) for c in RGBA))
    return to_bytes(made.union(stays), {c: F.col(c) for c in RGBA})


def _oval(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """The ellipse within the raster: centre, radii, place in it, distance."""
    rx, ry = F.greatest(F.lit(1.0), w / 2), F.greatest(F.lit(1.0), h / 2)
    p, q = (x - w / 2) / rx, (y - h / 2) / ry
    return rx, ry, p, q, F.sqrt(p * p + q * q)


def pinch(px: DataFrame, amount: float = 50) -> DataFrame:
    def to(x, y, w, h):
        rx, ry, p, q, r = _oval(x, y, w, h)
        k = F.power(F.sin(math.pi / 2 * r), F.lit(-amount / 100))
        return w / 2 + p * k * rx, h / 2 + q * k * ry, (r < 1) & (r != 0)

    return distort(px, to)


def spherize(px: DataFrame, amount: float = 100, mode: str = "normal") -> DataFrame:
    a = amount / 100
    bent = lambda r: r + (F.asin(r) * (2 / math.pi) - r) * a if a >= 0 else r + (F.sin(r * math.pi / 2) - r) * -a

    def to(x, y, w, h):
        rx, ry, p, q, r = _oval(x, y, w, h)
        if mode == "h":
            return w / 2 + F.signum(p) * bent(F.abs(p)) * rx, y, F.abs(p) < 1
        if mode == "v":
            return x, h / 2 + F.signum(q) * bent(F.abs(q)) * ry, F.abs(q) < 1
        k = bent(r) / r
        return w / 2 + p * k * rx, h / 2 + q * k * ry, (r < 1) & (r != 0)

    return distort(px, to)


def twirl(px: DataFrame, angle: float = 50) -> DataFrame:
    def to(x, y, w, h):
        rx, ry, p, q, r = _oval(x, y, w, h)
        t = -math.radians(angle) * (1 - r) * (1 - r)
        return w / 2 + (p * F.cos(t) - q * F.sin(t)) * rx, h / 2 + (p * F.sin(t) + q * F.cos(t)) * ry, r < 1

    return distort(px, to)


def zigzag(px: DataFrame, amount: float = 10, ridges: int = 5, style: str = "pond") -> DataFrame:
    def to(x, y, w, h):
        rx, ry, p, q, r = _oval(x, y, w, h)
        wave = F.sin(2 * math.pi * ridges * r) * (1 - r)
        turn = F.atan2(q, p) + (wave * (amount / 100 * 0.35) if style != "out" else 0)
        far = r + (wave * (amount / 100 * 0.06) if style != "around" else 0)
        return w / 2 + F.cos(turn) * far * rx, h / 2 + F.sin(turn) * far * ry, (r < 1) & (r != 0)

    return distort(px, to)


def polar(px: DataFrame, to_polar: bool = True) -> DataFrame:
    def to(x, y, w, h):
        rx, ry, p, q, r = _oval(x, y, w, h)
        if to_polar:
            turn = F.atan2(p, -q) / (2 * math.pi)
            return F.when(turn < 0, turn + 1).otherwise(turn) * w, F.least(F.lit(1.0), r) * h, F.lit(True)
        turn = x / w * (2 * math.pi)
        return w / 2 + F.sin(turn) * (y / h) * rx, h / 2 - F.cos(turn) * (y / h) * ry, F.lit(True)

    return distort(px, to)


def ripple(px: DataFrame, amount: float = 100, size: str = "medium") -> DataFrame:
    n = RIPPLES[size]
    a = amount / 100 * (n / 4)

    def to(x, y, w, h):
        jx, jy = ((noise(F.floor(c / n), F.lit(k), 5) - 0.5) * 0.6 for k, c in enumerate((y, x)))
        return x + a * F.sin(2 * math.pi * y / n + jx), y + a * F.sin(2 * math.pi * x / n + jy), F.lit(True)

    return distort(px, to)


def shear(px: DataFrame, top: float = 0, middle: float = 25, bottom: float = 0, edge: str = "wrap") -> DataFrame:
    """Rows moved by a parabola through three offsets, in percent of the width."""

    def to(x, y, w, h):
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), y / h))
        off = top / 100 * (1 - t) * (1 - 2 * t) + 4 * (middle / 100) * t * (1 - t) + bottom / 100 * t * (2 * t - 1)
        return x - off * w, y, F.lit(True)

    return distort(px, to, edge)


#: Waves that are added up at most.
MOST_WAVES = 64


def waves(generators: int, wavelengths: tuple[float, float], amplitudes: tuple[float, float], seed: int) -> list[tuple[float, float, float, float]]:
    """(length, height, phase across, phase down) of each wave, by position noise."""
    low, high = wavelengths[0], max(wavelengths[0] + 1, wavelengths[1])
    least, most = amplitudes[0], max(amplitudes)
    one = lambda k, n: float(position_hash(np.array(k), np.array(n), seed))
    return [(low + (high - low) * one(k, 0), least + (most - least) * one(k, 1), one(k, 2), one(k, 3)) for k in range(min(MOST_WAVES, generators))]


def wave(px: DataFrame, generators: int = 5, wavelengths: tuple[float, float] = (10, 120), amplitudes: tuple[float, float] = (5, 35), scale: tuple[float, float] = (100, 100), kind: str = "sine", edge: str = "repeat", seed: int = 1) -> DataFrame:
    """The mean of random waves: rows move sideways, columns up and down; sine, triangle or square."""
    every = waves(generators, wavelengths, amplitudes, seed)

    def shape(t: Column) -> Column:
        f = t - F.floor(t)
        return {"triangle": 4 * F.abs(f - 0.5) - 1, "square": F.when(f < 0.5, 1.0).otherwise(-1.0)}.get(kind, F.sin(2 * math.pi * f))

    def to(x, y, w, h):
        across, down = (sum((shape(c / n + p[k]) * a for n, a, *p in every), F.lit(0.0)) / len(every) for k, c in enumerate((y, x)))
        return x + across * (scale[0] / 100), y + down * (scale[1] / 100), F.lit(True)

    return distort(px, to, edge)


def _to_straight(px: DataFrame) -> DataFrame:
    """Straight bytes, rounded half up, of premultiplied sums; pixels without alpha are not stored."""
    a = F.least(F.lit(65025.0), F.greatest(F.lit(0.0), F.col("a")))
    px = px.withColumn("sa", a).where("sa > 0")
    return px.select("x", "y", *(half_up(F.least(F.lit(1.0), F.least(F.col("sa"), F.greatest(F.lit(0.0), F.col(c))) / F.col("sa")) * 255).alias(c) for c in RGB), half_up(F.col("sa") / 255).alias("a"))


def resample(px: DataFrame, sx: float, sy: float, method: str = "bicubic") -> DataFrame:
    """A raster scaled by sx and sy; source pixels that do not exist are transparent."""
    size = px.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    grid = size.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("h") * sy) - 1))).repartition("y").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("w") * sx) - 1)))
    at = grid.select("x", "y", ((F.col("x") + 0.5) / sx - 0.5).alias("u"), ((F.col("y") + 0.5) / sy - 0.5).alias("v"), "w", "h")
    return _to_straight(gather(at, px, method, "transparent"))


def transform(px: DataFrame, matrix: tuple, method: str = "bicubic") -> DataFrame:
    """A raster under an affine matrix (a, b, c, d, e, f), cut to its own size; whole shifts move pixels as they are."""
    a, b, c, d, e, f = matrix
    size = size_of(px)
    if (a, b, c, d) == (1, 0, 0, 1) and e == int(e) and f == int(f):
        return px.join(size).select((F.col("x") + int(e)).alias("x"), (F.col("y") + int(f)).alias("y"), *RGBA, "w", "h").where("x >= 0 and y >= 0 and x < w and y < h and a > 0").drop("w", "h")
    det = a * d - b * c
    if not det:
        return px.where("false")
    x, y = F.col("x") + 0.5 - e, F.col("y") + 0.5 - f
    at = px.join(size).select("x", "y", ((d * x - c * y) / det - 0.5).alias("u"), ((a * y - b * x) / det - 0.5).alias("v"), "w", "h")
    return _to_straight(gather(at, px, method, "transparent"))
