"""Rectangles, affine matrices, tiles and views as column expressions.

A rectangle is a struct (x0, y0, x1, y1), its end exclusive; a matrix a struct
(a, b, c, d, e, f) that maps (x, y) to (a x + c y + e, b x + d y + f).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pixels a side of a tile, and how tile coordinates are packed into one number.
TILE = 256
KEY_BIAS, KEY_STRIDE = 1 << 19, 1 << 20
#: Greatest sample of each kind, and its bytes.
SAMPLES = {"u8": (255, 1), "u16": (32768, 2), "f32": (1, 4)}
#: Limits of a view's zoom.
MIN_ZOOM, MAX_ZOOM = 0.001, 128.0


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*(_col(v).alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def is_empty(r: Column) -> Column:
    return (r["x1"] <= r["x0"]) | (r["y1"] <= r["y0"])


def area(r: Column) -> Column:
    return F.greatest(F.lit(0), r["x1"] - r["x0"]) * F.greatest(F.lit(0), r["y1"] - r["y0"])


def contains(r: Column, x, y) -> Column:
    return (x >= r["x0"]) & (x < r["x1"]) & (y >= r["y0"]) & (y < r["y1"])


def contains_rect(r: Column, inner: Column) -> Column:
    return is_empty(inner) | (inner["x0"] >= r["x0"]) & (inner["y0"] >= r["y0"]) & (inner["x1"] <= r["x1"]) & (inner["y1"] <= r["y1"])


def _unless_empty(r: Column, then: Column, otherwise: Column | None = None) -> Column:
    return F.when(is_empty(r), r if otherwise is None else otherwise).otherwise(then)


def intersect(a: Column, b: Column) -> Column:
    r = rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    zero = a["x0"] * 0
    return _unless_empty(r, r, rect(zero, zero, zero, zero))


def union(a: Column, b: Column) -> Column:
    both = rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def inflate(r: Column, n) -> Column:
    return _unless_empty(r, rect(r["x0"] - n, r["y0"] - n, r["x1"] + n, r["y1"] + n))


def shifted(r: Column, dx, dy) -> Column:
    return _unless_empty(r, rect(r["x0"] + dx, r["y0"] + dy, r["x1"] + dx, r["y1"] + dy))


def outer(r: Column) -> Column:
    """The least rectangle of whole pixels around it."""
    whole = rect(F.floor(r["x0"]), F.floor(r["y0"]), F.ceil(r["x1"]), F.ceil(r["y1"]))
    zero = F.lit(0).cast("long")
    return F.when(is_empty(r), rect(zero, zero, zero, zero)).otherwise(whole)


def tile_index(v: Column) -> Column:
    return F.floor(v / TILE)


def tile_key(tx: Column, ty: Column) -> Column:
    return (tx + KEY_BIAS) * KEY_STRIDE + ty + KEY_BIAS


def tiles_in(r: Column) -> Column:
    """Array of (tx, ty) of the tiles that a rectangle overlaps."""
    steps = lambda lo, hi: F.sequence(tile_index(r[lo]), tile_index(r[hi] - 1))
    all_ = F.flatten(F.transform(steps("y0", "y1"), lambda ty: F.transform(steps("x0", "x1"), lambda tx: F.struct(tx.alias("tx"), ty.alias("ty")))))
    return F.when(is_empty(r), F.array().cast("array<struct<tx:bigint,ty:bigint>>")).otherwise(all_)


def tile_bytes(channels: int, sample: str) -> int:
    return TILE * TILE * channels * SAMPLES[sample][1]


def mat(a, b, c, d, e, f) -> Column:
    return F.struct(*(_col(v).cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), "abcdef", strict=True)))


def translate(x, y) -> Column:
    return mat(1, 0, 0, 1, x, y)


def skew(hx, vy) -> Column:
    return mat(1, F.tan(_col(vy)), F.tan(_col(hx)), 1, 0, 0)


def apply(m: Column, x, y) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def multiply(m: Column, n: Column) -> Column:
    """``n`` first, then ``m``."""
    return mat(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"],
        m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"],
        m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def compose(m: Column, n: Column) -> Column:
    """``m`` first, then ``n``."""
    return multiply(n, m)


def about(m: Column, x, y) -> Column:
    """A transform about a pivot: the pivot stays where a linear map leaves it."""
    return compose(compose(translate(-_col(x), -_col(y)), m), translate(x, y))


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def inverse(m: Column) -> Column:
    """Null for a singular matrix."""
    det = F.when(determinant(m) != 0, determinant(m))
    inv = mat(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)
    return F.when(det.isNotNull(), inv)


def _linear_is_identity(m: Column, within: float) -> Column:
    return (F.abs(m["a"] - 1) < within) & (F.abs(m["b"]) < within) & (F.abs(m["c"]) < within) & (F.abs(m["d"] - 1) < within)


def is_identity(m: Column, within: float = 1e-9) -> Column:
    return _linear_is_identity(m, within) & (F.abs(m["e"]) < within) & (F.abs(m["f"]) < within)


def is_whole_shift(m: Column, within: float = 1e-6) -> Column:
    """Moves pixels by whole numbers only, so that nothing need be resampled."""
    whole = lambda v: F.abs(v - F.floor(v + 0.5)) < within
    return _linear_is_identity(m, within) & whole(m["e"]) & whole(m["f"])


def mapped_bounds(m: Column, r: Column) -> Column:
    """Bounds of the four mapped corners."""
    corners = [apply(m, r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = zip(*corners, strict=True)
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def rect_to_quad(r: Column, top_left: tuple, top_right: tuple, bottom_left: tuple) -> Column:
    """The matrix that maps three corners of a rectangle there; the identity for an empty side."""
    w, h = F.nullif(r["x1"] - r["x0"], F.lit(0)), F.nullif(r["y1"] - r["y0"], F.lit(0))
    a, b = ((p - q) / w for p, q in zip(top_right, top_left, strict=True))
    c, d = ((p - q) / h for p, q in zip(bottom_left, top_left, strict=True))
    made = mat(a, b, c, d, top_left[0] - a * r["x0"] - c * r["y0"], top_left[1] - b * r["x0"] - d * r["y0"])
    return F.when(w.isNull() | h.isNull(), mat(1, 0, 0, 1, 0, 0)).otherwise(made)


def decompose(m: Column) -> Column:
    """Struct (scale_x, scale_y, rotation, skew_x), angles in radians."""
    angle = F.atan2(m["b"], m["a"])
    c, d = m["c"] * F.cos(angle) + m["d"] * F.sin(angle), m["d"] * F.cos(angle) - m["c"] * F.sin(angle)
    sx = F.sqrt(m["a"] * m["a"] + m["b"] * m["b"]) * F.when(determinant(m) < 0, -1).otherwise(1)
    return F.struct(sx.alias("scale_x"), d.alias("scale_y"), angle.alias("rotation"), F.when(d == 0, 0.0).otherwise(F.atan2(c, d)).alias("skew_x"))


def _by_library(fn):
    """``fn`` of angles as the C library rounds it, which SQL engines call; Java's own differs in the last bit of some."""

    def run(angles: pa.Array) -> pa.Array:
        every, at = np.unique(angles.fill_null(0.0).to_numpy(zero_copy_only=False), return_inverse=True)
        made = np.array([fn(a) if math.isfinite(a) else math.nan for a in every.tolist()], float)
        return pa.array(made[at], pa.float64(), mask=angles.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, DoubleType())


_cos, _sin = _by_library(math.cos), _by_library(math.sin)


def view(zoom, cx, cy, rotation, width, height) -> Column:
    names = ("zoom", "cx", "cy", "rotation", "width", "height")
    return F.struct(*(_col(v).cast("double").alias(n) for v, n in zip((zoom, cx, cy, rotation, width, height), names, strict=True)))


def to_screen(v: Column) -> Column:
    """Document to screen: the centre goes to the middle, scaled, then turned."""
    c, s, z = _cos(v["rotation"]), _sin(v["rotation"]), v["zoom"]
    # The centre is turned before it is scaled, as the SQL rounds it.
    return mat(c * z, s * z, -s * z, c * z, v["width"] / 2 - z * (c * v["cx"] - s * v["cy"]), v["height"] / 2 - z * (s * v["cx"] + c * v["cy"]))


def _from_middle(v: Column, x, y) -> tuple[Column, Column]:
    """A screen point as an offset from the view's centre, turned back, not yet scaled."""
    c, s, dx, dy = _cos(v["rotation"]), _sin(v["rotation"]), x - v["width"] / 2, y - v["height"] / 2
    return dx * c + dy * s, dy * c - dx * s


def at_screen(v: Column, x, y) -> tuple[Column, Column]:
    """The document point under a screen point."""
    dx, dy = _from_middle(v, x, y)
    return v["cx"] + dx / v["zoom"], v["cy"] + dy / v["zoom"]


def visible(v: Column) -> Column:
    """Whole-pixel bounds of what a view shows: the turned window's half sides around the centre."""
    c, s = F.abs(_cos(v["rotation"])), F.abs(_sin(v["rotation"]))
    half_x, half_y = (v["width"] * c + v["height"] * s) / v["zoom"] / 2, (v["width"] * s + v["height"] * c) / v["zoom"] / 2
    return rect(F.floor(v["cx"] - half_x), F.floor(v["cy"] - half_y), F.ceil(v["cx"] + half_x), F.ceil(v["cy"] + half_y))


def zoom_at(v: Column, factor, x, y) -> Column:
    """The view zoomed so that the point under (x, y) stays there."""
    zoom = F.least(F.lit(MAX_ZOOM), F.greatest(F.lit(MIN_ZOOM), v["zoom"] * factor))
    by = F.least(F.lit(MAX_ZOOM) / v["zoom"], F.greatest(F.lit(MIN_ZOOM) / v["zoom"], _col(factor).cast("double")))
    dx, dy = (d / v["zoom"] for d in _from_middle(v, x, y))
    # The offset is scaled twice, as the SQL rounds it.
    return view(zoom, v["cx"] + dx - dx / by, v["cy"] + dy - dy / by, v["rotation"], v["width"], v["height"])


def fit(v: Column, width, height, pad: float = 32) -> Column:
    """The view that shows all of a document within a margin."""
    zoom = F.least(F.greatest(F.lit(1.0), v["width"] - pad) / width, F.greatest(F.lit(1.0), v["height"] - pad) / height)
    return view(F.least(F.lit(MAX_ZOOM), F.greatest(F.lit(MIN_ZOOM), zoom)), width / 2, height / 2, 0, v["width"], v["height"])


def mip_level(scale: Column, most: int) -> Column:
    """The smallest level that is not coarser than ``scale``."""
    level = F.floor(F.log2(1 / F.greatest(scale, F.lit(1e-6))))
    return F.when(scale >= 1, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), level))).cast("long")


def thumb_size(width: Column, height: Column, size: int) -> tuple[Column, Column]:
    """A box whose long side is ``size``."""
    k = size / F.greatest(width, height, F.lit(1))
    return tuple(F.greatest(F.lit(1), F.floor(v * k + 0.5)).cast("long") for v in (width, height))


def gradient_line(style: str, angle: float, scale: float, dx: float, dy: float, width: float, height: float) -> tuple[float, float, float, float]:
    """Ends of a fill's gradient line: through the centre at an angle in degrees, as long as the canvas seen along it."""
    ux, uy = math.cos(math.radians(angle)), -math.sin(math.radians(angle))
    half = (abs(width * ux) + abs(height * uy)) * scale / 200
    cx, cy = width / 2 + dx / 100 * width, height / 2 + dy / 100 * height
    begin = (cx - ux * half, cy - uy * half) if style == "linear" else (cx, cy)
    return (*begin, cx + ux * half, cy + uy * half)
