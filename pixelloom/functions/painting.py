"""Scalar functions of painting: position noise, brush coverage, tone curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.blend import Rgb, clamp
from pixelloom.functions.color import hsl, hsl_rgb

MASK = 0xFFFFFFFF
#: Multipliers of x, y, seed and of the mixing steps of the two position hashes.
FILTER_HASH = (374761393, 668265263, 2246822519)
FILTER_MIX = ((13, 1274126177),)
BRUSH_HASH = (0x27D4EB2D, 0x165667B1, 0x9E3779B9)
BRUSH_MIX = ((15, 0x85EBCA6B), (13, 0xC2B2AE35))


def times32(v: Column, k: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in halves that fit 64 bits."""
    high = (v * F.lit(k >> 16)).bitwiseAND(0xFFFF) * 65536
    return (high + v * F.lit(k & 0xFFFF)).bitwiseAND(MASK)


def _position_hash(x: Column, y: Column, seed: int, by: tuple, mix: tuple) -> Column:
    at = [times32(v.cast("long").bitwiseAND(MASK), k) for v, k in zip((x, y, F.lit(seed)), by, strict=True)]
    h = at[0].bitwiseXOR(at[1]).bitwiseXOR(at[2])
    for shift, k in mix:
        h = times32(h.bitwiseXOR(F.shiftright(h, shift)), k)
    return h.bitwiseXOR(F.shiftright(h, 16)) / 4294967296


def noise(x: Column, y: Column, seed: int = 0) -> Column:
    """0...1 (exclusive) by position, the same in any crop: that of filters."""
    return _position_hash(x, y, seed, FILTER_HASH, FILTER_MIX)


def brush_noise(x: Column, y: Column, seed: int = 0) -> Column:
    return _position_hash(x, y, seed, BRUSH_HASH, BRUSH_MIX)


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = clamp((v - low) / (high - low))
    return t * t * (3 - 2 * t)


def _overlaid(p: Column, s: Column) -> Column:
    return F.when(p < 0.5, 2 * p * s).otherwise(1 - 2 * (1 - p) * (1 - s))


def dual_blend(mode: str, p: Column, s: Column) -> Column:
    """How the coverage of a second tip shapes that of the first."""
    one = F.lit(1.0)
    dodge = F.when(s >= 1, (p > 0).cast("double")).otherwise(F.least(one, p / F.when(s < 1, 1 - s)) * s)
    return {
        "multiply": p * s, "darken": F.least(p, s), "overlay": _overlaid(p, s), "colorDodge": dodge,
        "colorBurn": F.when(s <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (1 - p) / F.when(s > 0, s))),
        "linearBurn": F.greatest(F.lit(0.0), p + s - 1), "hardMix": F.when(p + s >= 1, p).otherwise(0.0), "linearHeight": clamp(p * (0.5 + s)),
    }[mode]


def texture_blend(mode: str, a: Column, t: Column, depth: float) -> Column:
    """How a texture's value shapes coverage, at a depth of 0...1."""
    v = {
        "multiply": a * t, "subtract": a - (1 - t), "darken": F.least(a, t), "overlay": _overlaid(a, t),
        "colorDodge": F.when(t >= 1, 1.0).otherwise(F.least(F.lit(1.0), a / F.when(t < 1, 1 - t))),
        "colorBurn": F.when(t <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (1 - a) / F.when(t > 0, t))),
        "linearBurn": a + t - 1, "hardMix": (a + t >= 1).cast("double"), "linearHeight": a * (0.5 + t), "height": a * t * 2,
    }[mode]
    return a + (clamp(v) - a) * min(1.0, max(0.0, depth))


def wet_edges(s: Column) -> Column:
    return s * (0.5 + 2 * s * (1 - s))


def tone(v: Column, dodge: bool, part: str, e: float) -> Column:
    """Dodge or burn of shadows, midtones or highlights with an exposure of 0...1."""
    if part == "midtones":
        return F.power(v, F.lit(1 / (1 + e) if dodge else 1 + e))
    if part == "highlights":
        return clamp(v * (1 + e / 3)) if dodge else v * (1 - e / 3)
    f = 1 - e / 3 if dodge else 1 + e / 3
    return f * v + (1 - f) if dodge else clamp(f * v - (f - 1))


def recolor(c: Rgb, paint: tuple[float, float, float], mode: str) -> Rgb:
    """A pixel with the paint's hue, saturation, both, or lightness."""
    own, new = hsl(c), hsl(tuple(F.lit(float(v)) for v in paint))
    take = {"hue": (1, 0, 0), "saturation": (0, 1, 0), "color": (1, 1, 0), "luminosity": (0, 0, 1)}[mode]
    return hsl_rgb(*(n if k else o for k, n, o in zip(take, new, own, strict=True)))


def pattern_index(width: int, height: int, scale: float, px: float, py: float, x: Column, y: Column) -> Column:
    """Number of the texel under a pixel of a tiled pattern, at a scale in percent and a phase."""
    at = lambda v, p, n: F.pmod(F.floor((v + 0.5 - p) / (scale / 100)), F.lit(n))
    return at(y, py, height) * width + at(x, px, width)
