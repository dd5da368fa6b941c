"""Blend functions and source-over compositing as column expressions on 0...1 values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _burn(b: Column, s: Column) -> Column:
    return F.when(b >= 1, F.lit(1.0)).when(s <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), (1 - b) / s))


def _dodge(b: Column, s: Column) -> Column:
    return F.when(b <= 0, F.lit(0.0)).when(s >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / (1 - s)))


def _hard(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s))


SEPARABLE: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda b, s: s,
    "darken": F.least,
    "multiply": lambda b, s: b * s,
    "colorBurn": _burn,
    "linearBurn": lambda b, s: F.greatest(F.lit(0.0), b + s - 1),
    "lighten": F.greatest,
    "screen": lambda b, s: b + s - b * s,
    "colorDodge": _dodge,
    "linearDodge": lambda b, s: F.least(F.lit(1.0), b + s),
    "overlay": lambda b, s: _hard(s, b),
    "softLight": lambda b, s: F.when(s <= 0.5, 2 * b * s + b * b * (1 - 2 * s)).otherwise(2 * b * (1 - s) + F.sqrt(b) * (2 * s - 1)),
    "hardLight": _hard,
    "vividLight": lambda b, s: F.when(s <= 0.5, _burn(b, 2 * s)).otherwise(_dodge(b, 2 * s - 1)),
    "linearLight": lambda b, s: clamp(b + 2 * s - 1),
    "pinLight": lambda b, s: F.when(s <= 0.5, F.least(b, 2 * s)).otherwise(F.greatest(b, 2 * s - 1)),
    "hardMix": lambda b, s: F.when(b + s >= 1, F.lit(1.0)).otherwise(F.lit(0.0)),
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
    "subtract": lambda b, s: F.greatest(F.lit(0.0), b - s),
    "divide": lambda b, s: F.when(s <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / s)),
}


def lum(c: Rgb) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def sat(c: Rgb) -> Column:
    return F.greatest(*c) - F.least(*c)


def set_sat(c: Rgb, s: Column) -> Rgb:
    """The least channel to 0, the greatest to s, the middle one in proportion."""
    low, span = F.least(*c), sat(c)
    return tuple(F.when(span <= 0, F.lit(0.0)).otherwise((v - low) * s / span) for v in c)


def set_lum(c: Rgb, to: Column) -> Rgb:
    """Shifts to a luminance and clips about it into gamut, low side first."""
    c = tuple(v + (to - lum(c)) for v in c)
    level, low, high = lum(c), F.least(*c), F.greatest(*c)
    c = tuple(F.when((low < 0) & (level > low), level + (v - level) * level / (level - low)).otherwise(v) for v in c)
    return tuple(F.when((high > 1) & (high > level), level + (v - level) * (1 - level) / (high - level)).otherwise(v) for v in c)


#: Modes that give one colour the luminance of another: (colour, whose luminance).
LUMINANCE_MODES: dict[str, Callable[[Rgb, Rgb], tuple[Rgb, Column]]] = {
    "hue": lambda b, s: (set_sat(s, sat(b)), lum(b)),
    "saturation": lambda b, s: (set_sat(b, sat(s)), lum(b)),
    "color": lambda b, s: (s, lum(b)),
    "luminosity": lambda b, s: (b, lum(s)),
}
NON_SEPARABLE: dict[str, Callable[[Rgb, Rgb], Rgb]] = {
    **{m: lambda b, s, f=f: set_lum(*f(b, s)) for m, f in LUMINANCE_MODES.items()},
    "darkerColor": lambda b, s: tuple(F.when(lum(s) < lum(b), v).otherwise(u) for u, v in zip(b, s, strict=True)),
    "lighterColor": lambda b, s: tuple(F.when(lum(s) > lum(b), v).otherwise(u) for u, v in zip(b, s, strict=True)),
}
MODES = [*SEPARABLE, *NON_SEPARABLE]


def blend_frame(df: DataFrame, mode: str, b: Rgb, s: Rgb) -> tuple[DataFrame, Rgb]:
    """As ``blend``, but the luminance modes go step by step through columns of ``df``.

    As one expression they would repeat each step several times in the next;
    Catalyst keeps projections apart whose columns are used more than once.
    """
    if mode not in LUMINANCE_MODES:
        return df, blend(mode, b, s)
    color, to = LUMINANCE_MODES[mode](b, s)
    m = tuple(F.col(f"m{k}") for k in range(3))
    each = lambda f: {f"m{k}": f(v) for k, v in enumerate(m)}
    df = df.withColumns({f"m{k}": v for k, v in enumerate(color)} | {"m_to": to})
    df = df.withColumn("m_lum", lum(m))
    df = df.withColumns(each(lambda v: v + (F.col("m_to") - F.col("m_lum"))))
    df = df.withColumns({"m_lum": lum(m), "m_low": F.least(*m), "m_high": F.greatest(*m)})
    level, low, high = F.col("m_lum"), F.col("m_low"), F.col("m_high")
    df = df.withColumns(each(lambda v: F.when((low < 0) & (level > low), level + (v - level) * level / (level - low)).otherwise(v)))
    return df.withColumns(each(lambda v: F.when((high > 1) & (high > level), level + (v - level) * (1 - level) / (high - level)).otherwise(v))), m


def blend(mode: str, b: Rgb, s: Rgb) -> Rgb:
    """The mode is chosen while the plan is built; rows see one closed expression."""
    if mode in SEPARABLE:
        return tuple(SEPARABLE[mode](u, v) for u, v in zip(b, s, strict=True))
    return NON_SEPARABLE[mode](b, s)


def source_over(mixed: Rgb, b: Rgb, ab: Column, s: Rgb, as_: Column) -> tuple[Rgb, Column]:
    """Source over backdrop with a colour that is already blended; transparent black where nothing covers."""
    out = as_ + ab * (1 - as_)
    rgb = tuple(F.when(out <= 0, F.lit(0.0)).otherwise(((1 - as_) * ab * u + as_ * ((1 - ab) * v + ab * m)) / out) for u, v, m in zip(b, s, mixed, strict=True))
    return rgb, out


def composite(mode: str, b: Rgb, ab: Column, s: Rgb, as_: Column) -> tuple[Rgb, Column]:
    """Source over backdrop with a blend mode."""
    return source_over(blend(mode, b, s), b, ab, s, as_)


def dissolve_noise(x: Column, y: Column) -> Column:
    """Position hash in 0...1: a product in double precision, wrapped to 32 bits."""
    # The multipliers and shifts.
    mask = F.lit(0xFFFFFFFF)
    h = (x * 374761393 + y * 668265263).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 13))
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    h = (signed.cast("double") * 1274126177.0).cast("long").bitwiseAND(mask)
    return h.bitwiseXOR(F.shiftright(h, 16)) / 4294967296.0
