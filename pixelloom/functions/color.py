"""Colour models as column expressions: channels 0...1, hue in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.blend import Rgb

#: sRGB to XYZ, divided by the D65 white point below.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _hue(c: Rgb) -> Column:
    r, g, b = c
    high, span = F.greatest(*c), F.greatest(*c) - F.least(*c)
    return F.when(span == 0, F.lit(0.0)).when(high == r, 60 * (((g - b) / span + 6) % 6)).when(high == g, 60 * ((b - r) / span + 2)).otherwise(60 * ((r - g) / span + 4))


def hsl(c: Rgb) -> Rgb:
    high, low = F.greatest(*c), F.least(*c)
    light = (high + low) / 2
    return _hue(c), F.when(high == low, F.lit(0.0)).otherwise((high - low) / (1 - F.abs(2 * light - 1))), light


def hsl_rgb(h: Column, s: Column, light: Column) -> Rgb:
    """Each channel is a clipped ramp of the hue circle, begun 0, 240 and 120 degrees on; hue 0 or more."""
    reach = s * F.least(light, 1 - light)
    ramp = lambda k: F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
    return tuple(light - reach * ramp((h / 30 + n) % 12) for n in (0, 8, 4))


def hsb(c: Rgb) -> Rgb:
    """Saturation and brightness in percent."""
    high = F.greatest(*c)
    return _hue(c), F.when(high == 0, F.lit(0.0)).otherwise((high - F.least(*c)) / high * 100), high * 100


def linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.power((v + 0.055) / 1.055, F.lit(2.4)))


def lab(c: Rgb) -> Rgb:
    lin = [linear(v) for v in c]
    x, y, z = (F.lit(0.0) + sum(k * v for k, v in zip(row, lin, strict=True)) / w for row, w in zip(XYZ, WHITE, strict=True))
    x, y, z = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116) for t in (x, y, z))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def cmyk(c: Rgb) -> tuple[Column, Column, Column, Column]:
    """The arithmetic without a profile, in percent."""
    high = F.greatest(*c)
    return (*(F.when(high <= 0, F.lit(0.0)).otherwise((high - v) / high * 100) for v in c), (1 - high) * 100)


def web_safe(v: Column) -> Column:
    """The nearest multiple of 51 of an 8-bit value."""
    return (F.floor(v / 51 + 0.5) * 51).cast("long")


def hex_code(c: Rgb) -> Column:
    """Six upper-case digits of three 8-bit values."""
    return F.concat(*(F.lpad(F.hex(v), 2, "0") for v in c))


def hex_rgb(code: Column) -> Column:
    """Struct (r, g, b) of a code of six or three digits, with or without ``#``; null for anything else."""
    digits = F.regexp_replace(F.trim(code), "^#", "")
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    part = lambda k: F.conv(F.substring(six, k, 2), 16, 10).cast("long") / 255
    return F.when(six.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def hsb_rgb(h: Column, s: Column, b: Column) -> Rgb:
    """From hue in degrees (0 or more), saturation and brightness in percent: clipped ramps of the hue circle."""
    ramp = lambda k: F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
    v = b / 100
    return tuple(v - v * (s / 100) * ramp((h / 60 + n) % 6) for n in (5, 3, 1))


def encoded(v: Column) -> Column:
    """A linear value as sRGB."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.power(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def relative_luminance(c: Rgb) -> Column:
    return 0.2126 * linear(c[0]) + 0.7152 * linear(c[1]) + 0.0722 * linear(c[2])


#: XYZ to linear sRGB.
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))


def lab_rgb(lightness: Column, a: Column, b: Column) -> Rgb:
    y = (lightness + 16) / 116
    back = lambda t: F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787)
    xyz = [back(t) * w for t, w in zip((y + a / 500, y, y - b / 200), WHITE, strict=True)]
    return tuple(F.least(F.lit(1.0), F.greatest(F.lit(0.0), encoded(F.lit(0.0) + sum(k * v for k, v in zip(row, xyz, strict=True))))) for row in TO_RGB)


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column) -> Rgb:
    return tuple(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - v / 100) * (1 - k / 100))) for v in (c, m, y))


def out_of_gamut(c: Rgb) -> Column:
    """Whether a colour does not come back from CMYK."""
    back = cmyk_rgb(*cmyk(c))
    return sum(F.abs(p - q) for p, q in zip(back, c, strict=True)) > 0.02


def is_web_safe(c: Rgb) -> Column:
    """Within one level of a multiple of 51 in each 8-bit channel."""
    near = [F.abs(F.floor(v * 255 / 51 + 0.5) * 51 - v * 255) < 1 for v in c]
    return near[0] & near[1] & near[2]


def hue_weight(h: Column, band: tuple[float, float, float, float]) -> Column:
    """Membership of a hue in a range: up to the second edge, flat to the third, down to the fourth, round the circle."""
    up, flat, down = ((e - band[0]) % 360 for e in band[1:])
    at = (h - band[0] + 360) % 360  # not pmod, which keeps more bits of some hues
    rise = F.lit(1.0) if up == 0 else at / up
    fall = F.lit(1.0) if down == flat else (down - at) / (down - flat)
    return F.when(at <= up, rise).when(at <= flat, 1.0).when(at <= down, fall).otherwise(0.0)


def luma(c: Rgb) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]
