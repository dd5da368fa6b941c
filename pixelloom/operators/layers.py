"""Layer options while compositing: masks, fill, blend ranges, dissolve, clipping, adjustment layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.blend import Rgb, blend, clamp, composite, dissolve_noise, lum, source_over
from pixelloom.operators.raster import RGB, half_up

#: The neutral source value of the modes in which fill acts inside the blend.
SPECIAL_FILL_NEUTRAL = {
    "colorBurn": 1.0,
    "linearBurn": 1.0,
    "colorDodge": 0.0,
    "linearDodge": 0.0,
    "difference": 0.0,
    "vividLight": 0.5,
    "linearLight": 0.5,
    "hardMix": 0.5,
}


def mix(mode: str, b: Rgb, s: Rgb, fill: float) -> tuple[Rgb, float]:
    """The blended colour under ``fill``, and what of the fill is left to act as coverage."""
    if mode == "hardMix" and fill < 1:
        return tuple(clamp((u + fill * v - fill) / (1 - fill)) for u, v in zip(b, s, strict=True)), 1.0
    if mode in SPECIAL_FILL_NEUTRAL:
        n = SPECIAL_FILL_NEUTRAL[mode]
        return blend(mode, b, tuple(n + (v - n) * fill for v in s)), 1.0
    return blend(mode, b, s), fill


def ramp(v: Column, stops: tuple[float, float, float, float]) -> Column:
    """Trapezoid of a split slider: rises between the first two stops, falls between the last two."""
    b0, b1, w0, w1 = stops
    up = F.lit(1.0) if b1 == b0 else (v - b0) / (b1 - b0)
    down = F.lit(0.0) if w1 == w0 else 1 - (v - w0) / (w1 - w0)
    return F.when(v < b0, F.lit(0.0)).when(v < b1, up).when(v <= w0, F.lit(1.0)).when(v <= w1, down).otherwise(F.lit(0.0))


def blend_if(s: Rgb, b: Rgb, this: tuple, under: tuple) -> Column:
    """Weight by the luminance of the layer and of what lies under it."""
    return ramp(lum(s), this) * ramp(lum(b), under)


def _joined(below: DataFrame, layer: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Backdrop and layer columns of each pixel of either; the mask's coverage, nothing where absent."""
    new = layer.select("x", "y", *(F.col(c).alias(f"s{c}") for c in (*RGB, "a")))
    both = below.join(new, ["x", "y"], "full_outer").fillna(0)
    return both.withColumn("cov", F.lit(255)) if mask is None else both.join(mask, ["x", "y"], "left").fillna(0, ["cov"])


def _unit(prefix: str = "") -> Rgb:
    """Colours as 0...1; none where alpha is zero."""
    return tuple(F.when(F.col(f"{prefix}a") == 0, F.lit(0.0)).otherwise(F.col(prefix + c) / 255) for c in RGB)


def place(below: DataFrame, layer: DataFrame, mode: str = "normal", opacity: float = 1.0, fill: float = 1.0, mask: DataFrame | None = None, density: float = 1.0, ranges: tuple[tuple, tuple] | None = None, channels: str = "rgb") -> DataFrame:
    """A layer with its options over a raster.

    Coverage is alpha under the mask at its density, times opacity and fill;
    blend ranges weight it, dissolve turns it into all or nothing by the
    position's hash, and channels left out keep the backdrop.
    """
    b, s, ab = _unit(), _unit("s"), F.col("a") / 255
    mixed, left = mix("normal" if mode == "dissolve" else mode, b, s, fill)
    cover = F.col("sa") / 255 * (1 - density * (1 - F.col("cov") / 255)) * (opacity * left)
    if ranges:
        cover = cover * blend_if(s, b, *ranges)
    if mode == "dissolve":
        cover = F.when(dissolve_noise(F.col("x"), F.col("y")) < cover, F.lit(1.0)).otherwise(F.lit(0.0))
    both = _joined(below, layer, mask).withColumn("cover", cover)
    rgb, a = source_over(mixed, b, ab, s, F.col("cover"))
    rgb = tuple(v if c in channels else u for v, u, c in zip(rgb, b, RGB, strict=True))
    return both.select("x", "y", *(half_up(255 * v).alias(c) for v, c in zip(rgb, RGB, strict=True)), half_up(255 * a).alias("a"))


def clipped(below: DataFrame, base: DataFrame, top: DataFrame, base_mode: str = "normal", top_mode: str = "normal", opacity: float = 1.0, top_opacity: float = 1.0) -> DataFrame:
    """A clipping group: ``top`` blends with the opaque base colour, and the result has the base's alpha and mode."""
    extra = top.select("x", "y", *(F.col(c).alias(f"t{c}") for c in (*RGB, "a")))
    both = _joined(below, base, None).join(extra, ["x", "y"], "left").fillna(0)
    inner, _ = composite(top_mode, _unit("s"), F.lit(1.0), _unit("t"), F.col("ta") / 255 * top_opacity)
    both = both.select("x", "y", *RGB, "a", "sa", *(v.alias(f"m{c}") for v, c in zip(inner, RGB, strict=True)))
    rgb, a = composite(base_mode, _unit(), F.col("a") / 255, tuple(F.col(f"m{c}") for c in RGB), F.col("sa") / 255 * opacity)
    return both.select("x", "y", *(half_up(255 * v).alias(c) for v, c in zip(rgb, RGB, strict=True)), half_up(255 * a).alias("a"))


def adjust_layer(below: DataFrame, adjust: Callable[[DataFrame], DataFrame], mode: str = "normal", opacity: float = 1.0, fill: float = 1.0) -> DataFrame:
    """A row-local adjustment of the 8-bit backdrop as a layer: alpha stays, fill acts as opacity; no join."""
    held = [F.col(c).alias(f"b{c}") for c in RGB]
    new = adjust(below.select("x", "y", *RGB, "a").withColumn("x", F.struct("x", *held)))
    new = new.select("y", *RGB, "a", F.col("x.x").alias("x"), *(F.col(f"x.b{c}").alias(f"b{c}") for c in RGB))
    rgb, _ = composite(mode, tuple(F.col(f"b{c}") / 255 for c in RGB), F.lit(1.0), tuple(F.col(c) / 255 for c in RGB), F.lit(opacity * fill))
    return new.select("x", "y", *(F.when(F.col("a") == 0, F.col(f"b{c}")).otherwise(half_up(255 * v)).alias(c) for v, c in zip(rgb, RGB, strict=True)), "a")


def apply_mask(px: DataFrame, mask: DataFrame, density: float = 1.0) -> DataFrame:
    """A mask at its density taken into alpha."""
    both = px.join(mask, ["x", "y"], "left").fillna(0, ["cov"])
    return both.select("x", "y", *RGB, half_up(F.col("a") * (1 - density * (1 - F.col("cov") / 255))).alias("a"))


def clear(px: DataFrame, selection: DataFrame) -> DataFrame:
    """Takes what is selected out of alpha."""
    both = px.join(selection, ["x", "y"], "left").fillna(0, ["cov"])
    return both.select("x", "y", *RGB, half_up(F.col("a") * (255 - F.col("cov")) / 255).alias("a"))
