"""Adjustments that look at the surroundings: shadows and highlights, tone mapping.

What surrounds a pixel is its luminance (or its logarithm) under three box
means over tiles; it meets the pixels by one join. Histograms and means are
aggregates of a few rows, which are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.blend import clamp
from pixelloom.functions.color import hsl, hsl_rgb
from pixelloom.operators.raster import RGB, half_up, luminance
from pixelloom.operators.tiled import box_radius
from pixelloom.operators.tiles import TILE, box, from_tiles, to_tiles
from pixelloom.operators.tone import clip_ranges

#: Gaussians up to this are none.
SHARP = 0.3


def surrounded(px: DataFrame, value: Column, sigma: float, name: str, tile: int = TILE) -> DataFrame:
    """Adds ``value`` under a Gaussian of three boxes; pixels that do not count for colour count here."""
    if sigma <= SHARP:
        return px.withColumn(name, value)
    tiles = to_tiles(px.select("x", "y", value.cast("double").alias("v")), ("v",), tile=tile, dtype="float64")
    soft = from_tiles(box(tiles, box_radius(sigma), 3, 1, tile=tile, dtype="float64"), (name,), tile=tile, dtype="float64")
    return px.join(soft.withColumnsRenamed({"x": "s_x", "y": "s_y"}), (F.col("x") == F.col("s_x")) & (F.col("y") == F.col("s_y"))).drop("s_x", "s_y")


def _relit(target: Column, l: Column) -> tuple[Column, ...]:  # noqa: E741
    """Colours in the ratio of a new luminance to the old; grey where there was none."""
    return tuple(F.when(l > 1e-4, F.col(c) / 255 * (target / l)).otherwise(target) for c in RGB)


def _finished(px: DataFrame, new: tuple[Column, ...]) -> DataFrame:
    return px.select("x", "y", *(F.when(F.col("a") == 0, F.col(c)).otherwise(half_up(clamp(v) * 255)).cast("long").alias(c) for c, v in zip(RGB, new, strict=True)), "a")


def shadows_highlights(px: DataFrame, shadows: tuple[float, float, float] = (35, 50, 30), highlights: tuple[float, float, float] = (0, 50, 30), color: float = 20, midtones: float = 0, black: float = 0.01, white: float = 0.01, tile: int = TILE) -> DataFrame:
    """Lifts regions that are dark as a whole, lowers light ones; black and white stay.

    ``shadows`` and ``highlights`` are amount, tonal width (percent) and radius;
    ``color`` scales chroma where the tone moved; ``midtones`` bends an S-curve;
    ``black`` and ``white`` percent of the pixels are clipped at the ends.
    """
    at = px.select("x", "y", *RGB, "a").withColumn("l", luminance() / 255)
    v = F.col("l")
    for name, (amount, tone, radius), dark in (("s", shadows, True), ("h", highlights, False)):
        if amount > 0:
            at = surrounded(at, F.col("l"), radius / 2, name, tile)
            t = max(0.01, tone / 100)
            m = 1 - clamp(F.col(name) / t) if dark else clamp((F.col(name) - (1 - t)) / t)
            g = 1 + 3 * (amount / 100) * m * m
            v = F.pow(v, 1 / g) if dark else 1 - F.pow(1 - v, 1 / g)
    at = at.withColumn("v", v)
    if midtones:
        at = at.withColumn("v", F.col("v") + midtones / 100 * (F.col("v") * F.col("v") * (3 - 2 * F.col("v")) - F.col("v")))
    low, high = F.lit(0.0), F.lit(1.0)
    if black > 0 or white > 0:
        hist = at.where("a <> 0").groupBy(half_up(clamp(F.col("v")) * 255).alias("level")).agg(F.count("*").alias("n")).withColumn("channel", F.lit("v"))
        ends = clip_ranges(hist, black / 100).select(F.col("lo").alias("c_lo"), F.col("channel").alias("k")).join(clip_ranges(hist, white / 100).select(F.col("hi").alias("c_hi"), F.col("channel").alias("k")), "k").drop("k")
        at = at.join(F.broadcast(ends), F.lit(True), "left")  # one row, or none if all is transparent
        flat = F.coalesce((F.col("c_hi") - F.col("c_lo")) / 255 < 0.02, F.lit(True))
        low, high = F.when(flat, 0.0).otherwise(F.col("c_lo") / 255), F.when(flat, 1.0).otherwise(F.col("c_hi") / 255)
    at = at.withColumn("t", clamp((F.col("v") - low) / (high - low)))
    t, l = F.col("t"), F.col("l")  # noqa: E741
    rgb = _relit(t, l)
    moved = F.least(F.lit(1.0), F.abs(t - l) * 4)
    chroma = F.greatest(F.lit(0.0), 1 + color / 100 * moved - moved * 0.2 * F.when(t > l, 1).otherwise(0))
    at = at.select("x", "y", *RGB, "a", chroma.alias("k"), *(c.alias(f"n{n}") for n, c in zip(RGB, rgb)))
    grey = 0.3 * F.col("nr") + 0.59 * F.col("ng") + 0.11 * F.col("nb")
    return _finished(at, tuple(grey + (F.col(f"n{c}") - grey) * F.col("k") for c in RGB))


def hdr_toning(px: DataFrame, method: str = "localAdaptation", radius: float = 16, strength: float = 0.52, gamma: float = 1, exposure: float = 0, detail: float = 30, shadow: float = 0, highlight: float = 0, vibrance: float = 0, saturation: float = 20, tile: int = TILE) -> DataFrame:
    """Tone mapping by luminance: localAdaptation, equalize, highlightCompression or exposureGamma.

    Local adaptation takes the surroundings' logarithm nearer to its mean and
    raises what stands out from them.
    """
    at = px.select("x", "y", *RGB, "a").withColumn("l", luminance() / 255)
    l = F.col("l")  # noqa: E741
    if method == "localAdaptation":
        at = surrounded(at.withColumn("lg", F.log(l + 1e-3)), F.col("lg"), max(0.5, radius / 2), "base", tile)
        at = at.join(F.broadcast(at.agg(F.avg("base").alias("mean"))))  # one row
        v = F.exp(F.col("mean") + (F.col("base") - F.col("mean")) / (1 + max(0.1, strength)) + (F.col("lg") - F.col("base")) * (1 + detail / 100)) - 1e-3
    elif method == "equalize":
        at = at.withColumn("level", half_up(l * 255))
        counts = at.groupBy("level").agg(F.count(F.when(F.col("a") != 0, 1)).alias("n")).groupBy().agg(F.collect_list(F.struct("level", "n")).alias("levels"))  # 256 at most
        at = at.join(F.broadcast(counts))
        sums = lambda keep: F.aggregate("levels", F.lit(0).cast("long"), lambda acc, e: acc + F.when(keep(e), e["n"]).otherwise(0))
        v = sums(lambda e: e["level"] <= F.col("level")) / F.greatest(F.lit(1), sums(lambda e: F.lit(True)))
    else:
        v = l * 2 / (1 + l * 2) * 1.5 if method == "highlightCompression" else l
    at = at.withColumn("v", F.pow(clamp(v * (1 if method == "equalize" else 2.0**exposure)), F.lit(1 / max(0.1, gamma))))
    if shadow:
        at = at.withColumn("v", F.col("v") + shadow / 100 * 0.5 * F.pow(1 - F.col("v"), F.lit(3.0)))
    if highlight:
        at = at.withColumn("v", F.col("v") + highlight / 100 * 0.5 * F.pow(F.col("v"), F.lit(3.0)))
    at = at.withColumn("v", clamp(F.col("v")))
    at = at.select("x", "y", *RGB, "a", *(c.alias(f"n{n}") for n, c in zip(RGB, _relit(F.col("v"), l))))
    new = tuple(F.col(f"n{c}") for c in RGB)
    if vibrance or saturation:
        h, s, light = hsl(tuple(clamp(c) for c in new))
        at = at.withColumns({"h": h, "sat": s, "light": light})
        more = clamp(F.col("sat") * (1 + vibrance / 100 * (1 - F.col("sat"))) * (1 + saturation / 100))
        new = hsl_rgb(F.col("h"), more, F.col("light"))
    return _finished(at, new)
