"""Further tone and colour operators: curves of one channel, colour distance, automatic levels, two rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.blend import blend, clamp
from pixelloom.operators.raster import RGB, half_up, histogram, luminance, point

#: Share of the pixels that automatic levels leave out at each end.
AUTO_CLIP = 0.001


def byte(c: Column) -> Column:
    return half_up(255 * clamp(c))


def exposure(px: DataFrame, stops: float = 0.5, offset: float = 0.01, gamma: float = 1.2) -> DataFrame:
    """Gain and offset in linear light (power 2.2), then a gamma."""
    one = lambda v: byte(F.power(F.greatest(F.lit(0.0), F.power(v / 255, F.lit(2.2)) * 2**stops + offset), F.lit(1 / 2.2 / max(0.01, gamma))))
    return point(px, lambda *c: [one(v) for v in c])


def brightness_contrast(px: DataFrame, brightness: int = 30, contrast: int = 40) -> DataFrame:
    """Brightness as a gamma; contrast towards a smooth step (up) or half the range (down)."""

    def one(v: Column) -> Column:
        t = F.power(v / 255, F.lit(2 ** (-brightness / 150)))
        if contrast > 0:
            t = t + (t * t * (3 - 2 * t) - t) * (contrast / 100)
        elif contrast < 0:
            t = t + (0.5 + (t - 0.5) * 0.5 - t) * (-contrast / 50)
        return byte(t)

    return point(px, lambda *c: [one(v) for v in c])


def solarize(px: DataFrame) -> DataFrame:
    return point(px, lambda *c: [F.when(v > 127.5, 255 - v).otherwise(v) for v in c])


def gradient_map(px: DataFrame, dark: tuple = (10, 20, 80), light: tuple = (250, 240, 180), reverse: bool = False) -> DataFrame:
    """A two-colour ramp read at the rounded luminance."""
    level = half_up(luminance())
    t = (255 - level if reverse else level) / 255
    return point(px, lambda *_: [half_up(d + (h - d) * t) for d, h in zip(dark, light, strict=True)])


def monochrome_mixer(px: DataFrame, row: tuple = (40, 40, 20, 0)) -> DataFrame:
    """The red row of the channel mixer for all three channels."""
    return point(px, lambda r, g, b: [byte((r * row[0] + g * row[1] + b * row[2]) / 25500 + row[3] / 100)] * 3)


def color_mask(px: DataFrame, color: tuple = (120, 90, 60), fuzziness: float = 60) -> DataFrame:
    """Coverage by distance to a colour, falling to nothing at 1.5 times the fuzziness."""
    d = F.sqrt(sum((F.col(c) - k) * (F.col(c) - k) for c, k in zip(RGB, color, strict=True)).cast("double"))
    weight = F.when(d < 0.5, F.lit(1.0)).otherwise(F.lit(0.0)) if fuzziness <= 0 else clamp(1 - d / (fuzziness * 1.5))
    return px.select("x", "y", half_up(255 * weight).alias("cov"))


def clip_ranges(hist: DataFrame, clip: float = AUTO_CLIP) -> DataFrame:
    """(channel, lo, hi): occupied levels left after ``clip`` of the pixels goes at each end.

    ``hist`` has at most 256 rows a channel, so its windows stay small. Flat
    channels have the whole range.
    """
    w = Window.partitionBy("channel")
    run = hist.select("channel", "level", (F.sum("n").over(w) * clip).alias("cut"), F.sum("n").over(w.orderBy("level")).alias("up"), F.sum("n").over(w.orderBy(F.desc("level"))).alias("down"))
    out = run.groupBy("channel").agg(F.min(F.when(F.col("up") > F.col("cut"), F.col("level"))).alias("lo"), F.max(F.when(F.col("down") > F.col("cut"), F.col("level"))).alias("hi"))
    flat = F.col("hi") - F.col("lo") < 2
    return out.select("channel", F.when(flat, 0).otherwise(F.col("lo")).cast("long").alias("lo"), F.when(flat, 255).otherwise(F.col("hi")).cast("long").alias("hi"))


def _stretched(px: DataFrame, ranges: DataFrame, channel_of: dict[str, str]) -> DataFrame:
    """Levels with ranges from an aggregate: its one row is what is broadcast."""
    wide = ranges.agg(*(F.max(F.when(F.col("channel") == of, F.col(e))).alias(f"{c}_{e}") for c, of in channel_of.items() for e in ("lo", "hi")))
    one = lambda c: byte((F.col(c) - F.col(f"{c}_lo")) / F.greatest(F.lit(1), F.col(f"{c}_hi") - F.col(f"{c}_lo")))
    return point(px.crossJoin(F.broadcast(wide)), lambda *_: [one(c) for c in RGB])


def auto_tone(px: DataFrame, clip: float = AUTO_CLIP) -> DataFrame:
    """Each channel stretched over its own clip range."""
    return _stretched(px, clip_ranges(histogram(px), clip), {c: c for c in RGB})


def auto_contrast(px: DataFrame, clip: float = AUTO_CLIP) -> DataFrame:
    """All channels stretched over the clip range of their common histogram."""
    common = histogram(px).where("channel <> 'lum'").groupBy("level").agg(F.sum("n").alias("n")).withColumn("channel", F.lit("all"))
    return _stretched(px, clip_ranges(common, clip), dict.fromkeys(RGB, "all"))


def equalize(px: DataFrame) -> DataFrame:
    """Channels through the luminance distribution, whose first occupied level maps to 0.

    The table of 256 levels is an aggregate of one row, which is broadcast.
    """
    levels = px.sparkSession.range(256).select(F.col("id").alias("level"))
    dense = levels.join(histogram(px).where("channel = 'lum'"), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    dense = dense.select("level", F.sum("n").over(w.orderBy("level")).alias("acc"), F.sum("n").over(w).alias("total"), F.first(F.when(F.col("n") > 0, F.col("n")), ignorenulls=True).over(w.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("base"))
    value = F.when(F.col("total") == F.coalesce("base", F.lit(0)), F.col("level")).otherwise(half_up(F.greatest(F.lit(0), F.col("acc") - F.col("base")) / F.greatest(F.lit(1), F.col("total") - F.col("base")) * 255))
    lut = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("level", value.alias("v")))), lambda s: s["v"]).alias("lut"))
    return point(px.crossJoin(F.broadcast(lut)), lambda *c: [F.get(F.col("lut"), v.cast("int")) for v in c])


def color_stats(px: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of luminance and two opponent colours, from exact integer sums; of what is selected by half or more."""
    if selection is not None:
        px = px.join(selection.where("cov >= 128").select("x", "y"), ["x", "y"], "left_semi")
    lum, rg, yb = F.col("r") * 30 + F.col("g") * 59 + F.col("b") * 11, F.col("r") - F.col("g"), F.col("r") + F.col("g") - 2 * F.col("b")
    parts = {"lum": (lum, 25500.0), "rg": (rg, 255.0), "yb": (yb, 510.0)}
    sums = px.where("a <> 0").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s_{k}") for k, (v, _) in parts.items()), *(F.sum(v * v).alias(f"q_{k}") for k, (v, _) in parts.items()))
    mean = {k: F.col(f"s_{k}") / F.col("n") / scale for k, (_, scale) in parts.items()}
    dev = {k: F.sqrt(F.greatest(F.lit(1e-8), F.col(f"q_{k}") / F.col("n") / (scale * scale) - mean[k] * mean[k])) for k, (_, scale) in parts.items()}
    none = {"lum": (0.5, 0.25), "rg": (0.0, 0.1), "yb": (0.0, 0.1)}
    pick = lambda k, c, i: F.when(F.col("n") == 0, F.lit(none[k][i])).otherwise(c[k])
    return sums.select(*(F.round(pick(k, mean, 0), 9).alias(f"mean_{k}") for k in parts), *(F.round(pick(k, dev, 1), 9).alias(f"std_{k}") for k in parts))


def sample_color(px: DataFrame, x: int = 50, y: int = 5, size: int = 5) -> DataFrame:
    """Mean colour of a window, weighted by alpha; white where nothing covers."""
    half = max(0, (size - 1) // 2)
    seen = px.where(F.col("x").between(x - half, x + half) & F.col("y").between(y - half, y + half))
    sums = seen.agg(*(F.sum(F.col(c) * F.col("a")).alias(c) for c in RGB), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    return sums.select(*(F.when(F.col("a") <= 0, F.lit(1.0)).otherwise(F.col(c) / F.col("a") / 255).alias(c) for c in RGB))


def channel(name: str, prefix: str = "") -> Column:
    """r, g, b, alpha or gray of a raster as 0...1."""
    if name == "gray":
        return (0.3 * F.col(f"{prefix}r") + 0.59 * F.col(f"{prefix}g") + 0.11 * F.col(f"{prefix}b")) / 255
    return F.col(prefix + {"alpha": "a"}.get(name, name)) / 255


def _values(mode: str, b: tuple, s: tuple, scale: float, offset: float) -> tuple:
    if mode in ("add", "subtract"):
        sign = 1 if mode == "add" else -1
        return tuple(clamp((u + sign * v) / scale + offset / 255) for u, v in zip(b, s, strict=True))
    return blend(mode, b, s)


def _beside(px: DataFrame, source: DataFrame) -> DataFrame:
    """Pixels with those of ``source`` (absent ones empty) as s-columns: one equi-join."""
    other = source.select("x", "y", *(F.col(c).alias(f"s{c}") for c in (*RGB, "a")))
    return px.join(other, ["x", "y"], "left").fillna(0, [f"s{c}" for c in (*RGB, "a")])


def apply_image(px: DataFrame, source: DataFrame, mode: str = "multiply", pick: str = "rgb", opacity: float = 1.0, invert: bool = False, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A source raster or one of its channels blended onto pixels that are not transparent."""
    s = tuple(F.col(f"s{c}") / 255 for c in RGB) if pick == "rgb" else (channel(pick, "s"),) * 3
    s = tuple(1 - v for v in s) if invert else s
    b = tuple(F.col(c) / 255 for c in RGB)
    mixed = _values(mode, b, s, scale, offset)
    return point(_beside(px, source), lambda *_: [half_up((u + (clamp(m) - u) * opacity) * 255) for u, m in zip(b, mixed, strict=True)])


def calculations(px: DataFrame, source: DataFrame, first: str = "gray", second: str = "gray", mode: str = "multiply", opacity: float = 1.0, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A channel of ``source`` blended onto one of ``px``: a grey channel (x, y, cov)."""
    s, b = channel(first, "s"), channel(second)
    mixed = _values(mode, (b,) * 3, (s,) * 3, scale, offset)[0]
    return _beside(px, source).select("x", "y", byte(b + (clamp(mixed) - b) * opacity).alias("cov"))
