"""Commands on whole documents as tables: canvas, clipboard, masks and merging, many documents at once.

``layers`` and ``pixels`` (doc, layer, x, y, r, g, b, a) are as ``compositing``
takes them; ``canvas`` has a row (doc, w, h) for each document. Targets are
tables (doc, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.compositing import composite, with_defaults
from pixelloom.operators.raster import half_up

PIXEL = ("doc", "layer", "x", "y", "r", "g", "b", "a")


def moved(pixels: DataFrame, by: DataFrame) -> DataFrame:
    """All pixels of a document moved by its (doc, dx, dy)."""
    return pixels.join(by.select("doc", "dx", "dy"), "doc").select("doc", "layer", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "r", "g", "b", "a")


def anchor_offset(anchor: str, dw: Column, dh: Column) -> tuple[Column, Column]:
    """How far the picture moves when the canvas grows by (dw, dh): topLeft, top, topRight, left, center, ..."""
    name = anchor.lower()
    col = 0 if "left" in name else 2 if "right" in name else 1
    row = 0 if name.startswith("top") else 2 if name.startswith("bottom") else 1
    return half_up(dw * col / 2), half_up(dh * row / 2)


def canvas_size(pixels: DataFrame, canvas: DataFrame, w: int, h: int, anchor: str = "center") -> tuple[DataFrame, DataFrame]:
    """(pixels, canvas) on a canvas of another size; what leaves it is kept beside it."""
    dx, dy = anchor_offset(anchor, w - F.col("w"), h - F.col("h"))
    return moved(pixels, canvas.select("doc", dx.alias("dx"), dy.alias("dy"))), canvas.select("doc", F.lit(w).cast("long").alias("w"), F.lit(h).cast("long").alias("h"))


def _tight(pixels: DataFrame) -> DataFrame:
    return pixels.where("a > 0").groupBy("doc").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def _recanvased(pixels: DataFrame, canvas: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[DataFrame, DataFrame]:
    """A canvas of that box; a document without visible pixels keeps its own."""
    box = canvas.join(_tight(pixels), "doc", "left").withColumn("any", F.col("x0").isNotNull())
    box = box.select("doc", *(F.when(F.col("any"), c).otherwise(o).alias(n) for n, c, o in (("bx0", x0, F.lit(0)), ("by0", y0, F.lit(0)), ("bx1", x1, F.col("w")), ("by1", y1, F.col("h")))))
    return moved(pixels, box.select("doc", (-F.col("bx0")).alias("dx"), (-F.col("by0")).alias("dy"))), box.select("doc", (F.col("bx1") - F.col("bx0")).alias("w"), (F.col("by1") - F.col("by0")).alias("h"))


def trim(pixels: DataFrame, canvas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The canvas shrunk to what is not transparent on it."""
    return _recanvased(pixels, canvas, F.greatest(F.lit(0), "x0"), F.greatest(F.lit(0), "y0"), F.least("x1", "w"), F.least("y1", "h"))


def reveal_all(pixels: DataFrame, canvas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The canvas grown to all that is not transparent, on it or beside it."""
    return _recanvased(pixels, canvas, F.least(F.lit(0), "x0"), F.least(F.lit(0), "y0"), F.greatest("x1", "w"), F.greatest("y1", "h"))


def copied(px: DataFrame, selection: DataFrame) -> DataFrame:
    """Pixels (doc, x, y, r, g, b, a) through a selection (doc, x, y, cov): alpha under its coverage; what keeps none is left out."""
    both = px.join(selection.select("doc", "x", "y", "cov"), ["doc", "x", "y"])
    return both.select("doc", "x", "y", "r", "g", "b", half_up(F.col("a") * F.col("cov") / 255).alias("a")).where("a > 0")


def copied_merged(layers: DataFrame, pixels: DataFrame, selection: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """The flattened documents through a selection."""
    return copied(composite(layers, pixels, masks), selection)


def pasted(pixels: DataFrame, clip: DataFrame, layer: int, dx: int = 0, dy: int = 0) -> DataFrame:
    """The pixels with those of the clipboard (doc, x, y, ...) as a new layer, moved."""
    new = clip.select("doc", F.lit(layer).cast("long").alias("layer"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "r", "g", "b", "a")
    return pixels.select(*PIXEL).unionByName(new)


def added_mask(pixels: DataFrame, targets: DataFrame, mode: str, selection: DataFrame | None = None) -> DataFrame:
    """Masks (doc, layer, x, y, cov) for target layers, over their own pixels.

    revealAll, hideAll, revealSelection, hideSelection (a document without a
    selection reveals or hides all), fromTransparency (the layer's alpha).
    """
    own = pixels.join(targets.select("doc", F.col("id").alias("layer")), ["doc", "layer"], "left_semi").select("doc", "layer", "x", "y", "a")
    if mode in ("revealAll", "hideAll") or selection is None and mode != "fromTransparency":
        return own.select("doc", "layer", "x", "y", F.lit(0 if mode.startswith("hide") else 255).cast("long").alias("cov"))
    if mode == "fromTransparency":
        return own.select("doc", "layer", "x", "y", F.col("a").alias("cov"))
    hide = mode == "hideSelection"
    some = selection.select("doc").distinct().withColumn("some", F.lit(True))
    both = own.join(some, "doc", "left").join(selection.select("doc", "x", "y", "cov"), ["doc", "x", "y"], "left")
    cov = F.coalesce("cov", F.lit(0))
    return both.select("doc", "layer", "x", "y", F.when(F.col("some").isNull(), 0 if hide else 255).otherwise(255 - cov if hide else cov).cast("long").alias("cov"))


def _alone(layers: DataFrame, pixels: DataFrame, masks: DataFrame | None, canvas: DataFrame, number: Column | int) -> DataFrame:
    """The pixels of a new layer: ``layers`` composited with nothing below, on the canvas; what is transparent is not stored."""
    boxes = canvas.select("doc", F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1"))
    boxes = boxes.join(layers.select("doc").distinct(), "doc", "left_semi")
    flat = composite(layers, pixels, masks, boxes).where("a > 0")
    return flat.withColumn("layer", F.lit(number).cast("long") if isinstance(number, int) else number)


def merged_down(layers: DataFrame, pixels: DataFrame, targets: DataFrame, canvas: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Pixels with each target and the layer below it, composited on their own, in place of that layer.

    Both are pixel or adjustment layers; one target a document. A target that is
    lowest among its siblings stays.
    """
    full = with_defaults(layers)
    upper = full.join(targets, ["doc", "id"]).select("doc", F.col("id").alias("u_id"), F.col("parent").alias("u_parent"), F.col("z").alias("u_z"))
    pair = full.join(upper, "doc").where(F.col("parent").eqNullSafe(F.col("u_parent")) & (F.col("u_z") > 0) & ((F.col("z") == F.col("u_z")) | (F.col("z") == F.col("u_z") - 1)))
    two = pair.select(*full.columns).withColumn("parent", F.lit(None).cast("long"))
    lower = pair.where("z < u_z").select("doc", F.col("id").alias("lower"))
    new = _alone(two, pixels, masks, canvas, 0).drop("layer").join(lower, "doc").withColumnRenamed("lower", "layer")
    gone = pair.select("doc", F.col("id").alias("layer"))
    return pixels.select(*PIXEL).join(gone, ["doc", "layer"], "left_anti").select(*PIXEL).unionByName(new.select(*PIXEL))


def merged_visible(layers: DataFrame, pixels: DataFrame, canvas: DataFrame, layer: int, masks: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Pixels with all that is visible as one new layer, in place of those layers; with ``keep`` beside them (a stamp).

    Layers hidden at the root, and what they hold, stay.
    """
    new = _alone(layers, pixels, masks, canvas, layer).select(*PIXEL)
    if keep:
        return pixels.select(*PIXEL).unionByName(new)
    full = with_defaults(layers)
    hidden = full.where("parent is null and not visible").select("doc", F.col("id").alias("layer"))
    return pixels.select(*PIXEL).join(hidden, ["doc", "layer"], "left_semi").select(*PIXEL).unionByName(new)
