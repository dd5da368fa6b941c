"""Registered queries over document files that are written from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.compositing import composite, folded
from pixelloom.plans.compositing import _CELLS, _LAYER, Chain, _masks, _pixels, _rows, group, invert, px
from pixelloom.sources import psd
from pixelloom.streaming.histograms import shared_path

QUERIES = {}
ORACLE_SQL = {}

_TREE = (px(1, name="Ground"), group(10, px(2, name="Ümlaut ☃", mode="multiply", opacity=0.8, masked=True, density=0.6), px(3, name="Clipped", clipped=True, fill=0.4, mode="screen"), name="Group", opacity=0.6), invert(12, name="Invert", opacity=0.2))


def _read(spark: SparkSession, d: str) -> DataFrame:
    """What was parsed of files that were just written: a document a strip of the rasters."""
    pixels = _pixels(spark, d)
    masks = _masks(pixels).where("layer = 2")
    rows = _rows(_TREE)
    names = [c.split()[0] for c in _LAYER.split(", ")]
    one = spark.createDataFrame([(*(r[c] for c in names), r["name"]) for r in rows], f"{_LAYER}, name string")
    layers = pixels.select("doc").distinct().join(F.broadcast(one))  # the same few layers for each document
    boxes = pixels.groupBy("doc").agg(F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    folder = shared_path(spark, "documents")
    psd.save(psd.written(layers, pixels, composite(layers, pixels, masks, boxes), masks), folder)
    # The folder, not a pattern: Spark lists each file that a pattern matches by itself.
    return psd.parsed(psd.files(spark, folder)).withColumn("doc", F.regexp_extract("doc", r"/(\d+)\.psd$", 1))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return psd.documents(_read(spark, d)).select(F.col("doc").cast("long").alias("doc"), "width", "height", "depth", "error")


def _layers(spark: SparkSession, d: str) -> DataFrame:
    rows = psd.layers(_read(spark, d))
    above = rows.select(F.col("doc").alias("p_doc"), F.col("id").alias("p_id"), F.col("name").alias("group"))
    rows = rows.join(above, (F.col("doc") == F.col("p_doc")) & (F.col("parent") == F.col("p_id")), "left")
    return rows.select(F.col("doc").cast("long").alias("doc"), "name", "group", "z", "kind", "visible", F.floor(F.col("opacity") * 100 + 0.5).alias("opacity"), F.floor(F.col("fill") * 100 + 0.5).alias("fill"), "mode", "clipped", "masked")


def _values(spark: SparkSession, d: str) -> DataFrame:
    read = _read(spark, d)
    named = psd.pixels(read).join(psd.layers(read).select("doc", F.col("id").alias("layer"), "name"), ["doc", "layer"])
    return named.where("a > 0").select(F.col("doc").cast("long").alias("doc"), "name", "x", "y", "r", "g", "b", "a")


def _flat(spark: SparkSession, d: str) -> DataFrame:
    read = _read(spark, d)
    return folded(psd.layers(read), psd.tiles(read), psd.boxes(read)).select(F.col("doc").cast("long").alias("doc"), "x", "y", "r", "g", "b", "a")


QUERIES |= {"document_files": _sizes, "document_layers": _layers, "document_pixels": _values, "document_composite": _flat}
ORACLE_SQL["document_files"] = _CELLS + " select doc, (max(x) + 1)::int as width, (max(y) + 1)::int as height, 8 as depth, null::varchar as error from cells group by doc"
_ROWS = [("Ground", None, 0, "pixel", 100, 100, "normal", False, False), ("Group", None, 1, "group", 60, 100, "passThrough", False, False), ("Ümlaut ☃", "Group", 0, "pixel", 80, 100, "multiply", False, True), ("Clipped", "Group", 1, "pixel", 100, 40, "screen", True, False), ("Invert", None, 2, "adjustment", 20, 100, "normal", False, False)]
_literal = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
ORACLE_SQL["document_layers"] = _CELLS + f" select doc, v.name, v.grp as \"group\", z::bigint as z, kind, true as visible, opacity::bigint as opacity, fill::bigint as fill, mode, clipped, masked from (select distinct doc from cells), (values {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in _ROWS)}) v(name, grp, z, kind, opacity, fill, mode, clipped, masked)"
ORACLE_SQL["document_pixels"] = _CELLS + " " + " union all ".join(f"select doc, '{n}' as name, x, y, r, g, b, a from l{k} where a > 0" for k, n in ((1, "Ground"), (2, "Ümlaut ☃"), (3, "Clipped")))
_chain = Chain()
_done = _chain.stack(_TREE, "clear", "clear", "clear")
ORACLE_SQL["document_composite"] = _CELLS + _chain.sql + " select doc, x, y, " + ", ".join(f"cast(floor({_done}_{c} * 255 + 0.5) as bigint) as {c}" for c in "rgba") + f" from {_chain.last}"
