"""Registered commands on documents and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import commands as C
from pixelloom.plans.compositing import _CELLS, _LAYER, Chain, _masks, _pixels, _rows, invert, px

QUERIES = {}
ORACLE_SQL = {}

_FLAT = (px(1), px(2, mode="multiply", opacity=0.8, masked=True), px(3, mode="screen", fill=0.6), invert(12, opacity=0.3), px(2, visible=False) | {"id": 4})


def _layers(spark: SparkSession, pixels: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in _LAYER.split(", ")]
    one = spark.createDataFrame([tuple(r[c] for c in names) for r in _rows(_FLAT)], _LAYER)
    return pixels.select("doc").distinct().join(F.broadcast(one))  # the same few layers for each document


def _canvas(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("doc").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _selection(pixels: DataFrame) -> DataFrame:
    """A ramp, in documents of even numbers."""
    return pixels.where("doc % 2 = 0").select("doc", "x", "y").distinct().select("doc", "x", "y", ((F.col("x") * 3 + F.col("y") * 7) % 256).alias("cov"))


def _add(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(spark, _pixels(spark, d))
    ORACLE_SQL[name] = _CELLS + sql


_ALL = " px as (" + " union all ".join(f"select doc, {k}::bigint as layer, x, y, r, g, b, a from l{k}" for k in (1, 2, 3)) + "), canvas as (select doc, max(x) + 1 as w, max(y) + 1 as h from px group by doc)"
_COLS = "layer, r, g, b, a"
_both = lambda made: made[0].join(made[1], "doc")
_add("canvas_size", lambda spark, p: _both(C.canvas_size(p, _canvas(p), 131, 12, "bottomRight")), f",{_ALL} select doc, layer, x + 131 - w as x, y + 12 - h as y, r, g, b, a, 131::bigint as w, 12::bigint as h from px join canvas using (doc)")
_add("canvas_size_centre", lambda spark, p: _both(C.canvas_size(p, _canvas(p), 131, 12)), f",{_ALL} select doc, layer, x + floor((131 - w) / 2::double + 0.5)::bigint as x, y + floor((12 - h) / 2::double + 0.5)::bigint as y, r, g, b, a, 131::bigint as w, 12::bigint as h from px join canvas using (doc)")
_shift = lambda p: p.select("doc", "layer", (F.col("x") - 30).alias("x"), (F.col("y") + 6).alias("y"), "r", "g", "b", "a")
_SHIFT = f",{_ALL}, sh as (select doc, layer, x - 30 as x, y + 6 as y, r, g, b, a from px), t as (select doc, w, h, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from sh join canvas using (doc) where a > 0 group by doc, w, h)"
_add("canvas_trim", lambda spark, p: _both(C.trim(_shift(p), _canvas(p))), _SHIFT + ", e as (select doc, greatest(0, x0) as x0, greatest(0, y0) as y0, least(w, x1) as x1, least(h, y1) as y1 from t) select doc, layer, x - x0 as x, y - y0 as y, r, g, b, a, x1 - x0 as w, y1 - y0 as h from sh join e using (doc)")
_add("canvas_reveal_all", lambda spark, p: _both(C.reveal_all(_shift(p), _canvas(p))), _SHIFT + ", e as (select doc, least(0, x0) as x0, least(0, y0) as y0, greatest(w, x1) as x1, greatest(h, y1) as y1 from t) select doc, layer, x - x0 as x, y - y0 as y, r, g, b, a, x1 - x0 as w, y1 - y0 as h from sh join e using (doc)")
_SEL = ", sel as (select distinct doc, x, y, (x * 3 + y * 7) % 256 as cov from every where doc % 2 = 0)"
_add("clipboard_copy_paste", lambda spark, p: C.pasted(p.where("layer <> 3"), C.copied(p.where("layer = 3"), _selection(p)), 9, 4, -2).where("layer = 9"), f",{_ALL}{_SEL}, c as (select doc, 9::bigint as layer, x + 4 as x, y - 2 as y, r, g, b, cast(floor(a * cov / 255::double + 0.5) as bigint) as a from px join sel using (doc, x, y) where layer = 3) select * from c where a > 0")


def _flat_sql(tree: tuple, source: str) -> tuple[str, str]:
    chain = Chain()
    done = chain.stack(tree, "clear", "clear", "clear")
    return chain.sql, "select doc, x, y, " + ", ".join(f"cast(floor({done}_{c} * 255 + 0.5) as bigint) as {c}" for c in "rgba") + f" from {chain.last}"


_chain, _flat = _flat_sql(_FLAT[:4], "")
_add("clipboard_copy_merged", lambda spark, p: C.copied_merged(_layers(spark, p), p, _selection(p), _masks(p)), f"{_chain}, f as ({_flat}){_SEL}, c as (select doc, x, y, r, g, b, cast(floor(a * cov / 255::double + 0.5) as bigint) as a from f join sel using (doc, x, y)) select * from c where a > 0")
_add("merge_visible", lambda spark, p: C.merged_visible(_layers(spark, p), p.unionByName(p.where("layer = 1").withColumn("layer", F.lit(4).cast("long"))), _canvas(p), 20, _masks(p)), f"{_chain}, f as ({_flat}) select doc, 20::bigint as layer, x, y, r, g, b, a from f where a > 0 union all select doc, 4, x, y, r, g, b, a from l1")
_add("stamp_visible", lambda spark, p: C.merged_visible(_layers(spark, p), p, _canvas(p), 20, _masks(p), keep=True).where("layer <> 1"), f"{_chain}, f as ({_flat}) select doc, 20::bigint as layer, x, y, r, g, b, a from f where a > 0 " + " ".join(f"union all select doc, {k}, x, y, r, g, b, a from l{k}" for k in (2, 3)))
_two, _pair = _flat_sql(_FLAT[1:3], "")
_add("merge_down", lambda spark, p: C.merged_down(_layers(spark, p), p, p.select("doc", F.lit(3).cast("long").alias("id")).distinct(), _canvas(p), _masks(p)), f"{_two}, f as ({_pair}) select doc, 2::bigint as layer, x, y, r, g, b, a from f where a > 0 union all select doc, 1, x, y, r, g, b, a from l1")
for _mode, _cov in (("revealAll", "255"), ("hideAll", "0"), ("fromTransparency", "a"), ("revealSelection", "case when doc % 2 = 0 then coalesce(cov, 0) else 255 end"), ("hideSelection", "case when doc % 2 = 0 then 255 - coalesce(cov, 0) else 0 end")):
    _add(f"mask_{_mode}", lambda spark, p, mode=_mode: C.added_mask(p, p.select("doc", F.lit(3).cast("long").alias("id")).distinct(), mode, _selection(p)), f"{_SEL} select doc, 3::bigint as layer, x, y, ({_cov})::bigint as cov from l3 left join sel using (doc, x, y)")
