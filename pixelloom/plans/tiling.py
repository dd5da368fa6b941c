"""Registered operators over several tiles, of sparse rasters and of several documents, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelloom.operators import distance as D
from pixelloom.operators import selections as S
from pixelloom.operators import tiled as T
from pixelloom.plans.filters import _bytes, _straight
from pixelloom.plans.queries import PX
from pixelloom.sources.rasters import sparse_rasters, wide_raster

QUERIES = {}
ORACLE_SQL = {}

#: wide: the orders 750 pixels a row; wpm: premultiplied; sparse: two documents; spm and sst: all pixels of their bounds.
_WIDE = PX + """, wide as (select (y * 100 + x) % 750 as x, cast(floor((y * 100 + x) / 750) as bigint) as y, r, g, b, a from po),
  wpm as (select 0 as doc, x, y, r * a as r, g * a as g, b * a as b, a * 255 as a from wide)"""
_SPARSE = PX + """, sparse as (select cast(floor(y / 20) as bigint) % 2 as doc, x, cast(floor(floor(y / 20) / 2) as bigint) * 20 + y % 20 as y, r, g, b, a from pe where a <> 0),
  bx as (select doc, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from sparse group by doc),
  cells as (select doc, x0, x1, y0, y1, i as x, j as y from bx, range(0, 100) a(i), range(0, 100000) c(j) where i between x0 and x1 and j between y0 and y1),
  sst as (select c.*, coalesce(s.r, 0) as r, coalesce(s.g, 0) as g, coalesce(s.b, 0) as b, coalesce(s.a, 0) as a from cells c left join sparse s using (doc, x, y)),
  spm as (select doc, x, y, r * a as r, g * a as g, b * a as b, a * 255 as a from sst)"""


def _boxed(source: str, radius: int, passes: int, channels: str = "rgba") -> tuple[str, str]:
    """CTEs of box means by running frames; beyond the border its value counts as often as pixels are missing."""
    sql = ""
    for k in range(passes):
        for axis, other in (("x", "y"), ("y", "x")):
            name, over = f"{source}_{axis}{k}", (2 * radius + 1) ** 2 if axis == "y" else 1
            w = f"partition by doc, {other} order by {axis}"
            whole = f"({w} rows between unbounded preceding and unbounded following)"
            one = lambda c: f"(sum({c}) over ({w} rows between {radius} preceding and {radius} following) + greatest(0, {radius} - ({axis} - first_value({axis}) over {whole})) * first_value({c}) over {whole} + greatest(0, {radius} - (last_value({axis}) over {whole} - {axis})) * last_value({c}) over {whole}) / {over}::double as {c}"  # noqa: B023, E731
            sql, source = sql + f", {name} as (select doc, x, y, {', '.join(one(c) for c in channels)} from {source})", name
    return sql, source


def _wide(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(wide_raster(spark, d))
    ORACLE_SQL[name] = sql


def _sparse(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(sparse_rasters(spark, d))
    ORACLE_SQL[name] = sql


_keyed = lambda sql: sql.replace("select x, y,", "select doc, x, y,", 1)

_sql, _of = _boxed("wpm", 300, 1)
_wide("tiles_box_blur_300", lambda px: T.box_blur(px, 300), _WIDE + _sql + _bytes(_of))
_sql, _of = _boxed("wpm", T.box_radius(50), 3)
_wide("tiles_gaussian_50", lambda px: T.gaussian(px, 50), _WIDE + _sql + _bytes(_of))
_sql, _of = _boxed("spm", 20, 1)
_sparse("tiles_sparse_box_blur_20", lambda px: T.box_blur(px, 20, ("doc",), 64), _SPARSE + _sql + _keyed(_bytes(_of)))
_ring = "range(-2, 3) a(i), range(-2, 3) c(j)"
_near = f", nb as (select p.doc, p.x, p.y, q.r, q.g, q.b, q.a from sst p, {_ring} join sst q on q.doc = p.doc and q.x = greatest(p.x0, least(p.x1, p.x + i)) and q.y = greatest(p.y0, least(p.y1, p.y + j)))"
_sparse("tiles_sparse_median_2", lambda px: T.median(px, 2, ("doc",), 64), _SPARSE + _near + f", f as (select doc, x, y, {', '.join(f'list_sort(list({c}))[13] as {c}' for c in 'rgba')} from nb group by all)" + _keyed(_straight("f")))
_sparse("tiles_sparse_maximum_2", lambda px: T.extreme(px, 2, by=("doc",), tile=64), _SPARSE + _near.replace("q.r, q.g, q.b, q.a", "q.r * q.a as r, q.g * q.a as g, q.b * q.a as b, q.a * 255 as a") + f", f as (select doc, x, y, {', '.join(f'max({c}) as {c}' for c in 'rgba')} from nb group by all)" + _keyed(_bytes("f")))

# Selections of the wide raster: the pixels of a few red levels are selected, others in part or not at all.
_soft = lambda px: px.select("x", "y", F.when(F.col("r") < 4, 255).when(F.col("r") < 8, 100).otherwise(0).cast("long").alias("cov"))
_hard = lambda px: px.select("x", "y", F.when(F.col("r") < 60, 0).otherwise(255).cast("long").alias("cov"))
_half = lambda px: px.select("x", "y", F.when(F.col("x") * 2 + F.col("y") < 500, 255).when(F.col("x") * 2 + F.col("y") == 500, 90).otherwise(0).cast("long").alias("cov"))
_SOFT = _WIDE + ", sel as (select x, y, case when r < 4 then 255 when r < 8 then 100 else 0 end as cov from wide)"
_HARD = _WIDE + ", sel as (select x, y, case when r < 60 then 0 else 255 end as cov from wide)"
_HALF = _WIDE + ", sel as (select x, y, case when x * 2 + y < 500 then 255 when x * 2 + y = 500 then 90 else 0 end as cov from wide)"


def _closest(name: str, mark: str, of: str = "true") -> str:
    """CTE: the nearest marked pixel of each, by comparing with all of them."""
    return f", {name} as (select s.x, s.y, min([(s.x - m.x) * (s.x - m.x) + (s.y - m.y) * (s.y - m.y), m.x, m.y]) as n from sel s, sel m where m.cov {mark} and s.{of} group by all)".replace("s.true", "true")


_wide("select_expand_60", lambda px: D.expand(_soft(px), 60, tile=64), _SOFT + _closest("f", ">= 128") + " select s.x, s.y, case when n[1] <= 3600 then 255 else cov end::bigint as cov from sel s left join f using (x, y)")
_wide("select_contract_1_dense", lambda px: D.contract(_hard(px), 1, tile=64), _HARD + _closest("f", "< 128") + " select s.x, s.y, case when n[1] <= 1 then 0 else cov end::bigint as cov from sel s left join f using (x, y)")
_wide("select_border_31", lambda px: D.border(_half(px), 31, tile=64), _HALF + _closest("o", ">= 128", "cov < 128") + _closest("i", "< 128", "cov >= 128") + " select s.x, s.y, case when 4 * coalesce(o.n, i.n)[1] <= 961 then 255 else 0 end::bigint as cov from sel s left join o using (x, y) left join i using (x, y)")
_wide("select_nearest", lambda px: D.nearest(_soft(px), lambda cov: np.asarray(cov) >= 128, tile=64), _SOFT + _closest("f", ">= 128") + " select s.x, s.y, cov::bigint as cov, n[1]::bigint as d2, n[2]::bigint as nx, n[3]::bigint as ny from sel s left join f using (x, y)")
_wide(
    "select_signed_distance",
    lambda px: D.signed_distance(_half(px), tile=64).select("x", "y", F.floor(F.col("distance") * 1000 + 0.5).cast("long").alias("milli")),
    _HALF + _closest("o", ">= 128", "cov < 128") + _closest("i", "< 128", "cov >= 128")
    + """, v as (select s.x, s.y, s.cov / 255::double as a, coalesce(o.n, i.n) as n from sel s left join o using (x, y) left join i using (x, y)),
    q as (select v.*, coalesce(m.cov, 0) / 255::double as q from v left join sel m on m.x = n[2] and m.y = n[3])
    select x, y, cast(floor((case when a > 0 and a < 1 then 0.5::double - a when a >= 0.5 then (case when n is null then -1e6 else -(sqrt(n[1]) - (0.5::double - q)) end) when n is null then 1e6 else sqrt(n[1]) - (q - 0.5::double) end) * 1000 + 0.5::double) as bigint) as milli from q""",
)
_sql, _of = _boxed("cover", 133, 3, "c")
_wide("select_feather_400", lambda px: S.feather(_half(px), 400), _HALF + ", cover as (select 0 as doc, x, y, cov as c from sel)" + _sql + f" select x, y, cast(floor(least(255::double, greatest(0::double, c)) + 0.5) as bigint) as cov from {_of}")
