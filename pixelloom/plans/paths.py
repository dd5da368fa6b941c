"""Registered paths and their SQL: crossings, windings, intervals and overlaps with pixels, each by its rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import paths as P
from pixelloom.operators import tracing as T
from pixelloom.plans.queries import PX
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Some events as corners of three crossing outlines in each of four documents."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id % 20 = 3")
    return e.select((F.col("user_id") % 4).alias("doc"), (F.floor(F.col("event_id") / 20) % 3).alias("shape"), F.col("event_id").alias("n"), (F.col("event_id") * 13 % 97 + F.pmod(F.col("user_id"), F.lit(8)) / 8 - 4).cast("double").alias("x"), (F.floor("value") % 53 + F.pmod(F.col("event_id"), F.lit(16)) / 16 - 2).cast("double").alias("y"))


def _shapes(points: DataFrame, *ops: str, rule: str = "nonzero") -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ops)), (F.col("shape") + 1).cast("int"))
    return points.select("doc", "shape").distinct().select("doc", "shape", F.lit(True).alias("closed"), op.alias("op"), F.lit(rule).alias("rule"))


_BOX = "0::bigint as x0, 0::bigint as y0, 90::bigint as x1, 50::bigint as y1"


def _boxes(points: DataFrame) -> DataFrame:
    return points.select("doc").distinct().select("doc", *(F.lit(v).cast("long").alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 90), ("y1", 50))))


_POINTS = """with points as (select user_id % 4 as doc, cast(floor(event_id / 20) as bigint) % 3 as shape, event_id as n, (event_id * 13 % 97 + (user_id % 8) / 8::double - 4)::double as x,
    (cast(floor(value) as bigint) % 53 + (event_id % 16) / 16::double - 2)::double as y from events where event_id % 20 = 3),
  e as (select doc, shape, x as x0, y as y0, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1, count(*) over (partition by doc, shape) as knots from points window w as (partition by doc, shape order by n)),
  edges as (select * from e where knots > 1)"""


def _covered(sub: int, inside: str, evenodd: bool = False) -> str:
    """CTE cover (doc, x, y, cover): the overlap of each pixel with the inner intervals of its lines; ``inside`` of the shapes a, b, c."""
    held = "(winding % 2) <> 0" if evenodd else "winding <> 0"
    was = held.replace("winding", "(winding - turn)")
    return f""", lines as (select py, k, py + (k + 0.5) / {sub}::double as y from range(0, 50) a(py), range(0, {sub}) b(k)),
  crossed as (select doc, shape, py, k, case when y1 > y0 then x0 + (y - y0) / (y1 - y0) * (x1 - x0) else x1 + (y - y1) / (y0 - y1) * (x0 - x1) end as x, case when y1 > y0 then 1 else -1 end as turn
    from edges join lines on y >= least(y0, y1) and y < greatest(y0, y1)),
  wound as (select *, sum(turn) over (partition by doc, py, k, shape order by x rows unbounded preceding) as winding from crossed),
  events_ as (select doc, py, k, shape, x, case when {held} then 1 else -1 end as toggle from wound where ({held}) <> ({was})),
  started as (select doc, py, k, -1 as shape, -1e9::double as x, 0 as toggle from (select distinct doc from points), lines union all select * from events_),
  flags as (select doc, py, k, x, lead(x) over w as next, {', '.join(f'coalesce(sum(toggle) filter (where shape = {s}) over w, 0) > 0 as {n}' for s, n in enumerate('abc'))} from started window w as (partition by doc, py, k order by x, shape rows unbounded preceding)),
  spans as (select doc, py, greatest(x, 0) as xa, least(coalesce(next, 1e9), 90) as xb from flags where {inside}),
  cover as (select doc, i as x, py as y, sum(least(xb, i + 1) - greatest(xa, i)) / {sub}::double as cover from spans, range(0, 90) r(i) where xb > xa and xb > i and xa < i + 1 group by all)"""


def _path(name: str, inside: str, *ops: str, rule: str = "nonzero") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        points = _points(spark, d)
        shapes = _shapes(points, *ops, rule=rule)
        cover = P.coverage(P.edges(P.straight_knots(points), shapes), shapes, _boxes(points))
        return cover.select("doc", "x", "y", F.floor(F.least(F.lit(1.0), "cover") * 10000 + 0.5).cast("long").alias("cover")).where("cover > 0")

    QUERIES[name] = run
    ORACLE_SQL[name] = _POINTS + _covered(P.SUB, inside, rule == "evenodd") + " select doc, x, y, cast(floor(least(1, cover) * 10000 + 0.5) as bigint) as cover from cover where floor(least(1, cover) * 10000 + 0.5) > 0"


_path("path_nonzero", "a or b or c", "add", "add", "add")
_path("path_evenodd", "(a or b) or c", "add", "add", "add", rule="evenodd")
_path("path_subtract_intersect", "(a and not b) and c", "add", "subtract", "intersect")
_path("path_exclude", "(a <> b) <> c", "add", "exclude", "exclude")
_path("path_begins_with_subtract", "((not a) and b) or c", "subtract", "intersect", "add")

QUERIES["path_measures"] = lambda spark, d: P.areas(o := P.edges(P.straight_knots(p := _points(spark, d)), _shapes(p, "add", "add", "add"))).join(P.path_bounds(o), "doc").select("doc", "shape", *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("area", "x0", "y0", "x1", "y1")))
_milli = lambda c: f"cast(floor(({c}) * 1000 + 0.5) as bigint)"
ORACLE_SQL["path_measures"] = _POINTS + f" select doc, shape, {_milli('sum(x0 * y1 - x1 * y0) / 2')} as area, " + ", ".join(f"any_value({c}) as {c}" for c in ("bx0", "by0", "bx1", "by1")) + f" from edges join (select doc, {_milli('min(x0)')} as bx0, {_milli('min(y0)')} as by0, {_milli('max(x0)')} as bx1, {_milli('max(y0)')} as by1 from edges group by doc) using (doc) group by doc, shape"
ORACLE_SQL["path_measures"] = "select doc, shape, area, bx0 as x0, by0 as y0, bx1 as x1, by1 as y1 from (" + ORACLE_SQL["path_measures"] + ")"


def _lasso(smooth: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        px = events_raster(spark, d).select((F.col("y") % 4).alias("doc"), "x", F.floor(F.col("y") / 4).alias("y"))
        return P.polygon(px, _points(spark, d).where("shape = 0").drop("shape"), smooth)

    return run


for _name, _smooth in (("select_polygon", True), ("select_polygon_hard", False)):
    QUERIES[_name] = _lasso(_smooth)
    ORACLE_SQL[_name] = _POINTS.replace("event_id % 20 = 3)", "event_id % 20 = 3 and floor(event_id / 20)::bigint % 3 = 0)") + _covered(4 if _smooth else 1, "a", True).replace("range(0, 90)", "range(0, 100)").replace(", 90) as xb", ", 100) as xb") + ", px as (select event_id % 100 as x, cast(floor(event_id / 400) as bigint) as y, cast(floor(event_id / 100) as bigint) % 4 as doc from events) select px.doc, px.x, px.y, least(255, floor(coalesce(cover, 0) * 255 + 0.5))::bigint as cov from px left join cover using (doc, x, y)"


def _selected(spark: SparkSession, d: str) -> DataFrame:
    """Two documents of partly selected pixels."""
    px = events_raster(spark, d)
    return px.select((F.floor(F.col("y") / 5) % 2).alias("doc"), "x", (F.floor(F.col("y") / 10) * 5 + F.col("y") % 5).alias("y"), F.when((F.col("x") - 40) * (F.col("x") - 40) < 300, F.col("g")).when(F.col("r") > 90, 255).otherwise(0).cast("long").alias("cov"))


QUERIES["trace_links"] = lambda spark, d: T.links(_selected(spark, d)).select("doc", "node", "next", *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("x", "y")))
_node = lambda side: f"case {side} when 'T' then (cy * 1073741824 + cx) * 2 when 'B' then ((cy + 1) * 1073741824 + cx) * 2 when 'L' then (cy * 1073741824 + cx) * 2 + 1 else (cy * 1073741824 + cx + 1) * 2 + 1 end::bigint"
_share = lambda a, b: f"case when {a} = {b} then 0.5::double else (0.5::double - {a}) / ({b} - {a}) end"
ORACLE_SQL["trace_links"] = PX + f""", sel as (select cast(floor(y / 5) as bigint) % 2 as doc, x, cast(floor(y / 10) as bigint) * 5 + y % 5 as y, case when (x - 40) * (x - 40) < 300 then g when r > 90 then 255 else 0 end / 255::double as v from pe),
  cells as (select distinct doc, x - i as cx, y - j as cy from sel, range(0, 2) a(i), range(0, 2) b(j)),
  c as (select cells.*, coalesce(p.v, 0) as tl, coalesce(q.v, 0) as tr, coalesce(r.v, 0) as br, coalesce(s.v, 0) as bl from cells left join sel p on p.doc = cells.doc and p.x = cx and p.y = cy left join sel q on q.doc = cells.doc and q.x = cx + 1 and q.y = cy
    left join sel r on r.doc = cells.doc and r.x = cx + 1 and r.y = cy + 1 left join sel s on s.doc = cells.doc and s.x = cx and s.y = cy + 1),
  coded as (select *, (tl > 0.5)::int * 8 + (tr > 0.5)::int * 4 + (br > 0.5)::int * 2 + (bl > 0.5)::int as code from c),
  ways(code, a, b) as (values {', '.join(f"({k}, '{w[0]}', '{w[1]}')" for k, ws in T.LINKS.items() for w in ws)})
  select doc, {_node('a')} as node, {_node('b')} as next, {_milli(f"cx + 0.5::double + case a when 'T' then {_share('tl', 'tr')} when 'B' then {_share('bl', 'br')} when 'L' then 0 else 1 end")} as x,
    {_milli(f"cy + 0.5::double + case a when 'L' then {_share('tl', 'bl')} when 'R' then {_share('tr', 'br')} when 'T' then 0 else 1 end")} as y from coded join ways using (code)"""


def _traced(spark: SparkSession, d: str) -> DataFrame:
    """Outlines as cubics: least squares in arcs, so there is no SQL; tests hold them against their points."""
    return T.curves(T.rings(T.links(_selected(spark, d))), 1.0)


QUERIES["trace_curves"] = _traced
