"""Registered effects on tiles and their SQL: weighted neighbours, seeds of cells, deconvolution step by step."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pixelloom.operators import effects as E
from pixelloom.operators import healing as H
from pixelloom.operators import inpainting as I
from pixelloom.plans.filters import _BASE, _bytes, _hashes, _near
from pixelloom.sources.rasters import events_raster, orders_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


def _weighted(offsets: list[tuple[int, int, float]], source: str = "pm") -> str:
    """CTE nb: each pixel with those of the offsets (dx, dy, weight), coordinates clamped."""
    rows = ", ".join(f"({x}, {y}, {w!r}::double)" for x, y, w in offsets)
    return f", ofs(dx, dy, w) as (values {rows}), nb as (select p.x, p.y, w, q.r, q.g, q.b, q.a from pe p, ofs, dm join {source} q on q.x = greatest(0, least(mx, p.x + dx)) and q.y = greatest(0, least(my, p.y + dy)))"


def _line(angle: float, distance: float) -> list[tuple[int, int, float]]:
    """Corners around each sample of a line, with their shares."""
    taps, out = math.ceil(distance) + 1, []
    for t in range(taps):
        k = (t / (taps - 1) - 0.5) * distance
        x, y = math.cos(math.radians(angle)) * k, -math.sin(math.radians(angle)) * k
        fx, fy = x - math.floor(x), y - math.floor(y)
        out += [(math.floor(x) + i, math.floor(y) + j, (fx if i else 1 - fx) * (fy if j else 1 - fy) / taps) for i in (0, 1) for j in (0, 1)]
    return out


for _angle, _distance in ((30.0, 9.0), (-45.0, 20.0)):
    _one(f"effect_motion_blur_{_distance:.0f}", lambda px, a=_angle, d=_distance: E.motion_blur(px, a, d, tile=64), _BASE + _weighted(_line(_angle, _distance)) + f", f as (select x, y, {', '.join(f'sum({c} * w) as {c}' for c in 'rgba')} from nb group by x, y)" + _bytes("f"))

#: Rows of the shapes of radius 4: (dy, first, last).
_SHAPES = {
    "disc": [(-4, 0, 0), (-3, -3, 3), (-2, -3, 3), (-1, -4, 4), (0, -4, 4), (1, -4, 4), (2, -3, 3), (3, -3, 3), (4, 0, 0)],
    "square": [(d, -4, 4) for d in range(-4, 5)],
    "diamond": [(d, abs(d) - 4, 4 - abs(d)) for d in range(-4, 5)],
    "triangle": [(-4, 0, 0), (-3, -1, 1), (-2, -1, 1), (-1, -2, 2), (0, -2, 2), (1, -3, 3), (2, -3, 3), (3, -4, 4), (4, -4, 4)],
    "star": [(-4, 0, 0), (-3, 0, 0), (-2, -1, 1), (-1, -2, 2), (0, -4, 4), (1, -2, 2), (2, -1, 1), (3, 0, 0), (4, 0, 0)],
    "ring": [(-4, 0, 0), (-3, -3, 3), *[(d, a, b) for d, i, o in ((-2, 3, 3), (-1, 3, 4), (0, 3, 4), (1, 3, 4), (2, 3, 3)) for a, b in ((-o, -i), (i, o))], (3, -3, 3), (4, 0, 0)],
}
for _shape, _rows in _SHAPES.items():
    _offsets = [(x, dy, 1.0) for dy, a, b in _rows for x in range(a, b + 1)]
    _one(f"effect_shape_blur_{_shape}", lambda px, s=_shape: E.shape_blur(px, s, 4, tile=64), _BASE + _weighted(_offsets) + f", f as (select x, y, {', '.join(f'sum({c}) / {len(_offsets)}::double as {c}' for c in 'rgba')} from nb group by x, y)" + _bytes("f"))


def _seeded(cell: int, seed: int) -> str:
    """CTE near: for each pixel the nearest of the seeds of the nine cells around, its squared distance and the pixel under it."""
    sql, last = _hashes("places", ("hx", "i", "j", seed), ("hy", "i", "j", seed + 1))
    return _BASE + ", places as (select i, j from range(-2, 2000) a(i), range(-2, 2000) c(j), dm where i <= mx / " + f"{cell} + 2 and j <= my / {cell} + 2)" + sql + f""", seeds as (select i, j, (i + hx) * {cell} as sx, (j + hy) * {cell} as sy from {last}),
  met as (select p.x, p.y, i, j, sx, sy, (sx - p.x - 0.5) * (sx - p.x - 0.5) + (sy - p.y - 0.5) * (sy - p.y - 0.5) as d from pe p join seeds s on i between floor((p.x + 0.5) / {cell}) - 1 and floor((p.x + 0.5) / {cell}) + 1 and j between floor((p.y + 0.5) / {cell}) - 1 and floor((p.y + 0.5) / {cell}) + 1),
  near as (select * from met qualify row_number() over (partition by x, y order by d, j, i) = 1),
  under as (select n.x, n.y, n.d, floor(sx)::bigint as fx, floor(sy)::bigint as fy, q.r, q.g, q.b, q.a from near n, dm join pm q on q.x = greatest(0, least(mx, floor(sx))) and q.y = greatest(0, least(my, floor(sy))))"""


_one("effect_crystallize", lambda px: E.crystallize(px, 9, 4, tile=64), _seeded(9, 4) + _bytes("under"))
_sql, _last = _hashes("under", ("h", "fx", "fy", 5))
_dot = lambda c: f"least(65025::double, greatest(0::double, {c} + (h - 0.5::double) * 0.12::double * a))"
_one("effect_pointillize", lambda px: E.pointillize(px, 6, 3, (250, 240, 30), tile=64), _seeded(6, 3) + _sql + f", f as (select x, y, {', '.join(f'case when d > 3.72::double * 3.72::double then {v * 255} else {_dot(c)} end as {c}' for c, v in zip('rgb', (250, 240, 30)))}, case when d > 3.72::double * 3.72::double then 65025 else a end as a from {_last})" + _bytes("f"))


def _lens(passes: int, amount: float) -> str:
    """Deconvolution by a disc of radius one: the pixel and its four neighbours."""
    sql = _BASE + ", seen as (select x, y, r::double as r, g::double as g, b::double as b, a from pm), est0 as (select * from seen)"
    cross = "abs(i) + abs(j) <= 1"
    for k in range(passes):
        again = _near(f"est{k}", 1, cross).replace("ofs as", f"ofs{k} as").replace("nb as", f"nb{k} as").replace("pe p, ofs,", f"pe p, ofs{k},")
        sql += again + f", re{k} as (select x, y, sum(r) / 5 as r, sum(g) / 5 as g, sum(b) / 5 as b, max(a) as a from nb{k} group by x, y), ratio{k} as (select s.x, s.y, {', '.join(f's.{c} / greatest(6.5025::double, e.{c}) as {c}' for c in 'rgb')}, s.a from seen s join re{k} e using (x, y))"
        more = _near(f"ratio{k}", 1, cross).replace("ofs as", f"ofm{k} as").replace("nb as", f"nm{k} as").replace("pe p, ofs,", f"pe p, ofm{k},")
        sql += more + f", co{k} as (select x, y, sum(r) / 5 as r, sum(g) / 5 as g, sum(b) / 5 as b from nm{k} group by x, y), est{k + 1} as (select e.x, e.y, {', '.join(f'least(e.a, greatest(0::double, e.{c} * m.{c})) as {c}' for c in 'rgb')}, e.a from est{k} e join co{k} m using (x, y))"
    return sql + f", f as (select p.x, p.y, {', '.join(f'p.{c} + (e.{c} - p.{c}) * {amount!r}::double as {c}' for c in 'rgb')}, p.a from pm p join est{passes} e using (x, y))"



for _passes in (1, 3):
    _one(f"effect_smart_sharpen_lens_{_passes}", lambda px, n=_passes: E.smart_sharpen(px, 1.3, 1.0, 0.0, "lens", passes=n, tile=64), _lens(_passes, 1.3) + _bytes("f"))


def _healed(spark, d):
    """The orders healed into a disc of the events; solved by iteration, so there is no SQL: tests compare with a dense solve."""
    px = events_raster(spark, d)
    disc = (F.col("x") - 50) * (F.col("x") - 50) + (F.col("y") - 4) * (F.col("y") - 4) * 9 <= 900
    return H.heal(orders_raster(spark, d), px, px.select("x", "y", F.when(disc, 255).otherwise(0).cast("long").alias("cov")), tile=64)


QUERIES["heal_membrane"] = _healed


def _inpainted(spark, d):
    """A hole of the events filled by patch matching; seeded and iterative, so there is no SQL: tests take a texture that repeats."""
    px = events_raster(spark, d)
    hole = px.where("x between 40 and 52 and y between 2 and 7").select("x", "y", F.lit(255).alias("cov"))
    return I.inpaint(px, hole, size=5, tile=64)


QUERIES["inpaint_hole"] = _inpainted
