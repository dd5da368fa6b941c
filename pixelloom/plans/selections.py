"""Registered selections and their SQL: floods as recursive queries, neighbours as joins."""

from __future__ import annotations

from pixelloom.operators import selections as S
from pixelloom.plans.filters import _BASE
from pixelloom.plans.queries import PX
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


_BOX = (12.5, 3.0, 71.25, 60.5)


def _oval(n: int, box: tuple = _BOX) -> str:
    """Points of a grid in each pixel, counted by a join with their offsets."""
    x0, y0, x1, y1 = box
    d = lambda c, k, lo, hi: f"(({c} + ({k} + 0.5) / {n}::double - {(lo + hi) / 2}) / {(hi - lo) / 2}::double)"
    return f"(select x, y, cast(floor(sum(case when {d('x', 'i', x0, x1)} * {d('x', 'i', x0, x1)} + {d('y', 'j', y0, y1)} * {d('y', 'j', y0, y1)} <= 1 then 1 else 0 end) / {n * n}::double * 255 + 0.5) as bigint) as cov from pe, range(0, {n}) s(i), range(0, {n}) t(j) group by x, y)"


_SEL = _BASE + f", se as {_oval(4)}"
_oval_of = lambda px: S.ellipse(px, *_BOX)
_one("select_ellipse", _oval_of, PX + f" select * from {_oval(4)}")
_one("select_ellipse_hard", lambda px: S.ellipse(px, *_BOX, smooth=False), PX + f" select * from {_oval(1)}")
_one("select_inverse", lambda px: S.inverted(_oval_of(px)), PX + f" select x, y, 255 - cov as cov from {_oval(4)}")
_one("select_column", lambda px: S.line(px, 7, True), PX + " select x, y, case when x = 7 then 255 else 0 end::bigint as cov from pe")
_one("select_row", lambda px: S.line(px, 4, False), PX + " select x, y, case when y = 4 then 255 else 0 end::bigint as cov from pe")
_one("select_all", S.everything, PX + " select x, y, 255::bigint as cov from pe")


def _means(r: int, passes: int) -> str:
    """Box means by joins, rows then columns, several times."""
    out, of = ", b0 as (select x, y, cov::double as cov from se)", "b0"
    for k in range(passes):
        for axis in ("x", "y"):
            name, lim = f"b{k}{axis}", "mx" if axis == "x" else "my"
            on = f"q.{axis} = greatest(0, least({lim}, p.{axis} + k)) and q.{'y' if axis == 'x' else 'x'} = p.{'y' if axis == 'x' else 'x'}"
            out += f", {name} as (select x, y, list_reduce(list(cov order by k), lambda s, v: s + v) / {2 * r + 1}::double as cov from (select p.x, p.y, k, q.cov from {of} p, dm, range({-r}, {r + 1}) z(k) join {of} q on {on}) group by x, y)"
            of = name
    return out + f" select x, y, cast(floor(least(255::double, greatest(0::double, cov)) + 0.5) as bigint) as cov from {of}"


_one("select_feather", lambda px: S.feather(_oval_of(px), 7), _SEL + _means(2, 3))
_SEED = ", sd as (select r as sr, g as sg, b as sb, a as sa from pe where x = 50 and y = 5), di as (select x, y, greatest(abs(r - sr), abs(g - sg), abs(b - sb), abs(a - sa)) as d from pe, sd)"
_STEP = "(abs(n.x - f.x) + abs(n.y - f.y)) = 1"
_FLOOD = PX.replace("with pe", "with recursive pe", 1) + _SEED + f", fl as (select x, y, d from di where x = 50 and y = 5 union select n.x, n.y, n.d from fl f join di n on n.x between f.x - 1 and f.x + 1 and n.y between f.y - 1 and f.y + 1 and {_STEP} where n.d <= {{t}})"
_COV = "case when d <= {t} * 0.75 then 255 else cast(floor(255 * (1 - (d - {t} * 0.75) / ({t} * 0.25)::double) + 0.5) as bigint) end"
for _t in (96, 160):
    _one(f"select_wand_contiguous_{_t}", lambda px, t=_t: S.wand(px, 50, 5, t), _FLOOD.format(t=_t) + f" select p.x, p.y, coalesce({_COV.format(t=_t)}, 0)::bigint as cov from pe p left join fl using (x, y)")
_one(
    "select_smooth_2", lambda px: S.smoothed(S.wand(px, 50, 5, 160), 2),
    _FLOOD.format(t=160) + f", se as (select p.x, p.y, coalesce({_COV.format(t=160)}, 0) as cov from pe p left join fl using (x, y)), dm as (select max(x) as mx, max(y) as my from pe) select p.x, p.y, case when sum(case when q.cov >= 128 then 1 else 0 end) * 2 >= 25 then 255 else 0 end::bigint as cov "
    "from pe p, dm, range(-2, 3) s(i), range(-2, 3) t(j) join se q on q.x = greatest(0, least(mx, p.x + i)) and q.y = greatest(0, least(my, p.y + j)) group by p.x, p.y",
)
_GROW = _SEL.replace("with pe", "with recursive pe", 1) + ", me as (select x, y, r, g, b, cov from pe join se using (x, y)), fl as (select x, y, r, g, b from me where cov >= 128 union select n.x, n.y, n.r, n.g, n.b from fl f join me n on n.x between f.x - 1 and f.x + 1 and n.y between f.y - 1 and f.y + 1 and " + _STEP + " where greatest(abs(n.r - f.r), abs(n.g - f.g), abs(n.b - f.b)) <= {t})"
for _t in (40, 90):
    _one(f"select_grow_{_t}", lambda px, t=_t: S.grow(px, _oval_of(px), t), _GROW.format(t=_t) + " select me.x, me.y, case when cov < 128 and fl.x is not null then 255 else cov end::bigint as cov from me left join (select distinct x, y from fl) fl using (x, y)")
    _n = -(-(_t + 7) // 8)
    _one(
        f"select_similar_{_t}", lambda px, t=_t: S.similar(px, S.ellipse(px, 40, 2, 44, 6), t),
        PX + f", se as {_oval(4, (40, 2, 44, 6))}, q as (select x, y, cov, r >> 3 as cr, g >> 3 as cg, b >> 3 as cb from pe join se using (x, y)), p as (select distinct cr as pr, cg as pg, cb as pb from q where cov >= 128) "
        f"select x, y, case when cov < 128 and exists (select 1 from p where abs(cr - pr) <= {_n} and abs(cg - pg) <= {_n} and abs(cb - pb) <= {_n}) then 255 else cov end::bigint as cov from q",
    )
_edge = lambda dx, dy, a, b, c, d: f"select x + {a} as x0, y + {b} as y0, x + {c} as x1, y + {d} as y1 from se p where cov >= 128 and not exists (select 1 from se q where q.x = p.x + {dx} and q.y = p.y + {dy} and q.cov >= 128)"
_one("select_boundary", lambda px: S.boundary(_oval_of(px)), _SEL + " " + " union all ".join((_edge(0, -1, 0, 0, 1, 0), _edge(0, 1, 0, 1, 1, 1), _edge(-1, 0, 0, 0, 0, 1), _edge(1, 0, 1, 0, 1, 1))))
_one("select_measures", lambda px: S.measures(_oval_of(px)), _SEL + " select max(cov) as most, max(cov) = 0 as empty, min(case when cov <> 0 then x end) as x0, min(case when cov <> 0 then y end) as y0, max(case when cov <> 0 then x end) + 1 as x1, max(case when cov <> 0 then y end) + 1 as y1 from se")
_one("select_at", lambda px: S.at(_oval_of(px), 20, 6), _SEL + " select coalesce(max(cov), 0)::bigint as cov from se where x = 20 and y = 6")
_one("select_stored", lambda px: S.dense(S.sparse(_oval_of(px)), px), _SEL + " select x, y, cov from se")
