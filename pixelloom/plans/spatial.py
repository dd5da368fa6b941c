"""Registered adjustments by surroundings and their SQL."""

from __future__ import annotations

from pixelloom.operators import spatial as S
from pixelloom.operators.tiled import box_radius
from pixelloom.plans.queries import LUM, PX
from pixelloom.plans.tiling import _boxed
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


_unit = lambda v: f"least(1::double, greatest(0::double, {v}))"
_L = PX + f", l as (select *, {LUM} / 255::double as l from pe)"


def _soft(sigma: float, value: str, name: str) -> str:
    """CTE <name>_s (x, y, <name>): the value under three boxes."""
    sql, last = _boxed(f"{name}_0", box_radius(sigma), 3, "c")
    return f", {name}_0 as (select 0 as doc, x, y, {value} as c from l){sql}, {name}_s as (select x, y, c as {name} from {last})"


def _out(source: str, new: dict[str, str]) -> str:
    return f" select x, y, {', '.join(f'case when a = 0 then {c} else cast(floor({_unit(v)} * 255 + 0.5) as bigint) end as {c}' for c, v in new.items())}, a from {source}"


_relit = ", ".join(f"case when l > 1e-4 then {c} / 255::double * (t / l) else t end as n{c}" for c in "rgb")


def _shadows(s: tuple, h: tuple, color: float, mid: float, clip: float) -> str:
    sql, joins, v = _L, "", "l"
    if s[0]:
        sql, joins = sql + _soft(s[2] / 2, "l", "sb"), joins + " join sb_s using (x, y)"
        v = f"power({v}, 1 / (1 + {3 * s[0] / 100!r}::double * power(1 - {_unit(f'sb / {s[1] / 100!r}::double')}, 2)))"
    if h[0]:
        sql, joins = sql + _soft(h[2] / 2, "l", "hb"), joins + " join hb_s using (x, y)"
        v = f"1 - power(1 - {v}, 1 / (1 + {3 * h[0] / 100!r}::double * power({_unit(f'(hb - {1 - h[1] / 100!r}::double) / {h[1] / 100!r}::double')}, 2)))"
    cut = f"(select sum(n) * {clip / 100!r}::double from hist)"
    return sql + f""", v0 as (select *, {v} as w from l{joins}), v1 as (select *, w + {mid / 100!r}::double * (w * w * (3 - 2 * w) - w) as v from v0),
  hist as (select cast(floor({_unit('v')} * 255 + 0.5) as bigint) as level, count(*) as n from v1 where a <> 0 group by 1),
  run as (select level, sum(n) over (order by level) as up, sum(n) over (order by level desc) as down from hist),
  e0 as (select min(level) filter (where up > {cut}) as lo, max(level) filter (where down > {cut}) as hi from run),
  e as (select case when hi - lo < 6 then 0::double else lo / 255::double end as lo, case when hi - lo < 6 then 1::double else hi / 255::double end as hi from e0),
  v2 as (select v1.*, {_unit('(v - e.lo) / (e.hi - e.lo)')} as t from v1, e), v3 as (select *, {_relit}, least(1::double, abs(t - l) * 4) as moved from v2),
  v4 as (select *, 0.3::double * nr + 0.59::double * ng + 0.11::double * nb as grey, greatest(0::double, 1 + {color / 100!r}::double * moved - moved * 0.2::double * case when t > l then 1 else 0 end) as k from v3)""" + _out("v4", {c: f"grey + (n{c} - grey) * k" for c in "rgb"})


_one("adjust_shadows", lambda px: S.shadows_highlights(px, tile=64), _shadows((35, 50, 30), (0, 50, 30), 20, 0, 0.01))
_one("adjust_shadows_highlights", lambda px: S.shadows_highlights(px, (60, 40, 9), (45, 70, 50), 35, 25, 0.5, 0.5, tile=64), _shadows((60, 40, 9), (45, 70, 50), 35, 25, 0.5))

_toned = lambda v, more="": f", t0 as (select *, {_unit(v)} as u from {{source}}), t1 as (select *, {more or 'u'} as u1 from t0), t2 as (select *, {_unit('u1')} as t from t1), t3 as (select *, {_relit} from t2)"
_one(
    "adjust_hdr_local", lambda px: S.hdr_toning(px, radius=10, strength=0.8, exposure=0.3, detail=60, shadow=20, highlight=-15, gamma=1.2, saturation=0, tile=64),
    _L.replace(" as l from pe)", f" as l, ln({LUM} / 255::double + 1e-3) as lg from pe)") + _soft(5, "lg", "base") + ", m as (select avg(base) as mean from base_s), j as (select l.*, base, mean from l join base_s using (x, y), m)"
    + _toned("(exp(mean + (base - mean) / 1.8::double + (lg - base) * 1.6::double) - 1e-3) * power(2::double, 0.3::double)", "power(u, 1 / 1.2::double) + 0.1::double * power(1 - power(u, 1 / 1.2::double), 3) - 0.075::double * power(power(u, 1 / 1.2::double) + 0.1::double * power(1 - power(u, 1 / 1.2::double), 3), 3)").format(source="j")
    + _out("t3", {c: f"n{c}" for c in "rgb"}),
)
_one("adjust_hdr_compression", lambda px: S.hdr_toning(px, "highlightCompression", exposure=-0.2, saturation=0), _L + _toned("l * 2 / (1 + l * 2) * 1.5::double * power(2::double, -0.2::double)").format(source="l") + _out("t3", {c: f"n{c}" for c in "rgb"}))
_one("adjust_hdr_equalize", lambda px: S.hdr_toning(px, "equalize", saturation=0), _L + ", q as (select *, cast(floor(l * 255 + 0.5) as bigint) as level from l), n as (select level, sum(count(*) filter (where a <> 0)) over (order by level)::double / (select count(*) from q where a <> 0) as cdf from q group by level), j as (select q.*, cdf from q join n using (level))" + _toned("cdf").format(source="j") + _out("t3", {c: f"n{c}" for c in "rgb"}))
