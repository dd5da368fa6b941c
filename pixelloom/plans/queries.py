"""Registered raster queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.blend import MODES, dissolve_noise
from pixelloom.operators import raster as R
from pixelloom.sources.rasters import events_raster, orders_raster

PX = """with pe as (select event_id % 100 as x, cast(floor(event_id / 100) as bigint) as y, cast(floor(value) as bigint) % 256 as r,
  (user_id * 37) % 256 as g, (event_id * 11) % 256 as b, cast(case event_type when 'error' then 0 when 'signup' then 128 else 255 end as bigint) as a from events),
po as (select o_orderkey % 100 as x, cast(floor(o_orderkey / 100) as bigint) as y, cast(floor(o_totalprice) as bigint) % 256 as r,
  cast(floor(o_totalprice / 256) as bigint) % 256 as g, (o_custkey * 37) % 256 as b, cast(case when o_orderstatus = 'P' then 128 else 255 end as bigint) as a from orders)"""

BURN = "case when {b} >= 1 then 1.0::double when {s} <= 0 then 0.0::double else 1 - least(1.0::double, (1 - {b}) / ({s})) end"
DODGE = "case when {b} <= 0 then 0.0::double when {s} >= 1 then 1.0::double else least(1.0::double, {b} / (1 - ({s}))) end"
BLEND_SQL = {
    "normal": "{s}", "darken": "least({b}, {s})", "multiply": "{b} * {s}", "colorBurn": BURN, "linearBurn": "greatest(0, {b} + {s} - 1)",
    "lighten": "greatest({b}, {s})", "screen": "{b} + {s} - {b} * {s}", "colorDodge": DODGE, "linearDodge": "least(1, {b} + {s})",
    "overlay": "case when {b} <= 0.5 then 2 * {s} * {b} else 1 - 2 * (1 - {s}) * (1 - {b}) end",
    "softLight": "case when {s} <= 0.5 then 2 * {b} * {s} + {b} * {b} * (1 - 2 * {s}) else 2 * {b} * (1 - {s}) + sqrt({b}) * (2 * {s} - 1) end",
    "hardLight": "case when {s} <= 0.5 then 2 * {b} * {s} else 1 - 2 * (1 - {b}) * (1 - {s}) end",
    "vividLight": "case when {s} <= 0.5 then " + BURN.replace("{s}", "2 * {s}") + " else " + DODGE.replace("{s}", "2 * {s} - 1") + " end",
    "linearLight": "least(1, greatest(0, {b} + 2 * {s} - 1))", "pinLight": "case when {s} <= 0.5 then least({b}, 2 * {s}) else greatest({b}, 2 * {s} - 1) end",
    "hardMix": "case when {b} + {s} >= 1 then 1 else 0 end", "difference": "abs({b} - {s})", "exclusion": "{b} + {s} - 2 * {b} * {s}",
    "subtract": "greatest(0, {b} - {s})", "divide": "case when {s} <= 0 then 1 else least(1, {b} / {s}) end",
}


def _lum(p: str) -> str:
    return f"(0.3::double * {p}r + 0.59::double * {p}g + 0.11::double * {p}b)"


def _blend_sql(mode: str) -> str:
    """Backdrop and source as 0...1, blend, source over, 8 bits; whole-pixel modes clip in further steps."""
    base = PX + """, j as (select coalesce(pe.x, po.x) as x, coalesce(pe.y, po.y) as y,
      case when coalesce(pe.a, 0) = 0 then 0::double else pe.r / 255::double end as br, case when coalesce(pe.a, 0) = 0 then 0::double else pe.g / 255::double end as bg,
      case when coalesce(pe.a, 0) = 0 then 0::double else pe.b / 255::double end as bb, coalesce(pe.a, 0) / 255::double as ab,
      coalesce(po.r, 0) / 255::double as sr, coalesce(po.g, 0) / 255::double as sg, coalesce(po.b, 0) / 255::double as sb, coalesce(po.a, 0) / 255::double * 0.7::double as sa
      from pe full join po on pe.x = po.x and pe.y = po.y)"""
    if mode in BLEND_SQL:
        m = ", m as (select *, " + ", ".join(f"{BLEND_SQL[mode].format(b=f'b{c}', s=f's{c}')} as m{c}" for c in "rgb") + " from j)"
    elif mode in ("darkerColor", "lighterColor"):
        op = "<" if mode == "darkerColor" else ">"
        m = ", m as (select *, " + ", ".join(f"case when {_lum('s')} {op} {_lum('b')} then s{c} else b{c} end as m{c}" for c in "rgb") + " from j)"
    else:
        of = {"hue": "s", "saturation": "b", "color": "s", "luminosity": "b"}[mode]
        to = _lum("s" if mode == "luminosity" else "b")
        span = lambda p: f"(greatest({p}r, {p}g, {p}b) - least({p}r, {p}g, {p}b))"
        if mode in ("hue", "saturation"):
            other = "b" if of == "s" else "s"
            t = ", ".join(f"case when {span(of)} <= 0 then 0::double else ({of}{c} - least({of}r, {of}g, {of}b)) * {span(other)} / {span(of)} end as t{c}" for c in "rgb")
        else:
            t = ", ".join(f"{of}{c} as t{c}" for c in "rgb")
        m = f""", t as (select *, {t} from j),
          u as (select *, {", ".join(f"t{c} + ({to} - {_lum('t')}) as u{c}" for c in "rgb")} from t),
          v as (select *, {_lum("u")} as lv, least(ur, ug, ub) as lo, greatest(ur, ug, ub) as hi from u),
          w as (select *, {", ".join(f"case when lo < 0 and lv > lo then lv + (u{c} - lv) * lv / (lv - lo) else u{c} end as w{c}" for c in "rgb")} from v),
          m as (select *, {", ".join(f"case when hi > 1 and hi > lv then lv + (w{c} - lv) * (1 - lv) / (hi - lv) else w{c} end as m{c}" for c in "rgb")} from w)"""
    out = ", ".join(f"cast(floor(255 * (case when sa + ab * (1 - sa) <= 0 then 0::double else ((1 - sa) * ab * b{c} + sa * ((1 - ab) * s{c} + ab * m{c})) / (sa + ab * (1 - sa)) end) + 0.5) as bigint) as {c}" for c in "rgb")
    return f"{base}{m} select x, y, {out}, cast(floor(255 * (sa + ab * (1 - sa)) + 0.5) as bigint) as a from m"


def _point_sql(**channels: str) -> str:
    return PX + " select x, y, " + ", ".join(f"case when a = 0 then {c} else cast({channels[c]} as bigint) end as {c}" for c in "rgb") + ", a from pe"


def _each(form: str) -> dict[str, str]:
    return {c: form.format(v=c) for c in "rgb"}


LUM = "(0.3::double * r + 0.59::double * g + 0.11::double * b)"
CIRCLE = "cast(case when (x - 50) * (x - 50) + (y - 50) * (y - 50) <= 900 then 255 else 0 end as bigint)"
RECT = "cast(floor(255 * greatest(0::double, least(x + 1.0::double, 60.75::double) - greatest(x * 1.0::double, 10.25::double)) * greatest(0::double, least(y + 1.0::double, 40.5::double) - greatest(y * 1.0::double, 5.5::double)) + 0.5) as bigint)"
MEAN = ", ".join(f"case when sum(a) = 0 then 0 else cast(floor(sum({c} * a) / sum(a)::double + 0.5) as bigint) end as {c}" for c in "rgb")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, fn: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


for _m in MODES:
    QUERIES[f"blend_{_m}"] = lambda spark, d, m=_m: R.flatten([(events_raster(spark, d), "normal", 1.0), (orders_raster(spark, d), m, 0.7)])
    ORACLE_SQL[f"blend_{_m}"] = _blend_sql(_m)

_add("adjust_invert", R.invert, _point_sql(**_each("255 - {v}")))
_add("adjust_posterize", R.posterize, _point_sql(**_each("floor(floor({v} * 4 / 256::double) * 255 / 3::double + 0.5)")))
_add("adjust_threshold", R.threshold, _point_sql(**_each(f"case when {LUM} + 1e-3::double >= 128 then 255 else 0 end")))
_add("adjust_desaturate", R.desaturate, _point_sql(**_each("floor((greatest(r, g, b) + least(r, g, b)) / 2::double + 0.5)")))
_MIX = "floor(255 * least(1::double, greatest(0::double, (r * {} + g * {} + b * {}) / 25500::double + {}::double)) + 0.5)"
_add("adjust_channel_mixer", R.channel_mixer, _point_sql(r=_MIX.format(80, 30, -10, "0.0"), g=_MIX.format(10, 90, 0, "0.05"), b=_MIX.format(0, 20, 70, "0.1")))
_add("adjust_levels", R.levels, _point_sql(**_each("floor(10 + 235 * least(1::double, greatest(0::double, ({v} - 20) / 200::double)) + 0.5)")))
_add("adjust_brightness_contrast", R.brightness_contrast, _point_sql(**_each("floor(255 * least(1::double, greatest(0::double, (127.5::double + ({v} + 20 - 127.5::double) * (100 / 70::double)) / 255)) + 0.5)")))
_PF = "floor({v} + ({v} * {k} / 255::double - {v}) * 0.25::double + 0.5)"
_add("adjust_photo_filter", R.photo_filter, _point_sql(r=_PF.format(v="r", k=236), g=_PF.format(v="g", k=138), b=_PF.format(v="b", k=0)))
_add("stats_histogram", R.histogram, PX + f", h as (select unnest([{{'channel': 'r', 'level': r}}, {{'channel': 'g', 'level': g}}, {{'channel': 'b', 'level': b}}, {{'channel': 'lum', 'level': cast(floor({LUM} + 0.5) as bigint)}}]) as e from pe where a <> 0) select e.channel as channel, e.level as level, count(*) as n from h group by 1, 2")
_add("stats_equalize", R.equalize, PX + f", h as (select cast(floor({LUM} + 0.5) as bigint) as level, count(*) as n from pe where a <> 0 group by 1) select level, cast(sum(n) over (order by level) as bigint) as cdf from h")
_add("stats_bounds", R.bounds, PX + " select min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from pe where a <> 0")
_add("stats_color_sums", R.color_sums, PX + " select " + ", ".join(f"cast(sum({c} * a) as bigint) as sum_{c}" for c in "rgb") + ", cast(sum(a) as bigint) as sum_a, count(*) as n from pe where a <> 0")
_add("mip_downsample", R.downsample, PX + f" select cast(floor(x / 2) as bigint) as x, cast(floor(y / 2) as bigint) as y, {MEAN}, cast(floor(sum(a) / 4::double + 0.5) as bigint) as a from pe group by floor(x / 2), floor(y / 2)")
for _op, _f in (("add", "greatest({0}, {1})"), ("subtract", "greatest(0, {0} - {1})"), ("intersect", "least({0}, {1})")):
    _add(f"select_{_op}", lambda px, op=_op: R.combine(R.circle(px), R.rectangle(px), op), PX + f" select x, y, cast({_f.format(CIRCLE, RECT)} as bigint) as cov from pe")
_add("adjust_through_selection", lambda px: R.through(px, R.invert(px), R.rectangle(px)), PX + " select x, y, " + ", ".join(f"cast(floor({c} + ((case when a = 0 then {c} else 255 - {c} end) - {c}) * {RECT} / 255::double + 0.5) as bigint) as {c}" for c in "rgb") + ", a from pe")
_add("filter_edges", R.edges, PX + f", l as (select x, y, cast(floor({LUM} + 0.5) as bigint) as l from pe) select x, y, abs(coalesce(lead(l) over (partition by y order by x), l) - l) as dx, abs(coalesce(lead(l) over (partition by x order by y), l) - l) as dy from l")
_DM = ", dm as (select max(x) + 1 as w, max(y) + 1 as h from pe)"
_add("geometry_offset", lambda px: R.offset(px, 30, 7), PX + _DM + " select (x + 30) % w as x, (y + 7) % h as y, r, g, b, a from pe, dm")
_add("geometry_flip", R.flip, PX + _DM + " select w - 1 - x as x, y, r, g, b, a from pe, dm")
_add("geometry_flip_vertical", lambda px: R.flip(px, vertical=True), PX + _DM + " select x, h - 1 - y as y, r, g, b, a from pe, dm")
for _turn, _at in ((90, "h - 1 - y as x, x as y"), (180, "w - 1 - x as x, h - 1 - y as y"), (270, "y as x, w - 1 - x as y")):
    _add(f"geometry_rotate{_turn}", lambda px, turn=_turn: R.rotate(px, turn), PX + _DM + f" select {_at}, r, g, b, a from pe, dm")
_add("geometry_crop", lambda px: R.crop(px, 10, 2, 60, 8), PX + " select x - 10 as x, y - 2 as y, r, g, b, a from pe where x >= 10 and x < 60 and y >= 2 and y < 8")
_add("noise_dissolve", lambda px: px.select("x", "y", F.floor(dissolve_noise(F.col("x"), F.col("y")) * 1000000).cast("long").alias("n")), PX + ", h as (select x, y, (x * 374761393 + y * 668265263) & 4294967295 as h from pe), i as (select x, y, xor(h, h >> 13) as h from h), k as (select x, y, cast((case when h >= 2147483648 then h - 4294967296 else h end)::double * 1274126177::double as bigint) & 4294967295 as h from i) select x, y, cast(floor(xor(h, h >> 16) / 4294967296::double * 1000000) as bigint) as n from k")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance histogram of the events under the orders, multiplied at 0.7, with levels on top."""
    flat = R.flatten([(events_raster(spark, sf_dir), "normal", 1.0), (orders_raster(spark, sf_dir), "multiply", 0.7)])
    return R.histogram(R.levels(flat))


QUERIES["flatten_histogram"] = flagship
ORACLE_SQL["flatten_histogram"] = (
    "with f as (" + _blend_sql("multiply") + "), l as (select " + ", ".join(f"case when a = 0 then {c} else cast(floor(10 + 235 * least(1::double, greatest(0::double, ({c} - 20) / 200::double)) + 0.5) as bigint) end as {c}" for c in "rgb") + f", a from f), h as (select unnest([{{'channel': 'r', 'level': r}}, {{'channel': 'g', 'level': g}}, {{'channel': 'b', 'level': b}}, {{'channel': 'lum', 'level': cast(floor({LUM} + 0.5) as bigint)}}]) as e from l where a <> 0) select e.channel as channel, e.level as level, count(*) as n from h group by 1, 2"
)
