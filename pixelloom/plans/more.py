"""Registered queries of tone, neighbourhood and layer operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.operators import layers as L
from pixelloom.operators import distance as D
from pixelloom.operators import selections as SL
from pixelloom.operators import tiled as N
from pixelloom.operators import raster as R
from pixelloom.operators import tone as T
from pixelloom.plans.queries import BLEND_SQL, CIRCLE, LUM, PX, RECT, _each, _point_sql
from pixelloom.sources.rasters import events_raster, orders_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


def _two(name: str, fn, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fn(events_raster(spark, d), orders_raster(spark, d))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _unit(v: str) -> str:
    return f"least(1::double, greatest(0::double, {v}))"


def _byte(v: str) -> str:
    return f"cast(floor(255 * {_unit(v)} + 0.5) as bigint)"


# Tone.
_one("adjust_exposure", T.exposure, _point_sql(**_each(_byte("power(greatest(0::double, power({v} / 255::double, 2.2::double) * power(2::double, 0.5::double) + 0.01::double), 1 / 2.2::double / 1.2::double)"))))
_g = "power({v} / 255::double, power(2::double, -0.2::double))"
_one("adjust_brightness_contrast_modern", T.brightness_contrast, _point_sql(**_each(_byte(f"({_g} + ({_g} * {_g} * (3 - 2 * {_g}) - {_g}) * 0.4::double)"))))
_one("filter_solarize", T.solarize, _point_sql(**_each("case when {v} > 127 then 255 - {v} else {v} end")))
_one("adjust_gradient_map", T.gradient_map, _point_sql(**{c: f"floor({d} + {h - d} * (floor({LUM} + 0.5) / 255::double) + 0.5)" for c, d, h in (("r", 10, 250), ("g", 20, 240), ("b", 80, 180))}))
_one("adjust_monochrome_mixer", T.monochrome_mixer, _point_sql(**_each(_byte("((r * 40 + g * 40 + b * 20) / 25500::double)"))))
_one("select_color_range", T.color_mask, PX + f" select x, y, {_byte('(1 - sqrt(((r - 120) * (r - 120) + (g - 90) * (g - 90) + (b - 60) * (b - 60))::double) / 90::double)')} as cov from pe")

_HIST = PX + f""", e as (select unnest([{{'channel': 'r', 'level': r}}, {{'channel': 'g', 'level': g}}, {{'channel': 'b', 'level': b}}, {{'channel': 'lum', 'level': cast(floor({LUM} + 0.5) as bigint)}}]) as e from pe where a <> 0),
h as (select e.channel as channel, e.level as level, count(*) as n from e group by 1, 2)"""
_RANGE = """, run as (select channel, level, sum(n) over (partition by channel) * 0.001::double as cut, sum(n) over (partition by channel order by level) as up, sum(n) over (partition by channel order by level desc) as down from {h}),
k as (select channel, min(level) filter (where up > cut) as lo, max(level) filter (where down > cut) as hi from run group by 1), c as (select channel, case when hi - lo < 2 then 0 else lo end::bigint as lo, case when hi - lo < 2 then 255 else hi end::bigint as hi from k)"""
_STRETCH = "case when a = 0 then {v} else " + _byte("(({v} - {k}.lo) / ({k}.hi - {k}.lo)::double)") + " end as {v}"
_one("stats_clip_ranges", lambda px: T.clip_ranges(R.histogram(px)), _HIST + _RANGE.format(h="h") + " select channel, lo, hi from c")
_one("adjust_auto_tone", T.auto_tone, _HIST + _RANGE.format(h="h") + " select x, y, " + ", ".join(_STRETCH.format(v=v, k=f"c{v}") for v in "rgb") + ", a from pe" + "".join(f" join c c{v} on c{v}.channel = '{v}'" for v in "rgb"))
_one("adjust_auto_contrast", T.auto_contrast, _HIST + ", m as (select 'all' as channel, level, sum(n) as n from h where channel <> 'lum' group by 2)" + _RANGE.format(h="m") + " select x, y, " + ", ".join(_STRETCH.format(v=v, k="c") for v in "rgb") + ", a from pe join c on true")
_one("adjust_equalize", T.equalize, _HIST + ", l as (select level, n from h where channel = 'lum'), first as (select n as base from l where level = (select min(level) from l)), total as (select sum(n) as total from l), lut as (select i as level, case when total = base then i else cast(floor(greatest(0, coalesce((select sum(n) from l where l.level <= i), 0) - base) / (total - base)::double * 255 + 0.5) as bigint) end as v from range(256) t(i), first, total) select x, y, " + ", ".join(f"case when a = 0 then {v} else t{v}.v end as {v}" for v in "rgb") + ", a from pe" + "".join(f" join lut t{v} on t{v}.level = pe.{v}" for v in "rgb"))
_parts = (("lum", "r * 30 + g * 59 + b * 11", 25500), ("rg", "r - g", 255), ("yb", "r + g - 2 * b", 510))
_one("stats_color_stats", T.color_stats, PX + ", s as (select count(*) as n, " + ", ".join(f"cast(sum({e}) as double) as s_{k}, cast(sum(({e}) * ({e})) as double) as q_{k}" for k, e, _ in _parts) + " from pe where a <> 0) select " + ", ".join(f"round(s_{k} / n / {z}::double, 9) as mean_{k}, round(sqrt(greatest(1e-8::double, q_{k} / n / {z * z}::double - (s_{k} / n / {z}::double) * (s_{k} / n / {z}::double))), 9) as std_{k}" for k, _, z in _parts) + " from s")
_one("stats_sample_color", T.sample_color, PX + " select " + ", ".join(f"case when coalesce(sum(a), 0) = 0 then 1::double else sum({c} * a)::double / sum(a)::double / 255 end as {c}" for c in "rgb") + " from pe where x between 48 and 52 and y between 3 and 7")

# Two rasters.
_J = PX + ", j as (select pe.*, coalesce(po.r, 0) as sr, coalesce(po.g, 0) as sg, coalesce(po.b, 0) as sb, coalesce(po.a, 0) as sa from pe left join po on pe.x = po.x and pe.y = po.y)"


def _image(form: str) -> str:
    return _J + " select x, y, " + ", ".join(f"case when a = 0 then {c} else cast(floor({form.format(b=f'({c} / 255::double)', s=f's{c}')} * 255 + 0.5) as bigint) end as {c}" for c in "rgb") + ", a from j"


_two("apply_image_screen", lambda p, o: T.apply_image(p, o, "screen", opacity=0.6), _image("({b} + (({b} + {s} / 255::double - {b} * ({s} / 255::double)) - {b}) * 0.6::double)"))
_two("apply_image_add", lambda p, o: T.apply_image(p, o, "add", scale=2.0, offset=10), _image("({b} + (" + _unit("({b} + {s} / 255::double) / 2::double + 10 / 255::double") + " - {b}) * 1::double)"))
_two("apply_image_subtract_gray", lambda p, o: T.apply_image(p, o, "subtract", "gray", invert=True), _image("({b} + (" + _unit("({b} - (1 - (0.3::double * sr + 0.59::double * sg + 0.11::double * sb) / 255)) / 1::double + 0::double") + " - {b}) * 1::double)"))
_two("calculations_multiply", lambda p, o: T.calculations(p, o, "r", "gray", opacity=0.8), _J + f", g as (select x, y, {LUM} / 255 as v, sr / 255::double as s from j) select x, y, {_byte('(v + (v * s - v) * 0.8::double)')} as cov from g")

# Neighbourhoods.


def _near(columns: str, source: str) -> str:
    """CTE nb with <c>0 to <c>8, the 3 x 3 values of each column."""
    wx, wy = "over (partition by y order by x)", "over (partition by x order by y)"
    rows = ", ".join(f"coalesce(lag({c}) {wx}, {c}) as {c}_0, {c} as {c}_1, coalesce(lead({c}) {wx}, {c}) as {c}_2" for c in columns)
    cols = ", ".join(f"coalesce(lag({c}_{i}) {wy}, {c}_{i}) as {c}{i}, {c}_{i} as {c}{3 + i}, coalesce(lead({c}_{i}) {wy}, {c}_{i}) as {c}{6 + i}" for c in columns for i in range(3))
    return f", nr as (select *, {rows} from {source}), nb as (select *, {cols} from nr)"


_PRE = PX + ", pm as (select x, y, r * a as r, g * a as g, b * a as b, a from pe)"


def _straight(v: str) -> str:
    return f"case when a = 0 then 0 else cast(round_even(least(a * 255, greatest(0, {v})) / a::double, 0) as bigint) end"


def _conv(centre: int, scale: int) -> str:
    total = lambda c: f"(({centre} * {c}4 - {' - '.join(f'{c}{i}' for i in range(9) if i != 4)}) / {scale}::double)"
    return _PRE + _near("rgb", "pm") + " select x, y, " + ", ".join(f"{_straight(total(c))} as {c}" for c in "rgb") + ", a from nb"


_one("filter_sharpen", N.sharpen, _conv(12, 4))
_one("filter_sharpen_more", N.sharpen_more, _conv(9, 1))
_GX, _GY = "({c}2 + 2 * {c}5 + {c}8 - {c}0 - 2 * {c}3 - {c}6)", "({c}6 + 2 * {c}7 + {c}8 - {c}0 - 2 * {c}1 - {c}2)"
_SOBEL = f"case when a = 0 then 0 else cast(round_even(255 - least(255::double, sqrt(({_GX} * {_GX} + {_GY} * {_GY})::double) / 2), 0) as bigint) end as {{c}}"
_one("filter_find_edges", N.find_edges, PX + ", st as (select x, y, " + ", ".join(f"case when a = 0 then 0 else {c} end as {c}" for c in "rgb") + ", a from pe)" + _near("rgb", "st") + " select x, y, " + ", ".join(_SOBEL.format(c=c) for c in "rgb") + ", a from nb")
_MED = "list_sort([{0}])[5]"
_MEDS = {c: _MED.format(", ".join(f"{c}{i}" for i in range(9))) for c in "rgba"}


def _gauss(sigma: float) -> str:
    """CTE g2 with g_<c> by the same weights, rows first."""
    ws, sql, src = N.gaussian_weights(sigma), "", "g0"
    for axis, out in (("x", "g1"), ("y", "g2")):
        w = f"over (partition by {'y' if axis == 'x' else 'x'} order by {axis}"
        side = lambda c, k: f"(coalesce(lag({c}, {k}) {w}), first_value({c}) {w} rows between unbounded preceding and unbounded following)) + coalesce(lead({c}, {k}) {w}), last_value({c}) {w} rows between unbounded preceding and unbounded following)))"  # noqa: B023, E731
        sql += f", {out} as (select x, y, r, g, b, a, " + ", ".join(f"g_{c} * {ws[0]!r}::double + ({' + '.join(f'{side(f"g_{c}", k)} * {v!r}::double' for k, v in enumerate(ws) if k)}) as g_{c}" for c in "rgba") + f" from {src})"
        src = out
    return PX + ", g0 as (select *, (r * a)::double as g_r, (g * a)::double as g_g, (b * a)::double as g_b, (a * 255)::double as g_a from pe)" + sql


_one("filter_gaussian", N.gaussian, _gauss(0.6) + " select x, y, " + ", ".join(f"case when g_a <= 127.5 then 0 else cast(round_even(least(255::double, g_{c} * 255 / g_a), 0) as bigint) end as {c}" for c in "rgb") + ", case when g_a <= 127.5 then 0 else cast(round_even(g_a / 255, 0) as bigint) end as a from g2")
_one("filter_unsharp_mask", N.unsharp_mask, _gauss(0.6) + " select x, y, " + ", ".join(f"{_straight(f'(case when a > 0 and abs({c} * a - g_{c}) / a < 10 then ({c} * a)::double else {c} * a + 0.5::double * ({c} * a - g_{c}) end)')} as {c}" for c in "rgb") + ", a from g2")

# Selections.
_SEL = PX + f", s as (select x, y, {CIRCLE} as cov from pe)"


def _far(name: str, mark: str, reach: int) -> str:
    return f", {name} as (select p.x, p.y, min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d from s p join s q on q.cov {mark} and abs(p.x - q.x) <= {reach} and abs(p.y - q.y) <= {reach} group by 1, 2)"


_one("select_expand", lambda px: D.expand(R.circle(px)), _SEL + _far("f", ">= 128", 3) + " select s.x, s.y, case when d <= 9 then 255 else cov end as cov from s left join f on s.x = f.x and s.y = f.y")
_one("select_contract", lambda px: D.contract(R.circle(px)), _SEL + _far("f", "< 128", 3) + " select s.x, s.y, case when d <= 9 then 0 else cov end as cov from s left join f on s.x = f.x and s.y = f.y")
_one("select_border", lambda px: D.border(R.circle(px)), _SEL + _far("o", ">= 128", 2) + _far("i", "< 128", 2) + " select s.x, s.y, case when (case when cov >= 128 then i.d else o.d end) <= 4 then 255 else 0 end::bigint as cov from s left join o on s.x = o.x and s.y = o.y left join i on s.x = i.x and s.y = i.y")
_one("select_smooth", lambda px: SL.smoothed(T.color_mask(px, fuzziness=120)), PX + f", s as (select x, y, ({_byte('(1 - sqrt(((r - 120) * (r - 120) + (g - 90) * (g - 90) + (b - 60) * (b - 60))::double) / 180::double)')} >= 128)::bigint as o from pe)" + _near("o", "s") + f" select x, y, case when ({' + '.join(f'o{i}' for i in range(9))}) * 2 >= 9 then 255 else 0 end::bigint as cov from nb")

# Layers.


def _place(blend: str, cover: str, mask: str = "255", after: str = "{v}") -> str:
    """Orders over events, ``blend`` of {b} and {s}, coverage from sa (0...1) and cov."""
    base = PX + f""", j as (select coalesce(pe.x, po.x) as x, coalesce(pe.y, po.y) as y, pe.x is not null as old,
      {", ".join(f"case when coalesce(pe.a, 0) = 0 then 0::double else pe.{c} / 255::double end as b{c}, case when coalesce(po.a, 0) = 0 then 0::double else po.{c} / 255::double end as s{c}" for c in "rgb")},
      coalesce(pe.a, 0) / 255::double as ab, coalesce(po.a, 0) / 255::double as sa from pe full join po on pe.x = po.x and pe.y = po.y),
    m as (select *, {mask} as cov from j), k as (select *, {cover} as c from m)"""
    out = lambda c: f"(case when c + ab * (1 - c) <= 0 then 0::double else ((1 - c) * ab * b{c} + c * ((1 - ab) * s{c} + ab * ({blend.format(b=f'b{c}', s=f's{c}')}))) / (c + ab * (1 - c)) end)"
    return base + " select x, y, " + ", ".join(f"cast(floor(255 * {out(c) if after == '{v}' or c in after else f'b{c}'} + 0.5) as bigint) as {c}" for c in "rgb") + ", cast(floor(255 * (c + ab * (1 - c)) + 0.5) as bigint) as a from k"


def _fill(mode: str, neutral: str, fill: str) -> str:
    return BLEND_SQL[mode].format(b="{b}", s=f"({neutral} + ({{s}} - {neutral}) * {fill}::double)")


_two("layer_masked", lambda p, o: L.place(p, o, "multiply", mask=R.circle(p), density=0.75), _place("{b} * {s}", "sa * (1 - 0.75::double * (1 - cov / 255::double))", f"case when old then {CIRCLE} else 0 end"))
_two("layer_fill_linear_burn", lambda p, o: L.place(p, o, "linearBurn", fill=0.5), _place(_fill("linearBurn", "1::double", "0.5"), "sa"))
_two("layer_fill_difference", lambda p, o: L.place(p, o, "difference", opacity=0.9, fill=0.4), _place(_fill("difference", "0::double", "0.4"), "sa * 0.9::double"))
_two("layer_fill_hard_mix", lambda p, o: L.place(p, o, "hardMix", fill=0.5), _place(_unit("({b} + 0.5::double * {s} - 0.5::double) / 0.5::double"), "sa"))
_two("layer_channels", lambda p, o: L.place(p, o, "screen", channels="rb"), _place("{b} + {s} - {b} * {s}", "sa", after="rb"))
_L = "(0.3::double * {p}r + 0.59::double * {p}g + 0.11::double * {p}b)"
_RAMP = "(case when {v} < {0}::double then 0::double when {v} < {1}::double then ({v} - {0}::double) / ({1}::double - {0}::double) when {v} <= {2}::double then 1::double when {v} <= {3}::double then 1 - ({v} - {2}::double) / ({3}::double - {2}::double) else 0::double end)"
_two("layer_blend_if", lambda p, o: L.place(p, o, "normal", ranges=((0.125, 0.25, 0.75, 0.875), (0.0625, 0.5, 0.9375, 1.0))), _place("{s}", "sa * (" + _RAMP.format(0.125, 0.25, 0.75, 0.875, v=_L.format(p="s")) + " * " + _RAMP.format(0.0625, 0.5, 0.9375, 1.0, v=_L.format(p="b")) + ")"))
_NOISE = "(select xor(k, k >> 16) / 4294967296::double from (select cast((case when i >= 2147483648 then i - 4294967296 else i end)::double * 1274126177::double as bigint) & 4294967295 as k from (select xor(h, h >> 13) as i from (select (x * 374761393 + y * 668265263) & 4294967295 as h))))"
_two("blend_dissolve", lambda p, o: L.place(p, o, "dissolve", opacity=0.5), _place("{s}", f"case when {_NOISE} < sa * 0.5::double then 1::double else 0::double end"))
_two("layer_clipped", lambda p, o: L.clipped(p, o, R.invert(p), "multiply", "screen", 0.8, 0.5), PX + """, j as (select coalesce(pe.x, po.x) as x, coalesce(pe.y, po.y) as y, """ + ", ".join(f"case when coalesce(pe.a, 0) = 0 then 0::double else pe.{c} / 255::double end as b{c}, case when coalesce(po.a, 0) = 0 then 0::double else po.{c} / 255::double end as s{c}, case when coalesce(pe.a, 0) = 0 then 0::double else (255 - pe.{c}) / 255::double end as t{c}" for c in "rgb") + """, coalesce(pe.a, 0) / 255::double as ab, coalesce(po.a, 0) / 255::double * 0.8::double as c, coalesce(pe.a, 0) / 255::double * 0.5::double as ta from pe full join po on pe.x = po.x and pe.y = po.y),
m as (select *, """ + ", ".join(f"(1 - ta) * s{c} + ta * (s{c} + t{c} - s{c} * t{c}) as m{c}" for c in "rgb") + " from j) select x, y, " + ", ".join(f"cast(floor(255 * (case when c + ab * (1 - c) <= 0 then 0::double else ((1 - c) * ab * b{c} + c * ((1 - ab) * m{c} + ab * (b{c} * m{c}))) / (c + ab * (1 - c)) end) + 0.5) as bigint) as {c}" for c in "rgb") + ", cast(floor(255 * (c + ab * (1 - c)) + 0.5) as bigint) as a from m")
_one("layer_adjustment", lambda px: L.adjust_layer(px, R.invert, "normal", 0.7), PX + " select x, y, " + ", ".join(f"case when a = 0 then {c} else cast(floor(255 * ((1 - 0.7::double) * ({c} / 255::double) + 0.7::double * ((255 - {c}) / 255::double)) + 0.5) as bigint) end as {c}" for c in "rgb") + ", a from pe")
_one("layer_apply_mask", lambda px: L.apply_mask(px, R.rectangle(px), 0.5), PX + f" select x, y, r, g, b, cast(floor(a * (1 - 0.5::double * (1 - {RECT} / 255::double)) + 0.5) as bigint) as a from pe")
_one("layer_clear_selection", lambda px: L.clear(px, R.rectangle(px)), PX + f" select x, y, r, g, b, cast(floor(a * (255 - {RECT}) / 255::double + 0.5) as bigint) as a from pe")
