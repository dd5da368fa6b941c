"""Registered filters on neighbourhoods and their SQL: neighbours by joins on clamped coordinates."""

from __future__ import annotations

import math

from pixelloom.functions.painting import FILTER_HASH
from pixelloom.operators import stencils as S
from pixelloom.plans.more import _unit
from pixelloom.plans.queries import PX
from pixelloom.plans.scalars import _imul
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


_BASE = PX + """, st as (select x, y, case when a = 0 then 0 else r end as r, case when a = 0 then 0 else g end as g, case when a = 0 then 0 else b end as b, a from pe),
  pm as (select x, y, r * a as r, g * a as g, b * a as b, a * 255 as a from pe), dm as (select max(x) as mx, max(y) as my from pe)"""


def _near(source: str, reach: int, keep: str = "") -> str:
    """CTE nb: each pixel with those around it, coordinates clamped, by (dx, dy)."""
    return f", ofs as (select i as dx, j as dy from range({-reach}, {reach + 1}) a(i), range({-reach}, {reach + 1}) c(j){' where ' + keep if keep else ''}), nb as (select p.x, p.y, dx, dy, q.r, q.g, q.b, q.a from pe p, ofs, dm join {source} q on q.x = greatest(0, least(mx, p.x + dx)) and q.y = greatest(0, least(my, p.y + dy)))"


_even = lambda v: f"cast(round_even({v}, 0) as bigint)"


def _bytes(source: str) -> str:
    """Straight bytes of premultiplied r, g, b, a."""
    return f" select x, y, {', '.join(f'case when a <= 127.5 then 0 else {_even(f"least(a, greatest(0, {c})) * 255 / a::double")} end as {c}' for c in 'rgb')}, case when a <= 127.5 then 0 else {_even('a / 255::double')} end as a from {source}"


def _straight(source: str) -> str:
    return f" select x, y, {', '.join(f'case when a = 0 then 0 else {c} end as {c}' for c in 'rgb')}, a from {source}"


def _kernel(weights: list[int]) -> tuple[int, str]:
    reach = math.isqrt(len(weights)) // 2
    return reach, f"[{', '.join(map(str, weights))}][((dy + {reach}) * {2 * reach + 1} + dx + {reach} + 1)::int]"


def _convolved(weights: list[int], scale: float, offset: float = 0, alpha: bool = False) -> str:
    reach, w = _kernel(weights)
    a = f"least(65025::double, greatest(0::double, sum(a * {w}) / {scale}::double + {offset * 255}))" if alpha else "max(case when dx = 0 and dy = 0 then a end)::double"
    return _BASE + _near("pm", reach) + f", s as (select x, y, {', '.join(f'sum({c} * {w}) / {scale}::double as s{c}' for c in 'rgb')}, {a} as a from nb group by x, y), f as (select x, y, {', '.join(f's{c} + a * {offset / 255!r}::double as {c}' for c in 'rgb')}, a from s)" + _bytes("f")


_ROW = (1, 4, 6, 4, 1)
_CUSTOM = [0, 0, -1, 0, 0, 0, -1, -2, -1, 0, -1, -2, 19, -2, -1, 0, -1, -2, -1, 0, 0, 0, -1, 0, 0]
_one("filter_blur", S.blur, _convolved([1, 2, 1, 2, 4, 2, 1, 2, 1], 16, alpha=True))
_one("filter_blur_more", S.blur_more, _convolved([p * q for p in _ROW for q in _ROW], 256, alpha=True))
_one("filter_custom", lambda px: S.convolve(px, _CUSTOM, 3, 11), _convolved(_CUSTOM, 3, 11))
for _r in (1, 3):
    _one(f"filter_box_blur_{_r}", lambda px, r=_r: S.box_blur(px, r), _BASE + _near("pm", _r) + f", f as (select x, y, {', '.join(f'sum({c}) / {(2 * _r + 1) ** 2}::double as {c}' for c in 'rgba')} from nb group by x, y)" + _bytes("f"))
    _one(f"filter_median_{_r}", lambda px, r=_r: S.median(px, r), _BASE + _near("st", _r) + f", f as (select x, y, {', '.join(f'list_sort(list({c}))[{(2 * _r + 1) ** 2 // 2 + 1}] as {c}' for c in 'rgba')} from nb group by x, y)" + _straight("f"))
    for _n, _agg, _big in (("maximum", "max", True), ("minimum", "min", False)):
        for _shape, _keep in (("square", ""), ("disc", f"i * i + j * j <= {_r * _r}")):
            _one(f"filter_{_n}_{_shape}_{_r}", lambda px, r=_r, big=_big, disc=_shape == "disc": S.extreme(px, r, big, disc), _BASE + _near("pm", _r, _keep) + f", f as (select x, y, {', '.join(f'{_agg}({c}) as {c}' for c in 'rgba')} from nb group by x, y)" + _bytes("f"))
_one("filter_fragment", S.fragment, _BASE + _near("pm", 4, "(abs(i) = 4 and j = 0) or (abs(j) = 4 and i = 0)") + f", f as (select x, y, {', '.join(f'sum({c}) / 4::double as {c}' for c in 'rgba')} from nb group by x, y)" + _bytes("f"))
_one("filter_dust_scratches", lambda px: S.dust_and_scratches(px, 2, 25), _BASE + _near("st", 2) + f", m as (select x, y, {', '.join(f'list_sort(list({c}))[13] as m{c}' for c in 'rgb')} from nb group by x, y), f as (select x, y, {', '.join(f'case when abs(s.{c} - m{c}) > 25 then m{c} else s.{c} end as {c}' for c in 'rgb')}, a from st s join m using (x, y))" + _straight("f"))
_one("filter_mosaic", lambda px: S.mosaic(px, 7), _BASE + f", m as (select floor(x / 7) as cx, floor(y / 7) as cy, {', '.join(f'avg({c}) as {c}' for c in 'rgba')} from pm group by 1, 2), f as (select p.x, p.y, m.r, m.g, m.b, m.a from pm p join m on floor(p.x / 7) = cx and floor(p.y / 7) = cy)" + _bytes("f"))
_one("filter_average", S.average, _BASE + f", m as (select {', '.join(f'sum({c} * a) / sum(a)::double as m{c}' for c in 'rgb')} from pe) select x, y, {', '.join(f'case when a = 0 then 0 else {_even(f"m{c}")} end as {c}' for c in 'rgb')}, a from pe, m")


def _hash_steps(name: str, of: str, x: str, y: str, seed: int) -> tuple[str, str]:
    """CTE that adds ``name``, position noise of (x, y), to the rows of ``of``."""
    p = [f"({_imul(f'(({v}) & 4294967295)', k)})" for v, k in ((x, FILTER_HASH[0]), (y, FILTER_HASH[1]), (str(seed), FILTER_HASH[2]))]
    a, b = f"{name}_a", f"{name}_b"
    return f", {a} as (select *, xor(xor({p[0]}, {p[1]}), {p[2]}) as {a}h from {of}), {b} as (select *, {_imul(f'(xor({a}h, {a}h >> 13))', 1274126177)} as {b}h from {a}), {name}_c as (select *, xor({b}h, {b}h >> 16) / 4294967296::double as {name} from {b})", f"{name}_c"


def _hashes(of: str, *fields: tuple[str, str, str, int]) -> tuple[str, str]:
    out = ""
    for f in fields:
        more, of = _hash_steps(f[0], of, *f[1:])
        out += more
    return out, of


_byte = lambda v: _even(f"{_unit(v)} * 255")
_after = lambda form, of: f" select x, y, {', '.join(f'case when a = 0 then 0 else {form(c)} end as {c}' for c in 'rgb')}, a from {of}"
for _mono in (False, True):
    _h, _t = _hashes("st", *((f"n{c}", "x", "y", 21 + (0 if _mono else 2 * k)) for k, c in enumerate("rgb")))
    _one("filter_add_noise" + ("_mono" if _mono else ""), lambda px, mono=_mono: S.add_noise(px, 40, mono, 3), _BASE + _h + _after(lambda c: _byte(f"{c} / 255::double + (n{c} - 0.5) * 0.4::double"), _t))
_h, _t = _hashes("st", *((f"{p}{c}", "x", "y", 21 + 2 * k + n) for k, c in enumerate("rgb") for n, p in enumerate("uv")))
_one("filter_add_noise_gaussian", lambda px: S.add_noise(px, 40, False, 3, gaussian=True), _BASE + _h + _after(lambda c: _byte(f"{c} / 255::double + sqrt(-2 * ln(greatest(1e-12::double, u{c}))) * cos({2 * math.pi!r}::double * v{c}) * 0.1::double"), _t))
for _kind, _fields in {
    "mediumDots": [(f"n{c}", "cast(floor(x / 2) as bigint)", "cast(floor(y / 2) as bigint)", 1 + k) for k, c in enumerate("rgb")],
    "grainyDots": [(f"{p}{c}", f"cast(floor(x / {n}) as bigint)", f"cast(floor(y / {n}) as bigint)", 1 + k + e) for k, c in enumerate("rgb") for p, n, e in (("p", 1, 0), ("q", 2, 9))],
    "mediumLines": [(f"n{c}", "cast(floor(x / 10) as bigint)", "y", 1 + 3 * k) for k, c in enumerate("rgb")],
    "shortStrokes": [(f"n{c}", "cast(floor((x + y) / 4) as bigint)", "x - y", 1 + 3 * k) for k, c in enumerate("rgb")],
}.items():
    _h, _t = _hashes("st", *_fields)
    _level = (lambda c: f"(0.5 * p{c} + 0.5 * q{c})") if _kind == "grainyDots" else (lambda c: f"n{c}")
    _one(f"filter_mezzotint_{_kind}", lambda px, kind=_kind: S.mezzotint(px, kind), _BASE + _h + _after(lambda c, level=_level: f"case when {c} / 255::double > {level(c)} then 255 else 0 end", _t))

_LUM = "(r * 30 + g * 59 + b * 11)"
_h, _t = _hashes("st", ("u", "x", "y", 5), ("v", "x", "y", 6))
for _mode, _test in (("normal", "true"), ("darken", "q.l < p.l"), ("lighten", "q.l > p.l")):
    _one(
        f"filter_diffuse_{_mode}", lambda px, mode=_mode: S.diffuse(px, mode, 5),
        _BASE + _h + f", l as (select *, {_LUM} as l from {_t}), f as (select p.x, p.y, {', '.join(f'case when {_test} then q.{c} else p.{c} end as {c}' for c in 'rgba')} from l p, dm join l q on q.x = greatest(0, least(mx, p.x + cast(floor(p.u * 3) as bigint) - 1)) and q.y = greatest(0, least(my, p.y + cast(floor(p.v * 3) as bigint) - 1)))" + _straight("f"),
    )
_PLACES = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
_h, _t = _hashes("st", *((f"u{k}", "x", "y", 5 + k) for k in range(8)))
_one(
    "filter_diffuse_anisotropic", lambda px: S.diffuse(px, "anisotropic", 5),
    _BASE + _h + f", l as (select *, {_LUM} as l, [{', '.join(f'u{k}' for k in range(8))}] as us from {_t}), way as (select unnest([{', '.join(f'{{k: {k}, dx: {x}, dy: {y}}}' for k, (x, y) in enumerate(_PLACES))}], recursive := true)), "
    "c as (select p.x, p.y, k, abs(q.l - p.l) / 25500::double + p.us[k + 1] * 1e-3::double as d, q.r, q.g, q.b, q.a from l p, way, dm join l q on q.x = greatest(0, least(mx, p.x + dx)) and q.y = greatest(0, least(my, p.y + dy))), f as (select x, y, r, g, b, a from c qualify row_number() over (partition by x, y order by d, k) = 1)" + _straight("f"),
)
for _edge, _op, _no in (("lower", "<", ">="), ("upper", ">=", "<")):
    _one(
        f"filter_trace_contour_{_edge}", lambda px, low=_edge == "lower": S.trace_contour(px, 120, low),
        _BASE + _near("st", 1, "abs(i) + abs(j) = 1") + f", m as (select x, y, {', '.join(f'bool_or({c} {_no} 120) as m{c}' for c in 'rgb')} from nb group by x, y), f as (select x, y, {', '.join(f'case when s.{c} {_op} 120 and m{c} then 0 else 255 end as {c}' for c in 'rgb')}, a from st s join m using (x, y))" + _straight("f"),
    )
_QUAD = "select p.x, p.y, k, count(*) as n, sum(q.r)::double as r, sum(q.g)::double as g, sum(q.b)::double as b, sum(q.r * q.r + q.g * q.g + q.b * q.b)::double as q from st p, (select k, (k % 2 - 1) * 2 as x0, (k // 2 - 1) * 2 as y0 from range(0, 4) t(k)) z join st q on q.x between p.x + x0 and p.x + x0 + 2 and q.y between p.y + y0 and p.y + y0 + 2 group by p.x, p.y, k"
_one(
    "filter_facet", S.kuwahara,
    _BASE + f", z as ({_QUAD}), w as (select *, q / n - ((r / n) * (r / n) + (g / n) * (g / n) + (b / n) * (b / n)) as v from z), m as (select x, y, {', '.join(f'{_even(f"{c} / n")} as {c}' for c in 'rgb')} from w qualify row_number() over (partition by x, y order by v, k) = 1), f as (select x, y, m.r, m.g, m.b, s.a from m join st s using (x, y))" + _straight("f"),
)


def _tap(sign: int) -> str:
    """Luminance between four pixels at a fixed offset, by their weights."""
    dx, dy = math.cos(math.radians(135)) * 1.5 * sign, -math.sin(math.radians(135)) * 1.5 * sign
    x0, y0 = math.floor(dx), math.floor(dy)
    tx, ty = dx - x0, dy - y0
    at = lambda c, i, j: f"max(case when dx = {x0 + i} and dy = {y0 + j} then {c} end)::double"
    mix = lambda p, q, t: f"({p} + ({q} - {p}) * {t!r}::double)"
    s = {c: mix(mix(at(c, 0, 0), at(c, 1, 0), tx), mix(at(c, 0, 1), at(c, 1, 1), tx), ty) for c in "rgba"}
    return f"case when {s['a']} > 0 then (0.3::double * {s['r']} + 0.59::double * {s['g']} + 0.11::double * {s['b']}) / {s['a']} else 0::double end"


_one(
    "filter_emboss", lambda px: S.emboss(px, 135, 3, 150),
    _BASE + _near("pm", 3) + f", t as (select x, y, {_tap(-1)} as l1, {_tap(1)} as l2 from nb group by x, y), f as (select x, y, {', '.join(f'{_even(f"{_unit('0.5 + 1.5::double * (l1 - l2)')} * 255")} as {c}' for c in 'rgb')}, a from t join pe using (x, y))" + _straight("f"),
)
for _odd, _interp in ((True, True), (False, False)):
    _new = (lambda c: f"(u.{c} + d.{c}) / 2::double") if _interp else (lambda c: f"u.{c}::double")
    _one(
        f"filter_deinterlace_{'odd' if _odd else 'even'}", lambda px, odd=_odd, interp=_interp: S.deinterlace(px, odd, interp),
        _BASE + f", f as (select p.x, p.y, {', '.join(f'case when p.y % 2 = {0 if _odd else 1} then {_new(c)} else p.{c} end as {c}' for c in 'rgba')} from pm p, dm join pm u on u.x = p.x and u.y = greatest(0, p.y - 1) join pm d on d.x = p.x and d.y = least(my, p.y + 1))" + _bytes("f"),
    )
_one(
    "filter_ntsc", S.ntsc,
    PX + ", u as (select x, y, a, r / 255::double as fr, g / 255::double as fg, b / 255::double as fb from pe), w as (select *, 0.299::double * fr + 0.587::double * fg + 0.114::double * fb as py, 0.596::double * fr - 0.274::double * fg - 0.322::double * fb as pi, 0.211::double * fr - 0.523::double * fg + 0.312::double * fb as pq from u), "
    "k as (select *, sqrt(pi * pi + pq * pq) as ch, least(1.2::double - py, py + 0.2::double) as lim from w), m as (select *, case when ch > lim and ch > 0 then greatest(0::double, lim) / ch else 1::double end as k from k), n as (select x, y, a, py + 0.956::double * (pi * k) + 0.621::double * (pq * k) as r, py - 0.272::double * (pi * k) - 0.647::double * (pq * k) as g, py - 1.106::double * (pi * k) + 1.703::double * (pq * k) as b from m)"
    + _after(_byte, "n"),
)
for _edge, _sql in {
    "wrap": "select (x + 13) % (mx + 1) as x, (y - 4 + my + 1) % (my + 1) as y, r, g, b, a from st, dm",
    "repeat": "select p.x, p.y, q.r, q.g, q.b, q.a from pe p, dm join st q on q.x = greatest(0, least(mx, p.x - 13)) and q.y = greatest(0, least(my, p.y + 4))",
    "transparent": "select p.x, p.y, coalesce(q.r, 0) as r, coalesce(q.g, 0) as g, coalesce(q.b, 0) as b, coalesce(q.a, 0) as a from pe p left join st q on q.x = p.x - 13 and q.y = p.y + 4",
}.items():
    _one(f"filter_offset_{_edge}", lambda px, edge=_edge: S.offset(px, 13, -4, edge), _BASE + " " + _sql)

# Channels as another colour model.
_HB = ", u as (select x, y, a, r / 255::double as fr, g / 255::double as fg, b / 255::double as fb from pe), v as (select *, greatest(fr, fg, fb) as hi, least(fr, fg, fb) as lo from u), w as (select *, case when hi = lo then 0::double when hi = fr then 60 * (((fg - fb) / (hi - lo) + 6) % 6) when hi = fg then 60 * ((fb - fr) / (hi - lo) + 2) else 60 * ((fr - fg) / (hi - lo) + 4) end as h from v)"
_one("filter_hsb_from_rgb", S.hsb_hsl, PX + _HB + ", n as (select x, y, a, h / 360 as r, case when hi = 0 then 0::double else (hi - lo) / hi * 100 end / 100 as g, hi * 100 / 100 as b from w)" + _after(_byte, "n"))
_one("filter_hsl_from_rgb", lambda px: S.hsb_hsl(px, "rgb", "hsl"), PX + _HB + ", n as (select x, y, a, h / 360 as r, case when hi = lo then 0::double else (hi - lo) / (1 - abs(2 * ((hi + lo) / 2) - 1)) end as g, (hi + lo) / 2 as b from w)" + _after(_byte, "n"))
_hv = lambda n: f"b / 255::double * 100 / 100 - b / 255::double * 100 / 100 * (g / 255::double * 100 / 100) * greatest(0::double, least((r / 255::double * 360 / 60 + {n}) % 6, 4 - (r / 255::double * 360 / 60 + {n}) % 6, 1::double))"
_one("filter_rgb_from_hsb", lambda px: S.hsb_hsl(px, "hsb", "rgb"), PX + f", n as (select x, y, a, {_hv(5)} as r, {_hv(3)} as g, {_hv(1)} as b from pe)" + _after(_byte, "n"))
