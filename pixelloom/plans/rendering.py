"""Registered despeckling, surface blur, wind, clouds and the rest of the sharpening family, and their SQL."""

from __future__ import annotations

from pixelloom.operators import tiled as N
from pixelloom.operators import stencils as S
from pixelloom.plans.filters import _BASE, _after, _byte, _even, _hashes, _near
from pixelloom.plans.filters import _straight as _colored
from pixelloom.plans.more import _gauss, _straight, _unit
from pixelloom.plans.queries import PX
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


_one(
    "filter_despeckle", S.despeckle,
    _BASE + _near("st", 1) + f", m as (select x, y, {', '.join(f'list_sort(list({c}))[5] as m{c}' for c in 'rgb')}, greatest(0::double, 1 - (max(r * 30 + g * 59 + b * 11) - min(r * 30 + g * 59 + b * 11)) / 25500::double / 0.25::double) as k from nb group by x, y), "
    f"f as (select x, y, {', '.join(f'{_even(f"s.{c} + (m{c} - s.{c}) * k")} as {c}' for c in 'rgb')}, a from st s join m using (x, y))" + _colored("f"),
)
_w = lambda c: f"greatest(0::double, 1 - abs(q.{c} - p.{c}) / 50::double) * q.a"
_sum = lambda v: f"list_reduce(list({v} order by dy, dx), lambda s, v: s + v, 0::double)"
_one(
    "filter_surface_blur", lambda px: S.surface_blur(px, 2, 20),
    _BASE + ", ofs as (select i as dx, j as dy from range(-2, 3) s(i), range(-2, 3) t(j)), m as (select p.x, p.y, " + ", ".join(f"{_sum(f'q.{c} * ({_w(c)})')} as s{c}, {_sum(_w(c))} as w{c}" for c in "rgb") + " from st p, ofs, dm join st q on q.x = greatest(0, least(mx, p.x + dx)) and q.y = greatest(0, least(my, p.y + dy)) group by p.x, p.y), "
    f"f as (select x, y, {', '.join(f'{_even(f"case when w{c} > 0 then s{c} / w{c} else s.{c} end")} as {c}' for c in 'rgb')}, a from st s join m using (x, y))" + _colored("f"),
)
_one("filter_sharpen_edges", N.sharpen_edges, _gauss(1.0) + " select x, y, " + ", ".join(f"{_straight(f'(case when a > 0 and abs({c} * a - g_{c}) / a < 8 then ({c} * a)::double else {c} * a + 1.0::double * ({c} * a - g_{c}) end)')} as {c}" for c in "rgb") + ", a from g2")
_one("filter_high_pass", N.high_pass, _gauss(2.0) + " select x, y, " + ", ".join(f"case when a = 0 then 0 else {_byte(f'(({c} - g_{c} * 255 / g_a) / 255 + 0.5)')} end as {c}" for c in "rgb") + ", a from g2")

_h, _t = _hashes("st", ("u", "1", "y", 1))
for _name, _blast, _right in (("wind", False, True), ("blast", True, False)):
    _fade = "ln(0.985::double)" if _blast else "ln(0.93::double + u * 0.05::double)"
    _k, _order = ("-x", "x desc") if _right else ("x", "x")
    _carried = lambda c: f"exp(max(case when {c} > 0 then ln({c}::double) - k * fade end) over (partition by y order by {_order} rows unbounded preceding) + k * fade)"  # noqa: B023, E731
    _one(
        f"filter_{_name}", lambda px, blast=_blast, right=_right: S.wind(px, blast, right),
        _BASE + _h + f", w as (select *, {_fade} as fade, {_k} as k from {_t}), f as (select x, y, {', '.join(f'{_even(f"coalesce(greatest({c}::double, {_carried(c)}), 0::double)")} as {c}' for c in 'rgb')}, a from w)" + _colored("f"),
    )
_h, _t = _hashes("st", ("u", "0", "y", 1))
_one("filter_stagger", S.stagger, _BASE + _h + f" select p.x, p.y, q.r, q.g, q.b, q.a from {_t} p, dm join st q on q.y = p.y and q.x = greatest(0, least(mx, p.x + cast(floor(p.u * 12) as bigint)))")


def _fractal(of: str, scale: int, seed: int, sx: str = "1", sy: str = "1") -> tuple[str, str]:
    """CTEs with fv, octaves of lattice noise; every corner's hash is a column."""
    steps, fields, parts = [scale >> k for k in range(scale.bit_length())], [], []
    for k, s in enumerate(steps):
        x, y = f"(x * {sx} / {s}::double)", f"(y * {sy} / {s}::double)"
        for i in (0, 1):
            for j in (0, 1):
                fields.append((f"n{k}{i}{j}", f"((cast(floor({x}) as bigint) + {i}) % 256)", f"((cast(floor({y}) as bigint) + {j}) % 256)", seed + s))
        ease = lambda v: f"(({v} - floor({v})) * ({v} - floor({v})) * (3 - 2 * ({v} - floor({v}))))"
        row = lambda j: f"(n{k}0{j} + (n{k}1{j} - n{k}0{j}) * {ease(x)})"  # noqa: B023, E731
        parts.append(f"({row(0)} + ({row(1)} - {row(0)}) * {ease(y)}) * {0.5 ** (k + 1)!r}::double")
    ctes, last = _hashes(of, *fields)
    return ctes + f", fr as (select *, ({' + '.join(parts)}) / {sum(0.5 ** (k + 1) for k in range(len(steps)))!r}::double as fv from {last})", "fr"


_front, _back = (0.1, 0.2, 0.4), (0.9, 0.95, 1.0)
_mixed = lambda c: f"({_front['rgb'.index(c)]}::double + {_back['rgb'.index(c)] - _front['rgb'.index(c)]!r}::double * t)"
_opaque = " select x, y, " + ", ".join(f"{_even(f'{_mixed(c)} * 255')} as {c}" for c in "rgb") + ", 255::bigint as a from cl"
_ct, _last = _fractal("st", 256, 3)
for _name, _gain, _contrast in (("clouds", "2.2", False), ("clouds_contrast", "4", True)):
    _one(f"render_{_name}", lambda px, contrast=_contrast: S.clouds(px, _front, _back, 3, contrast), _BASE + _ct + f", cl as (select *, {_unit(f'0.5 + (fv - 0.5) * {_gain}::double')} as t from {_last})" + _opaque)
_one("render_difference_clouds", lambda px: S.difference_clouds(px, _front, _back, 3), _BASE + _ct + f", cl as (select *, {_unit('0.5 + (fv - 0.5) * 2.2::double')} as t from {_last})" + _after(lambda c: _byte(f"abs({c} / 255::double - {_mixed(c)})"), "cl"))
_ct, _last = _fractal("st", 32, 4, "4", f"{1 / (3 * (1 + 16 / 20))!r}::double")
_one("render_fibers", lambda px: S.fibers(px, 20, 3, _front, _back, 4), _BASE + _ct + f", cl as (select *, {_unit('0.5 + (fv - 0.5) * 2.75::double')} as t from {_last})" + _opaque)
