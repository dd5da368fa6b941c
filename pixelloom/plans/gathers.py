"""Registered distortions, resampling and transforms, and their SQL: taps joined with the source."""

from __future__ import annotations

import math

from pixelloom.operators import gather as G
from pixelloom.plans.filters import _BASE, _bytes, _hashes
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}

_PI = f"{math.pi!r}::double"


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


def _keys(d: str, a: float) -> str:
    return f"case when abs({d}) <= 1 then {a + 2}::double * abs({d}) * abs({d}) * abs({d}) - {a + 3}::double * abs({d}) * abs({d}) + 1 when abs({d}) < 2 then {a}::double * abs({d}) * abs({d}) * abs({d}) - {5 * a}::double * abs({d}) * abs({d}) + {8 * a}::double * abs({d}) - {4 * a}::double else 0::double end"


def _taps(of: str, method: str, edge: str) -> str:
    """CTE su: sums of the taps about (u, v) of the rows of ``of``, in order."""
    lo, hi = {"nearest": (0, 0), "bilinear": (0, 1)}.get(method, (-1, 2))
    if method == "nearest":
        wu = wv = "1::double"
    elif method == "bilinear":
        wu, wv = ("case when {k} = 1 then {c} - floor({c}) else 1 - ({c} - floor({c})) end".format(c=c, k=k) for c, k in (("u", "i"), ("v", "j")))
    else:
        wu, wv = (_keys(f"({c} - floor({c}) - {k})", G.SHARPNESS[method]) for c, k in (("u", "i"), ("v", "j")))
    base = "floor({c} + 0.5)" if method == "nearest" else "floor({c})"
    bx, by = (f"(cast({base.format(c=c)} as bigint) + {k})" for c, k in (("u", "i"), ("v", "j")))
    sx, sy = {"repeat": (f"greatest(0, least(mx, {bx}))", f"greatest(0, least(my, {by}))"), "wrap": (f"((({bx}) % (mx + 1) + mx + 1) % (mx + 1))", f"((({by}) % (my + 1) + my + 1) % (my + 1))"), "transparent": (bx, by)}[edge]
    return (
        f", tp as (select x, y, j * 4 + i as k, {sx} as sx, {sy} as sy, ({wu}) * ({wv}) as f from {of}, dm, range({lo}, {hi + 1}) s(i), range({lo}, {hi + 1}) t(j) where u is not null), "
        f"su as (select t.x, t.y, {', '.join(f'list_reduce(list(f * p.{c} order by k), lambda s, v: s + v, 0::double) as {c}' for c in 'rgba')} from tp t join pm p on p.x = t.sx and p.y = t.sy group by t.x, t.y)"
    )


def _distorted(u: str, v: str, moved: str = "true", edge: str = "repeat", ctes: str = "", of: str = "pe") -> str:
    """``u`` and ``v`` in terms of gx, gy, w, h, and of the ellipse: p, q, rx, ry, d (distance)."""
    return (
        _BASE + ctes + f", g1 as (select {of}.*, x + 0.5 as gx, y + 0.5 as gy, (mx + 1)::double as w, (my + 1)::double as h, greatest(1::double, (mx + 1) / 2::double) as rx, greatest(1::double, (my + 1) / 2::double) as ry from {of}, dm), "
        f"g2 as (select *, (gx - w / 2) / rx as p, (gy - h / 2) / ry as q from g1), g3 as (select *, sqrt(p * p + q * q) as d from g2), g4 as (select x, y, case when {moved} then {u} - 0.5 end as u, case when {moved} then {v} - 0.5 end as v from g3)"
        + _taps("g4", "distort", edge)
        + ", f as (select x, y, r, g, b, least(65025::double, greatest(0::double, a)) as a from su union all select x, y, r, g, b, a from pm where (x, y) in (select (x, y) from g4 where u is null))" + _bytes("f")
    )


_IN = "d < 1 and d <> 0"
_scaled = lambda k: (f"w / 2 + p * ({k}) * rx", f"h / 2 + q * ({k}) * ry")
for _amount in (50, -40):
    _one(f"distort_pinch_{abs(_amount)}", lambda px, a=_amount: G.pinch(px, a), _distorted(*_scaled(f"power(sin({_PI} / 2 * d), {-_amount / 100!r}::double)"), _IN))
_arc = lambda r: f"{r} + (asin({r}) * (2 / {_PI}) - {r}) * 0.8::double"
_sag = lambda r: f"{r} + (sin({r} * {_PI} / 2) - {r}) * 0.6::double"
_one("distort_spherize", lambda px: G.spherize(px, 80), _distorted(*_scaled(f"({_arc('d')}) / d"), _IN))
_one("distort_spherize_inward", lambda px: G.spherize(px, -60), _distorted(*_scaled(f"({_sag('d')}) / d"), _IN))
_one("distort_spherize_horizontal", lambda px: G.spherize(px, 80, "h"), _distorted(f"w / 2 + sign(p) * ({_arc('abs(p)')}) * rx", "gy", "abs(p) < 1"))
_one("distort_spherize_vertical", lambda px: G.spherize(px, 80, "v"), _distorted("gx", f"h / 2 + sign(q) * ({_arc('abs(q)')}) * ry", "abs(q) < 1"))
_t = f"(-{math.radians(120)!r}::double * (1 - d) * (1 - d))"
_one("distort_twirl", lambda px: G.twirl(px, 120), _distorted(f"w / 2 + (p * cos({_t}) - q * sin({_t})) * rx", f"h / 2 + (p * sin({_t}) + q * cos({_t})) * ry", "d < 1"))
_wave = f"sin(2 * {_PI} * 4 * d) * (1 - d)"
for _style in ("around", "out", "pond"):
    _turn = "atan2(q, p)" + (f" + {_wave} * {60 / 100 * 0.35!r}::double" if _style != "out" else "")
    _far = "d" + (f" + {_wave} * {60 / 100 * 0.06!r}::double" if _style != "around" else "")
    _one(f"distort_zigzag_{_style}", lambda px, style=_style: G.zigzag(px, 60, 4, style), _distorted(f"w / 2 + cos({_turn}) * ({_far}) * rx", f"h / 2 + sin({_turn}) * ({_far}) * ry", _IN))
_turn = f"(atan2(p, -q) / (2 * {_PI}))"
_one("distort_to_polar", G.polar, _distorted(f"case when {_turn} < 0 then {_turn} + 1 else {_turn} end * w", "least(1::double, d) * h"))
_one("distort_from_polar", lambda px: G.polar(px, False), _distorted(f"w / 2 + sin(gx / w * (2 * {_PI})) * (gy / h) * rx", f"h / 2 - cos(gx / w * (2 * {_PI})) * (gy / h) * ry"))
_h, _of = _hashes("pe", ("n0", "cast(floor((y + 0.5) / 16) as bigint)", "0", 5), ("n1", "cast(floor((x + 0.5) / 16) as bigint)", "1", 5))
_one("distort_ripple", lambda px: G.ripple(px, 90), _distorted(f"gx + 3.6::double * sin(2 * {_PI} * gy / 16 + (n0 - 0.5) * 0.6::double)", f"gy + 3.6::double * sin(2 * {_PI} * gx / 16 + (n1 - 0.5) * 0.6::double)", ctes=_h, of=_of))
_y = "least(1::double, greatest(0::double, gy / h))"
for _edge in ("wrap", "repeat"):
    _one(f"distort_shear_{_edge}", lambda px, edge=_edge: G.shear(px, 5, 25, -10, edge), _distorted(f"gx - (0.05::double * (1 - {_y}) * (1 - 2 * {_y}) + 4 * 0.25::double * {_y} * (1 - {_y}) + -0.1::double * {_y} * (2 * {_y} - 1)) * w", "gy", edge=_edge))



def _waved(every: list, kind: str, c: str, k: int) -> str:
    f = lambda t: f"(({t}) - floor({t}))"
    shape = {"sine": lambda t: f"sin(2 * {_PI} * {f(t)})", "triangle": lambda t: f"(4 * abs({f(t)} - 0.5) - 1)", "square": lambda t: f"(case when {f(t)} < 0.5 then 1::double else -1::double end)"}[kind]
    return "(0::double + " + " + ".join(f"{shape(f'{c} / {n!r}::double + {p[k]!r}::double')} * {a!r}::double" for n, a, *p in every) + f") / {len(every)}"


for _kind, _edge, _n in (("sine", "repeat", 5), ("triangle", "wrap", 3), ("square", "repeat", 2)):
    _every = G.waves(_n, (8, 40), (3, 12), 6)
    _one(f"distort_wave_{_kind}", lambda px, kind=_kind, edge=_edge, n=_n: G.wave(px, n, (8, 40), (3, 12), (90, 60), kind, edge, 6), _distorted(f"gx + {_waved(_every, _kind, 'gy', 0)} * 0.9::double", f"gy + {_waved(_every, _kind, 'gx', 1)} * 0.6::double", edge=_edge))

_STRAIGHT = ", sa as (select *, least(65025::double, greatest(0::double, a)) as k from su) select x, y, " + ", ".join(f"cast(floor(least(1::double, least(k, greatest(0::double, {c})) / k) * 255 + 0.5) as bigint) as {c}" for c in "rgb") + ", cast(floor(k / 255 + 0.5) as bigint) as a from sa where k > 0"
for _method in ("nearest", "bilinear", "bicubic", "bicubicSmoother", "bicubicSharper"):
    _one(
        f"geometry_resample_{_method}", lambda px, m=_method: G.resample(px, 0.7, 1.3, m),
        _BASE + ", spots as (select i::bigint as x, j::bigint as y, (i + 0.5) / 0.7::double - 0.5 as u, (j + 0.5) / 1.3::double - 0.5 as v from dm, range(0, 1000) s(i), range(0, 2000) t(j) where i < ceil((mx + 1) * 0.7::double) and j < ceil((my + 1) * 1.3::double))" + _taps("spots", _method, "transparent") + _STRAIGHT,
    )
_M = (0.8, 0.35, -0.45, 1.1, 12.25, -7.5)
_det = _M[0] * _M[3] - _M[1] * _M[2]
_gx, _gy = f"(x + 0.5 - {_M[4]}::double)", f"(y + 0.5 - {_M[5]}::double)"
for _method in ("bilinear", "bicubic"):
    _one(
        f"geometry_transform_{_method}", lambda px, m=_method: G.transform(px, _M, m),
        _BASE + f", spots as (select x, y, ({_M[3]}::double * {_gx} - {_M[2]}::double * {_gy}) / {_det!r}::double - 0.5 as u, ({_M[0]}::double * {_gy} - {_M[1]}::double * {_gx}) / {_det!r}::double - 0.5 as v from pe)" + _taps("spots", _method, "transparent") + _STRAIGHT,
    )
_one("geometry_shift", lambda px: G.transform(px, (1, 0, 0, 1, 17, -3)), _BASE + " select x + 17 as x, y - 3 as y, r, g, b, a from pe, dm where x + 17 <= mx and y >= 3 and a > 0")
