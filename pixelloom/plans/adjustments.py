"""Registered adjustments with all their parameters, gradients and tables, and their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pixelloom.functions import geometry, ramps
from pixelloom.operators import adjust as A
from pixelloom.plans.colors import _HSL, _N, _U, _out
from pixelloom.plans.more import _HIST, _RANGE, _byte, _unit
from pixelloom.plans.queries import PX, _point_sql
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


def _round(v) -> np.ndarray:
    return np.floor(np.asarray(v, float) + 0.5).astype(int)


def _list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _spline(points: list[tuple[float, float]]) -> list[int]:
    """The natural spline from the dense system of its second derivatives."""
    x, y = (np.array(v) for v in zip(*points, strict=True))
    n, h = len(x), np.diff(x)
    m, rhs = np.eye(n), np.zeros(n)
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        rhs[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    d = np.linalg.solve(m, rhs)
    t = np.clip(np.arange(256) / 255, x[0], x[-1])
    k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 2)
    a, b = (x[k + 1] - t) / h[k], (t - x[k]) / h[k]
    return _round(np.clip(a * y[k] + b * y[k + 1] + ((a**3 - a) * d[k] + (b**3 - b) * d[k + 1]) * h[k] ** 2 / 6, 0, 1) * 255).tolist()


_LEVELS = {"master": (10, 0.8, 240, 5, 250), "red": (20, 1.4, 220, 0, 255), "green": (0, 1.0, 255, 30, 200), "blue": (40, 0.5, 200, 0, 255)}
_level = lambda v, of: f"floor({of[3]} + {of[4] - of[3]} * power({_unit(f'({v} - {of[0]}) / {of[2] - of[0]}::double')}, {1 / of[1]!r}::double) + 0.5)"
_one("adjust_levels_channels", lambda px: A.levels(px, **_LEVELS), _point_sql(**{c: _level(_level(c, _LEVELS[n]), _LEVELS["master"]) for c, n in zip("rgb", ("red", "green", "blue"), strict=True)}))

_M, _R, _G = [(0.0, 0.05), (0.3, 0.2), (0.7, 0.85), (1.0, 0.95)], [(0.1, 0.0), (0.5, 0.6), (0.9, 1.0)], [(0.0, 1.0), (1.0, 0.0)]
_B = [min(255, (i // 16) * 17) for i in range(256)]
_line = lambda pts: _round(np.interp(np.arange(256) / 255, *zip(*pts, strict=True)) * 255).tolist()
_one(
    "adjust_curves", lambda px: A.curves(px, [*_M, (0.3, 0.1), (0.3, 0.2)], _R, _G, _B),
    _point_sql(**{c: f"{_list(_spline(_M))}[({_list(t)}[({c} + 1)::int] + 1)::int]" for c, t in (("r", _spline(_R)), ("g", _line(_G)), ("b", _B))}),
)


def _luminance(p: str) -> str:
    return f"(0.3::double * {p}r + 0.59::double * {p}g + 0.11::double * {p}b)"


def _keep(new: dict[str, str]) -> str:
    """CTE n with nr, ng, nb: new unit colours with the luminance of the old ones."""
    return (
        ", o as (select *, " + ", ".join(f"{new[c]} as k{c}" for c in "rgb") + " from v), p as (select *, " + ", ".join(f"k{c} + ({_luminance('f')} - {_luminance('k')}) as p{c}" for c in "rgb")
        + f" from o), q as (select *, {_luminance('p')} as py, least(pr, pg, pb) as plo, greatest(pr, pg, pb) as phi from p), s as (select *, "
        + ", ".join(f"case when plo < 0 then py + (p{c} - py) * py / (py - plo) else p{c} end as s{c}" for c in "rgb") + " from q), n as (select *, "
        + ", ".join(f"case when phi > 1 then py + (s{c} - py) * (1 - py) / (phi - py) else s{c} end as n{c}" for c in "rgb") + " from s)"
    )


def _balanced(c: str, s: int, m: int, h: int) -> str:
    v = f"f{c}"
    dark, light = _unit(f"({v} - 0.333::double) / -0.25::double + 0.5::double"), _unit(f"({v} - (1 - 0.333::double)) / 0.25::double + 0.5::double")
    mid = f"{_unit(f'({v} - 0.333::double) / 0.25::double + 0.5::double')} * {_unit(f'({v} + 0.333::double - 1) / -0.25::double + 0.5::double')}"
    return _unit(f"{v} + ({dark} * ({s} / 100::double) + {mid} * ({m} / 100::double) + {light} * ({h} / 100::double)) * 0.7::double")


_one("adjust_color_balance_preserved", lambda px: A.color_balance(px, (40, 0, -30), (0, 50, 0), (-35, 0, 45)), _U + _keep({"r": _balanced("r", 40, 0, -35), "g": _balanced("g", 0, 50, 0), "b": _balanced("b", -30, 0, 45)}) + _out(_N))
_one("adjust_photo_filter_preserved", lambda px: A.photo_filter(px, (0.925, 0.54, 0.0), 60), _U + _keep({c: f"f{c} + (f{c} * {k}::double - f{c}) * 0.6::double" for c, k in zip("rgb", (0.925, 0.54, 0.0), strict=True)}) + _out(_N))

_BANDS = {"reds": (30, 40, -20), "greens": (-60, -50, 25), "magentas": (10, 80, 5)}


def _band(name: str) -> str:
    e = A.HUE_BANDS[name]
    up, flat, down = ((v - e[0]) % 360 for v in e[1:])
    at = f"((h0 - {e[0]} + 360) % 360)"
    return f"case when s0 <= 0 then 0::double when {at} <= {up} then {at} / {up}::double when {at} <= {flat} then 1::double when {at} <= {down} then ({down} - {at}) / {down - flat}::double else 0::double end as w_{name}"


_shift = lambda k, m: f"({m}::double + (" + " + ".join(f"w_{n} * {of[k]}" for n, of in _BANDS.items()) + "))"
_part = lambda c, n: f"l - s * least(l, 1 - l) * greatest(-1::double, least((h / 30 + {n}) % 12 - 3, 9 - (h / 30 + {n}) % 12, 1::double)) as n{c}"
_PARTS = ", ".join((_part("r", 0), _part("g", 8), _part("b", 4)))
_one(
    "adjust_hue_bands", lambda px: A.hue_bands(px, (15, 10, 0), _BANDS),
    _HSL + f", w as (select *, {', '.join(map(_band, _BANDS))} from e), z as (select *, {_shift(0, 15)} as th, greatest(-100::double, least(100::double, {_shift(1, 10)})) as ts, greatest(-100::double, least(100::double, {_shift(2, 0)})) as tl from w), "
    f"t as (select x, y, r, g, b, a, (h0 + th + 720) % 360 as h, {_unit('s0 * (1 + ts / 100)')} as s, case when tl > 0 then l0 + (1 - l0) * (tl / 100) else l0 * (1 + tl / 100) end as l from z), n as (select *, {_PARTS} from t)" + _out(_N),
)
_GREY = _unit("(lo + (fr + fg + fb - hi - lo - lo) * pair + (hi - (fr + fg + fb - hi - lo)) * first)")
_one(
    "adjust_black_white_tint", lambda px: A.black_white(px, (1.0, 0.75, 0.5)),
    _U + """, w as (select *, case when fr = hi then 40 when fg = hi then 40 else 20 end / 100::double as first, case when fr = hi then case when fb = lo then 60 else 80 end when fg = hi then 60 else case when fr = lo then 60 else 80 end end / 100::double as pair from v), """
    f"t as (select x, y, r, g, b, a, 30::double as h, 1::double as s, {_GREY} as l from w), n as (select *, {_PARTS} from t)" + _out(_N),
)

_INK = {"reds": (-40, 20, 60, 10), "yellows": (0, -50, 30, 0), "cyans": (70, 0, 0, -20), "whites": (10, 0, -80, 5), "neutrals": (15, -15, 20, 0), "blacks": (0, 30, 0, 40), "magentas": (20, -90, 0, 0)}
_MEMBER = {
    "reds": ("r = hi", "hi - mid"), "yellows": ("b = lo", "mid - lo"), "cyans": ("r = lo", "mid - lo"), "magentas": ("g = lo", "mid - lo"), "whites": ("r > 128 and g > 128 and b > 128", "2 * lo - 255"),
    "neutrals": ("hi > 0 and lo < 255", "(510 - (abs(2 * hi - 255) + abs(2 * lo - 255))) / 2::double"), "blacks": ("r < 128 and g < 128 and b < 128", "255 - 2 * hi"),
}


def _inked(c: str, k: int, relative: bool) -> str:
    parts = []
    for n, ink in _INK.items():
        change = f"{(-1 - ink[k] / 100) * (ink[3] / 100) - ink[k] / 100!r}::double" + (f" * (1 - {c} / 255::double)" if relative else "")
        parts.append(f"case when {_MEMBER[n][0]} and {_MEMBER[n][1]} > 0 then least(1 - {c} / 255::double, greatest(-{c} / 255::double, {change})) * ({_MEMBER[n][1]}) else 0::double end")
    return f"({c} + ({' + '.join(parts)})) / 255::double as n{c}"


for _rel in (True, False):
    _one(
        f"adjust_selective_color_{'relative' if _rel else 'absolute'}", lambda px, rel=_rel: A.selective_color(px, _INK, rel),
        PX + ", v as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo, r + g + b - greatest(r, g, b) - least(r, g, b) as mid from pe), n as (select *, " + ", ".join(_inked(c, k, _rel) for k, c in enumerate("rgb")) + " from v)" + _out(_N),
    )

#: A table of 5 x 5 x 5: channels bent, mixed and turned.
_SIZE = 5
_CUBE = [round(v, 6) for b in range(5) for g in range(5) for r in range(5) for v in ((r / 4) ** 2, 0.71371 * g / 4 + 0.28311 * b / 4, 1 - (b / 4) * (r / 4))]
_CUBE_TEXT = ramps.write_cube("bent", _SIZE, _CUBE)
_corner = lambda r, g, b, k: f"{_list(_CUBE)}[((((b0 + {b}) * 5 + g0 + {g}) * 5 + r0 + {r}) * 3 + {k + 1})::int]"


def _tetra(k: int) -> str:
    """The six orders of the fractions, each written out."""
    p = lambda *at: _corner(*at, k)
    way = lambda f1, c1, f2, c2, f3: f"{p(0, 0, 0)} + {f1} * ({p(*c1)} - {p(0, 0, 0)}) + {f2} * ({p(*c2)} - {p(*c1)}) + {f3} * ({p(1, 1, 1)} - {p(*c2)})"
    return (
        f"case when u >= v and v >= w then {way('u', (1, 0, 0), 'v', (1, 1, 0), 'w')} when u >= w and w >= v then {way('u', (1, 0, 0), 'w', (1, 0, 1), 'v')} when w >= u and u >= v then {way('w', (0, 0, 1), 'u', (1, 0, 1), 'v')} "
        f"when w >= v and v >= u then {way('w', (0, 0, 1), 'v', (0, 1, 1), 'u')} when v >= w and w >= u then {way('v', (0, 1, 0), 'w', (0, 1, 1), 'u')} else {way('v', (0, 1, 0), 'u', (1, 1, 0), 'w')} end as n{'rgb'[k]}"
    )


_one(
    "adjust_color_lookup", lambda px: A.color_lookup(px, *ramps.read_cube(_CUBE_TEXT)),
    PX + ", c as (select *, least(3, floor(r / 255::double * 4)) as r0, least(3, floor(g / 255::double * 4)) as g0, least(3, floor(b / 255::double * 4)) as b0 from pe), d as (select *, r / 255::double * 4 - r0 as u, g / 255::double * 4 - g0 as v, b / 255::double * 4 - b0 as w from c), "
    "n as (select *, " + ", ".join(map(_tetra, range(3))) + " from d)" + _out(_N),
)

#: A table of 33 x 33 x 33 in twelve bits, blue fastest, by a rule.
_LARGE = lambda r, g, b: [(r * 91 + g * 33 + b * 7) % 4096, (g * 127) % 4096, (4095 - b * 100 - r * 20) % 4096]
_LARGE_TEXT = "\n".join([" ".join(str(k * 32) for k in range(33)), *(" ".join(map(str, _LARGE(r, g, b))) for r in range(33) for g in range(33) for b in range(33))])
_rule = lambda k, r, g, b: ("((({r}) * 91 + ({g}) * 33 + ({b}) * 7) % 4096)", "((({g}) * 127) % 4096)", "((4095 - ({b}) * 100 - ({r}) * 20 + 409600) % 4096)")[k].format(r=f"r0 + {r}", g=f"g0 + {g}", b=f"b0 + {b}") + "::double / 4095::double"
_small, _corner = _corner, lambda r, g, b, k: f"({_rule(k, r, g, b)})"
_one(
    "adjust_color_lookup_3dl", lambda px: A.color_lookup(px, *ramps.read_lut("large.3dl", _LARGE_TEXT)),
    PX + ", c as (select *, least(31, floor(r / 255::double * 32))::bigint as r0, least(31, floor(g / 255::double * 32))::bigint as g0, least(31, floor(b / 255::double * 32))::bigint as b0 from pe), d as (select *, r / 255::double * 32 - r0 as u, g / 255::double * 32 - g0 as v, b / 255::double * 32 - b0 as w from c), "
    "n as (select *, " + ", ".join(map(_tetra, range(3))) + " from d)" + _out(_N),
)


_COLORS = [(0.0, (0.0, 0.1, 0.3), 0.3), (0.4, (0.9, 0.2, 0.1)), (1.0, (1.0, 0.95, 0.7))]
_OPACITY = [(0.0, 1.0), (0.6, 0.2, 0.7), (1.0, 0.8)]


def _sampled(stops: list[tuple], t: np.ndarray) -> np.ndarray:
    at = np.array([s[0] for s in stops])
    value = np.array([np.atleast_1d(s[1]) for s in stops], float)
    k = np.clip(np.searchsorted(at, t, side="left") - 1, 0, len(at) - 2)
    f = np.clip((t - at[k]) / (at[k + 1] - at[k]), 0, 1)
    middle = np.array([s[2] if len(s) > 2 else 0.5 for s in stops])[k]
    return value[k] + (value[k + 1] - value[k]) * (f ** (np.log(0.5) / np.log(middle)))[:, None]


for _rev in (False, True):
    _t = 1 - np.arange(256) / 255 if _rev else np.arange(256) / 255
    _ramp = _round(_sampled(_COLORS, _t) * 255)
    _at = f"(cast(floor({_unit('(0.3::double * (r / 255::double) + 0.59::double * (g / 255::double) + 0.11::double * (b / 255::double))')} * 255 + 0.5) as int) + 1)"
    _one("adjust_gradient_map" + ("_stops_reversed" if _rev else "_stops"), lambda px, rev=_rev: A.gradient_map(px, _COLORS, rev), _point_sql(**{c: f"{_list(_ramp[:, k].tolist())}[{_at}]" for k, c in enumerate("rgb")}))

_LINE = geometry.gradient_line("linear", 30, 80, 10, -5, 100, 100)
_CENTRE = geometry.gradient_line("radial", 30, 80, 10, -5, 100, 100)
_ux, _uy = math.cos(math.pi / 6), -math.sin(math.pi / 6)
_far = (100 * abs(_ux) + 100 * abs(_uy)) * 0.4
_table = np.concatenate([_round(_sampled(_COLORS, np.arange(256) / 255) * 255), _round(_sampled(_OPACITY, np.arange(256) / 255) * 255)], axis=1)
_along, _across = f"((x + 0.5 - 60) * {_ux!r}::double + (y + 0.5 - 45) * {_uy!r}::double)", f"((y + 0.5 - 45) * {_ux!r}::double - (x + 0.5 - 60) * {_uy!r}::double)"
_PLACE = {
    "linear": f"({_along} + {_far!r}::double) / {2 * _far!r}::double", "reflected": f"abs({_along} / {_far!r}::double)", "radial": f"sqrt({_along} * {_along} + {_across} * {_across}) / {_far!r}::double",
    "diamond": f"(abs({_along}) + abs({_across})) / {_far!r}::double", "angle": f"(atan2({_across}, {_along}) / {2 * math.pi!r}::double + case when {_across} < 0 then 1 else 0 end)",
}
for _style, _place in _PLACE.items():
    _one(
        f"fill_gradient_{_style}", lambda px, style=_style: A.gradient_fill(px, style, _LINE if style == "linear" else _CENTRE, _COLORS, _OPACITY),
        PX + f", t as (select x, y, cast(floor({_unit(_place)} * 255 + 0.5) as int) + 1 as nth from pe) select x, y, " + ", ".join(f"cast({_list(_table[:, k].tolist())}[nth] as bigint) as {c}" for k, c in enumerate("rgba")) + " from t",
    )

# Levels as curves, drawn tables as points, eyedroppers, automatic colour.
_LV = (30, 1.6, 210, 10, 240)
_lv = [(_LV[0] / 255, _LV[3] / 255), ((_LV[0] + (_LV[2] - _LV[0]) * 0.5 ** _LV[1]) / 255, (_LV[3] + _LV[4]) / 510), (_LV[2] / 255, _LV[4] / 255)]
_drawn = [(i // 40) * 40 for i in range(256)]
_pts = [(x / 255, _drawn[x] / 255) for x in _round(np.arange(16) * 17).tolist()]
_one("adjust_levels_as_curves", lambda px: A.curves(px, ramps.levels_points(*_LV), ramps.table_points(_drawn)), _point_sql(**{c: f"{_list(_spline(_lv))}[({_list(_spline(_pts))}[(r + 1)::int] + 1)::int]" if c == "r" else f"{_list(_spline(_lv))}[({c} + 1)::int]" for c in "rgb"}))


def _picked(px):
    """What the three eyedroppers make of each pixel's colour."""
    c = tuple(F.col(k) for k in "rgb")
    grays = ramps.gray_gammas(c, (10, 0, 5), (240, 255, 200))
    return px.select("x", "y", ramps.black_point(c[0], 200).alias("black"), ramps.white_point(c[1], 60).alias("white"), *(F.floor(v * 100 + 0.5).cast("long").alias(f"gamma_{k}") for k, v in zip("rgb", grays, strict=True)))


_u = {c: f"least(0.999::double, greatest(0.001::double, ({c} - {b}) / {w - b}::double))" for c, b, w in zip("rgb", (10, 0, 5), (240, 255, 200), strict=True)}
_one(
    "scalar_eyedroppers", _picked,
    PX + f", t as (select x, y, r, g, {', '.join(f'{v} as t{c}' for c, v in _u.items())} from pe) select x, y, least(r, 198) as black, greatest(g, 62) as white, " + ", ".join(f"cast(floor(floor(least(9.99::double, greatest(0.1::double, ln(t{c}) / ln((tr + tg + tb) / 3))) * 100 + 0.5) / 100 * 100 + 0.5) as bigint) as gamma_{c}" for c in "rgb") + " from t",
)
_AUTO = _HIST + _RANGE.format(h="h") + f", mn as (select h.channel, lo, hi, sum({_unit('(level - lo) / (hi - lo)::double')} * n) / sum(n)::double as m from h join c on c.channel = h.channel where h.channel <> 'lum' group by 1, 2, 3), tg as (select *, avg(m) over () as target from mn), ac as (select channel, lo, hi, case when m > 0 and m < 1 and target > 0 and target < 1 then floor(least(2::double, greatest(0.5::double, ln(m) / ln(target))) * 100 + 0.5) / 100 else 1::double end as gamma from tg)"
_one("stats_auto_color", A.auto_color_levels, _AUTO + " select channel, lo, hi, gamma from ac")
_one("adjust_auto_color", A.auto_color, _AUTO + " select x, y, " + ", ".join(f"case when a = 0 then {c} else cast(floor(255 * power({_unit(f'({c} - c{c}.lo) / (c{c}.hi - c{c}.lo)::double')}, 1 / c{c}.gamma) + 0.5) as bigint) end as {c}" for c in "rgb") + ", a from pe" + "".join(f" join ac c{c} on c{c}.channel = '{c}'" for c in "rgb"))
