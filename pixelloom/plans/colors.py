"""Registered queries of the colour operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import color as C
from pixelloom.plans.more import _byte, _unit
from pixelloom.plans.queries import PX, _point_sql
from pixelloom.sources.rasters import events_raster, orders_raster

QUERIES = {}
ORACLE_SQL = {}


def _one(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: fn(events_raster(spark, d))
    ORACLE_SQL[name] = sql


_HUE = "case when hi = lo then 0::double when hi = fr then 60 * (((fg - fb) / (hi - lo) + 6) % 6) when hi = fg then 60 * ((fb - fr) / (hi - lo) + 2) else 60 * ((fr - fg) / (hi - lo) + 4) end"
_U = PX + ", u as (select *, r / 255::double as fr, g / 255::double as fg, b / 255::double as fb from pe), v as (select *, greatest(fr, fg, fb) as hi, least(fr, fg, fb) as lo from u)"
_HSL = _U + f", k as (select *, (hi + lo) / 2 as l0, {_HUE} as h0 from v), e as (select *, case when hi = lo then 0::double else (hi - lo) / (1 - abs(2 * l0 - 1)) end as s0 from k)"


def _ramps(h: str, s: str, light: str, extra: str = "0::double") -> str:
    """CTE n with nr, ng, nb from new hue, saturation and lightness."""
    one = lambda c, n: f"l - s * least(l, 1 - l) * greatest(-1::double, least((h / 30 + {n}) % 12 - 3, 9 - (h / 30 + {n}) % 12, 1::double)) as n{c}"
    return _HSL + f", t as (select x, y, r, g, b, a, {h} as h, {s} as s, {light} as l, {extra} as w from e), n as (select *, {one('r', 0)}, {one('g', 8)}, {one('b', 4)} from t)"


def _out(form: str) -> str:
    return " select x, y, " + ", ".join(f"case when a = 0 then {c} else {form.format(c=c)} end as {c}" for c in "rgb") + ", a from n"


_N = _byte("n{c}")
_one("adjust_hue_saturation", C.hue_saturation, _ramps("(h0 + 40 + 720) % 360", _unit("s0 * 1.25::double"), "l0 * 0.9::double") + _out(_N))
_one("adjust_colorize", C.colorize, _ramps("210::double", "0.4::double", "l0") + _out(_N))
_one("adjust_vibrance", C.vibrance, _ramps("h0", _unit("s0 * (1 + 0.6::double * ((1 - s0) * (1 - 0.5::double * greatest(0::double, 1 - abs(h0 - 35) / 35)))) * 1.1::double"), "l0") + _out(_N))
_one("adjust_replace_color", C.replace_color, _ramps("(h0 + 60 + 720) % 360", _unit("s0 * 1.2::double"), "l0 + (1 - l0) * 0.1::double", _unit("1 - sqrt(((r - 120) * (r - 120) + (g - 90) * (g - 90) + (b - 60) * (b - 60))::double) / 120::double")) + _out("cast(floor({c} + (n{c} * 255 - {c}) * w + 0.5) as bigint)"))


def _balance(c: str, low: int, mid: int, high: int) -> str:
    v = f"({c} / 255::double)"
    dark, bright = _unit(f"0.5::double - ({v} - 0.333::double) / 0.25::double"), _unit(f"({v} - (1 - 0.333::double)) / 0.25::double + 0.5::double")
    middle = f"{_unit(f'({v} - 0.333::double) / 0.25::double + 0.5::double')} * {_unit(f'0.5::double - ({v} + 0.333::double - 1) / 0.25::double')}"
    return _byte(f"{v} + ({dark} * ({low} / 100::double) + {middle} * ({mid} / 100::double) + {bright} * ({high} / 100::double)) * 0.7::double")


_one("adjust_color_balance", C.color_balance, _point_sql(r=_balance("r", 20, 0, -15), g=_balance("g", 0, 30, 0), b=_balance("b", -10, 0, 25)))
_GREY = _byte("((lo * 100 + (mid - lo) * pair + (hi - mid) * first) / 25500::double)")
_one("adjust_black_white", C.black_white, PX + """, v as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo, r + g + b - greatest(r, g, b) - least(r, g, b) as mid from pe),
  n as (select *, case when r = hi then 40 when g = hi then 40 else 20 end as first, case when r = hi then case when b = lo then 60 else 80 end when g = hi then 60 else case when r = lo then 60 else 80 end end as pair from v)""" + _out(_GREY))
_one("select_wand", C.wand, PX + ", s as (select r as sr, g as sg, b as sb, a as sa from pe where x = 50 and y = 5), d as (select x, y, greatest(abs(r - sr), abs(g - sg), abs(b - sb), abs(a - sa)) as d from pe, s) select x, y, case when d > 96 then 0 when d <= 72 then 255 else cast(floor(255 * (1 - (d - 72) / 24::double) + 0.5) as bigint) end as cov from d")
_LIN = "case when f{c} <= 0.04045::double then f{c} / 12.92::double else power((f{c} + 0.055::double) / 1.055::double, 2.4::double) end as l{c}"
_F = "case when {t} > 0.008856::double then cbrt({t}) else 7.787::double * {t} + 16 / 116::double end as f{t}"
_one("color_readout", C.readout, _U + ", w as (select *, " + ", ".join(_LIN.format(c=c) for c in "rgb") + f", {_HUE} as hue from v), z as (select *, (0.4124564::double * lr + 0.3575761::double * lg + 0.1804375::double * lb) / 0.95047::double as tx, (0.2126729::double * lr + 0.7151522::double * lg + 0.072175::double * lb) as ty, (0.0193339::double * lr + 0.119192::double * lg + 0.9503041::double * lb) / 1.08883::double as tz from w), q as (select *, " + ", ".join(_F.format(t=t) for t in ("tx", "ty", "tz")) + " from z) select x, y, round(hue, 6) + 0.0 as hue, round(case when hi = 0 then 0 else (hi - lo) / hi * 100 end, 6) + 0.0 as sat, round(hi * 100, 6) + 0.0 as bright, round(116 * fty - 16, 6) + 0.0 as lab_l, round(500 * (ftx - fty), 6) + 0.0 as lab_a, round(200 * (fty - ftz), 6) + 0.0 as lab_b, " + ", ".join(f"round(case when hi <= 0 then 0 else (hi - f{c}) / hi * 100 end, 6) + 0.0 as {k}" for c, k in zip("rgb", ("cyan", "magenta", "yellow"), strict=True)) + ", round((1 - hi) * 100, 6) + 0.0 as black, printf('%02X%02X%02X', r, g, b) as code, " + ", ".join(f"cast(floor({c} / 51::double + 0.5) * 51 as bigint) as web_{c}" for c in "rgb") + " from q")
_PARTS = (("lum", "r * 30 + g * 59 + b * 11", 25500), ("rg", "r - g", 255), ("yb", "r + g - 2 * b", 510))


def _stats(name: str, table: str) -> str:
    sums = ", ".join(f"cast(sum({e}) as double) as s_{k}, cast(sum(({e}) * ({e})) as double) as q_{k}" for k, e, _ in _PARTS)
    out = ", ".join(f"round(s_{k} / n / {z}::double, 9) as {name}_m_{k}, round(sqrt(greatest(1e-8::double, q_{k} / n / {z * z}::double - (s_{k} / n / {z}::double) * (s_{k} / n / {z}::double))), 9) as {name}_d_{k}" for k, _, z in _PARTS)
    return f", {name} as (select {out} from (select count(*) as n, {sums} from {table} where a <> 0))"


QUERIES["adjust_match_color"] = lambda spark, d: C.match_color(events_raster(spark, d), orders_raster(spark, d))
_OPP = {"lum": "0.3::double * fr + 0.59::double * fg + 0.11::double * fb", "rg": "fr - fg", "yb": "(fr + fg) / 2 - fb"}
ORACLE_SQL["adjust_match_color"] = _U + _stats("p", "pe") + _stats("o", "po") + ", t as (select x, y, r, g, b, a, fr, fg, fb, " + ", ".join(f"({e} - p_m_{k}) / p_d_{k} * o_d_{k} + o_m_{k} as t{k}" for k, e in _OPP.items()) + " from v, p, o), w as (select *, tlum - 0.3::double * trg - 0.11::double * (trg / 2 - tyb) as mg from t), n as (select *, mg + trg as nr, mg as ng, mg + trg / 2 - tyb as nb from w)" + _out(_byte("n{c} + (f{c} - n{c}) * 0.25::double"))
_half = lambda px: px.select("x", "y", F.when(F.col("x") < 60, 200).otherwise(100).alias("cov"))
QUERIES["adjust_match_color_neutral"] = lambda spark, d: C.match_color(px := events_raster(spark, d), orders_raster(spark, d), 0.1, 90, 140, True, _half(px), _half(orders_raster(spark, d)))
ORACLE_SQL["adjust_match_color_neutral"] = _U + ", peh as (select * from pe where x < 60), poh as (select * from po where x < 60)" + _stats("p", "peh") + _stats("o", "poh") + ", t as (select x, y, r, g, b, a, fr, fg, fb, " + ", ".join(f"(({e} - p_m_{k}) / p_d_{k} * o_d_{k} + {f'o_m_{k}' if k == 'lum' else '0'}) * {'0.9' if k == 'lum' else '1.4'}::double as t{k}" for k, e in _OPP.items()) + " from v, p, o), w as (select *, tlum - 0.3::double * trg - 0.11::double * (trg / 2 - tyb) as mg from t), n as (select *, mg + trg as nr, mg as ng, mg + trg / 2 - tyb as nb from w)" + _out(_byte("n{c} + (f{c} - n{c}) * 0.1::double"))
