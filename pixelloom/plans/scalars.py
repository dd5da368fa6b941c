"""Registered scalar functions: colour codes and models, rectangles, matrices, views, painting; and their SQL.

Real results are compared as whole millionths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.functions import geometry as G
from pixelloom.functions import painting as P
from pixelloom.plans.colors import _HSL, _HUE
from pixelloom.plans.queries import PX
from pixelloom.sources.rasters import events_raster

QUERIES = {}
ORACLE_SQL = {}


def _micro(v: Column) -> Column:
    return F.floor(v * 1_000_000 + 0.5).cast("long")


def _of(v: str) -> str:
    return f"cast(floor(({v}) * 1000000 + 0.5) as bigint)"


def _add(name: str, columns, sql: dict[str, str], ctes: str = "", table: str = "pe", exact: tuple = ()) -> None:
    """A query of ``columns``, a function of the pixels, beside SQL by name; those in ``exact`` are not reals."""

    def run(spark, sf_dir):
        px = events_raster(spark, sf_dir)
        made = columns(px)
        return px.select("x", "y", *((v if k in exact else _micro(v)).alias(k) for k, v in made.items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = PX + ctes + " select x, y, " + ", ".join(f"{v if k in exact else _of(v)} as {k}" for k, v in sql.items()) + f" from {table}"


def _pixel() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in "rgbxy")


def _unit_of() -> tuple[Column, Column, Column]:
    return tuple(F.col(c) / 255 for c in "rgb")



# Codes and colour models.


def _codes(px):
    r, g, b, x, y = _pixel()
    code = C.hex_code((r, g, b))
    back, short, none = C.hex_rgb(F.concat(F.lit(" #"), F.lower(code), F.lit(" "))), C.hex_rgb(F.concat(F.lit("#"), F.substring(code, 1, 3))), C.hex_rgb(F.substring(code, 1, 5))
    return {"code": code, "css": F.concat(F.lit("#"), code), "back": _micro(back["r"] + back["g"] * 10 + back["b"] * 100), "short": _micro(short["r"] + short["g"] * 10 + short["b"] * 100), "none": none.isNull()}


_HEX = "upper(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0'))"
_digit = lambda k: f"(instr('0123456789ABCDEF', substr(h, {k}, 1)) - 1)"
_add("scalar_hex_codes", _codes, {"code": "h", "css": "'#' || h", "back": _of("r / 255::double + g / 255::double * 10 + b / 255::double * 100"), "short": _of(f"{_digit(1)} / 15::double + {_digit(2)} / 15::double * 10 + {_digit(3)} / 15::double * 100"), "none": "true"}, f", c as (select *, {_HEX} as h from pe)", "c", ("code", "css", "back", "short", "none"))


def _models(px):
    unit = _unit_of()
    h, s, b = C.hsb(unit)
    lab, cmyk = C.lab(unit), C.cmyk(unit)
    out = {}
    for name, made in (("hsb", C.hsb_rgb(h * 0.8, s * 0.9, b)), ("lab", C.lab_rgb(lab[0] * 0.9, lab[1] * 0.5, lab[2])), ("cmyk", C.cmyk_rgb(cmyk[0], cmyk[1] * 0.5, cmyk[2], cmyk[3] * 0.7))):
        out |= {f"{name}_{c}": v for c, v in zip("rgb", made, strict=True)}
    return out | {"luminance": C.relative_luminance(unit), "encoded": C.encoded(unit[0] * 0.1), "off": C.out_of_gamut(unit), "safe": C.is_web_safe((unit[0], F.lit(0.2), F.lit(0.6)))}


_L = "case when f{c} <= 0.04045::double then f{c} / 12.92::double else power((f{c} + 0.055::double) / 1.055::double, 2.4::double) end as l{c}"
_T = "case when {t} > 0.008856::double then cbrt({t}) else 7.787::double * {t} + 16 / 116::double end as f{t}"
_CTE = f""", u as (select *, r / 255::double as fr, g / 255::double as fg, b / 255::double as fb from pe), v as (select *, greatest(fr, fg, fb) as hi, least(fr, fg, fb) as lo from u),
  w as (select *, {_HUE} * 0.8::double as hue, case when hi = 0 then 0::double else (hi - lo) / hi * 0.9::double end as sat, {', '.join(_L.format(c=c) for c in 'rgb')} from v),
  t as (select *, (0.4124564::double * lr + 0.3575761::double * lg + 0.1804375::double * lb) / 0.95047::double as tx, 0.2126729::double * lr + 0.7151522::double * lg + 0.072175::double * lb as ty, (0.0193339::double * lr + 0.119192::double * lg + 0.9503041::double * lb) / 1.08883::double as tz from w),
  f as (select *, {', '.join(_T.format(t=t) for t in ('tx', 'ty', 'tz'))} from t),
  i as (select *, ((116 * fty - 16) * 0.9::double + 16) / 116 as iy, ((116 * fty - 16) * 0.9::double + 16) / 116 + 500 * (ftx - fty) * 0.5::double / 500 as ix, ((116 * fty - 16) * 0.9::double + 16) / 116 - 200 * (fty - ftz) / 200 as iz from f),
  j as (select *, case when ix * ix * ix > 0.008856::double then ix * ix * ix else (ix - 16 / 116::double) / 7.787::double end * 0.95047::double as jx, case when iy * iy * iy > 0.008856::double then iy * iy * iy else (iy - 16 / 116::double) / 7.787::double end as jy, case when iz * iz * iz > 0.008856::double then iz * iz * iz else (iz - 16 / 116::double) / 7.787::double end * 1.08883::double as jz from i),
  k as (select *, 3.2404542::double * jx - 1.5371385::double * jy - 0.4985314::double * jz as kr, -0.969266::double * jx + 1.8760108::double * jy + 0.041556::double * jz as kg, 0.0556434::double * jx - 0.2040259::double * jy + 1.0572252::double * jz as kb from j)"""
_enc = lambda v: f"case when {v} <= 0.0031308::double then {v} * 12.92::double else 1.055::double * power({v}, 1 / 2.4::double) - 0.055::double end"
_ramp = lambda n: f"hi - hi * sat * greatest(0::double, least((hue / 60 + {n}) % 6, 4 - (hue / 60 + {n}) % 6, 1::double))"
_ink = lambda c, f: f"(1 - case when hi <= 0 then 0::double else (hi - f{c}) / hi * {f}::double end) * (1 - (1 - hi) * 0.7::double)"
_add(
    "scalar_color_models", _models,
    {f"hsb_{c}": _ramp(n) for c, n in zip("rgb", (5, 3, 1), strict=True)} | {f"lab_{c}": f"least(1::double, greatest(0::double, {_enc(f'k{c}')}))" for c in "rgb"} | {"cmyk_r": _ink("r", 1), "cmyk_g": _ink("g", 0.5), "cmyk_b": _ink("b", 1)}
    | {"luminance": "0.2126::double * lr + 0.7152::double * lg + 0.0722::double * lb", "encoded": _enc("(fr * 0.1::double)"), "off": "false", "safe": "abs(floor(r / 51::double + 0.5) * 51 - r) < 1"},
    _CTE, "k", ("off", "safe"),
)

# Rectangles and tiles, with empty ones among them.


def _rects(px):
    r, g, b, x, y = _pixel()
    one = G.rect(r % 40, g % 30, r % 40 + b % 50 - 5, g % 30 + r % 45 - 5)
    two = G.rect(x % 30, b % 35, x % 30 + 20, b % 35 + g % 25)
    real = G.rect(r / 7, g / 9, r / 7 + b / 5 - 3, g / 9 + 2.5)
    out = {"empty": G.is_empty(one), "area": G.area(one), "point": G.contains(one, x % 50, g % 40), "whole": G.contains_rect(one, two)}
    for name, box in (("both", G.intersect(one, two)), ("either", G.union(one, two)), ("more", G.inflate(one, 3)), ("moved", G.shifted(one, x, -g)), ("round", G.outer(real))):
        out[name] = F.concat_ws(",", *(box[k].cast("long").cast("string") for k in ("x0", "y0", "x1", "y1")))
    tiles = G.tiles_in(G.rect(r * 5 - 300, g * 3, r * 5 - 300 + b * 4, g * 3 + 600))
    return out | {"tile": G.tile_index(r * 37 - 3000).cast("long"), "key": G.tile_key(r - 100, g), "tiles": F.size(tiles).cast("long"), "first": F.coalesce(F.get(tiles, F.lit(0))["tx"] * 1000 + F.get(tiles, F.lit(0))["ty"], F.lit(-1)).cast("long"), "bytes": F.lit(G.tile_bytes(4, "u16")).cast("long")}


_RECTS = """, q as (select x, y, r, g, b, r % 40 as a0, g % 30 as a1, r % 40 + b % 50 - 5 as a2, g % 30 + r % 45 - 5 as a3, x % 30 as b0, b % 35 as b1, x % 30 + 20 as b2, b % 35 + g % 25 as b3, r / 7::double as f0, g / 9::double as f1, r / 7::double + b / 5::double - 3 as f2, g / 9::double + 2.5::double as f3,
    r * 5 - 300 as t0, g * 3 as t1, r * 5 - 300 + b * 4 as t2, g * 3 + 600 as t3 from pe),
  e as (select *, a2 <= a0 or a3 <= a1 as ae, b2 <= b0 or b3 <= b1 as be, greatest(a0, b0) as i0, greatest(a1, b1) as i1, least(a2, b2) as i2, least(a3, b3) as i3 from q)"""
_four = lambda *v: "concat_ws(',', " + ", ".join(f"cast(cast({p} as bigint) as varchar)" for p in v) + ")"
_A = ("a0", "a1", "a2", "a3")
_add(
    "scalar_rectangles", _rects,
    {
        "empty": "ae", "area": "greatest(0, a2 - a0) * greatest(0, a3 - a1)", "point": "x % 50 >= a0 and x % 50 < a2 and g % 40 >= a1 and g % 40 < a3", "whole": "be or (b0 >= a0 and b1 >= a1 and b2 <= a2 and b3 <= a3)",
        "both": f"case when i2 <= i0 or i3 <= i1 then '0,0,0,0' else {_four('i0', 'i1', 'i2', 'i3')} end",
        "either": f"case when ae then {_four('b0', 'b1', 'b2', 'b3')} when be then {_four(*_A)} else {_four('least(a0, b0)', 'least(a1, b1)', 'greatest(a2, b2)', 'greatest(a3, b3)')} end",
        "more": f"case when ae then {_four(*_A)} else {_four('a0 - 3', 'a1 - 3', 'a2 + 3', 'a3 + 3')} end", "moved": f"case when ae then {_four(*_A)} else {_four('a0 + x', 'a1 - g', 'a2 + x', 'a3 - g')} end",
        "round": f"case when f2 <= f0 or f3 <= f1 then '0,0,0,0' else {_four('floor(f0)', 'floor(f1)', 'ceil(f2)', 'ceil(f3)')} end",
        "tile": "cast(floor((r * 37 - 3000) / 256::double) as bigint)", "key": "(r - 100 + 524288) * 1048576 + g + 524288",
        "tiles": "case when t2 <= t0 then 0 else cast((floor((t2 - 1) / 256::double) - floor(t0 / 256::double) + 1) * (floor((t3 - 1) / 256::double) - floor(t1 / 256::double) + 1) as bigint) end",
        "first": "case when t2 <= t0 then -1 else cast(floor(t0 / 256::double) * 1000 + floor(t1 / 256::double) as bigint) end", "bytes": "524288::bigint",
    },
    _RECTS, "e", ("empty", "area", "point", "whole", "both", "either", "more", "moved", "round", "tile", "key", "tiles", "first", "bytes"),
)

# Matrices and views.


def _matrices(px):
    r, g, b, x, y = _pixel()
    m = G.mat(r / 64, g / 128 - 1, b / 100 - 1, (r + g) % 7 - 3, x, y - 5)
    n = G.mat(b / 90, 0.5, -0.25, g / 80, 3, r / 10)
    box = G.rect(x, y % 7, x + 20, y % 7 + r)
    out, point = {}, G.apply(m, b, x)
    for name, made in (("then", G.compose(m, n)), ("product", G.multiply(m, n)), ("about", G.about(n, x, 4.0)), ("undo", G.inverse(m)), ("skew", G.skew(r / 255, g / 300)), ("quad", G.rect_to_quad(box, (r / 2, g / 2), (b / 1, x / 1), (y / 1, r / 3)))):
        out[name] = sum((made[k] * w for k, w in zip("abcdef", (1, 2, 3, 5, 7, 11), strict=True)), F.lit(0.0))
    out["undo"] = F.when(F.abs(G.determinant(m)) > 1e-3, out["undo"]).otherwise(0.0)
    around = G.mapped_bounds(m, box)
    parts = G.decompose(n)
    return out | {
        "px": point[0], "py": point[1], "det": G.determinant(m), "around": around["x0"] + 2 * around["y0"] + 3 * around["x1"] + 5 * around["y1"], "scale_x": parts["scale_x"], "scale_y": parts["scale_y"], "rotation": parts["rotation"], "skew_x": parts["skew_x"],
        "same": G.is_identity(G.mat(1, 0, 0, 1, r % 2, 0)), "shift": G.is_whole_shift(G.mat(1, 0, 0, 1, r / 2, g)),
    }


def _sum6(*v: str) -> str:
    return " + ".join(f"({p}) * {w}" for p, w in zip(v, (1, 2, 3, 5, 7, 11), strict=True))


def _mul(m: str, n: str) -> list[str]:
    """``n`` first, then ``m``; each letter of the first is a column with a prefix."""
    a, b = [f"{m}{k}" for k in "abcdef"], [f"{n}{k}" for k in "abcdef"]
    return [f"{a[0]} * {b[0]} + {a[2]} * {b[1]}", f"{a[1]} * {b[0]} + {a[3]} * {b[1]}", f"{a[0]} * {b[2]} + {a[2]} * {b[3]}", f"{a[1]} * {b[2]} + {a[3]} * {b[3]}", f"{a[0]} * {b[4]} + {a[2]} * {b[5]} + {a[4]}", f"{a[1]} * {b[4]} + {a[3]} * {b[5]} + {a[5]}"]


_MATS = """, q as (select x, y, r, g, b, r / 64::double as ma, g / 128::double - 1 as mb, b / 100::double - 1 as mc, ((r + g) % 7 - 3)::double as md, x::double as me, (y - 5)::double as mf, b / 90::double as na, 0.5::double as nb, -0.25::double as nc, g / 80::double as nd, 3::double as ne, r / 10::double as nf,
    x as x0, y % 7 as y0, x + 20 as x1, y % 7 + r as y1 from pe), d as (select *, ma * md - mb * mc as det, atan2(nb, na) as rot from q)"""
_corners = [f"(m{{0}} * {a} + m{{1}} * {b} + m{{2}})" for a in ("x0", "x1") for b in ("y0", "y1")]
_cx, _cy = [c.format("a", "c", "e") for c in _corners], [c.format("b", "d", "f") for c in _corners]
_cd = ("nc * cos(rot) + nd * sin(rot)", "(nd * cos(rot) - nc * sin(rot))")
_qa, _qb, _qc, _qd = "(b - r / 2::double) / 20", "(x - g / 2::double) / 20", "(y - r / 2::double) / r", "(r / 3::double - g / 2::double) / r"
_add(
    "scalar_matrices", _matrices,
    {
        "then": _sum6(*_mul("n", "m")), "product": _sum6(*_mul("m", "n")), "about": _sum6("na", "nb", "nc", "nd", "na * -x + nc * -4 + ne + x", "nb * -x + nd * -4 + nf + 4"),
        "undo": "case when abs(det) > 1e-3::double then " + _sum6("md / det", "-mb / det", "-mc / det", "ma / det", "(mc * mf - md * me) / det", "(mb * me - ma * mf) / det") + " else 0 end",
        "skew": _sum6("1", "tan(g / 300::double)", "tan(r / 255::double)", "1", "0", "0"),
        "quad": f"case when r = 0 then 6 else {_sum6(_qa, _qb, _qc, _qd, f'r / 2::double - {_qa} * x0 - {_qc} * y0', f'g / 2::double - {_qb} * x0 - {_qd} * y0')} end",
        "px": "ma * b + mc * x + me", "py": "mb * b + md * x + mf", "det": "det",
        "around": f"least({', '.join(_cx)}) + 2 * least({', '.join(_cy)}) + 3 * greatest({', '.join(_cx)}) + 5 * greatest({', '.join(_cy)})",
        "scale_x": "sqrt(na * na + nb * nb) * case when na * nd - nb * nc < 0 then -1 else 1 end", "scale_y": _cd[1], "rotation": "rot", "skew_x": f"case when {_cd[1]} = 0 then 0 else atan2({_cd[0]}, {_cd[1]}) end",
        "same": "r % 2 = 0", "shift": "r % 2 = 0",
    },
    _MATS, "d", ("same", "shift"),
)


def _views(px):
    r, g, b, x, y = _pixel()
    v = G.view(r / 100 + 0.1, x, y, g / 100, 640, 480)
    m, at, seen = G.to_screen(v), G.at_screen(v, b, x), G.visible(v)
    near, all_ = G.zoom_at(v, 1.5, b, x), G.fit(v, r + 1, g + 1)
    w, h = G.thumb_size(r + 1, g + 1, 48)
    return {"m": sum((m[k] * f for k, f in zip("abcdef", (1, 2, 3, 5, 7, 11), strict=True)), F.lit(0.0)), "dx": at[0], "dy": at[1], "seen": (seen["x1"] - seen["x0"]) * 1000 + seen["y1"] - seen["y0"], "zoom": near["zoom"], "zx": near["cx"], "zy": near["cy"], "fit": all_["zoom"], "fx": all_["cx"], "level": G.mip_level(r / 255, 6), "thumb": w * 1000 + h}


_VIEWS = """, q as (select *, r / 100::double + 0.1::double as z, cos(g / 100::double) as co, sin(g / 100::double) as si from pe),
  p as (select *, ((b - 320) * co + (x - 240) * si) / z as px, ((x - 240) * co - (b - 320) * si) / z as py, (640 * abs(co) + 480 * abs(si)) / z / 2 as hw, (640 * abs(si) + 480 * abs(co)) / z / 2 as hh from q)"""
_add(
    "scalar_views", _views,
    {
        "m": _sum6("co * z", "si * z", "-si * z", "co * z", "320 - z * (co * x - si * y)", "240 - z * (si * x + co * y)"), "dx": "x + px", "dy": "y + py",
        "seen": "cast((ceil(x + hw) - floor(x - hw)) * 1000 + ceil(y + hh) - floor(y - hh) as bigint)", "zoom": "z * 1.5::double", "zx": "x + px - px / 1.5::double", "zy": "y + py - py / 1.5::double",
        "fit": "least(128::double, least(608 / (r + 1)::double, 448 / (g + 1)::double))", "fx": "(r + 1) / 2::double",
        "level": "case when r = 255 then 0 else greatest(0, least(6, cast(floor(log2(1 / greatest(r / 255::double, 1e-6::double))) as bigint))) end",
        "thumb": "greatest(1, cast(floor((r + 1) * (48 / greatest(r, g)::double * greatest(r, g) / (greatest(r, g) + 1)) + 0.5) as bigint)) * 1000 + greatest(1, cast(floor((g + 1) * (48 / (greatest(r, g) + 1)::double) + 0.5) as bigint))",
    },
    _VIEWS, "p", ("seen", "level", "thumb"),
)
ORACLE_SQL["scalar_views"] = ORACLE_SQL["scalar_views"].replace("48 / greatest(r, g)::double * greatest(r, g) / (greatest(r, g) + 1)", "48 / (greatest(r, g) + 1)::double")

# Painting.


def _painting(px):
    r, g, b, x, y = _pixel()
    p, s = r / 255, g / 255
    out = {f"dual_{m}": P.dual_blend(m, p, s) for m in ("multiply", "darken", "overlay", "colorDodge", "colorBurn", "linearBurn", "hardMix", "linearHeight")}
    out |= {f"texture_{m}": P.texture_blend(m, p, s, 0.8) for m in ("multiply", "subtract", "darken", "overlay", "colorDodge", "colorBurn", "linearBurn", "hardMix", "linearHeight", "height")}
    out |= {f"{'dodge' if d else 'burn'}_{k}": P.tone(p, d, k, 0.6) for d in (True, False) for k in ("shadows", "midtones", "highlights")}
    return out | {"wet": P.wet_edges(p), "step": P.smoothstep(0.2, 0.7, p), "texel": P.pattern_index(6, 4, 150, 1.5, -2, x, y), "noise": P.noise(x, y, 7), "grain": P.brush_noise(x, y, 3)}


_OVER = "case when p < 0.5 then 2 * p * {s} else 1 - 2 * (1 - p) * (1 - {s}) end"
_deep = lambda v: f"p + (least(1::double, greatest(0::double, {v})) - p) * 0.8::double"
_imul = lambda v, k: f"(((({v})::bigint * {k >> 16}) & 65535) * 65536 + ({v})::bigint * {k & 65535}) & 4294967295"
_HASHES = f""", q as (select *, r / 255::double as p, g / 255::double as s, xor(xor({_imul('x', P.FILTER_HASH[0])}, {_imul('y', P.FILTER_HASH[1])}), {_imul('7', P.FILTER_HASH[2])}) as h, xor(xor({_imul('x', P.BRUSH_HASH[0])}, {_imul('y', P.BRUSH_HASH[1])}), {_imul('3', P.BRUSH_HASH[2])}) as k from pe),
  h1 as (select *, xor(h, h >> 13) as h2, xor(k, k >> 15) as k2 from q), h3 as (select *, {_imul('h2', 1274126177)} as h4, {_imul('k2', 0x85EBCA6B)} as k4 from h1), h5 as (select *, xor(k4, k4 >> 13) as k5 from h3), h6 as (select *, {_imul('k5', 0xC2B2AE35)} as k6 from h5)"""
_add(
    "scalar_painting", _painting,
    {
        "dual_multiply": "p * s", "dual_darken": "least(p, s)", "dual_overlay": _OVER.format(s="s"), "dual_colorDodge": "case when s >= 1 then case when p > 0 then 1 else 0 end else least(1::double, p / (1 - s)) * s end",
        "dual_colorBurn": "case when s <= 0 then 0 else greatest(0::double, 1 - (1 - p) / s) end", "dual_linearBurn": "greatest(0::double, p + s - 1)", "dual_hardMix": "case when p + s >= 1 then p else 0 end", "dual_linearHeight": "least(1::double, p * (0.5 + s))",
        "texture_multiply": _deep("p * s"), "texture_subtract": _deep("p - (1 - s)"), "texture_darken": _deep("least(p, s)"), "texture_overlay": _deep(_OVER.format(s="s")), "texture_colorDodge": _deep("case when s >= 1 then 1 else least(1::double, p / (1 - s)) end"),
        "texture_colorBurn": _deep("case when s <= 0 then 0 else greatest(0::double, 1 - (1 - p) / s) end"), "texture_linearBurn": _deep("p + s - 1"), "texture_hardMix": _deep("case when p + s >= 1 then 1 else 0 end"), "texture_linearHeight": _deep("p * (0.5 + s)"), "texture_height": _deep("p * s * 2"),
        "dodge_shadows": "0.8::double * p + (1 - 0.8::double)", "dodge_midtones": "power(p, 1 / 1.6::double)", "dodge_highlights": "least(1::double, p * 1.2::double)", "burn_shadows": "greatest(0::double, 1.2::double * p - (1.2::double - 1))", "burn_midtones": "power(p, 1.6::double)", "burn_highlights": "p * 0.8::double",
        "wet": "p * (0.5 + 2 * p * (1 - p))", "step": "least(1::double, greatest(0::double, (p - 0.2::double) / 0.5::double)) * least(1::double, greatest(0::double, (p - 0.2::double) / 0.5::double)) * (3 - 2 * least(1::double, greatest(0::double, (p - 0.2::double) / 0.5::double)))",
        "texel": "cast((((floor((y + 0.5 + 2) / 1.5::double) % 4) + 4) % 4) * 6 + (((floor((x + 0.5 - 1.5) / 1.5::double) % 6) + 6) % 6) as bigint)", "noise": "xor(h4, h4 >> 16) / 4294967296::double", "grain": "xor(k6, k6 >> 16) / 4294967296::double",
    },
    _HASHES, "h6", ("texel",),
)


def _recolored(px):
    out = {}
    for mode in ("hue", "saturation", "color", "luminosity"):
        out |= {f"{mode}_{c}": v for c, v in zip("rgb", P.recolor(_unit_of(), (0.8, 0.4, 0.2), mode), strict=True)}
    return out


_way = lambda h, s, l, n: f"{l} - {s} * least({l}, 1 - {l}) * greatest(-1::double, least(({h} / 30 + {n}) % 12 - 3, 9 - ({h} / 30 + {n}) % 12, 1::double))"  # noqa: E731, E741
_PAINT = {"hue": ("20::double", "s0", "l0"), "saturation": ("h0", "0.6::double", "l0"), "color": ("20::double", "0.6::double", "l0"), "luminosity": ("h0", "s0", "0.5::double")}
_add("scalar_recolor", _recolored, {f"{m}_{c}": _way(*of, n) for m, of in _PAINT.items() for c, n in zip("rgb", (0, 8, 4), strict=True)}, _HSL[len(PX):], "e")
