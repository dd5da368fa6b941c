"""Registered layer trees of many documents and their SQL: one step of the fold is one query of the chain."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.compositing import composite
from pixelloom.operators.layers import SPECIAL_FILL_NEUTRAL
from pixelloom.plans.queries import BLEND_SQL, PX
from pixelloom.sources.rasters import events_raster, orders_raster

QUERIES = {}
ORACLE_SQL = {}

#: Rows of a document: the rasters are cut into strips.
STRIP = 25
INVERT = [[255 - v for v in range(256)]] * 3


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Layer 1 the events, 2 the orders, 3 some of the orders, moved and with channels exchanged."""
    events, orders = events_raster(spark, d), orders_raster(spark, d)
    third = orders.where("r < 128").select(((F.col("x") + 37) % 100).alias("x"), "y", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), "a")
    every = events.withColumn("layer", F.lit(1)).unionByName(orders.withColumn("layer", F.lit(2))).unionByName(third.withColumn("layer", F.lit(3)))
    return every.select(F.floor(F.col("y") / STRIP).alias("doc"), F.col("layer").cast("long").alias("layer"), "x", (F.col("y") % STRIP).alias("y"), "r", "g", "b", "a")


def _masks(pixels: DataFrame) -> DataFrame:
    """One mask for every layer that has one: a ramp, absent on the right."""
    px = pixels.select("doc", "x", "y").distinct().where("x < 80")
    cov = ((F.col("x") * 5 + F.col("y") * 3) % 256).alias("cov")
    return px.select("doc", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 10, 11, 12)))).alias("layer"), "x", "y", cov)


_LAYER = "id long, parent long, z long, kind string, visible boolean, opacity double, fill double, mode string, clipped boolean, as_group boolean, knockout string, channels string, ranges array<struct<channel:string,this:array<double>,under:array<double>>>, masked boolean, density double, tables array<array<int>>"


def px(id: int, **options) -> dict:
    return {"id": id, "kind": "pixel"} | options


def group(id: int, *children: dict, **options) -> dict:
    return {"id": id, "kind": "group", "children": children, "mode": "passThrough"} | options


def invert(id: int, **options) -> dict:
    return {"id": id, "kind": "adjustment", "tables": INVERT} | options


_PLAIN = {"visible": True, "opacity": 1.0, "fill": 1.0, "mode": "normal", "clipped": False, "as_group": True, "knockout": "none", "channels": "rgb", "ranges": [], "masked": False, "density": 1.0, "tables": None}


def _rows(tree: tuple, parent: int | None = None) -> list[dict]:
    out = []
    for z, x in enumerate(tree):
        out.append(_PLAIN | {k: v for k, v in x.items() if k != "children"} | {"parent": parent, "z": z})
        out += _rows(x.get("children", ()), x["id"])
    return out


class Chain:
    """A WITH chain whose paints are columns <name>_r, _g, _b, _a of one row a pixel."""

    def __init__(self):
        self.sql, self.last, self.numbers = "", "cells", count()
        self.add("clear", "0::double", "0::double", "0::double", "0::double")

    def add(self, name: str, *exprs: str) -> str:
        step = f"c{next(self.numbers)}"
        self.sql += f", {step} as (select *, {', '.join(f'{e} as {name}_{c}' for e, c in zip(exprs, 'rgba'))} from {self.last})"
        self.last = step
        return name

    def new(self, *exprs: str) -> str:
        return self.add(f"p{next(self.numbers)}", *exprs)

    def value(self, expr: str) -> str:
        """A column of one expression."""
        step, name = f"c{next(self.numbers)}", f"v{next(self.numbers)}"
        self.sql += f", {step} as (select *, {expr} as {name} from {self.last})"
        self.last = step
        return name

    def over(self, mode: str, below: str, color: str, alpha: str) -> str:
        a = self.value(alpha)
        out = f"({a} + {below}_a * (1 - {a}))"
        one = lambda c: f"case when {out} <= 0 then 0::double else ((1 - {a}) * {below}_a * {below}_{c} + {a} * ((1 - {below}_a) * {color}_{c} + {below}_a * ({BLEND_SQL[mode].format(b=f'{below}_{c}', s=f'{color}_{c}')}))) / {out} end"
        return self.new(*(one(c) for c in "rgb"), out)

    def fade(self, p: str, q: str, t: str) -> str:
        t = self.value(t)
        a = f"({p}_a + ({q}_a - {p}_a) * {t})"
        one = lambda c: f"case when {a} <= 0 then 0::double else ({p}_{c} * {p}_a + ({q}_{c} * {q}_a - {p}_{c} * {p}_a) * {t}) / {a} end"
        return self.new(*(one(c) for c in "rgb"), a)

    def when(self, test: str, p: str, q: str) -> str:
        return self.new(*(f"case when {test} then {p}_{c} else {q}_{c} end" for c in "rgba"))

    def only(self, x: dict, p: str, q: str) -> str:
        return self.new(*(f"{p if c in x['channels'] else q}_{c}" for c in "rgb"), f"{p}_a")

    def mask(self, x: dict) -> str:
        return f"(1 - {x['density']!r}::double * (1 - cov))" if x["masked"] else "1::double"

    def weight(self, ranges: list[dict], source: str, below: str) -> str:
        def ramp(v: str, s: list[float]) -> str:
            b0, b1, w0, w1 = (f"{k!r}::double" for k in s)
            up = f"when {v} < {b1} then ({v} - {b0}) / ({b1} - {b0})" if s[0] != s[1] else ""
            down = f"when {v} <= {w1} then 1 - ({v} - {w0}) / ({w1} - {w0})" if s[2] != s[3] else ""
            return f"(case when {v} < {b0} then 0::double {up} when {v} <= {w0} then 1::double {down} else 0::double end)"

        of = lambda p, c: f"(0.3::double * {p}_r + 0.59::double * {p}_g + 0.11::double * {p}_b)" if c == "gray" else f"{p}_{c}"
        return " * ".join(f"{ramp(of(source, r['channel']), r['this'])} * {ramp(of(below, r['channel']), r['under'])}" for r in ranges) or "1::double"

    def stack(self, tree: tuple, acc: str, entry: str, base: str) -> str:
        tree = [_PLAIN | x for x in tree]
        k = 0
        while k < len(tree):
            x, run = tree[k], []
            k += 1
            if not x["visible"]:
                continue
            while k < len(tree) and tree[k]["clipped"]:
                run += [tree[k]] if tree[k]["visible"] else []
                k += 1
            acc = self.clip(x, run, acc, entry, base) if run else self.one(x, acc, entry, base)
        return acc

    def one(self, x: dict, acc: str, entry: str, base: str, limit: str = "1::double") -> str:
        if x["kind"] == "group":
            share = self.value(f"{self.mask(x)} * {x['opacity']!r}::double")
            if x["mode"] == "passThrough":
                inner = self.stack(x["children"], acc, acc, base)
                return self.when(f"{share} >= 1", inner, self.fade(acc, inner, share))
            inner = self.stack(x["children"], "clear", "clear", base)
            alpha = self.value(f"{inner}_a * {share}")
            return self.only(x, self.when(f"{alpha} > 0", self.over(x["mode"], acc, inner, alpha), acc), acc)
        if x["kind"] == "adjustment":
            byte = lambda c: f"floor(least(1::double, greatest(0::double, {acc}_{c})) * 255 + 0.5)"
            new = self.new(*(f"(255 - {byte(c)}) / 255::double" for c in "rgb"), "1::double")
            solid = self.new(*(f"{acc}_{c}" for c in "rgb"), "1::double")
            cover = self.value(f"{self.mask(x)} * {x['fill']!r}::double * {x['opacity']!r}::double * {self.weight(x['ranges'], new, acc)}")
            done = self.over(x["mode"], solid, new, cover)
            done = self.new(*(f"{done}_{c}" for c in "rgb"), f"{acc}_a")
            return self.only(x, self.when(f"{acc}_a > 0 and {cover} > 0", done, acc), acc)
        s = f"l{x['id']}"
        shape = self.value(f"{s}_a * {limit} * {self.mask(x)} * {x['opacity']!r}::double")
        ground = acc if x["knockout"] == "none" else self.fade(acc, base if x["knockout"] == "deep" else entry, shape)
        special = SPECIAL_FILL_NEUTRAL.get(x["mode"])
        cover = self.value(f"{shape} * {1 if special is not None else x['fill']!r}::double * {self.weight(x['ranges'], s, acc)}")
        color = s if special is None else self.new(*(f"{special!r}::double + ({s}_{c} - {special!r}::double) * {x['fill']!r}::double" for c in "rgb"), f"{s}_a")
        return self.only(x, self.when(f"{cover} > 0", self.over(x["mode"], ground, color, cover), ground), acc)

    def clip(self, x: dict, run: list[dict], acc: str, entry: str, base: str) -> str:
        if x["kind"] != "pixel":
            for y in (x, *run):
                acc = self.one(y, acc, entry, base)
            return acc
        s = f"l{x['id']}"
        alpha = self.value(f"{s}_a * {self.mask(x)}")
        if not x["as_group"]:
            new = self.one(x, acc, entry, base)
            for y in run:
                new = self.one(y, new, entry, base, alpha)
            return self.when(f"{alpha} > 0", new, acc)
        inner = self.new(*(f"{s}_{c}" for c in "rgb"), "1::double")
        for y in run:
            inner = self.one(y, inner, inner, base)
        done = self.over(x["mode"], acc, inner, f"{alpha} * {x['fill']!r}::double * {x['opacity']!r}::double")
        return self.when(f"{alpha} > 0", self.only(x, done, acc), acc)


_of = lambda k, c: f"case when coalesce(l{k}.a, 0) = 0 then 0::double else l{k}.{c} / 255::double end as l{k}_{c}"
_CELLS = PX + f""", l1 as (select floor(y / {STRIP})::bigint as doc, x, y % {STRIP} as y, r, g, b, a from pe), l2 as (select floor(y / {STRIP})::bigint as doc, x, y % {STRIP} as y, r, g, b, a from po),
  l3 as (select floor(y / {STRIP})::bigint as doc, (x + 37) % 100 as x, y % {STRIP} as y, g as r, b as g, r as b, a from po where r < 128),
  every as (select doc, x, y from l1 union select doc, x, y from l2 union select doc, x, y from l3),
  bx as (select doc, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from every group by doc),
  spots as (select doc, i as x, j as y from bx, range(0, 100) a(i), range(0, {STRIP}) c(j) where i between x0 and x1 and j between y0 and y1),
  cells as (select spots.doc, spots.x, spots.y, case when spots.x < 80 and e.x is not null then (spots.x * 5 + spots.y * 3) % 256 else 0 end / 255::double as cov, {', '.join(_of(k, c) for k in (1, 2, 3) for c in 'rgb')}, {', '.join(f'coalesce(l{k}.a, 0) / 255::double as l{k}_a' for k in (1, 2, 3))}
    from spots left join every e using (doc, x, y) left join l1 using (doc, x, y) left join l2 using (doc, x, y) left join l3 using (doc, x, y))"""


def _tree(name: str, *tree: dict) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pixels = _pixels(spark, d)
        rows = _rows(tree)
        names = [c.split()[0] for c in _LAYER.split(", ")]
        one = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], _LAYER)
        layers = pixels.select("doc").distinct().join(F.broadcast(one))  # the same few layers for each document
        return composite(layers, pixels, _masks(pixels))

    chain = Chain()
    done = chain.stack(tree, "clear", "clear", "clear")
    QUERIES[name] = run
    ORACLE_SQL[name] = _CELLS + chain.sql + " select doc, x, y, " + ", ".join(f"cast(floor({done}_{c} * 255 + 0.5) as bigint) as {c}" for c in "rgba") + f" from {chain.last}"


_tree("composite_isolated_group", px(1), group(10, px(2, mode="multiply"), px(3, mode="screen", opacity=0.6), mode="normal", opacity=0.8))
_tree("composite_pass_through_group", px(1), group(10, px(2, mode="multiply"), px(3, mode="screen", opacity=0.6), opacity=0.7))
_tree("composite_group_mask", px(1), group(10, px(2, mode="overlay"), masked=True, density=0.75), group(11, px(3), mode="multiply", masked=True, channels="rb"))
_tree("composite_nested_groups", px(1), group(10, px(2, opacity=0.9), group(11, px(3, mode="difference"), opacity=0.5), mode="hardLight", opacity=0.6))
_tree("composite_knockout_shallow", px(1), group(10, px(2), px(3, knockout="shallow", fill=0.0, opacity=0.7)), px(3, mode="linearDodge", opacity=0.2))
_tree("composite_knockout_isolated", px(1), group(10, px(2), px(3, knockout="shallow", fill=0.4), mode="normal", opacity=0.9))
_tree("composite_knockout_deep", px(1), group(10, px(2, opacity=0.8), px(3, knockout="deep", fill=0.25, masked=True)))
_tree("composite_clip_run", px(1), px(2, mode="multiply", opacity=0.8, masked=True), px(3, clipped=True, mode="screen"), invert(12, clipped=True, opacity=0.5), px(1, clipped=True, visible=False))
_tree("composite_clip_each", px(1), px(2, as_group=False, opacity=0.7), px(3, clipped=True, mode="darken"), invert(12, clipped=True, opacity=0.25))
_tree("composite_clip_hidden_base", px(1), px(2, visible=False), px(3, clipped=True, mode="lighten", fill=0.5), px(2, clipped=True, mode="exclusion"))
_tree("composite_adjustment_in_group", px(1), group(10, px(3, opacity=0.37), invert(12, masked=True), opacity=0.9), group(11, px(2), invert(13, fill=0.5), mode="multiply", opacity=0.4))
_RANGES = [{"channel": "r", "this": [0.1, 0.3, 0.8, 0.9], "under": [0.0, 0.0, 1.0, 1.0]}, {"channel": "b", "this": [0.0, 0.0, 1.0, 1.0], "under": [0.2, 0.4, 0.6, 1.0]}]
_tree("composite_blend_if_channels", px(1), px(2, ranges=_RANGES, mode="linearBurn", fill=0.6), invert(12, ranges=[{"channel": "gray", "this": [0.0, 0.5, 1.0, 1.0], "under": [0.0, 0.0, 0.7, 0.9]}]))
