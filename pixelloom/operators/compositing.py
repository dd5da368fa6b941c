"""Compositing of layer trees: groups, pass-through, knockout, clipping runs and blend ranges, many documents at once.

``layers`` has a row for each layer: doc, id, parent (its group; null at the
root), z (order among siblings from below), kind (pixel, group, adjustment), and
any of the columns of DEFAULTS. ``pixels`` (doc, layer, x, y, r, g, b, a) and
``masks`` (doc, layer, x, y, cov) may be sparse: what is absent is transparent,
or hidden. Pixels meet by document and tile; a tile's layers are folded as
arrays, the tree from its root: each step knows the colour below, what the
group began with, and the document's base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.layers import SPECIAL_FILL_NEUTRAL
from pixelloom.operators.tiles import BOUNDS, RGBA, _inside, _pixels, _planes, bounds, grid, present

#: A tile of one layer is 16 KB; a task holds those of all layers of a document.
TILE = 64
#: Columns that ``layers`` may lack, as SQL.
DEFAULTS = {
    "visible": "true",
    "opacity": "1.0D",
    "fill": "1.0D",
    "mode": "'normal'",
    "clipped": "false",
    "as_group": "true",  # clipped layers blend as one with their base
    "knockout": "'none'",  # shallow: to the group's entry; deep: to the document's base
    "channels": "'rgb'",
    "ranges": "cast(array() as array<struct<channel:string,this:array<double>,under:array<double>>>)",
    "masked": "false",
    "density": "1.0D",
    "adjust": "cast(null as string)",  # desaturate, threshold; else the tables
    "tables": "cast(null as array<array<int>>)",  # of each channel, 256 entries
}

#: Colour (3, n) and alpha (n).
Paint = tuple[np.ndarray, np.ndarray]

_LUM = np.array([0.3, 0.59, 0.11])


def _lum(c: np.ndarray) -> np.ndarray:
    return _LUM[0] * c[0] + _LUM[1] * c[1] + _LUM[2] * c[2]


def _ratio(a: np.ndarray, b: np.ndarray, where: np.ndarray, other) -> np.ndarray:
    """a / b, and ``other`` where it is not to be divided."""
    return np.where(where, other, a / np.where(where, 1, b))


def _burn(b, s):
    return np.where(b >= 1, 1.0, 1 - np.minimum(1, _ratio(1 - b, s, s <= 0, 1.0)))


def _dodge(b, s):
    return np.where(b <= 0, 0.0, np.where(s >= 1, 1.0, np.minimum(1, _ratio(b, 1 - s, s >= 1, 1.0))))


def _hard(b, s):
    return np.where(s <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s))


def _with_sat(c, s):
    low, span = c.min(0), c.max(0) - c.min(0)
    return np.where(span <= 0, 0.0, (c - low) * s / np.where(span <= 0, 1, span))


def _with_lum(c, to):
    c = c + (to - _lum(c))
    level, low, high = _lum(c), c.min(0), c.max(0)
    down, up = (low < 0) & (level > low), (high > 1) & (high > level)
    c = np.where(down, level + (c - level) * level / np.where(down, level - low, 1), c)
    return np.where(up, level + (c - level) * (1 - level) / np.where(up, high - level, 1), c)


BLENDS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "normal": lambda b, s: s,
    "dissolve": lambda b, s: s,
    "darken": np.minimum,
    "multiply": lambda b, s: b * s,
    "colorBurn": _burn,
    "linearBurn": lambda b, s: np.maximum(0, b + s - 1),
    "lighten": np.maximum,
    "screen": lambda b, s: b + s - b * s,
    "colorDodge": _dodge,
    "linearDodge": lambda b, s: np.minimum(1, b + s),
    "overlay": lambda b, s: _hard(s, b),
    "softLight": lambda b, s: np.where(s <= 0.5, 2 * b * s + b * b * (1 - 2 * s), 2 * b * (1 - s) + np.sqrt(b) * (2 * s - 1)),
    "hardLight": _hard,
    "vividLight": lambda b, s: np.where(s <= 0.5, _burn(b, 2 * s), _dodge(b, 2 * s - 1)),
    "linearLight": lambda b, s: np.clip(b + 2 * s - 1, 0, 1),
    "pinLight": lambda b, s: np.where(s <= 0.5, np.minimum(b, 2 * s), np.maximum(b, 2 * s - 1)),
    "hardMix": lambda b, s: (b + s >= 1) * 1.0,
    "difference": lambda b, s: np.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
    "subtract": lambda b, s: np.maximum(0, b - s),
    "divide": lambda b, s: np.where(s <= 0, 1.0, np.minimum(1, _ratio(b, s, s <= 0, 1.0))),
    "hue": lambda b, s: _with_lum(_with_sat(s, b.max(0) - b.min(0)), _lum(b)),
    "saturation": lambda b, s: _with_lum(_with_sat(b, s.max(0) - s.min(0)), _lum(b)),
    "color": lambda b, s: _with_lum(s, _lum(b)),
    "luminosity": lambda b, s: _with_lum(b, _lum(s)),
    "darkerColor": lambda b, s: np.where(_lum(s) < _lum(b), s, b),
    "lighterColor": lambda b, s: np.where(_lum(s) > _lum(b), s, b),
}


def over(mode: str, below: Paint, color: np.ndarray, alpha: np.ndarray) -> Paint:
    """A colour over a paint; transparent black where nothing covers."""
    b, ab = below
    out = alpha + ab * (1 - alpha)
    mixed = (1 - ab) * color + ab * BLENDS[mode](b, color)
    return _ratio((1 - alpha) * ab * b + alpha * mixed, out, out <= 0, 0.0), out


def fade(a: Paint, b: Paint, t: np.ndarray) -> Paint:
    """From one paint to another, premultiplied."""
    alpha = a[1] + (b[1] - a[1]) * t
    pa_, pb = a[0] * a[1], b[0] * b[1]
    return _ratio(pa_ + (pb - pa_) * t, alpha, alpha <= 0, 0.0), np.maximum(alpha, 0)


def choose(where: np.ndarray, a: Paint, b: Paint) -> Paint:
    return np.where(where, a[0], b[0]), np.where(where, a[1], b[1])


def position_noise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Position hash in 0...1, as ``dissolve_noise`` of column expressions."""
    mask = 0xFFFFFFFF
    # The multipliers and shifts.
    h = (x.astype(np.int64) * 374761393 + y.astype(np.int64) * 668265263) & mask
    h ^= h >> 13
    signed = np.where(h >= 1 << 31, h - (1 << 32), h)
    h = (signed.astype(np.float64) * 1274126177.0).astype(np.int64) & mask
    return (h ^ (h >> 16)) / 4294967296.0


def ramp(v: np.ndarray, stops: list[float]) -> np.ndarray:
    """Trapezoid of a split slider."""
    b0, b1, w0, w1 = stops
    up = (v - b0) / (b1 - b0) if b1 != b0 else np.ones_like(v)
    down = 1 - (v - w0) / (w1 - w0) if w1 != w0 else np.zeros_like(v)
    return np.select([v < b0, v < b1, v <= w0, v <= w1], [0.0, up, 1.0, down], 0.0)


def range_weight(ranges: list[dict], source: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Product over the ranges of a layer, each of a channel or of luminance (gray)."""
    of = lambda c, name: _lum(c) if name == "gray" else c["rgb".index(name)]
    out = np.ones(source.shape[1])
    for r in ranges:
        out = out * ramp(of(source, r["channel"]), r["this"]) * ramp(of(below, r["channel"]), r["under"])
    return out


class Tile:
    """The layers of a document within one tile."""

    def __init__(self, layers: list[dict], planes: dict[int, np.ndarray], masks: dict[int, np.ndarray], noise: np.ndarray):
        self.planes, self.masks, self.noise, self.n = planes, masks, noise, noise.size
        self.children: dict[int | None, list[dict]] = {}
        for layer in sorted(layers, key=lambda r: r["z"]):
            self.children.setdefault(layer["parent"], []).append(layer)

    def clear(self) -> Paint:
        return np.zeros((3, self.n)), np.zeros(self.n)

    def source(self, layer: dict) -> Paint:
        if layer["id"] not in self.planes:
            return self.clear()
        v = self.planes[layer["id"]].reshape(4, self.n) / 255
        return np.where(v[3] == 0, 0.0, v[:3]), v[3]

    def cover(self, layer: dict) -> np.ndarray:
        """What a layer's mask leaves, at its density."""
        if not layer["masked"]:
            return np.ones(self.n)
        cov = self.masks[layer["id"]].reshape(self.n) / 255 if layer["id"] in self.masks else np.zeros(self.n)
        return 1 - layer["density"] * (1 - cov)

    def stack(self, parent: int | None, acc: Paint, entry: Paint, base: Paint) -> Paint:
        """The children of a group over ``acc``; a layer and the clipped ones right above it are one step."""
        runs: list[list[dict]] = []
        shown = False  # whether a visible layer lies below to be clipped to
        for layer in self.children.get(parent, []):
            if layer["visible"]:
                if layer["clipped"] and shown:
                    runs[-1].append(layer)
                else:
                    runs.append([layer])
            # A hidden base takes nothing with it: what was clipped to it begins a run of its own.
            shown = layer["visible"] or layer["clipped"] and shown
        for first, *run in runs:
            acc = self.clip_run(first, run, acc, entry, base) if run else self.one(first, acc, entry, base)
        return acc

    def one(self, layer: dict, acc: Paint, entry: Paint, base: Paint, limit: np.ndarray | float = 1.0) -> Paint:
        if layer["kind"] == "group":
            return self.group(layer, acc, base)
        if layer["kind"] == "adjustment":
            return self.adjusted(layer, acc)
        color, alpha = self.source(layer)
        shape = alpha * limit * self.cover(layer) * layer["opacity"]
        ground = acc if layer["knockout"] == "none" else fade(acc, base if layer["knockout"] == "deep" else entry, shape)
        mode, fill = layer["mode"], layer["fill"]
        cover = shape if mode in SPECIAL_FILL_NEUTRAL else shape * fill
        if layer["ranges"]:
            cover = cover * range_weight(layer["ranges"], color, acc[0])
        if mode == "dissolve":
            cover = (cover > self.noise) * 1.0
        if mode == "hardMix" and fill < 1:
            mode, color = "normal", np.clip((ground[0] + fill * color - fill) / (1 - fill), 0, 1)
        done = choose(cover > 0, over(mode, ground, self.filled(mode, color, fill), cover), ground)
        return self.only(layer, done, acc)

    @staticmethod
    def filled(mode: str, color: np.ndarray, fill: float) -> np.ndarray:
        """The colour under a fill that acts inside the blend."""
        neutral = SPECIAL_FILL_NEUTRAL.get(mode)
        return color if neutral is None else neutral + (color - neutral) * fill

    @staticmethod
    def only(layer: dict, done: Paint, acc: Paint) -> Paint:
        """The channels that a layer may change."""
        return np.stack([d if c in layer["channels"] else a for c, d, a in zip("rgb", done[0], acc[0])]), done[1]

    def group(self, layer: dict, acc: Paint, base: Paint) -> Paint:
        share = self.cover(layer) * layer["opacity"]
        if layer["mode"] == "passThrough":
            inner = self.stack(layer["id"], acc, acc, base)
            return choose(share >= 1, inner, fade(acc, inner, share))
        inner = self.stack(layer["id"], self.clear(), self.clear(), base)
        alpha = inner[1] * share
        return self.only(layer, choose(alpha > 0, over(layer["mode"], acc, inner[0], alpha), acc), acc)

    def adjusted(self, layer: dict, acc: Paint) -> Paint:
        """A function of the 8-bit colour below; alpha stays."""
        color, alpha = acc
        byte = np.floor(np.clip(color, 0, 1) * 255 + 0.5).astype(int)
        if layer["adjust"] == "desaturate":
            new = np.repeat(((byte.max(0) + byte.min(0)) / 510)[None], 3, 0)
        elif layer["adjust"] == "threshold":
            new = np.repeat(((_lum(byte) + 1e-3 >= 128) * 1.0)[None], 3, 0)
        elif layer["tables"]:
            new = np.stack([np.array(t)[v] for t, v in zip(layer["tables"], byte)]) / 255
        else:
            return acc
        cover = self.cover(layer) * layer["fill"] * layer["opacity"]
        if layer["ranges"]:
            cover = cover * range_weight(layer["ranges"], new, color)
        done = over(layer["mode"], (color, np.ones(self.n)), new, cover)[0]
        return self.only(layer, choose((alpha > 0) & (cover > 0), (done, alpha), acc), acc)

    def clip_run(self, first: dict, run: list[dict], acc: Paint, entry: Paint, base: Paint) -> Paint:
        if first["kind"] != "pixel":
            for layer in (first, *run):
                acc = self.one(layer, acc, entry, base)
            return acc
        color, alpha = self.source(first)
        alpha = alpha * self.cover(first)
        if not first["as_group"]:
            new = self.one(first, acc, entry, base)
            for layer in run:
                new = self.one(layer, new, entry, base, alpha)
            return choose(alpha > 0, new, acc)
        inner = color, np.ones(self.n)
        for layer in run:
            inner = self.one(layer, inner, inner, base)
        cover = alpha * first["opacity"] * (1 if first["mode"] in SPECIAL_FILL_NEUTRAL else first["fill"])
        done = over(first["mode"], acc, self.filled(first["mode"], inner[0], first["fill"]), cover)
        return choose(alpha > 0, self.only(first, done, acc), acc)


def with_defaults(layers: DataFrame) -> DataFrame:
    return layers.selectExpr("doc", "id", "parent", "z", "kind", *(c if c in layers.columns else f"{sql} as {c}" for c, sql in DEFAULTS.items()))


def composite(layers: DataFrame, pixels: DataFrame, masks: DataFrame | None = None, boxes: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """The flattened documents (doc, x, y, r, g, b, a), every pixel of their boxes (else of their pixels' bounds).

    Hidden layers are left out, with all that a hidden group holds. Rounded to
    8 bits once, at the end. Of repeated pixels of a layer the last one read
    counts; documents without pixels have none.
    """
    boxes = bounds(pixels, ("doc",)) if boxes is None else boxes
    parts = present(pixels, RGBA, ("doc", "layer"), tile).withColumn("mask", F.lit(False))
    if masks is not None:
        parts = parts.union(present(masks, ("cov",), ("doc", "layer"), tile).withColumn("mask", F.lit(True)))
    return folded(layers, parts, boxes, tile)


def folded(layers: DataFrame, parts: DataFrame, boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """``composite`` of what are tiles already: ``parts`` (doc, layer, tx, ty, data, mask), planes of colour or of a mask."""
    parts = parts.groupBy(F.col("doc").alias("p_doc"), F.col("tx").alias("p_tx"), F.col("ty").alias("p_ty")).agg(F.collect_list(F.struct("layer", "mask", "data")).alias("parts"))
    every = grid(boxes, tile)
    tiles = every.join(parts, (F.col("doc") == F.col("p_doc")) & (F.col("tx") == F.col("p_tx")) & (F.col("ty") == F.col("p_ty")), "left").select("doc", "tx", "ty", *BOUNDS, "parts")
    trees = with_defaults(layers).groupBy(F.col("doc").alias("t_doc")).agg(F.collect_list(F.struct("id", "parent", "z", "kind", *DEFAULTS)).alias("tree"))
    both = tiles.join(trees, F.col("doc") == F.col("t_doc"), "left").drop("t_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                mine = row["parts"] or []
                planes = {p["layer"]: _planes(p["data"], 4, tile, "uint8") for p in mine if not p["mask"]}
                cover = {p["layer"]: _planes(p["data"], 1, tile, "uint8") for p in mine if p["mask"]}
                xs, ys = _inside(row, tile)
                noise = position_noise(np.tile(xs, tile), np.repeat(ys, tile))
                t = Tile(row["tree"] or [], planes, cover, noise)
                color, alpha = t.stack(None, t.clear(), t.clear(), t.clear())
                out = np.floor(np.concatenate([color, alpha[None]]) * 255 + 0.5).reshape(4, tile, tile)
                yield _pixels(row, ("doc",), out, RGBA, tile, b)

    return both.mapInArrow(run, f"doc {dict(boxes.dtypes)['doc']}, x long, y long, r long, g long, b long, a long")
