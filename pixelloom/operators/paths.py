"""Paths of many documents as tables of knots, flattened to edges and rasterised by scanlines.

A knot is (doc, shape, n, ax, ay, ix, iy, ox, oy): the anchor and its two handles;
``shapes`` says of (doc, shape) whether it is ``closed``, its ``op`` (add, subtract,
intersect, exclude) and ``rule`` (nonzero, evenodd). Shapes of a document are
combined in order of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines a pixel row is sampled on.
SUB = 16
#: Distance in pixels between a curve and the line that stands for it.
TOLERANCE = 0.05
XY = ("ax", "ay", "ix", "iy", "ox", "oy")


def straight_knots(points: DataFrame) -> DataFrame:
    """Knots without handles from points (doc, shape, n, x, y): polygons."""
    return points.select("doc", "shape", "n", *(F.col(c[1]).cast("double").alias(c) for c in XY))


def transformed(knots: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float) -> DataFrame:
    """All anchors and handles under an affine map, which is exact for cubics."""
    at = lambda p: ((a * F.col(f"{p}x") + c * F.col(f"{p}y") + e).alias(f"{p}x"), (b * F.col(f"{p}x") + d * F.col(f"{p}y") + f).alias(f"{p}y"))
    return knots.select("doc", "shape", "n", *at("a"), *at("i"), *at("o"))


def reversed_knots(knots: DataFrame) -> DataFrame:
    """Each shape run through the other way: handles change places."""
    return knots.select("doc", "shape", (-F.col("n")).alias("n"), "ax", "ay", F.col("ox").alias("ix"), F.col("oy").alias("iy"), F.col("ix").alias("ox"), F.col("iy").alias("oy"))


def segments(knots: DataFrame, shapes: DataFrame) -> DataFrame:
    """(doc, shape, n, x0, y0, ..., x3, y3): the cubic from each knot to the next; a closed shape's last goes to its first."""
    w = Window.partitionBy("doc", "shape").orderBy("n")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct("ax", "ay", "ix", "iy")
    rows = knots.join(shapes.select("doc", "shape", "closed"), ["doc", "shape"])
    rows = rows.select("*", F.lead(point).over(w).alias("next"), F.first(point).over(whole).alias("first"), F.count("*").over(whole).alias("knots"))
    rows = rows.withColumn("to", F.when(F.col("next").isNotNull(), F.col("next")).when(F.col("closed") & (F.col("knots") > 1), F.col("first"))).where("to is not null")
    names = (("ax", "x0"), ("ay", "y0"), ("ox", "x1"), ("oy", "y1"), ("to.ix", "x2"), ("to.iy", "y2"), ("to.ax", "x3"), ("to.ay", "y3"))
    return rows.select("doc", "shape", "n", *(F.col(a).alias(b) for a, b in names))


def pieces(c: tuple[float, ...], tolerance: float) -> list[tuple[float, float]]:
    """Points after the start of a cubic: halved until its handles are as near to the chord as asked."""
    out, todo = [], [(c, 0)]
    while todo:
        (x0, y0, x1, y1, x2, y2, x3, y3), depth = todo.pop()
        dx, dy = x3 - x0, y3 - y0
        chord = math.hypot(dx, dy)
        off = max(abs((x - x0) * dy - (y - y0) * dx) for x, y in ((x1, y1), (x2, y2))) / chord if chord >= 1e-6 else max(math.hypot(x1 - x0, y1 - y0), math.hypot(x2 - x0, y2 - y0))
        if off <= tolerance or depth > 16:
            out.append((x3, y3))
            continue
        m = [(p + q) / 2 for p, q in ((x0, x1), (y0, y1), (x1, x2), (y1, y2), (x2, x3), (y2, y3))]
        n = [(m[0] + m[2]) / 2, (m[1] + m[3]) / 2, (m[2] + m[4]) / 2, (m[3] + m[5]) / 2]
        h = [(n[0] + n[2]) / 2, (n[1] + n[3]) / 2]
        todo += [((*h, *n[2:], *m[4:], x3, y3), depth + 1), ((x0, y0, *m[:2], *n[:2], *h), depth + 1)]
    return out


def edges(knots: DataFrame, shapes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, shape, x0, y0, x1, y1) of the outlines; an open shape is closed by a straight line, as a fill needs."""
    shut = shapes.withColumn("closed", F.lit(True))
    open_ = shapes.where("not closed").select("doc", "shape", F.lit(True).alias("open"))
    last = Window.partitionBy("doc", "shape").orderBy(F.desc("n"))
    rows = segments(knots, shut).join(open_, ["doc", "shape"], "left").withColumn("last", F.row_number().over(last) == 1)
    line = F.col("open") & F.col("last")  # what closes an open shape
    rows = rows.select("doc", "shape", *(F.when(line, F.col(near)).otherwise(F.col(c)).alias(c) for c, near in (("x0", "x0"), ("y0", "y0"), ("x1", "x0"), ("y1", "y0"), ("x2", "x3"), ("y2", "y3"), ("x3", "x3"), ("y3", "y3"))))

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, shape, *c in zip(*(x.to_pylist() for x in b.columns)):
                at = (c[0], c[1])
                for to in pieces(tuple(c), tolerance):
                    for col, v in zip(out, (doc, shape, *at, *to)):
                        col.append(v)
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (b.schema.field(0).type, b.schema.field(1).type, *[pa.float64()] * 4))], names=["doc", "shape", "x0", "y0", "x1", "y1"])

    kinds = dict(rows.dtypes)
    # Few bytes, but long edges cross many lines: dealt over all tasks, by a number that is kept.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x0", "y0", "x3", "y3")
    return rows.mapInArrow(flatten, f"doc {kinds['doc']}, shape {kinds['shape']}, x0 double, y0 double, x1 double, y1 double")


def path_bounds(outline: DataFrame) -> DataFrame:
    return outline.groupBy("doc").agg(F.least(F.min("x0"), F.min("x1")).alias("x0"), F.least(F.min("y0"), F.min("y1")).alias("y0"), F.greatest(F.max("x0"), F.max("x1")).alias("x1"), F.greatest(F.max("y0"), F.max("y1")).alias("y1"))


def areas(outline: DataFrame) -> DataFrame:
    """(doc, shape, area): positive where the outline turns from x towards y."""
    return outline.groupBy("doc", "shape").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))


def crossings(outline: DataFrame, sub: int) -> DataFrame:
    """(doc, py, k, shape, x, turn) where edges cross the lines y = py + (k + 0.5) / sub; ``turn`` is 1 downwards.

    An edge has its upper end and not its lower one, so a corner is crossed once.
    """
    down = F.col("y1") > F.col("y0")
    top, low = F.least("y0", "y1"), F.greatest("y0", "y1")
    # The lines with top <= y < low.
    first, last = F.ceil(top * sub - 0.5), F.ceil(low * sub - 0.5) - 1
    rows = outline.where("y0 <> y1").withColumn("line", F.explode(F.when(first <= last, F.sequence(first, last))))
    y = (F.col("line") + 0.5) / sub
    xa, ya, xb, yb = (F.when(down, F.col(p)).otherwise(F.col(q)) for p, q in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0")))
    return rows.select("doc", F.floor(F.col("line") / sub).alias("py"), F.pmod("line", F.lit(sub)).cast("int").alias("k"), "shape", (xa + (y - ya) / (yb - ya) * (xb - xa)).alias("x"), F.when(down, 1).otherwise(-1).alias("turn"))


#: What a shape makes of what stands before it (a) and itself (b).
OPS = {"add": np.logical_or, "subtract": lambda a, b: a & ~b, "intersect": np.logical_and, "exclude": np.logical_xor}


def coverage(outline: DataFrame, shapes: DataFrame, boxes: DataFrame, sub: int = SUB) -> DataFrame:
    """(doc, x, y, cover: 0...1) of the pixels in ``boxes`` (doc, x0, y0, x1, y1: long) that the combined shapes cover at all.

    Exact along x, sampled on ``sub`` lines a pixel row. The first shape's
    operation has nothing before it: if it subtracts, all but it is covered.
    Crossings are sorted by line and x and stream through; a task holds those
    of one line and the coverage of one row of pixels.
    """
    ops = shapes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("shape", "op", "rule"))).alias("ops"))  # shapes of one path
    # A row of pixels stands before its crossings, and alone if it has none: it is covered where the first shape subtracts.
    every = boxes.join(ops, "doc").withColumn("py", F.explode(F.sequence("y0", F.col("y1") - 1))).select("doc", "py", F.lit(-1).alias("k"), "x0", "x1", "ops")
    rows = every.unionByName(crossings(outline, sub), allowMissingColumns=True).where("doc is not null").select("doc", "py", "k", "shape", "x", "turn", "x0", "x1", "ops")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, line, held = None, None, []  # the row of pixels, and the crossings of its last line so far

        def close() -> None:
            if held and row and row.key == line[:2]:
                row.add(*(np.concatenate(c) for c in zip(*held)))
                row.lines += 1
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            doc, kind = b.column("doc"), b.schema.field("doc").type
            key = [b.column(c).to_numpy(zero_copy_only=False) for c in ("py", "k")]
            other = pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1)).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.logical_or.reduce([other, *(np.diff(c) != 0 for c in key)])) + 1
            shape, x, turn = b.column("shape"), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "turn"))
            for s, e in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows]):
                at = (doc[s].as_py(), int(key[0][s]), int(key[1][s]))
                if at != line:
                    close()
                    line = at
                if at[2] >= 0:
                    held.append((shape[s:e].to_numpy(zero_copy_only=False), x[s:e], turn[s:e]))
                    continue
                if row:
                    yield row.batch(kind)
                row = _Row(at[:2], b.column("x0")[s].as_py(), b.column("x1")[s].as_py(), b.column("ops")[s].as_py(), sub)
        close()
        if row:
            yield row.batch(kind)

    return rows.repartition("doc", "py").sortWithinPartitions("doc", "py", "k", "x").mapInArrow(fill, f"doc {dict(rows.dtypes)['doc']}, x long, y long, cover double")


class _Row:
    """Coverage of one row of pixels, line by line."""

    def __init__(self, key: tuple, left: int, right: int, ops: list[dict], sub: int):
        self.key, self.left, self.width, self.ops, self.sub, self.lines = key, left, right - left, ops, sub, 0
        self.ends, self.run = np.zeros(self.width + 2), np.zeros(self.width + 2)

    def add(self, shape: np.ndarray, x: np.ndarray, turn: np.ndarray) -> None:
        """One line, by its crossings from left to right; nothing is held at the far left."""
        xs = np.concatenate([[-np.inf], x, [np.inf]])
        acc = None
        for o in self.ops:
            now = np.concatenate([[0], np.cumsum(np.where(shape == o["shape"], turn, 0))])
            held = now % 2 == 1 if o["rule"] == "evenodd" else now != 0
            acc = OPS[o["op"]](acc, held) if acc is not None else ~held if o["op"] == "subtract" else held
        a, z = np.clip(xs[:-1][acc] - self.left, 0, self.width), np.clip(xs[1:][acc] - self.left, 0, self.width)
        a, z = a[z > a], z[z > a]
        ia, iz = np.floor(a).astype(int), np.floor(z).astype(int)
        same = ia == iz
        np.add.at(self.ends, ia, np.where(same, z - a, ia + 1 - a))
        np.add.at(self.ends, iz[~same], (z - iz)[~same])
        np.add.at(self.run, ia[~same] + 1, 1)
        np.add.at(self.run, iz[~same], -1)

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        if self.ops[0]["op"] == "subtract" and self.lines < self.sub:  # lines without a crossing
            empty = np.empty(0)
            for _ in range(self.sub - self.lines):
                self.add(empty, empty, empty)
        cover = np.minimum(1, (self.ends + np.cumsum(self.run))[: self.width] / self.sub)
        at = np.flatnonzero(cover > 0)
        doc, py = self.key
        return pa.RecordBatch.from_arrays([pa.array([doc] * len(at), kind), pa.array(at + self.left, pa.int64()), pa.array([py] * len(at), pa.int64()), pa.array(cover[at], pa.float64())], names=["doc", "x", "y", "cover"])


def polygon(px: DataFrame, points: DataFrame, smooth: bool = True) -> DataFrame:
    """The selection (doc, x, y, cov) that lassos enclose, on the pixels of ``px`` (doc, x, y): four lines a row, or one; what is enclosed twice is out."""
    boxes = px.groupBy("doc").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    points = points.withColumn("shape", F.lit(0))
    shapes = points.groupBy("doc").agg(F.count("*").alias("n")).where("n >= 3").select("doc", F.lit(0).alias("shape"), F.lit(True).alias("closed"), F.lit("add").alias("op"), F.lit("evenodd").alias("rule"))
    cover = coverage(edges(straight_knots(points), shapes), shapes, boxes, 4 if smooth else 1)
    cover = cover.select(F.col("doc").alias("c_doc"), F.col("x").alias("c_x"), F.col("y").alias("c_y"), "cover")
    both = px.select("doc", "x", "y").join(cover, (F.col("doc") == F.col("c_doc")) & (F.col("x") == F.col("c_x")) & (F.col("y") == F.col("c_y")), "left")
    return both.select("doc", "x", "y", F.least(F.lit(255), F.floor(F.coalesce("cover", F.lit(0.0)) * 255 + 0.5)).cast("long").alias("cov"))
