"""Outlines of selections: contours of coverage as closed rings, ranked by pointer jumping, and cubics fitted to them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.staging import cut

#: Points of a ring that are fitted at a time; longer rings are fitted in arcs that share their ends and tangents.
ARC = 4096
#: Side of a block whose points are put end to end at once, and how much wider the next blocks are.
SIDE, GROWTH = 256, 16
#: Rounds of moving the places of points along a curve before it is halved.
ROUNDS = 20

# A cell has its corners at four pixel centres; its sides are named after where they lie. Of each
# pattern of inner corners (upper left 8, upper right 4, lower right 2, lower left 1) the links that
# leave the inside on their right.
LINKS = {
    1: ("BL",), 2: ("RB",), 3: ("RL",), 4: ("TR",), 5: ("TL", "BR"), 6: ("TB",), 7: ("TL",),
    8: ("LT",), 9: ("BT",), 10: ("LB", "RT"), 11: ("RT",), 12: ("LR",), 13: ("BR",), 14: ("LB",),
}


def links(sel: DataFrame, level: float = 0.5) -> DataFrame:
    """(doc, node, next, x, y): points where coverage (doc, x, y, cov) crosses the level between neighbouring pixels, and which follows.

    Absent pixels and those beyond the raster are not covered, so every contour
    closes. A node is a pair of neighbours: twice the place of the first, plus 1
    for the pair one below the other.
    """
    corners = F.array(*(F.struct((F.col("x") - i).alias("cx"), (F.col("y") - j).alias("cy"), F.lit(n).alias("corner")) for n, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    cells = sel.where("cov > 0").select("doc", (F.col("cov") / 255).alias("v"), F.explode(corners).alias("c")).select("doc", "v", "c.*")
    value = lambda n: F.coalesce(F.max(F.when(F.col("corner") == n, F.col("v"))), F.lit(0.0))
    cells = cells.groupBy("doc", "cx", "cy").agg(*(value(n).alias(f"v{n}") for n in range(4)))
    code = sum((F.when(F.col(f"v{n}") > level, 1 << (3 - n)).otherwise(0) for n in range(4)), F.lit(0))
    place = lambda dx, dy, down: (((F.col("cy") + dy) * (1 << 30) + F.col("cx") + dx) * 2 + down)
    node = {"T": place(0, 0, 0), "B": place(0, 1, 0), "L": place(0, 0, 1), "R": place(1, 0, 1)}
    share = lambda a, b: F.when(F.col(f"v{a}") == F.col(f"v{b}"), 0.5).otherwise((level - F.col(f"v{a}")) / (F.col(f"v{b}") - F.col(f"v{a}")))
    at = {
        "T": (F.col("cx") + 0.5 + share(0, 1), F.col("cy") + 0.5),
        "B": (F.col("cx") + 0.5 + share(3, 2), F.col("cy") + 1.5),
        "L": (F.col("cx") + 0.5, F.col("cy") + 0.5 + share(0, 3)),
        "R": (F.col("cx") + 1.5, F.col("cy") + 0.5 + share(1, 2)),
    }
    found = F.when(F.lit(False), F.array().cast("array<struct<node:bigint,next:bigint,x:double,y:double>>"))
    for pattern, ways in LINKS.items():
        found = found.when(F.col("code") == pattern, F.array(*(F.struct(node[a].alias("node"), node[b].alias("next"), at[a][0].cast("double").alias("x"), at[a][1].cast("double").alias("y")) for a, b in ways)))
    return cells.withColumn("code", code).select("doc", F.explode(found).alias("l")).select("doc", "l.*")


def _block(node: Column, side: int) -> tuple[Column, Column]:
    """The block of a node; one block holds all about the origin once its side is large enough."""
    at = F.shiftright(node, 1)
    y = F.shiftright(at + (1 << 29), 30)
    return F.floor((at - y * (1 << 30) + side // 2) / side), F.floor((y + side // 2) / side)


def _joined(start: np.ndarray, to: np.ndarray, length: np.ndarray, least: np.ndarray, least_at: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Runs of points (first node, node after the last, points, least node and its place) put end to end: values and which of them are known.

    Of each run the run that begins its chain (``head``) and its place there; of
    a chain that closes its ring, place from the ring's least node and size; of
    a chain that does not, at its head, what makes it a run of its own.
    """
    n = len(start)
    order = np.argsort(start)
    at = order[np.minimum(np.searchsorted(start, to, sorter=order), n - 1)]
    inside = start[at] == to
    back = np.full(n, -1)
    back[at[inside]] = np.flatnonzero(inside)
    rounds = max(n - 1, 1).bit_length() + 1
    hop, low = np.where(back < 0, np.arange(n), back), least.copy()
    for _ in range(rounds):
        low, hop = np.minimum(low, low[hop]), hop[hop]
    closed = back[hop] >= 0
    back[closed & (low == least)] = -1
    hop, place = np.where(back < 0, np.arange(n), back), np.where(back < 0, 0, length[back])
    for _ in range(rounds):
        place, hop = place + place[hop], hop[hop]
    size, lowest, out, first = np.zeros(n, np.int64), least.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(size, hop, length)
    np.minimum.at(lowest, hop, least)
    has = least == lowest[hop]
    first[hop[has]] = (place + least_at)[has]
    out[hop[~inside]] = to[~inside]
    open_, heads = ~closed, ~closed & (hop == np.arange(n))
    return {
        "head": (start[hop], open_), "place": (np.where(closed, (place - first[hop]) % size[hop], place), closed | open_), "ring": (lowest[hop], closed), "size": (size[hop], closed),
        "out": (out, heads), "length": (size, heads), "least": (lowest, heads), "least_at": (first, heads),
    }


def rings(points: DataFrame) -> DataFrame:
    """Adds to ``links`` the ring (its least node), ``n``, the place from there on, and ``size``, the ring's points.

    A block's points are put end to end into runs, the runs that leave it meet
    those of the blocks around in blocks GROWTH times as wide, and so on until
    every ring has closed; then places are handed down again. A task holds a
    block's points or the few runs that cross its inner edges, never a ring.
    """
    kind = dict(points.dtypes)["doc"]
    found = ("head", "place", "ring", "size", "out", "length", "least", "least_at")

    def join(runs: DataFrame, side: int, *more: str) -> DataFrame:
        def run(t: pa.Table) -> pa.Table:
            made = _joined(*(t.column(c).to_numpy() for c in ("node", "next", "length", "least", "least_at")))
            return pa.table({c: t.column(c) for c in ("doc", "node", "next", *more)} | {f"{c}_": pa.array(v, pa.int64(), mask=~known) for c, (v, known) in made.items()})

        bx, by = _block(F.col("node"), side)
        schema = f"doc {kind}, node long, next long, " + "".join(f"{c} double, " for c in more) + ", ".join(f"{c}_ long" for c in found)
        return cut(runs.withColumns({"bx": bx, "by": by}).groupBy("doc", "bx", "by").applyInArrow(run, schema))

    one = {"length": F.lit(1).cast("long"), "least": F.col("node"), "least_at": F.lit(0).cast("long")}
    side, levels = SIDE, [join(points.withColumns(one), SIDE, "x", "y")]
    while not (left := levels[-1].where("out_ is not null").select("doc", "node", F.col("out_").alias("next"), F.col("length_").alias("length"), F.col("least_").alias("least"), F.col("least_at_").alias("least_at"))).isEmpty():
        side *= GROWTH
        levels.append(join(left, side))
    known = None
    for level in reversed(levels):
        closed = level.where("ring_ is not null")
        place = {"ring": F.col("ring_"), "n": F.col("place_"), "size": F.col("size_")}
        if known is not None:
            above = known.select(F.col("doc").alias("a_doc"), F.col("node").alias("a_node"), F.col("ring").alias("a_ring"), F.col("n").alias("a_n"), F.col("size").alias("a_size"))
            rest = level.where("ring_ is null").join(above, (F.col("doc") == F.col("a_doc")) & (F.col("head_") == F.col("a_node")))
            rest = rest.withColumns({"ring": F.col("a_ring"), "n": (F.col("a_n") + F.col("place_")) % F.col("a_size"), "size": F.col("a_size")}).select(*points.columns if level is levels[0] else ("doc", "node"), "ring", "n", "size")
        closed = closed.withColumns(place).select(*points.columns if level is levels[0] else ("doc", "node"), "ring", "n", "size")
        known = closed if known is None else closed.unionByName(rest)
    return known


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (math.hypot(*v) or 1.0)


def _at(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    u = 1 - t
    return np.stack([u**3, 3 * u * u * t, 3 * u * t * t, t**3], 1) @ c


def _fitted(p: np.ndarray, t: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The cubic through the ends of points, with these tangents, that lies nearest to them at places ``t``: least squares in two lengths."""
    u = 1 - t
    a, b = (3 * u * u * t)[:, None] * begin, (3 * u * t * t)[:, None] * end
    rest = p - np.outer(u**3 + 3 * u * u * t, p[0]) - np.outer(3 * u * t * t + t**3, p[-1])
    aa, ab, bb, ar, br = (a * a).sum(), (a * b).sum(), (b * b).sum(), (a * rest).sum(), (b * rest).sum()
    det = aa * bb - ab * ab
    chord = math.hypot(*(p[-1] - p[0]))
    one, two = ((ar * bb - br * ab) / det, (aa * br - ab * ar) / det) if det else (0.0, 0.0)
    if min(one, two) < 1e-6 * chord:
        one = two = chord / 3
    return np.stack([p[0], p[0] + begin * one, p[-1] + end * two, p[-1]])


def _moved(c: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Places nearer to the points, by a step of Newton's method."""
    d1, d2 = 3 * np.diff(c, axis=0), 6 * np.diff(c, 2, axis=0)
    u = 1 - t
    off = _at(c, t) - p
    v1 = np.stack([u * u, 2 * u * t, t * t], 1) @ d1
    v2 = np.stack([u, t], 1) @ d2
    below = (v1 * v1).sum(1) + (off * v2).sum(1)
    return np.clip(np.where(np.abs(below) < 1e-12, t, t - (off * v1).sum(1) / np.where(np.abs(below) < 1e-12, 1, below)), 0, 1)


def fit(points: np.ndarray, tolerance: float, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Cubics (4 points each) end to end, none further than ``tolerance`` from the points; tangents point inwards."""
    out, todo = [], [(0, len(points) - 1, begin, end)]
    while todo:
        lo, hi, a, b = todo.pop()
        p = points[lo : hi + 1]
        if len(p) == 2:
            third = math.hypot(*(p[1] - p[0])) / 3
            out.append(np.stack([p[0], p[0] + a * third, p[1] + b * third, p[1]]))
            continue
        steps = np.hypot(*np.diff(p, axis=0).T)
        t = np.concatenate([[0.0], np.cumsum(steps)]) / (steps.sum() or 1.0)
        done = False
        for k in range(ROUNDS + 1):
            c = _fitted(p, t, a, b)
            off = ((_at(c, t) - p) ** 2).sum(1)
            done = off.max() < tolerance**2
            if done or off.max() >= 4 * tolerance**2 or k == ROUNDS:
                break
            t = _moved(c, p, t)
        if done:
            out.append(c)
            continue
        at = lo + min(max(int(off.argmax()), 1), len(p) - 2)
        middle = _unit(points[at - 1] - points[at + 1])
        todo += [(at, hi, -middle, b), (lo, at, a, middle)]
    return out


def curves(ringed: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc, shape, n, x0, y0, ..., x3, y3): the cubics that follow each ring of three points or more, n in order.

    A ring of up to ARC points is fitted as one closed curve from its first
    point; a longer one in arcs that begin where the last ended, with the
    tangent that the points on both sides give.
    """
    rows = ringed.where("size > 2")
    arc = F.floor(F.col("n") / ARC)
    # Each arc is sent its own points, one before, and two after (the next arc's first ones; the last arc's are the ring's first).
    near = F.array(F.struct(arc.alias("arc"), F.col("n").alias("k")))
    last = F.floor((F.col("size") - 1) / ARC)
    before = F.when(F.col("n") % ARC < 2, F.array(F.struct(F.when(arc == 0, last).otherwise(arc - 1).alias("arc"), F.when(arc == 0, F.col("size") + F.col("n")).otherwise(F.col("n")).alias("k")))).otherwise(F.array().cast("array<struct<arc:bigint,k:bigint>>"))
    after = F.when((F.col("n") % ARC == ARC - 1) | (F.col("n") == F.col("size") - 1), F.array(F.struct(F.when(F.col("n") == F.col("size") - 1, F.lit(0).cast("long")).otherwise(arc + 1).alias("arc"), F.when(F.col("n") == F.col("size") - 1, F.lit(-1).cast("long")).otherwise(F.col("n")).alias("k")))).otherwise(F.array().cast("array<struct<arc:bigint,k:bigint>>"))
    rows = rows.select("doc", F.col("ring").alias("shape"), "x", "y", F.explode(F.concat(near, before, after)).alias("e")).select("doc", "shape", "x", "y", "e.arc", "e.k")

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("k").to_numpy(), kind="stable")
        p = np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], 1)[order]
        own = p[1:-1]  # from the arc's first point to the next one's
        found = fit(own, tolerance, _unit(p[2] - p[0]), _unit(p[-3] - p[-1]))
        n, arc_ = len(found), t.column("arc")[0].as_py()
        same = {c: pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type) for c in ("doc", "shape")}
        flat = np.stack(found).reshape(n, 8)
        return pa.table(same | {"n": pa.array(np.arange(n) + arc_ * ARC)} | {f"{c}{k}": flat[:, 2 * k + i] for k in range(4) for i, c in enumerate("xy")})

    # Fitting costs far more than its few bytes let the planner expect, so arcs are dealt out by number.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "shape", "arc")
    kind = dict(ringed.dtypes)["doc"]
    return rows.groupBy("doc", "shape", "arc").applyInArrow(run, f"doc {kind}, shape long, n long, " + ", ".join(f"{c}{k} double" for k in range(4) for c in "xy"))


def knots(cubics: DataFrame) -> DataFrame:
    """Closed shapes of ``paths`` from cubics end to end: a knot's handles are those of the cubics that meet there."""
    w = Window.partitionBy("doc", "shape").orderBy("n")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    into = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    return cubics.select("doc", "shape", "n", F.col("x0").alias("ax"), F.col("y0").alias("ay"), into("x2").alias("ix"), into("y2").alias("iy"), F.col("x1").alias("ox"), F.col("y1").alias("oy"))


def trace(sel: DataFrame, tolerance: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(knots, shapes) of the outline of selections (doc, x, y, cov), as ``paths`` take them.

    Rings never cross, so all of them excluded from each other leave holes and
    the islands within holes as they are.
    """
    found = knots(cut(curves(rings(links(sel)), tolerance)))
    shapes = found.select("doc", "shape").distinct().select("doc", "shape", F.lit(True).alias("closed"), F.lit("exclude").alias("op"), F.lit("evenodd").alias("rule"))
    return found, shapes
