"""Connected regions of pixels: runs along rows, then components of the graph of touching runs, cell by cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.staging import cut

#: A node is y * 2^ROW + x.
ROW = 31
#: Sides of the first cells, and how many times as long each further one is, as powers of two.
SIDE, GROWTH = 8, 4


def least_joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of edges, and the least node that they join each to: roots hook onto lesser ones until no edge is between two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b = ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node that ``edges`` (u, v) join to a lesser one: the least of all that it is joined to.

    The edges within a square cell are taken in one task and leave its nodes as
    stars about the least of them; edges between cells then join those, in
    cells sixteen times as long. So rounds grow with the logarithm of the
    raster's side, whatever way a region winds, and a task holds the edges
    along the borders of 16 x 16 cells. Tables as long as the graph are merged,
    as packed files look small enough to broadcast.
    """

    def link(t: pa.Table) -> pa.Table:
        nodes, roots = least_joined(t.column("u").to_numpy(), t.column("v").to_numpy())
        less = nodes != roots
        return pa.table({"node": nodes[less], "root": roots[less]})

    rest, levels, shift = cut(edges.where("u <> v")), [], SIDE
    while True:
        cell = lambda c: (F.shiftright(c, min(63, ROW + shift)), F.shiftright(F.col(c).bitwiseAND((1 << ROW) - 1), min(ROW, shift)))  # noqa: B023, E731
        cells = rest.select("u", "v", *(c.alias(n) for c, n in zip(cell("u"), ("cy", "cx"))), *(c.alias(n) for c, n in zip(cell("v"), ("dy", "dx"))))
        stars = cut(cells.where("cy = dy and cx = dx").groupBy("cy", "cx").applyInArrow(link, "node long, root long"))
        levels.append(stars)
        rest = cells.where("cy <> dy or cx <> dx").select("u", "v")
        for c in ("u", "v"):
            rest = rest.join(stars.hint("merge"), F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("root", c)).drop("node", "root")
        rest = cut(rest.distinct())
        if rest.isEmpty():
            break
        shift += GROWTH
    found = levels.pop().withColumnRenamed("root", "label")
    while levels:
        to = found.select(F.col("node").alias("root"), "label")
        found = cut(levels.pop().join(to.hint("merge"), "root", "left").select("node", F.coalesce("label", "root").alias("label")).union(found))
    return found


def regions(px: DataFrame, linked: Column, columns: tuple) -> DataFrame:
    """Adds ``region`` to pixels: 4-connected ones of the same number belong together.

    ``linked`` says of a pixel and the one before it (columns with a prefix
    ``p_``) whether they do; it is asked along rows first, then along columns
    between the runs that this makes.
    """

    def before(df: DataFrame, axis: str) -> DataFrame:
        w = Window.partitionBy("y" if axis == "x" else "x").orderBy(axis)
        at = df.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("x", "y", *columns)), *([F.lag("run").over(w).alias("p_run")] if axis == "y" else []))
        return at.withColumn("joined", F.coalesce(linked & (F.col(axis) - F.col(f"p_{axis}") == 1), F.lit(False)))

    rows = before(px, "x")
    start = F.last(F.when(~F.col("joined"), F.col("x")), ignorenulls=True).over(Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    rows = cut(rows.withColumn("run", F.col("y") * (1 << 31) + start).drop("joined", *(f"p_{c}" for c in ("x", "y", *columns))))
    edges = before(rows, "y").where("joined").select(F.col("run").alias("u"), F.col("p_run").alias("v")).distinct()
    found = components(edges)
    return rows.join(found.hint("merge"), rows["run"] == found["node"], "left").withColumn("region", F.coalesce("label", "run")).drop("run", "node", "label")
