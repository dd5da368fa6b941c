"""Selections (x, y, cov: 0...255) made from shapes and colours, changed, measured and stored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.raster import RGB, half_up
from pixelloom.operators.regions import regions
from pixelloom.operators.stencils import _beside, haloed
from pixelloom.operators.tiles import TILE, Keys, box, pointwise, to_tiles

#: Levels of a cell of colours that are taken as similar; five bits a channel remain.
CELL = 8


def constant(spark: SparkSession, width: int, height: int, cov: int = 0) -> DataFrame:
    """A mask of one coverage; 255 selects all."""
    return spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"), F.lit(cov).cast("long").alias("cov"))


def everything(px: DataFrame) -> DataFrame:
    """Every pixel of a raster, selected."""
    return px.select("x", "y", F.lit(255).cast("long").alias("cov"))


def inverted(sel: DataFrame) -> DataFrame:
    return sel.select("x", "y", (255 - F.col("cov")).alias("cov"))


def ellipse(px: DataFrame, x0: float, y0: float, x1: float, y1: float, smooth: bool = True) -> DataFrame:
    """The share of 4 x 4 points of each pixel that lie within the ellipse of a box (hard: its centre)."""
    n = 4 if smooth else 1
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) / 2, abs(y1 - y0) / 2
    if not rx or not ry:
        return px.select("x", "y", F.lit(0).cast("long").alias("cov"))
    at = lambda c, k, m, r: (F.col(c) + (k + 0.5) / n - m) / r
    inside = lambda i, j: (at("x", i, cx, rx) * at("x", i, cx, rx) + at("y", j, cy, ry) * at("y", j, cy, ry) <= 1).cast("int")
    hits = sum(inside(i, j) for j in range(n) for i in range(n))
    return px.select("x", "y", half_up(hits / (n * n) * 255).alias("cov"))


def line(px: DataFrame, index: int, vertical: bool) -> DataFrame:
    """A single column or row."""
    return px.select("x", "y", F.when(F.col("x" if vertical else "y") == index, 255).otherwise(0).cast("long").alias("cov"))


def feather(sel: DataFrame, radius: float, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Softens by three box means, each along rows and columns, of a third of the radius; any radius costs the same shuffles."""
    if radius <= 0:
        return sel.select(*by, "x", "y", "cov")
    soft = box(to_tiles(sel, ("cov",), by, tile), max(1, int(radius / 3 + 0.5)), 3, 1, by, tile)
    return pointwise(soft, lambda v, xs, ys: np.floor(np.clip(v, 0, 255) + 0.5), 1, ("cov",), by, tile)


def smoothed(sel: DataFrame, radius: int = 1, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Selected where at least half of the square around is; edges repeat. Squares have odd sizes: there are no ties."""
    on = sel.select(*by, "x", "y", (F.col("cov") >= 128).cast("int").alias("cov"))
    share = box(to_tiles(on, ("cov",), by, tile), radius, 1, 1, by, tile)
    return pointwise(share, lambda v, xs, ys: np.where(v >= 0.5, 255, 0), 1, ("cov",), by, tile)


def coverage(diff: Column, tolerance: int, smooth: bool = True) -> Column:
    """Full up to three quarters of the tolerance, then falling."""
    soft = tolerance * 0.75
    fall = half_up(255 * (1 - (diff - soft) / (tolerance - soft))) if smooth and tolerance else F.lit(255).cast("long")
    return F.when(diff > tolerance, 0).when(diff <= soft, 255).otherwise(fall).cast("long")


def wand(px: DataFrame, x: int, y: int, tolerance: int = 32, smooth: bool = True) -> DataFrame:
    """The connected pixels about a seed whose channels are within the tolerance of it.

    The seed is one row, broadcast; pixels within the tolerance fall into
    regions, of which that of the seed is kept.
    """
    seed = F.broadcast(px.where((F.col("x") == x) & (F.col("y") == y)).select(*(F.col(c).alias(f"s{c}") for c in (*RGB, "a"))))
    at = px.join(seed).select("x", "y", F.greatest(*(F.abs(F.col(c) - F.col(f"s{c}")) for c in (*RGB, "a"))).alias("d"))
    found = regions(at.where(F.col("d") <= tolerance), F.lit(True), ("d",))
    home = F.broadcast(found.where((F.col("x") == x) & (F.col("y") == y)).select("region"))
    chosen = found.join(home, "region", "left_semi").select("x", "y", coverage(F.col("d"), tolerance, smooth).alias("cov"))
    return px.select("x", "y").join(chosen.hint("merge"), ["x", "y"], "left").select("x", "y", F.coalesce("cov", F.lit(0)).cast("long").alias("cov"))


def grow(px: DataFrame, sel: DataFrame, tolerance: int) -> DataFrame:
    """Adds all pixels that a selected one reaches over neighbours each within the tolerance of the last."""
    at = px.join(sel, ["x", "y"], "left").select("x", "y", *RGB, F.coalesce("cov", F.lit(0)).alias("cov"))
    linked = F.greatest(*(F.abs(F.col(c) - F.col(f"p_{c}")) for c in RGB)) <= tolerance
    found = regions(at, linked, RGB)
    seeds = found.where("cov >= 128").select("region").distinct().withColumn("seed", F.lit(True))
    return found.join(seeds, "region", "left").select("x", "y", F.when((F.col("cov") < 128) & F.col("seed"), 255).otherwise(F.col("cov")).cast("long").alias("cov"))


def similar(px: DataFrame, sel: DataFrame, tolerance: int) -> DataFrame:
    """Adds pixels anywhere whose cell of colours is near that of a selected pixel; what is selected stays.

    There are 32,768 cells at most, so the near ones are broadcast.
    """
    reach = -(-(tolerance + CELL - 1) // CELL)
    cell = [F.shiftright(c, 3).alias(f"c{c}") for c in RGB]
    at = px.join(sel, ["x", "y"], "left").select("x", "y", F.coalesce("cov", F.lit(0)).alias("cov"), *cell)
    near = at.where("cov >= 128").select(*(f"c{c}" for c in RGB)).distinct()
    for c in RGB:
        near = near.withColumn(f"c{c}", F.explode(F.sequence(F.greatest(F.lit(0), F.col(f"c{c}") - reach), F.least(F.lit(31), F.col(f"c{c}") + reach)))).distinct()
    out = at.join(F.broadcast(near.withColumn("near", F.lit(True))), [f"c{c}" for c in RGB], "left")
    return out.select("x", "y", F.when((F.col("cov") < 128) & F.col("near"), 255).otherwise(F.col("cov")).cast("long").alias("cov"))


def boundary(sel: DataFrame) -> DataFrame:
    """Unit segments (x0, y0, x1, y1) between selected pixels (128 or more) and others, or the edge of the raster."""
    at = haloed(sel.select("x", "y", (F.col("cov") >= 128).alias("on")), 1)
    side = lambda k, axis: ~F.coalesce(_beside("on", k, axis, repeat=False), F.lit(False))
    at = at.select("x", "y", "on", "own", *(side(k, axis).alias(f"{axis}{i}") for axis in ("x", "y") for i, k in enumerate((-1, 1))))
    seg = lambda free, x0, y0, x1, y1: F.when(F.col(free), F.struct((F.col("x") + x0).alias("x0"), (F.col("y") + y0).alias("y0"), (F.col("x") + x1).alias("x1"), (F.col("y") + y1).alias("y1")))
    all_ = F.array(seg("y0", 0, 0, 1, 0), seg("y1", 0, 1, 1, 1), seg("x0", 0, 0, 0, 1), seg("x1", 1, 0, 1, 1))
    return at.where("own and on").select(F.explode(F.filter(all_, lambda s: s.isNotNull())).alias("s")).select("s.*")


def measures(sel: DataFrame) -> DataFrame:
    """One row: greatest coverage, whether nothing is selected, bounds of what is."""
    some = F.col("cov") != 0
    return sel.agg(F.max("cov").alias("most"), (F.max("cov") == 0).alias("empty"), *(f(F.when(some, F.col(c))).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"))), *((F.max(F.when(some, F.col(c))) + 1).alias(n) for c, n in (("x", "x1"), ("y", "y1"))))


def at(sel: DataFrame, x: int, y: int) -> DataFrame:
    """Coverage at a point; 0 where there is none."""
    return sel.where((F.col("x") == x) & (F.col("y") == y)).agg(F.coalesce(F.max("cov"), F.lit(0)).alias("cov"))


def sparse(sel: DataFrame) -> DataFrame:
    """A selection as it is stored: without what is not selected."""
    return sel.where("cov <> 0")


def dense(stored: DataFrame, grid: DataFrame) -> DataFrame:
    """A stored selection on the whole of a grid (x, y)."""
    return grid.select("x", "y").join(stored, ["x", "y"], "left").select("x", "y", F.coalesce("cov", F.lit(0)).cast("long").alias("cov"))
