"""Healing: a pasted source keeps its gradients and meets what is around it, by a smooth membrane solved over tiles.

The membrane is the harmonic function that has given values on the border of a
region. Tiles relax their own pixels with what their neighbours last had; every
exchange of edges is one round, written down, until an aggregate finds that
nothing moves any more. A coarser membrane, solved first, is where a finer one
begins, so smooth parts need not travel pixel by pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.staging import cut
from pixelloom.operators.tiles import BOUNDS, TILE, Keys, _pixels, _planes, _rows_of, _schema, _strips_schema, filtered, haloed, pieces, to_tiles

RGB = ("r", "g", "b")
#: What a pixel may still move in a round when the membrane counts as solved, in levels.
SETTLED = 1e-3
#: Pixels of the neighbours that a tile relaxes along with its own, and sweeps of a round.
OVERLAP, SWEEPS = 16, 64
#: Rasters up to so many pixels a side are not halved any more.
COARSEST = 16
#: Over-relaxation.
OMEGA = 1.8


def relax(values: np.ndarray, open_: np.ndarray, there: np.ndarray, sweeps: int) -> np.ndarray:
    """Red-black sweeps of planes (channel, row, column): open pixels go to the mean of their neighbours that exist."""
    values = values.copy()
    n, m = open_.shape
    wide = np.zeros((n + 2, m + 2))
    wide[1:-1, 1:-1] = there
    count = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]
    colour = (np.arange(n)[:, None] + np.arange(m)[None, :]) % 2
    masks = [open_ & (colour == k) & (count > 0) for k in (0, 1)]
    pad = np.zeros((len(values), n + 2, m + 2))
    for _ in range(sweeps):
        for on in masks:
            pad[:, 1:-1, 1:-1] = values * there
            mean = (pad[:, :-2, 1:-1] + pad[:, 2:, 1:-1] + pad[:, 1:-1, :-2] + pad[:, 1:-1, 2:]) / np.maximum(count, 1)
            values = np.where(on, values + OMEGA * (mean - values), values)
    return values


def _rounds(tiles: DataFrame, open_: DataFrame, by: Keys, tile: int) -> DataFrame:
    """Tiles (v0, v1, v2, open) with the membrane in their open pixels; ``open_`` (keys, tx, ty) are those that have any.

    Only these move, so a round holds the pieces that they get of each other,
    and the pieces of their closed neighbours once. Python sees a tile at a
    time, as a group, never a batch of them.
    """
    cells = (*by, "tx", "ty")
    around = -(-OVERLAP // tile)
    is_ = lambda df, others: [df[c].eqNullSafe(others[f"o_{c}"]) for c in cells]
    near = F.explode(F.array(*(F.struct((F.col("tx") + i).alias("tx"), (F.col("ty") + j).alias("ty")) for j in range(-around, around + 1) for i in range(-around, around + 1))))
    near = open_.select(*by, near.alias("n")).select(*by, "n.*").distinct().select(*(F.col(c).alias(f"o_{c}") for c in cells))
    open_ = open_.select(*(F.col(c).alias(f"o_{c}") for c in cells))
    from_ = open_.select(*(F.col(f"o_{c}").alias(f"f_{c}") for c in cells))

    def dealt(t: pa.Table, planes: np.ndarray, moved: float) -> pa.Table:
        row = {c: t.column(c)[0].as_py() for c in (*cells, *BOUNDS)}
        out = pieces(row, planes, OVERLAP, tile)
        n = len(out["tx"])
        same = {c: pa.array([row[c]] * n, t.schema.field(c).type) for c in (*by, *BOUNDS)}
        return pa.table(same | out | {"moved": [moved] * n})

    def first(t: pa.Table) -> pa.Table:
        return dealt(t, _planes(t.column("data")[0].as_py(), 4, tile, "float64"), 0.0)

    def once(t: pa.Table) -> pa.Table:
        block = haloed(t, OVERLAP, 4, tile, "float64")
        row = {c: t.column(c)[0].as_py() for c in (*cells, *BOUNDS)}
        xs = row["tx"] * tile - OVERLAP + np.arange(block.shape[2])
        ys = row["ty"] * tile - OVERLAP + np.arange(block.shape[1])
        there = ((ys >= row["y0"]) & (ys < row["y1"]))[:, None] & ((xs >= row["x0"]) & (xs < row["x1"]))[None, :]
        free = (block[3] > 0) & there
        edge = np.ones(free.shape, bool)  # the outermost pixels are the neighbours' to move
        edge[1:-1, 1:-1] = False
        new = relax(block[:3], free & ~edge, there, SWEEPS)
        own = slice(OVERLAP, OVERLAP + tile)
        return dealt(t, np.stack([*new[:, own, own], block[3, own, own]]), float(np.abs(new - block[:3])[:, own, own].max()))

    kind = f"{_strips_schema(tiles, by)}, moved double"
    giver = [F.floor(F.col("px") / tile).alias("gx"), F.floor(F.col("py") / tile).alias("gy")]
    held = tiles.join(near, is_(tiles, near), "left_semi").groupBy(*cells).applyInArrow(first, kind)
    held = held.join(open_, is_(held, open_), "left_semi").select("*", *giver)
    moves = [held[c].eqNullSafe(from_[f"f_{c}"]) for c in by] + [held["gx"] == from_["f_tx"], held["gy"] == from_["f_ty"]]
    held = cut(held.join(from_.withColumn("moves", F.lit(True)), moves, "left").drop(*(f"f_{c}" for c in cells), "gx", "gy"))
    fixed, moving = held.where("moves is null").drop("moves"), held.where("moves").drop("moves")
    while True:
        new = moving.unionByName(fixed).groupBy(*cells).applyInArrow(once, kind)
        moving = cut(new.join(open_, is_(new, open_), "left_semi"))
        if (moving.agg(F.max("moved")).first()[0] or 0) <= SETTLED:
            break
    own = moving.select("*", *giver).where("gx = tx and gy = ty").select(tiles.columns)
    return tiles.join(open_, is_(tiles, open_), "left_anti").unionByName(own)


def membrane(values: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Pixels (keys, x, y, v0, v1, v2, open: 0 or 1) with the harmonic function that the closed ones fix in the open ones.

    Only pixels of the raster's bounds count as neighbours, so beyond them
    nothing flows. Open pixels that touch no closed one, however far, stay at
    what they begin with: the nearest coarser value, or their own.
    """
    size = values.groupBy(*by).agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).agg(F.max(F.greatest("w", "h"))).first()[0]
    start = values
    if size is not None and size >= COARSEST and not values.where("open = 1").isEmpty():
        half = [F.floor(F.col(c) / 2).alias(c) for c in ("x", "y")]
        known = lambda c: F.avg(F.when(F.col("open") == 0, F.col(c)))
        coarse = values.groupBy(*by, *half).agg(*(F.coalesce(known(c), F.avg(c)).alias(c) for c in ("v0", "v1", "v2")), F.min("open").alias("open"))
        done = membrane(cut(coarse), by, tile).select(*(F.col(c).alias(f"h_{c}") for c in by), F.col("x").alias("hx"), F.col("y").alias("hy"), *(F.col(f"v{k}").alias(f"h{k}") for k in range(3)))
        on = [values[c].eqNullSafe(done[f"h_{c}"]) for c in by] + [F.floor(values["x"] / 2) == done["hx"], F.floor(values["y"] / 2) == done["hy"]]
        start = values.join(done, on, "left").select(*by, "x", "y", *(F.when(F.col("open") == 1, F.coalesce(f"h{k}", f"v{k}")).otherwise(F.col(f"v{k}")).alias(f"v{k}") for k in range(3)), "open")
    planes = ("v0", "v1", "v2", "open")
    open_ = cut(values.where("open = 1").select(*by, *(F.floor(F.col(c) / tile).alias(f"t{c}") for c in "xy")).distinct())
    solved = cut(to_tiles(start, planes, by, tile, dtype="float64"))
    solved = solved if open_.isEmpty() else _rounds(solved, open_, by, tile)

    def spread(t: pa.Table) -> pa.Table:
        row = next(_rows_of(t, by))
        return pa.Table.from_batches([_pixels(row, by, _planes(row["data"], 4, tile, "float64"), planes, tile, t, pa.float64())])

    # Tiles of doubles are large: each is a group, as a batch of them would grow with the table.
    out = solved.groupBy(*by, "tx", "ty").applyInArrow(spread, _schema(solved, by, "x long", "y long", *(f"{c} double" for c in planes)))
    return out.withColumn("open", F.col("open").cast("int"))


def inner(region: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    """(keys, x, y, inner: 0 or 1) of a region (cov): pixels that are selected with their four neighbours; the raster's border is none."""

    def run(block, xs, ys):
        on = block[0] >= 128
        return (on[1:-1, 1:-1] & on[:-2, 1:-1] & on[2:, 1:-1] & on[1:-1, :-2] & on[1:-1, 2:])[None].astype(int)

    rows = filtered(to_tiles(region, ("cov",), by, tile), 1, run, ("cov",), ("inner",), by, tile)
    box = region.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    names = [F.col(c).alias(f"b_{c}") for c in by]
    box = box.select(*names, *BOUNDS)
    rows = rows.join(box, [rows[c].eqNullSafe(box[f"b_{c}"]) for c in by]) if by else rows.join(F.broadcast(box))  # one row a raster
    within = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    return rows.select(*by, "x", "y", F.when(within, F.col("inner")).otherwise(0).cast("int").alias("inner"))


def heal(source: DataFrame, px: DataFrame, region: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    """``px`` with ``source`` healed into the selected pixels of ``region`` (keys, x, y, cov); alpha stays.

    On the region's rim the result is what was there; inside, the source plus
    the membrane of the rim's differences. Pixels that source or region lack
    are transparent black, or outside.
    """
    at = [*by, "x", "y"]
    same = lambda a, b, p: [a[c].eqNullSafe(b[f"{p}_{c}"]) for c in by] + [a["x"] == b[f"{p}_x"], a["y"] == b[f"{p}_y"]]
    named = lambda df, p, cols: df.select(*(F.col(c).alias(f"{p}_{c}") for c in at), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    source, mask, deep = named(source, "s", RGB), named(region, "m", ("cov",)), named(inner(region, by, tile), "i", ("inner",))
    both = px.join(source, same(px, source, "s"), "left").join(mask, same(px, mask, "m"), "left")
    both = both.join(deep, [both[c].eqNullSafe(deep[f"i_{c}"]) for c in by] + [both["x"] == deep["i_x"], both["y"] == deep["i_y"]], "left")
    both = cut(both.select(*at, *RGB, "a", *(F.coalesce(f"s_{c}", F.lit(0)).alias(f"s_{c}") for c in RGB), (F.coalesce("m_cov", F.lit(0)) >= 128).alias("on"), F.coalesce("i_inner", F.lit(0)).alias("inner")))
    rim = F.col("on") & (F.col("inner") == 0)
    # Outside the region nothing is read: those pixels are closed at zero.
    start = both.select(*at, *(F.when(rim, (F.col(c) - F.col(f"s_{c}")).cast("double")).otherwise(0.0).alias(f"v{k}") for k, c in enumerate(RGB)), F.col("inner").alias("open"))
    solved = membrane(start, by, tile)
    solved = solved.select(*(F.col(c).alias(f"v_{c}") for c in at), "v0", "v1", "v2")
    out = both.join(solved, [both[c].eqNullSafe(solved[f"v_{c}"]) for c in by] + [both["x"] == solved["v_x"], both["y"] == solved["v_y"]], "left")
    new = lambda k, c: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(f"s_{c}") + F.coalesce(f"v{k}", F.lit(0.0)))) + 0.5).cast("long")
    return out.select(*at, *(F.when(F.col("on"), new(k, c)).otherwise(F.col(c)).cast("long").alias(c) for k, c in enumerate(RGB)), "a")
