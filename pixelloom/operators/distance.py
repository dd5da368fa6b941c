"""Exact Euclidean distances over tiles, of any reach, with the nearest pixel; what selections make of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators.staging import cut
from pixelloom.operators.tiles import BOUNDS, TILE, Keys, _inside, _pixels, _planes, _rows_of, _schema, to_tiles

#: Stands for "no marked pixel in this column".
NONE = -(1 << 40)
FAR = float("inf")


def _column_marks(tiles: DataFrame, mark: Callable[[np.ndarray], np.ndarray], by: Keys, tile: int) -> DataFrame:
    """First and last marked row of each column of each tile (NONE: no such row), then their coverage."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows_of(b, by):
                on, ys = _marked(row, mark, tile), _inside(row, tile)[1][:, None]
                any_ = on.any(0)
                first = np.where(any_, np.where(on, ys, 1 << 40).min(0), NONE)
                last = np.where(any_, np.where(on, ys, NONE).max(0), NONE)
                cov, start, xs = _planes(row["data"], 1, tile, "uint8")[0], row["ty"] * tile, np.arange(tile)
                ends = [cov[np.where(any_, v - start, 0), xs] for v in (first, last)]
                yield pa.RecordBatch.from_pydict({c: pa.array([row[c]], b.schema.field(c).type) for c in (*by, "tx", "ty", *BOUNDS)} | {"data": [np.stack([first, last, *ends]).astype(np.int64).tobytes()]})

    return tiles.mapInArrow(find, tiles.schema)


def _marked(row: dict, mark: Callable[[np.ndarray], np.ndarray], tile: int) -> np.ndarray:
    """Marked pixels of a tile that lie within the raster."""
    xs, ys = _inside(row, tile)
    inside = ((ys >= row["y0"]) & (ys < row["y1"]))[:, None] & ((xs >= row["x0"]) & (xs < row["x1"]))[None, :]
    return mark(_planes(row["data"], 1, tile, "uint8")[0]) & inside


def _nearest_rows(tiles: DataFrame, mark: Callable[[np.ndarray], np.ndarray], by: Keys, tile: int) -> DataFrame:
    """Tiles with ``near``: for each pixel the nearest marked row of its column, the upper one of two; after all rows the coverage there.

    Beside them, of the squared distances to those rows: ``least`` of the tile,
    ``worst`` of its rows' least ones, and ``most`` of what the tile's own
    columns leave as distance (null: no marked column).
    """
    cells = (*by, "tx", "ty")

    def carry(t: pa.Table) -> pa.Table:
        """For each tile of a column of tiles: the last marked row above it and the first below, by column."""
        rows = sorted(_rows_of(t, by), key=lambda r: r["ty"])
        marks = [np.frombuffer(r["data"], np.int64).reshape(4, tile) for r in rows]
        above, below = [np.full((2, tile), NONE)], [np.full((2, tile), NONE)]
        for m in marks[:-1]:
            above.append(np.where(m[1] == NONE, above[-1], m[[1, 3]]))
        for m in marks[:0:-1]:
            below.append(np.where(m[0] == NONE, below[-1], m[[0, 2]]))
        data = [np.stack(x).tobytes() for x in zip(above, below[::-1])]
        return pa.table({c: pa.array([r[c] for r in rows], t.schema.field(c).type) for c in (*cells, *BOUNDS)} | {"data": data, "own": pa.array([False] * len(rows))})

    def fill(t: pa.Table) -> pa.Table:
        k = t.column("own").to_pylist().index(True)
        row = {c: t.column(c)[k].as_py() for c in (*cells, *BOUNDS, "data")}
        above, above_cov, below, below_cov = np.frombuffer(t.column("data")[1 - k].as_py(), np.int64).reshape(4, tile)
        on, ys = _marked(row, mark, tile), _inside(row, tile)[1][:, None]
        up = np.maximum.accumulate(np.where(on, ys, above[None, :]), axis=0)
        big = 1 << 40
        low = np.where(below == NONE, big, below)[None, :]
        down = np.minimum.accumulate(np.where(on, ys, low)[::-1], axis=0)[::-1]
        near = np.where((down < big) & ((up == NONE) | (down - ys < ys - up)), down, up)
        f = np.where(near == NONE, FAR, (ys - near).astype(np.float64) ** 2)
        xs = np.arange(tile)
        own_cov = _planes(row["data"], 1, tile, "uint8")[0][np.clip(near - ys[0], 0, tile - 1), xs[None, :]]
        cov = np.where(near < ys[0], above_cov, np.where(near > ys[-1], below_cov, own_cov)).astype(np.uint8)
        own = f.copy()
        for s in np.flatnonzero(np.isfinite(f).any(0)):
            np.minimum(own, f[:, s : s + 1] + (xs - s)[None, :] ** 2, out=own)
        number = lambda v: None if v == FAR else float(v)
        return pa.table({c: pa.array([row[c]], t.schema.field(c).type) for c in (*cells, *BOUNDS)} | {"data": [row["data"]], "near": [near.astype(np.int64).tobytes() + cov.tobytes()], "least": pa.array([number(f.min())], pa.float64()), "worst": pa.array([number(f.min(1).max())], pa.float64()), "most": pa.array([number(own.max())], pa.float64())})

    marks = _column_marks(tiles, mark, by, tile).groupBy(*by, "tx").applyInArrow(carry, _schema(tiles, (*cells, *BOUNDS), "data binary", "own boolean"))
    both = marks.union(tiles.select(*cells, *BOUNDS, "data", F.lit(True)))
    return both.groupBy(*cells).applyInArrow(fill, _schema(tiles, (*cells, *BOUNDS), "data binary", "near binary", "least double", "worst double", "most double"))


def nearest(sel: DataFrame, mark: Callable[[np.ndarray], np.ndarray], by: Keys = (), tile: int = TILE) -> DataFrame:
    """``with_coverage`` without the nearest pixel's coverage."""
    return with_coverage(sel, mark, by, tile).drop("ncov")


def with_coverage(sel: DataFrame, mark: Callable[[np.ndarray], np.ndarray], by: Keys = (), tile: int = TILE) -> DataFrame:
    """Adds to each pixel the nearest marked one: d2 (squared distance), nx, ny, ncov (its coverage); null if none is marked.

    Of several nearest the one with the least x, then y. ``mark`` takes an array
    of coverage. Columns are solved first, by carrying marked rows along columns
    of tiles. Then a tile asks those tiles of its row that can hold a nearest
    pixel: what it knows already bounds how far they may be, and their least
    distance within columns how near they must be. So the reach is that of the
    data, and nothing holds a whole row of the raster.
    """
    cells = (*by, "tx", "ty")
    rows = cut(_nearest_rows(cut(to_tiles(sel, ("cov",), by, tile)), mark, by, tile))
    line = Window.partitionBy(*by, "ty").orderBy("tx")
    known = F.when(F.col("worst").isNotNull(), F.struct("tx", "worst"))
    before = F.last(known, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    stats = rows.select(*cells, "x0", "x1", "least", "most", before.alias("b"), after.alias("f"), known.alias("k"))
    across = lambda c: F.pow((F.abs(F.col(f"{c}.tx") - F.col("tx")) + 1) * tile, F.lit(2)) + F.col(f"{c}.worst")
    limit = F.least("most", across("b"), across("f"), across("k"))
    asks = stats.select(*cells, limit.alias("limit"), F.floor(F.col("x0") / tile).alias("t_x0"), F.floor((F.col("x1") - 1) / tile).alias("t_x1"))
    span = F.floor(F.sqrt("limit") / tile).cast("long") + 1
    asks = asks.withColumn("sx", F.explode(F.when(F.col("limit").isNull(), F.array("tx")).otherwise(F.sequence(F.greatest("t_x0", F.col("tx") - span), F.least("t_x1", F.col("tx") + span)))))
    gap = F.greatest(F.lit(0), (F.abs(F.col("sx") - F.col("tx")) - 1) * tile + 1)
    line_keys = (*by, "ty")
    of = stats.select(*(F.col(c).alias(f"s_{c}") for c in (*line_keys, "tx")), "least")
    asks = asks.join(of, [asks[c].eqNullSafe(of[f"s_{c}"]) for c in line_keys] + [asks["sx"] == of["s_tx"]])
    asks = asks.where((F.col("sx") == F.col("tx")) | (gap * gap + F.col("least") <= F.col("limit"))).select(*cells, "sx")
    given = rows.select(*(F.col(c).alias(f"g_{c}") for c in (*line_keys, "tx")), *BOUNDS, "data", "near")
    sent = asks.join(given, [asks[c].eqNullSafe(given[f"g_{c}"]) for c in line_keys] + [asks["sx"] == given["g_tx"]])
    sent = sent.select(*cells, "sx", *BOUNDS, F.when(F.col("sx") == F.col("tx"), F.col("data")).alias("data"), (F.col("sx") == F.col("tx")).alias("own"), "near")

    def solve(t: pa.Table) -> pa.Table:
        k = t.column("own").to_pylist().index(True)
        row = {c: t.column(c)[k].as_py() for c in (*cells, *BOUNDS, "data")}
        xs, ys = _inside(row, tile)
        best = np.full((tile, tile), FAR)
        nx, ny, ncov = np.full((tile, tile), NONE), np.full((tile, tile), NONE), np.zeros((tile, tile), np.uint8)
        for j in np.argsort(t.column("sx").to_numpy()):
            start = t.column("sx")[int(j)].as_py() * tile
            data = t.column("near")[int(j)].as_py()
            near, cov = np.frombuffer(data, np.int64, tile * tile).reshape(tile, tile), np.frombuffer(data, np.uint8, offset=8 * tile * tile).reshape(tile, tile)
            f = np.where(near == NONE, FAR, (ys[:, None] - near).astype(np.float64) ** 2)
            for s in np.flatnonzero((near != NONE).any(0)):
                d = f[:, s : s + 1] + (xs - (start + s))[None, :].astype(np.float64) ** 2
                less = d < best
                if less.any():
                    best, nx, ny, ncov = np.where(less, d, best), np.where(less, start + s, nx), np.where(less, near[:, s : s + 1], ny), np.where(less, cov[:, s : s + 1], ncov)
        planes = np.stack([_planes(row["data"], 1, tile, "uint8")[0].astype(np.float64), np.where(np.isfinite(best), best, -1), nx, ny, ncov])
        return pa.Table.from_batches([_pixels(row, by, planes, ("cov", "d2", "nx", "ny", "ncov"), tile, t)])

    out = sent.groupBy(*cells).applyInArrow(solve, _schema(sel, by, "x long", "y long", "cov long", "d2 long", "nx long", "ny long", "ncov long"))
    return out.select(*by, "x", "y", "cov", *(F.when(F.col("d2") >= 0, F.col(c)).alias(c) for c in ("d2", "nx", "ny", "ncov")))


def _selected(cov: np.ndarray) -> np.ndarray:
    return cov >= 128


def _unselected(cov: np.ndarray) -> np.ndarray:
    return cov < 128


def _cov(where: Column, value: int, other: Column | int, by: Keys) -> list[Column]:
    return [*(F.col(c) for c in by), F.col("x"), F.col("y"), F.when(where, value).otherwise(other).cast("long").alias("cov")]


def expand(sel: DataFrame, px: int = 3, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Selects what lies within ``px`` of a pixel of coverage 128 or more."""
    return nearest(sel, _selected, by, tile).select(*_cov(F.col("d2") <= px * px, 255, F.col("cov"), by))


def contract(sel: DataFrame, px: int = 3, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Takes out what lies within ``px`` of a pixel of coverage below 128."""
    return nearest(sel, _unselected, by, tile).select(*_cov(F.col("d2") <= px * px, 0, F.col("cov"), by))


def _both_sides(sel: DataFrame, by: Keys, tile: int) -> DataFrame:
    """Each pixel with the nearest one of the other side of the edge: selected ones look out, others in."""
    out = with_coverage(sel, _selected, by, tile).where("cov < 128")
    return out.unionByName(with_coverage(sel, _unselected, by, tile).where("cov >= 128"))


def border(sel: DataFrame, px: int = 4, by: Keys = (), tile: int = TILE) -> DataFrame:
    """A hard band of ``px``: half of it on each side of the edge."""
    return _both_sides(sel, by, tile).select(*_cov(4 * F.col("d2") <= px * px, 255, 0, by))


def signed_distance(sel: DataFrame, by: Keys = (), tile: int = TILE) -> DataFrame:
    """Distance to the edge in pixels, negative within: the edge runs where coverage crosses one half.

    Pixels of part coverage are at the distance that it tells; others take the
    nearest pixel beyond the edge, whose own coverage tells how far through it
    the edge runs. Without such a pixel the distance is a million.
    """
    rows = _both_sides(sel, by, tile)
    a, q, d = F.col("cov") / 255, F.coalesce(F.col("ncov") / 255, F.lit(0.0)), F.sqrt("d2")
    within = F.when(F.col("d2").isNull(), F.lit(-1e6)).otherwise(-(d - (0.5 - q)))
    beyond = F.when(F.col("d2").isNull(), F.lit(1e6)).otherwise(d - (q - 0.5))
    return rows.select(*by, "x", "y", F.when((a > 0) & (a < 1), 0.5 - a).when(a >= 0.5, within).otherwise(beyond).alias("distance"))
