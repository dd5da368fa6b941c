"""Rasters as tiles of arrays: halos of any reach, prefix sums across tiles, numpy inside a task.

A tile is a row (keys, tx, ty, x0, y0, x1, y1, data): its place in the grid, the
bounds of its raster, and its planes as bytes. Every raster's grid is complete:
pixels and tiles that a sparse raster leaves out are transparent (zero). Keys
such as a document and a layer tell rasters apart, so one pass serves many.
A task holds one tile with its halo, or the sums along one line of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.staging import cut

RGBA = ("r", "g", "b", "a")
TILE = 256
BOUNDS = ("x0", "y0", "x1", "y1")

Keys = tuple[str, ...]
#: Planes (channel, row, column) with halo, columns and rows of the tile itself -> its new planes.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _schema(df: DataFrame, names: tuple, *more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{c} {kinds[c]}" for c in names), *more])


def _batch(like: pa.Table | pa.RecordBatch, names: tuple, rows: int, **columns) -> pa.RecordBatch:
    """``rows`` rows that repeat the first values of ``names`` beside new columns."""
    same = {c: pa.array([like.column(c)[0].as_py()] * rows, like.schema.field(c).type) for c in names}
    return pa.RecordBatch.from_pydict(same | columns)


def bounds(px: DataFrame, by: Keys = ()) -> DataFrame:
    """The box of each raster's pixels, of transparent ones too."""
    return px.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")).where("x0 is not null")


def grid(boxes: DataFrame, tile: int) -> DataFrame:
    """A row for each tile of each box."""
    at = lambda c: F.floor(F.col(c) / tile)
    rows = boxes.withColumn("tx", F.explode(F.sequence(at("x0"), F.floor((F.col("x1") - 1) / tile))))
    return rows.withColumn("ty", F.explode(F.sequence(at("y0"), F.floor((F.col("y1") - 1) / tile))))


def present(px: DataFrame, channels: tuple = RGBA, by: Keys = (), tile: int = TILE, dtype: str = "uint8") -> DataFrame:
    """(keys, tx, ty, data) of the tiles that have pixels; the last of repeated pixels stays."""
    cells = (*by, "tx", "ty")
    rows = px.select(*by, F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"), "x", "y", *channels)

    def gather(t: pa.Table) -> pa.Table:
        planes = np.zeros((len(channels), tile * tile), dtype)
        at = (t.column("y").to_numpy() % tile) * tile + t.column("x").to_numpy() % tile
        for k, c in enumerate(channels):
            planes[k, at] = t.column(c).to_numpy()
        return pa.Table.from_batches([_batch(t, cells, 1, data=[planes.tobytes()])])

    return rows.groupBy(*cells).applyInArrow(gather, _schema(rows, cells, "data binary"))


def to_tiles(px: DataFrame, channels: tuple = RGBA, by: Keys = (), tile: int = TILE, boxes: DataFrame | None = None, dtype: str = "uint8") -> DataFrame:
    """All tiles of the rasters in ``px``, within ``boxes`` (else within the pixels' own bounds)."""
    cells = (*by, "tx", "ty")
    made = present(px, channels, by, tile, dtype)
    made = made.select(*(F.col(c).alias(f"m_{c}") for c in cells), "data")
    every = grid(bounds(px, by) if boxes is None else boxes, tile)
    # Few rows each: one for a tile.
    return every.join(made, [every[c].eqNullSafe(made[f"m_{c}"]) for c in cells], "left").select(*by, "tx", "ty", *BOUNDS, "data")


def _planes(data: bytes | None, channels: int, tile: int, dtype: str) -> np.ndarray:
    return np.zeros((channels, tile, tile), dtype) if data is None else np.frombuffer(data, dtype).reshape(channels, tile, tile)


def _inside(row: dict, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of a tile."""
    return row["tx"] * tile + np.arange(tile), row["ty"] * tile + np.arange(tile)


def _rows_of(t: pa.Table | pa.RecordBatch, by: Keys) -> Iterator[dict]:
    names = (*by, "tx", "ty", *BOUNDS, "data")
    for k in range(t.num_rows):
        yield {c: t.column(c)[k].as_py() for c in names}


def _pixels(row: dict, by: Keys, planes: np.ndarray, channels: tuple, tile: int, like, kind=pa.int64()) -> pa.RecordBatch:
    """The pixels of one tile that lie within its raster."""
    xs, ys = _inside(row, tile)
    iy, ix = np.flatnonzero((ys >= row["y0"]) & (ys < row["y1"])), np.flatnonzero((xs >= row["x0"]) & (xs < row["x1"]))
    n = len(iy) * len(ix)
    same = {c: pa.array([row[c]] * n, like.schema.field(c).type) for c in by}
    cut = planes[:, iy[0] : iy[-1] + 1, ix[0] : ix[-1] + 1].reshape(len(channels), n)
    return pa.RecordBatch.from_pydict(same | {"x": np.tile(xs[ix], len(iy)), "y": np.repeat(ys[iy], len(ix))} | {c: pa.array(v.astype(np.float64 if kind == pa.float64() else np.int64), kind) for c, v in zip(channels, cut)})


def from_tiles(tiles: DataFrame, channels: tuple = RGBA, by: Keys = (), tile: int = TILE, dtype: str = "uint8") -> DataFrame:
    """The pixels of tiles, absent ones as zeros."""
    real = np.dtype(dtype).kind == "f"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows_of(b, by):
                yield _pixels(row, by, _planes(row["data"], len(channels), tile, dtype), channels, tile, b, pa.float64() if real else pa.int64())

    return tiles.mapInArrow(spread, _schema(tiles, by, "x long", "y long", *(f"{c} {'double' if real else 'long'}" for c in channels)))


def pieces(row: dict, planes: np.ndarray, reach: int, tile: int) -> dict[str, list]:
    """What a tile gives to itself and to all tiles within ``reach`` (tx, ty of the receiver): x, y, w, h of the piece and its data."""
    around, out = -(-reach // tile), []
    lo_x, lo_y = row["tx"] * tile, row["ty"] * tile
    for ty in range(max(row["ty"] - around, row["y0"] // tile), min(row["ty"] + around, (row["y1"] - 1) // tile) + 1):
        for tx in range(max(row["tx"] - around, row["x0"] // tile), min(row["tx"] + around, (row["x1"] - 1) // tile) + 1):
            xa, xb = max(lo_x, tx * tile - reach), min(lo_x + tile, (tx + 1) * tile + reach)
            ya, yb = max(lo_y, ty * tile - reach), min(lo_y + tile, (ty + 1) * tile + reach)
            if xa < xb and ya < yb:
                out.append((tx, ty, xa, ya, xb - xa, yb - ya, np.ascontiguousarray(planes[:, ya - lo_y : yb - lo_y, xa - lo_x : xb - lo_x]).tobytes()))
    return {n: list(v) for n, v in zip(("tx", "ty", "px", "py", "pw", "ph", "data"), zip(*out))}


def _strips(tiles: DataFrame, reach: int, channels: int, by: Keys, tile: int, dtype: str) -> DataFrame:
    """What each tile needs of itself and of all tiles within ``reach``: a row (its tx, ty; x, y, w, h of the piece; data)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows_of(b, by):
                out = pieces(row, _planes(row["data"], channels, tile, dtype), reach, tile)
                same = {c: pa.array([row[c]] * len(out["tx"]), b.schema.field(c).type) for c in (*by, *BOUNDS)}
                yield pa.RecordBatch.from_pydict(same | out)

    return tiles.mapInArrow(deal, _strips_schema(tiles, by))


def _strips_schema(tiles: DataFrame, by: Keys) -> str:
    return _schema(tiles, (*by, *BOUNDS), "tx long", "ty long", "px long", "py long", "pw long", "ph long", "data binary")


def haloed(t: pa.Table, reach: int, channels: int, tile: int, dtype: str) -> np.ndarray:
    """A tile with ``reach`` pixels around it, from its strips; beyond the raster the border's pixels repeat."""
    one = {c: t.column(c)[0].as_py() for c in ("tx", "ty", *BOUNDS)}
    side = tile + 2 * reach
    left, top = one["tx"] * tile - reach, one["ty"] * tile - reach
    block = np.zeros((channels, side, side), dtype)
    for k in range(t.num_rows):
        x, y, w, h = (t.column(c)[k].as_py() for c in ("px", "py", "pw", "ph"))
        block[:, y - top : y - top + h, x - left : x - left + w] = np.frombuffer(t.column("data")[k].as_py(), dtype).reshape(channels, h, w)
    ix = np.clip(np.arange(left, left + side), one["x0"], one["x1"] - 1) - left
    iy = np.clip(np.arange(top, top + side), one["y0"], one["y1"] - 1) - top
    return block[:, iy[:, None], ix[None, :]]


def filtered(tiles: DataFrame, reach: int, kernel: Kernel, channels: tuple = RGBA, out: tuple | None = None, by: Keys = (), tile: int = TILE, dtype: str = "uint8") -> DataFrame:
    """The pixels that ``kernel`` makes of every tile and its halo.

    One shuffle of the tiles' edges; any reach is served, by as many
    neighbours as it spans. The kernel gets the planes with halo as floats.
    """
    out = out or channels
    cells = (*by, "tx", "ty")

    def run(t: pa.Table) -> pa.Table:
        block = haloed(t, reach, len(channels), tile, dtype).astype(np.float64)
        row = {c: t.column(c)[0].as_py() for c in (*cells, *BOUNDS)}
        planes = np.stack(kernel(block, *_inside(row, tile)))
        return pa.Table.from_batches([_pixels(row, by, planes, out, tile, t)])

    strips = _strips(tiles, reach, len(channels), by, tile, dtype)
    return strips.groupBy(*cells).applyInArrow(run, _schema(tiles, by, "x long", "y long", *(f"{c} long" for c in out)))


def at_border(block: np.ndarray, left: int, top: int, row: dict) -> np.ndarray:
    """A block that begins at (left, top), with the raster's border repeated anew beyond it."""
    ix = np.clip(np.arange(left, left + block.shape[2]), row["x0"], row["x1"] - 1) - left
    iy = np.clip(np.arange(top, top + block.shape[1]), row["y0"], row["y1"] - 1) - top
    return block[:, iy[:, None], ix[None, :]]


def stepped(tiles: DataFrame, reach: int, kernel: Callable[[np.ndarray, dict], np.ndarray], channels: int, by: Keys = (), tile: int = TILE, dtype: str = "float64") -> DataFrame:
    """Tiles of doubles that ``kernel`` makes of each tile with its halo, and its row (place and bounds): a step of an iteration."""
    cells = (*by, "tx", "ty")

    def run(t: pa.Table) -> pa.Table:
        block = haloed(t, reach, channels, tile, dtype).astype(np.float64)
        row = {c: t.column(c)[0].as_py() for c in (*cells, *BOUNDS)}
        return pa.Table.from_batches([_batch(t, (*cells, *BOUNDS), 1, data=[np.ascontiguousarray(np.stack(kernel(block, row))).tobytes()])])

    return _strips(tiles, reach, channels, by, tile, dtype).groupBy(*cells).applyInArrow(run, tiles.schema)


# Box means: running sums along each line of tiles.


def _line_sums(tiles: DataFrame, axis: str, channels: int, by: Keys, tile: int, dtype: str) -> DataFrame:
    """For each tile, summed along the axis within the raster: its total, and its first and last line."""
    lo, hi, t_at = ("x0", "x1", "tx") if axis == "x" else ("y0", "y1", "ty")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows_of(b, by):
                v = _planes(row["data"], channels, tile, dtype).astype(np.float64)
                v = v if axis == "x" else v.transpose(0, 2, 1)
                first, last = max(row[lo] - row[t_at] * tile, 0), min(row[hi] - row[t_at] * tile, tile)
                parts = [v[:, :, first:last].sum(2), v[:, :, first], v[:, :, last - 1]]
                yield pa.RecordBatch.from_pydict({c: pa.array([row[c]], b.schema.field(c).type) for c in (*by, "tx", "ty", *BOUNDS)} | {"data": [np.stack(parts).tobytes()]})

    return tiles.mapInArrow(sums, tiles.schema)


def box_axis(tiles: DataFrame, radius: int, axis: str, channels: int = 4, by: Keys = (), tile: int = TILE, dtype: str = "float64", over: int = 1) -> DataFrame:
    """The sum of 2 * radius + 1 pixels along an axis, divided by ``over``, as tiles of doubles; the raster's border repeats.

    A small shuffle gathers the sums of each line of tiles (a tile's edge for a
    tile), a second one brings to each tile the running sums at both ends of
    its windows: two pieces of a tile's size, whatever the radius.
    """
    along, across = ("tx", "ty") if axis == "x" else ("ty", "tx")
    lo, hi = ("x0", "x1") if axis == "x" else ("y0", "y1")
    cells = (*by, "tx", "ty")
    ends = {"after": radius, "before": -radius - 1}  # the window's sum is the difference of two running sums
    moved = _schema(tiles, (*cells, *BOUNDS), "what string", "at long", "data binary")

    def carry(t: pa.Table) -> pa.Table:
        """What stands before each tile of a line, for the tiles whose windows end in it; the whole line's sum and ends for all."""
        rows = sorted(_rows_of(t, by), key=lambda r: r[along])
        parts = [np.frombuffer(r["data"], np.float64).reshape(3, channels, tile) for r in rows]
        before = np.cumsum([np.zeros((channels, tile)), *(p[0] for p in parts)], axis=0)
        whole = np.stack([before[-1], parts[0][1], parts[-1][2]]).tobytes()
        first, out = rows[0][along], []
        for r in rows:
            out.append((r[along], "line", 0, whole))
            for d in ends.values():
                for s in {(r[along] * tile + d) // tile, (r[along] * tile + tile - 1 + d) // tile}:
                    if first <= s < first + len(rows):
                        out.append((r[along], "carry", s, before[s - first].tobytes()))
        n = len(out)
        same = {c: pa.array([rows[0][c]] * n, t.schema.field(c).type) for c in (*by, across, *BOUNDS)}
        return pa.table(same | {along: pa.array([o[0] for o in out], pa.int64()), "what": [o[1] for o in out], "at": pa.array([o[2] for o in out], pa.int64()), "data": [o[3] for o in out]}).select([*cells, *BOUNDS, "what", "at", "data"])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running sums within each tile, cut for the tiles whose windows end there."""
        for b in batches:
            for row in _rows_of(b, by):
                v = _planes(row["data"], channels, tile, dtype).astype(np.float64)
                v = v if axis == "x" else v.transpose(0, 2, 1)
                start = row[along] * tile
                at = np.arange(start, start + tile)
                sums = np.cumsum(np.where((at >= row[lo]) & (at < row[hi]), v, 0), axis=2)
                out = []
                for what, d in ends.items():
                    for t_ in sorted({(start - d) // tile, (start + tile - 1 - d) // tile}):
                        if row[lo] // tile <= t_ <= (row[hi] - 1) // tile:
                            a, z = max(start, t_ * tile + d), min(start + tile, (t_ + 1) * tile + d)
                            out.append((t_, what, a, np.ascontiguousarray(sums[:, :, a - start : z - start]).tobytes()))
                if out:
                    same = {c: pa.array([row[c]] * len(out), b.schema.field(c).type) for c in (*by, across, *BOUNDS)}
                    yield pa.RecordBatch.from_pydict(same | {along: pa.array([o[0] for o in out], pa.int64()), "what": [o[1] for o in out], "at": pa.array([o[2] for o in out], pa.int64()), "data": [o[3] for o in out]}).select([*cells, *BOUNDS, "what", "at", "data"])

    def means(t: pa.Table) -> pa.Table:
        one = {c: t.column(c)[0].as_py() for c in (*cells, *BOUNDS)}
        pieces = list(zip(t.column("what").to_pylist(), t.column("at").to_pylist(), t.column("data").to_pylist()))
        total, first, last = np.frombuffer(next(d for w, _, d in pieces if w == "line"), np.float64).reshape(3, channels, tile)
        carried = {s: np.frombuffer(d, np.float64).reshape(channels, tile) for w, s, d in pieces if w == "carry"}
        start = one[along] * tile
        at = np.arange(start, start + tile)
        sums = {}
        for what, d in ends.items():
            p = np.zeros((channels, tile, tile))
            p[:, :, at + d >= one[hi]] = total[:, :, None]
            for w, a, data in pieces:
                if w == what:
                    cut = np.frombuffer(data, np.float64).reshape(channels, tile, -1)
                    k, keep = a - d - start, a + np.arange(cut.shape[2]) < one[hi]
                    p[:, :, k : k + cut.shape[2]][:, :, keep] = (cut + carried[a // tile][:, :, None])[:, :, keep]
            sums[what] = p
        beyond = np.maximum(0, at + radius - (one[hi] - 1)), np.maximum(0, one[lo] - (at - radius))
        got = sums["after"] - sums["before"] + beyond[0] * last[:, :, None] + beyond[1] * first[:, :, None]
        got = got / over
        got = got if axis == "x" else got.transpose(0, 2, 1)
        return pa.Table.from_batches([_batch(t, (*cells, *BOUNDS), 1, data=[np.ascontiguousarray(got).tobytes()])])

    lines = _line_sums(tiles, axis, channels, by, tile, dtype).groupBy(*by, across).applyInArrow(carry, moved)
    pieces = lines.union(tiles.mapInArrow(running, moved))
    return pieces.groupBy(*cells).applyInArrow(means, tiles.schema)


def box(tiles: DataFrame, radius: int, passes: int = 1, channels: int = 4, by: Keys = (), tile: int = TILE, dtype: str = "uint8") -> DataFrame:
    """Box means along rows and columns, ``passes`` times, as tiles of doubles: whole numbers are divided once, after both.

    Each axis reads its tiles twice, for the sums of lines and for the pieces, so they are written down before.
    """
    for _ in range(passes):
        for axis, over in (("x", 1), ("y", (2 * radius + 1) ** 2)):
            tiles, dtype = box_axis(cut(tiles), radius, axis, channels, by, tile, dtype, over), "float64"
    return tiles


def pointwise(tiles: DataFrame, kernel: Kernel, channels: int = 4, out: tuple = RGBA, by: Keys = (), tile: int = TILE, dtype: str = "float64") -> DataFrame:
    """The pixels that ``kernel`` makes of each tile alone: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows_of(b, by):
                planes = _planes(row["data"], channels, tile, dtype).astype(np.float64)
                yield _pixels(row, by, np.stack(kernel(planes, *_inside(row, tile))), out, tile, b)

    return tiles.mapInArrow(run, _schema(tiles, by, "x long", "y long", *(f"{c} long" for c in out)))


def beside(tiles: DataFrame, others: DataFrame, by: Keys = (), tile: int = TILE, channels: int = 4, dtypes: tuple[str, str] = ("int32", "float64")) -> DataFrame:
    """Tiles of doubles with the planes of ``others`` after those of ``tiles``; both have the same grid."""
    cells = [*by, "tx", "ty"]
    right = others.select(*(F.col(c).alias(f"o_{c}") for c in cells), F.col("data").alias("o_data"))
    names = tiles.columns
    both = tiles.join(right, [tiles[c].eqNullSafe(right[f"o_{c}"]) for c in cells]).select(*names, "o_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.concatenate([_planes(p, channels, tile, d).astype(np.float64) for p, d in zip(pair, dtypes)]).tobytes() for pair in zip(b.column("data").to_pylist(), b.column("o_data").to_pylist())]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in names if c != "data"} | {"data": data}).select(names)

    return both.mapInArrow(run, tiles.schema)
