"""Brush strokes from streams of pen samples: dabs by a state for each stroke, coverage by tiles.

A sample is (stroke, at: timestamp, seq, x, y, pressure), and may have ``lift``:
whether the pen leaves there, so that a brush that lags runs the rest of the
way (if it is one that does). The state of a stroke
is where the brush is (it lags behind the pen when smoothed), how far it has
gone since the last dab, and the last pressure; it outlives restarts in the
state store. Samples of a micro-batch are folded in order of (at, seq); a sample
that comes in a later batch is folded then, as it arrives: none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pixelloom.operators.compositing import over
from pixelloom.operators.tiles import RGBA, TILE, _pixels, _planes, _rows_of, bounds, grid, present

DABS = "stroke long, n long, x double, y double, radius double"
#: Dabs of one tile that a task takes at a time; more are dealt to several, whose planes are multiplied.
DABS_A_PART = 4096
STATE = "bx double, by double, gone double, pressure double, dabs long"


@dataclass(frozen=True)
class Brush:
    """Size in pixels; spacing as a share of it; hardness, roundness, flow and smoothing 0...1; angle in degrees.

    ``leash`` pulls the brush on a string of 60 times the smoothing; ``catch_up`` ends strokes where the pen did.
    """

    size: float = 60.0
    spacing: float = 0.25
    hardness: float = 0.6
    roundness: float = 1.0
    angle: float = 0.0
    flow: float = 1.0
    smoothing: float = 0.1
    pressure_size: bool = True
    leash: bool = False
    catch_up: bool = False

    @property
    def step(self) -> float:
        return max(0.5, self.size * max(0.01, self.spacing))

    @property
    def pull(self) -> float:
        """The share of the way to the pen that the brush goes at a sample."""
        return 1 - min(0.95, max(0.0, self.smoothing))

    def radius(self, pressure: float) -> float:
        return self.size / 2 * (max(0.02, pressure) if self.pressure_size else 1.0)


State = tuple[float, float, float, float, int]


def begin(brush: Brush, x: float, y: float, pressure: float) -> tuple[State, list[tuple]]:
    """A stroke's first sample makes a dab where it stands."""
    return (x, y, 0.0, pressure, 1), [(0, x, y, brush.radius(pressure))]


def travel(brush: Brush, state: State, x: float, y: float, pressure: float) -> tuple[State, list[tuple]]:
    """Moves the brush to a point; a dab every step of the way, counted from the last dab."""
    bx, by, gone, before, n = state
    dx, dy = x - bx, y - by
    far = math.sqrt(dx * dx + dy * dy)
    if far <= 0:
        return (bx, by, gone, pressure, n), []
    out, at = [], brush.step - gone
    while at <= far:
        t = at / far
        out.append((n + len(out), bx + dx * t, by + dy * t, brush.radius(before + (pressure - before) * t)))
        at += brush.step
    gone = far - (at - brush.step) if out else gone + far
    return (x, y, gone, pressure, n + len(out)), out


def towards(brush: Brush, bx: float, by: float, x: float, y: float) -> tuple[float, float]:
    """Where the brush goes when the pen is at (x, y): a share of the way, or to the end of its leash."""
    if not brush.leash:
        return bx + (x - bx) * brush.pull, by + (y - by) * brush.pull
    far, leash = math.hypot(x - bx, y - by), (1 - brush.pull) * 60
    return (bx, by) if far <= leash else (x - (x - bx) / far * leash, y - (y - by) / far * leash)


def follow(brush: Brush, state: State | None, x: float, y: float, pressure: float, lift: bool = False) -> tuple[State, list[tuple]]:
    """One sample; at a lift, a brush that catches up goes all the way."""
    if state is None:
        return begin(brush, x, y, pressure)
    state, dabs = travel(brush, state, *towards(brush, *state[:2], x, y), pressure)
    if lift and brush.catch_up:
        state, more = travel(brush, state, x, y, pressure)
        dabs = dabs + more
    return state, dabs


class Strokes(StatefulProcessor):
    """Samples to dabs, with a value state for each stroke."""

    def __init__(self, brush: Brush):
        self.brush = brush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("brush", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")  # of one stroke in one batch
        state = self.state.get()
        state = tuple(state) if state is not None else None
        found = []
        lifts = samples["lift"] if "lift" in samples else [False] * len(samples)
        for x, y, pressure, lift in zip(samples["x"], samples["y"], samples["pressure"], lifts):
            state, dabs = follow(self.brush, state, float(x), float(y), float(pressure), lift is True or bool(lift == 1))
            found += dabs
        self.state.update(state)
        out = pd.DataFrame(found, columns=["n", "x", "y", "radius"]).astype({"n": "int64", "x": "float64", "y": "float64", "radius": "float64"})
        out.insert(0, "stroke", int(key[0]))
        yield out

    def close(self) -> None:
        pass


def stroke_dabs(samples: DataFrame, brush: Brush = Brush()) -> DataFrame:
    """The dabs (stroke, n, x, y, radius) of a stream of samples.

    Samples without a stroke, place or pressure are left out: a pen cannot send
    them. Needs the state store that keeps rows on disk (RocksDB).
    """
    samples = samples.where("stroke is not null and x is not null and y is not null and pressure is not null")
    return samples.groupBy("stroke").transformWithStateInPandas(Strokes(brush), DABS, "append", "none")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_strokes(samples: DataFrame, path: str, brush: Brush = Brush()) -> DataFrame:
    """Paints what is there of a stream and reads all dabs so far; another run with the same ``path`` goes on where it ended."""
    spark = samples.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        # The file sink writes each batch once, whatever is rerun.
        stroke_dabs(samples, brush).writeStream.format("parquet").option("path", f"{path}/dabs").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(DABS).parquet(f"{path}/dabs")


def dab_alpha(brush: Brush, x: np.ndarray, y: np.ndarray, dx: float, dy: float, radius: float) -> np.ndarray:
    """A round tip: a hard core, then a smooth fall to the rim; turned and flattened."""
    turn = -math.radians(brush.angle)
    u, v = x - dx, y - dy
    along, across = u * math.cos(turn) - v * math.sin(turn), (u * math.sin(turn) + v * math.cos(turn)) / brush.roundness
    d = np.sqrt(along * along + across * across)
    inner = radius * brush.hardness
    outer = max(radius, inner + 0.5)
    t = np.clip((d - inner) / (outer - inner), 0, 1)
    return np.where(d >= outer, 0.0, np.where(d <= inner, brush.flow, brush.flow * (1 - t * t * (3 - 2 * t))))


def coverage_tiles(dabs: DataFrame, boxes: DataFrame, brush: Brush = Brush(), tile: int = TILE) -> DataFrame:
    """(stroke, tx, ty, data) of what dabs let through: the product of 1 - alpha, as doubles.

    A dab goes to the tiles that it touches. Products may be taken in any order,
    so the dabs of a tile are dealt to as many parts as they need; the parts'
    planes meet afterwards.
    """
    reach = F.greatest(F.col("radius"), F.col("radius") * brush.hardness + 0.5) / max(0.01, min(1.0, brush.roundness)) + 1
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile).cast("long"), F.floor((F.col(c) + reach) / tile).cast("long"))
    rows = dabs.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    cells = grid(boxes, tile).select("tx", "ty").distinct()
    rows = rows.join(cells, ["tx", "ty"], "left_semi")
    counts = rows.groupBy("stroke", "tx", "ty").agg((F.floor(F.count("*") / DABS_A_PART) + 1).alias("parts"))
    rows = rows.join(counts, ["stroke", "tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")))

    def stamp(t: pa.Table) -> pa.Table:
        tx, ty = t.column("tx")[0].as_py(), t.column("ty")[0].as_py()
        left = np.ones((tile, tile))
        for x, y, radius in zip(*(t.column(c).to_pylist() for c in ("x", "y", "radius"))):
            r = max(radius, radius * brush.hardness + 0.5) / max(0.01, min(1.0, brush.roundness)) + 1
            xa, xb = max(0, math.floor(x - r) - tx * tile), min(tile, math.ceil(x + r) - tx * tile)
            ya, yb = max(0, math.floor(y - r) - ty * tile), min(tile, math.ceil(y + r) - ty * tile)
            if xa < xb and ya < yb:
                xs, ys = tx * tile + np.arange(xa, xb) + 0.5, ty * tile + np.arange(ya, yb) + 0.5
                left[ya:yb, xa:xb] *= 1 - dab_alpha(brush, xs[None, :], ys[:, None], x, y, radius)
        return pa.table({"stroke": t.column("stroke")[:1], "tx": t.column("tx")[:1], "ty": t.column("ty")[:1], "data": [left.tobytes()]})

    def multiply(t: pa.Table) -> pa.Table:
        left = np.prod([np.frombuffer(x, np.float64) for x in t.column("data").to_pylist()], axis=0)
        return pa.table({"stroke": t.column("stroke")[:1], "tx": t.column("tx")[:1], "ty": t.column("ty")[:1], "data": [left.tobytes()]})

    schema = "stroke long, tx long, ty long, data binary"
    return rows.groupBy("stroke", "tx", "ty", "part").applyInArrow(stamp, schema).groupBy("stroke", "tx", "ty").applyInArrow(multiply, schema)


def coverage(dabs: DataFrame, boxes: DataFrame, brush: Brush = Brush(), tile: int = TILE) -> DataFrame:
    """(stroke, x, y, cover: 0...1) of the pixels that a stroke covers at all, within the boxes."""
    tiles = coverage_tiles(dabs, boxes, brush, tile)
    every = grid(boxes, tile)
    tiles = tiles.join(every, ["tx", "ty"]).select("stroke", "tx", "ty", "x0", "y0", "x1", "y1", "data")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows_of(b, ("stroke",)):
                out = _pixels(row, ("stroke",), 1 - _planes(row["data"], 1, tile, "float64"), ("cover",), tile, b, pa.float64())
                yield out.filter(pc.greater(out.column("cover"), 0.0))

    return tiles.mapInArrow(spread, "stroke long, x long, y long, cover double")


def wet_edges(s: np.ndarray) -> np.ndarray:
    """Paint pools at the rim: the middle settles to half."""
    return s * (0.5 + 2 * s * (1 - s))


def composite_strokes(px: DataFrame, dabs: DataFrame, color: tuple[int, int, int], brush: Brush = Brush(), opacity: float = 1.0, mode: str = "normal", wet: bool = False, preserve: bool = False, tile: int = TILE) -> DataFrame:
    """A raster with each stroke, in order of its number, painted in one colour.

    A stroke covers by its dabs at their flow, and is laid on once at its
    opacity, so overlapping dabs build up to that and no further. ``mode`` is a
    blend mode, ``behind`` (under what is there) or ``clear`` (takes alpha
    away); ``preserve`` keeps alpha. Each stroke's result is rounded to 8 bits.
    """
    boxes = bounds(px)
    strokes = coverage_tiles(dabs, boxes, brush, tile).groupBy("tx", "ty").agg(F.collect_list(F.struct("stroke", "data")).alias("strokes"))
    made = present(px, RGBA, (), tile)
    both = grid(boxes, tile).join(made, ["tx", "ty"], "left").join(strokes, ["tx", "ty"], "left")
    ink = np.array(color)[:, None, None] / 255

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            painted = b.column("strokes").to_pylist()
            for row, some in zip(_rows_of(b, ()), painted):
                v = _planes(row["data"], 4, tile, "uint8").astype(np.float64)
                for stroke in sorted(some or [], key=lambda s: s["stroke"]):
                    s = np.floor((1 - np.frombuffer(stroke["data"], np.float64).reshape(tile, tile)) * 255 + 0.5) / 255
                    s = (wet_edges(s) if wet else s) * opacity
                    below, a = v[:3] / 255, v[3] / 255
                    source = np.broadcast_to(ink, below.shape)
                    if mode == "clear":
                        new = np.stack([*v[:3], np.floor(a * (1 - s) * 255 + 0.5)])
                    else:
                        c, alpha = over("normal", (source, s), below, a) if mode == "behind" else over(mode, (below, a), source, s)
                        new = np.floor(np.concatenate([c, alpha[None]]) * 255 + 0.5)
                        new = np.stack([*new[:3], v[3]]) if preserve else new
                    v = np.where((s > 0) & ((v[3] > 0) | (not preserve)), new, v)
                yield _pixels(row, (), v, RGBA, tile, b)

    return both.mapInArrow(run, "x long, y long, r long, g long, b long, a long")
