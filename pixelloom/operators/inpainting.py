"""Filling holes from elsewhere in a picture: patch matching as joins, coarse to fine.

Every patch that touches the hole (a target) looks for the most similar patch
that is known throughout (a source). The matches are a table; a round proposes
to each target what its neighbours found, moved along, and places about its own
match at halving distances, fetches the proposed patches by a join, and keeps
the best. Then the matched patches vote for the pixels of the hole. Proposals
come from hashes of place and round, so reruns agree; a target keeps its match
unless a better one is proposed, so within a step the sum of distances never
rises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.healing import COARSEST, membrane
from pixelloom.operators.staging import cut
from pixelloom.operators.tiles import BOUNDS, TILE, _inside, _strips, haloed, to_tiles

#: Width of a patch, rounds of proposals in a step, steps at a level.
PATCH, ROUNDS, STEPS = 7, 4, 2
#: Places that a target without a match tries at random.
TRIES = 8
PLANES = ("v0", "v1", "v2", "hole")


def patches(image: DataFrame, size: int = PATCH, tile: int = TILE) -> DataFrame:
    """(x, y, patch, source, target) of the pixels (x, y, v0, v1, v2: 0...255, hole: 0 or 1) that a patch can be about.

    A source is all known and within the raster; a target touches the hole, its
    pixels beyond the raster being those of the border.
    """
    reach = size // 2
    tiles = to_tiles(image, PLANES, (), tile)

    def run(t: pa.Table) -> pa.Table:
        block = haloed(t, reach, 4, tile, "uint8")
        row = {c: t.column(c)[0].as_py() for c in ("tx", "ty", *BOUNDS)}
        xs, ys = _inside(row, tile)
        view = np.lib.stride_tricks.sliding_window_view(block, (size, size), axis=(1, 2))  # channel, row, column, window
        holes = view[3].any((2, 3))
        deep = lambda v, lo, hi: (v - reach >= row[lo]) & (v + reach < row[hi])
        here = lambda v, lo, hi: (v >= row[lo]) & (v < row[hi])
        there = here(ys, "y0", "y1")[:, None] & here(xs, "x0", "x1")[None, :]
        source = ~holes & deep(ys, "y0", "y1")[:, None] & deep(xs, "x0", "x1")[None, :]
        j, i = np.nonzero(there & (source | holes))
        flat = np.ascontiguousarray(view[:3, j, i].transpose(1, 0, 2, 3)).reshape(len(j), 3 * size * size)
        return pa.table({"x": xs[i], "y": ys[j], "patch": pa.array([p.tobytes() for p in flat], pa.binary()), "source": source[j, i], "target": holes[j, i]})

    return _strips(tiles, reach, 4, (), tile, "uint8").groupBy("tx", "ty").applyInArrow(run, "x long, y long, patch binary, source boolean, target boolean")


def _noise(*of: Column | int) -> Column:
    """0...1 from a hash."""
    return F.pmod(F.xxhash64(*(F.lit(v) if isinstance(v, int) else v for v in of)), F.lit(1 << 30)) / float(1 << 30)


def _best(proposals: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(x, y, sx, sy, d): of the proposals (x, y, sx, sy) that are sources, the nearest to each target; of equal ones the first place."""
    both = proposals.distinct().join(sources, ["sx", "sy"]).join(targets, ["x", "y"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, s = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int32) for c in ("patch", "seen"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "y", "sx", "sy")), pa.array(((a - s) ** 2).sum(1).astype(np.int64))], names=["x", "y", "sx", "sy", "d"])

    measured = both.select("x", "y", "sx", "sy", "patch", "seen").mapInArrow(measure, "x long, y long, sx long, sy long, d long")
    return measured.groupBy("x", "y").agg(F.min(F.struct("d", "sx", "sy")).alias("m")).select("x", "y", "m.sx", "m.sy", "m.d")


def match(image: DataFrame, size: int = PATCH, rounds: int = ROUNDS, seed: int = 1, tile: int = TILE, start: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """(x, y, sx, sy, d) of the targets, and the sum of d after each round; ``start`` (x, y, sx, sy) is proposed first."""
    found = cut(patches(image, size, tile))
    targets = found.where("target").select("x", "y", F.col("patch"))
    sources = found.where("source").select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("patch").alias("seen"))
    places = found.where("target").select("x", "y")
    box = found.where("source").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None:
        return places.select("x", "y", *(F.lit(None).cast("long").alias(c) for c in ("sx", "sy", "d"))).limit(0), []
    width, height = box[2] - box[0] + 1, box[3] - box[1] + 1
    any_ = lambda k: F.struct((box[0] + F.floor(_noise(F.col("x"), F.col("y"), seed, 2 * k) * width)).alias("sx"), (box[1] + F.floor(_noise(F.col("x"), F.col("y"), seed, 2 * k + 1) * height)).alias("sy"))
    first = places.select("x", "y", F.explode(F.array(*(any_(k) for k in range(TRIES)))).alias("s")).select("x", "y", "s.*")
    now = cut(_best(first if start is None else first.union(start.select("x", "y", "sx", "sy")), targets, sources))
    energy = []
    reaches = [1 << k for k in range(max(1, max(width, height).bit_length()))]
    for r in range(rounds):
        beside = F.explode(F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), (F.col("sx") + i).alias("sx"), (F.col("sy") + j).alias("sy")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))))
        moved = now.select(beside.alias("p")).select("p.*")
        jump = lambda c, k, n: F.col(c) + F.floor((_noise(F.col("x"), F.col("y"), seed + 1 + r, 2 * k + n) * 2 - 1) * reaches[k] + 0.5)  # noqa: B023, E731
        about = now.select("x", "y", F.explode(F.array(*(F.struct(jump("sx", k, 0).alias("sx"), jump("sy", k, 1).alias("sy")) for k in range(len(reaches))))).alias("s")).select("x", "y", "s.*")
        now = cut(_best(moved.union(about), targets, sources))
        energy.append(now.agg(F.sum("d")).first()[0])
    return now, energy


def vote(image: DataFrame, matches: DataFrame, size: int = PATCH) -> DataFrame:
    """The image with each pixel of the hole the mean of what the patches over it say, nearer matches counting more."""
    reach = size // 2
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1))))
    said = matches.select("x", "y", "sx", "sy", (1.0 / (1 + F.col("d") / (3 * size * size))).alias("w"), steps.alias("s"))
    said = said.select((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), (F.col("sx") + F.col("s.i")).alias("sx"), (F.col("sy") + F.col("s.j")).alias("sy"), "w")
    said = said.join(image.where("hole = 1").select("x", "y"), ["x", "y"], "left_semi")
    colour = image.select(F.col("x").alias("sx"), F.col("y").alias("sy"), *(F.col(f"v{k}").alias(f"s{k}") for k in range(3)))
    new = said.join(colour, ["sx", "sy"]).groupBy("x", "y").agg(*((F.sum(F.col(f"s{k}") * F.col("w")) / F.sum("w")).alias(f"n{k}") for k in range(3)))
    out = image.join(new, ["x", "y"], "left")
    return out.select("x", "y", *(F.when(F.col("hole") == 1, F.floor(F.coalesce(f"n{k}", f"v{k}") + 0.5)).otherwise(F.col(f"v{k}")).cast("long").alias(f"v{k}") for k in range(3)), "hole")


def _filled(image: DataFrame, size: int, rounds: int, steps: int, seed: int, tile: int) -> DataFrame:
    """The image with its hole filled, beginning with what a coarser one came to."""
    image = cut(image)
    extent = image.agg(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).first()
    hole = image.where("hole = 1").agg(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).first()
    if hole[0] is None:
        return image
    if max(hole) >= 2 * size and min(extent) >= 6 * size and min(extent) >= COARSEST:
        half = [F.floor(F.col(c) / 2).alias(c) for c in ("x", "y")]
        known = lambda c: F.avg(F.when(F.col("hole") == 0, F.col(c)))
        coarse = image.groupBy(*half).agg(*(F.floor(F.coalesce(known(c), F.avg(c)) + 0.5).cast("long").alias(c) for c in PLANES[:3]), F.max("hole").alias("hole"))
        done = _filled(coarse, size, rounds, steps, seed + 101, tile).select(F.col("x").alias("hx"), F.col("y").alias("hy"), *(F.col(f"v{k}").alias(f"h{k}") for k in range(3)))
        both = image.join(done, (F.floor(image["x"] / 2) == done["hx"]) & (F.floor(image["y"] / 2) == done["hy"]), "left")
        image = cut(both.select("x", "y", *(F.when(F.col("hole") == 1, F.coalesce(f"h{k}", f"v{k}")).otherwise(F.col(f"v{k}")).alias(f"v{k}") for k in range(3)), "hole"))
    else:  # the coarsest begins with the membrane over its hole
        solved = membrane(image.select("x", "y", *(F.col(c).cast("double").alias(c) for c in PLANES[:3]), F.col("hole").alias("open")), tile=tile)
        image = cut(solved.select("x", "y", *(F.floor(F.col(c) + 0.5).cast("long").alias(c) for c in PLANES[:3]), F.col("open").cast("long").alias("hole")))
    matches = None
    for k in range(steps):
        matches, _ = match(image, size, rounds, seed + k, tile, matches)
        image = cut(vote(image, matches, size))
    return image


def inpaint(px: DataFrame, hole: DataFrame, size: int = PATCH, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 1, tile: int = TILE) -> DataFrame:
    """``px`` (x, y, r, g, b, a) with the pixels that ``hole`` (x, y, cov) selects filled from the rest; alpha stays.

    Without a patch that is known throughout, the hole keeps the membrane over
    it. Pixels that ``px`` lacks are black and known.
    """
    marks = hole.where("cov >= 128").select(F.col("x").alias("hx"), F.col("y").alias("hy")).distinct()
    both = px.join(marks, (F.col("x") == F.col("hx")) & (F.col("y") == F.col("hy")), "left")
    # What the hole held must not show through: it begins at nothing.
    image = both.select("x", "y", *(F.when(F.col("hx").isNull(), F.col(c)).otherwise(0).cast("long").alias(f"v{k}") for k, c in enumerate("rgb")), F.col("hx").isNotNull().cast("long").alias("hole"))
    done = _filled(image, size, rounds, steps, seed, tile).where("hole = 1").select(F.col("x").alias("dx"), F.col("y").alias("dy"), *(F.col(f"v{k}").alias(f"d{k}") for k in range(3)))
    out = px.join(done, (F.col("x") == F.col("dx")) & (F.col("y") == F.col("dy")), "left")
    return out.select("x", "y", *(F.coalesce(f"d{k}", c).cast("long").alias(c) for k, c in enumerate("rgb")), "a")
