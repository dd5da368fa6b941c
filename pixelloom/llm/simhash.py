"""SimHash near-duplicates: exact comparison in tiles of equal population counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import components, documents, drop_table, fresh, hot_join, maybe_among, staged

RADIUS = 3
#: Fingerprints in one chunk of a tile; two chunks are compared at a time.
CHUNK = 2048
SHINGLE = 3
#: Least shingle hashes by which documents that may be similar share a tile: of pairs of Jaccard
#: similarity 0.8, one in 3,000 shares none of five.
KEYS = 5
#: Radius of pairs to be verified: at similarity 0.8 about 9.7 of 64 bits differ, standard deviation 2.9.
WIDE = 18
#: Fingerprints of one such tile that are compared with those of another at a time.
TILE = 16_384
#: Nearest neighbours of a fingerprint in a tile whose similarity is verified first, besides the spanning
#: forest; a second pass verifies what that leaves between different components.
NEAREST = 4
#: Pairs that a task hands on at a time.
PAIR_ROWS = 1 << 18


def hashes(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Hashes of the lower-cased word shingles, repeats included; one of all words if there are fewer."""
    ws = text.lower().split()  # bytes: A-Z alone are lowered, and U+0009 to U+000D and space split
    rows = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False)) if len(ws) >= shingle else [b" ".join(ws)] if ws else []
    return np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(seed)), np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 65536 + 1):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the lower-cased word shingles, repeats included; 0 without words."""
    return majority(hashes(text, shingle, seed))


def least(h: np.ndarray, keys: int = KEYS) -> list[int]:
    """For each of ``keys`` orders of the hashes, the least one's place in it."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    out = []
    for k in range(keys if len(h) else 0):
        x = (h ^ (h >> np.uint64(31))) * (odd + np.uint64(2 * k * 0x51ED2701))
        x ^= x >> np.uint64(29)
        out.append(int((x * np.uint64(0xBF58476D1CE4E5B9)).min().view(np.int64)))
    return out


def histogram(h: np.ndarray) -> bytes:
    """How many different hashes have each first byte, up to 255."""
    return np.minimum(np.bincount((np.unique(h) >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def may_reach(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with those histograms (a row each) can have that Jaccard similarity: what they share is at most the lesser count, byte by byte."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 14):
        x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
        shared, both = np.minimum(x, y).sum(1, dtype=np.int64), x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
        full = (x == 255).any(1) | (y == 255).any(1)  # counts beyond are not known
        out[k : k + len(x)] = full | (shared * (1 + similarity) + 1e-6 >= similarity * both)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: int = 0) -> DataFrame:
    """Rows (doc_id, fp, text_hash: long, keys: array of long, hist: binary) of all whole texts; a null text counts as empty.

    Without ``keys`` there are no histograms either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, mins, hists = [], [], []
            for t in b.column(2).to_pylist():
                h = hashes(t, shingle)
                fps.append(majority(h))
                mins.append(least(h, keys))
                hists.append(histogram(h) if keys else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), b.column(1), pa.array(mins, pa.list_(pa.int64())), pa.array(hists, pa.binary())], ["doc_id", "fp", "text_hash", "keys", "hist"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text.cast("binary")).mapInArrow(run, "doc_id long, fp long, text_hash long, keys array<long>, hist binary")


def slices(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits) of all pairs of a and b within ``radius``: exclusive or and bit counts, in slices that stay in cache.

    Both are taken in order of their population counts: what differs in them by
    more than the radius is skipped.
    """
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    pa_, pb, b = pa_[oa], pb[ob], b[ob]
    for lo in range(0, len(a), 128):
        own = oa[lo : lo + 128]
        from_, to = np.searchsorted(pb, pa_[lo] - radius), np.searchsorted(pb, pa_[lo + len(own) - 1] + radius, side="right")
        bits = np.bitwise_count(a[own, None] ^ b[None, from_:to])
        i, j = np.nonzero(bits <= radius)
        if len(i):
            yield own[i], ob[from_ + j], bits[i, j]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within ``radius``."""
    found = [(i, j) for i, j, _ in slices(a, b, radius)]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than n links with the same components as the links (i, j): each node to the least of its own."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            nodes = np.nonzero(label != np.arange(n))[0]
            return nodes, label[nodes]
        label = new


def forest(i: np.ndarray, j: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Which of the links, in order of ``bits``, form a minimum spanning forest of n nodes."""
    label, chosen = np.arange(n), np.zeros(len(i), bool)
    while True:
        li, lj = label[i], label[j]
        at = np.nonzero(li != lj)[0]
        if not len(at):
            return chosen
        first = np.full(n, len(i))
        np.minimum.at(first, li[at], at)
        np.minimum.at(first, lj[at], at)
        pick = np.unique(first[first < len(i)])
        chosen[pick] = True
        while True:  # the labels of joined nodes sink to the least
            low = np.minimum(label[i[pick]], label[j[pick]])
            new = label.copy()
            np.minimum.at(new, label[i[pick]], low)
            np.minimum.at(new, label[j[pick]], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new


def fewer(i: np.ndarray, j: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of more than NEAREST links a node, a minimum spanning forest and those to each node's NEAREST neighbours.

    Links cut at any similarity have the components that the forest has, cut
    there; the neighbours make up for what fingerprints misjudge.
    """
    if len(i) <= NEAREST * n:
        return i, j, bits
    order = np.argsort(bits, kind="stable")
    i, j, bits = i[order], j[order], bits[order]
    keep = forest(i, j, bits, n)
    for node in (i, j):
        by = np.argsort(node, kind="stable")
        new = np.concatenate([[True], node[by][1:] != node[by][:-1]])
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        keep[by[place < NEAREST]] = True
    return i[keep], j[keep], bits[keep]


def near_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (x, y) of the links between a and b that ``fewer`` leaves, none to itself."""
    both = np.concatenate([a, b])
    values, node = np.unique(both, return_inverse=True)
    none = np.empty(0, np.int64)
    held, size = [(none, none, none)], 0
    for i, j, bits in slices(a, b, radius):
        i, j = node[i], node[len(a) + j]
        own = i != j
        held.append(fewer(i[own], j[own], bits[own].astype(np.int64), len(values)))
        size += len(held[-1][0])
        if size > 64 * len(values):
            held = [fewer(*(np.concatenate(x) for x in zip(*held, strict=True)), len(values))]
            size = len(held[0][0])
    i, j, _ = fewer(*(np.concatenate(x) for x in zip(*held, strict=True)), len(values))
    return values[np.minimum(i, j)], values[np.maximum(i, j)]


def candidates(firsts: DataFrame, radius: int = WIDE, tile: int = TILE, groups: DataFrame | None = None, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) of distinct values of ``firsts`` (fp, keys, hist) within ``radius`` that share a key.

    The fingerprints of a key are a tile; a tile of more than ``tile`` is cut
    into chunks, all pairs of which are compared. Of a tile's links those that
    ``fewer`` leaves are returned; with ``groups`` (node, component) all those
    between different components instead, of tiles in which ``fewer`` may have
    left any out, but for pairs whose histograms rule ``similarity`` out.
    """
    every = groups is not None
    firsts = firsts.join(groups, firsts["fp"] == groups["node"], "left").select("fp", "keys", "hist", F.coalesce("component", "fp").alias("c")) if every else firsts.select("fp", "keys", F.lit(None).cast("binary").alias("hist"), F.lit(None).cast("long").alias("c"))
    keyed = firsts.select("fp", "c", "hist", F.posexplode("keys").alias("k", "key")).select("fp", "c", "hist", F.xxhash64("k", "key").alias("key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    sizes = staged(counted.where((F.col("n") > 2 * NEAREST) & (F.col("lo") < F.col("hi")) if every else F.col("n") > 1).select("key", "n"), "keys")
    cut = hot_join(keyed, sizes, "key").withColumn("n_chunks", F.ceil(F.col("n") / tile).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("n_chunks")).cast("int"))
    of = F.collect_list(F.struct("fp", "c", "hist"))  # tile fingerprints, about
    chunks = staged(cut.repartition("key", "chunk").groupBy("key", "chunk", "n_chunks").agg(of.alias("x")).select("key", "chunk", "n_chunks", F.col("x.fp").alias("fps"), F.col("x.c").alias("cs"), F.col("x.hist").alias("hs")), "tiles")
    side = lambda name: chunks.where("n_chunks > 1").select("key", F.col("chunk").alias(f"chunk_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in ("fps", "cs", "hs")))
    keys = chunks.where("n_chunks > 1").select("key", F.col("chunk").alias("chunk_a"), F.explode(F.sequence("chunk", F.col("n_chunks") - 1)).alias("chunk_b"))
    large = keys.join(side("a"), ["key", "chunk_a"]).join(side("b"), ["key", "chunk_b"]).select("fps_a", "cs_a", "hs_a", "fps_b", "cs_b", "hs_b")
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    pairs = chunks.where("n_chunks = 1").select(F.col("fps").alias("fps_a"), F.col("cs").alias("cs_a"), F.col("hs").alias("hs_a"), none("long").alias("fps_b"), none("long").alias("cs_b"), none("binary").alias("hs_b")).union(large.repartition(firsts.sparkSession.sparkContext.defaultParallelism * 4))
    longs = lambda x: x.values.to_numpy(zero_copy_only=False)

    def some(row: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = row[0], row[3]
        a = longs(x).view(np.uint64)
        yield near_links(a, longs(y).view(np.uint64) if y.is_valid else a, radius)

    def between(row: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, c, p, y, d, q = row
        counts = lambda h: np.frombuffer(b"".join(h.as_py()), np.uint8).reshape(-1, 256)
        a, c, p = longs(x).view(np.uint64), longs(c), counts(p)
        b, d, q = (longs(y).view(np.uint64), longs(d), counts(q)) if y.is_valid else (a, c, p)
        for i, j, _ in slices(a, b, radius):
            other = (c[i] != d[j]) & (y.is_valid | (a[i] < b[j]))
            i, j = i[other], j[other]
            can = may_reach(p[i], q[j], similarity) if len(i) else np.empty(0, bool)
            if can.any():
                u, v = a[i[can]], b[j[can]]
                yield np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for pair in (between if every else some)(row):
                    held.append(pair)
                    size += len(pair[0])
                    if size >= PAIR_ROWS:
                        yield table(held)
                        held, size = [], 0
        yield table(held)

    def table(held: list) -> pa.RecordBatch:
        a, b = (np.concatenate(v).view(np.int64) for v in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def similar_links(docs: DataFrame, firsts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) whose shingle sets have at least that Jaccard similarity, with the components of all candidates that have.

    ``firsts`` names a text of each fingerprint (doc_id, text_hash). Nearest
    candidates are verified first; of the rest those between components that
    are still apart. What joins nodes of one component cannot change it.
    """
    near = staged(verified(docs, firsts, staged(candidates(firsts), "candidates"), similarity, shingle), "near")
    groups = staged(components(near), "groups")
    rest = staged(candidates(firsts, groups=groups, similarity=similarity), "candidates")
    return near.union(verified(docs, firsts, rest, similarity, shingle))


def verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The ``pairs`` (a, b) of fingerprints whose texts are that similar. Only texts with a candidate are shuffled."""
    nodes = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = staged(firsts.join(nodes, "fp").select("fp", F.col("first").alias("w_id"), F.col("text_hash").alias("w_hash")), "wanted")
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    texts = maybe_among(texts, ["doc_id", "h"], wanted, ["w_id", "w_hash"]).where("maybe")
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["w_id"]) & (texts["h"] == wanted["w_hash"])).select("fp", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = staged(texts.dropDuplicates(["fp"]), "texts")
    of = lambda c: texts.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = (np.unique(hashes(t, shingle)) for t in (x, y))
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(same + 1e-9 >= similarity * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the distinct values of ``fps`` (fp) that join all pairs within ``radius``.

    A tile holds fingerprints with the same population counts in each of
    ``blocks`` equal bit blocks. Two fingerprints within the radius have counts
    that differ by the radius at most in sum, so only such tile pairs meet. By
    default ``blocks`` grows with the number of fingerprints (2, 4, 8), which
    changes how many pairs are skipped, never the result. Each pair of chunks
    returns a spanning forest of its links, not all of them.
    """
    spark = fps.sparkSession
    if blocks is None:
        n = fps.count()
        blocks = 2 if n <= 1 << 20 else 4 if n <= 1 << 27 else 8
    pairs = chunk_pairs(fps, radius, blocks, chunk).repartition(spark.sparkContext.defaultParallelism * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                i, j = close_pairs(a, b, radius)
                both = np.concatenate([a, b])
                i, j = spanning(i, j + len(a), len(both)) if len(i) > len(both) else (i, j + len(a))
                out_a.append(both[i])
                out_b.append(both[j])
            a, b = (np.concatenate(v).view(np.int64) if v else np.empty(0, np.int64) for v in (out_a, out_b))
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def chunk_pairs(fps: DataFrame, radius: int, blocks: int, chunk: int) -> DataFrame:
    """Pairs (fps_a, fps_b) of chunks of tiles that can hold fingerprints within ``radius``."""
    width, base = 64 // blocks, 80
    ones = [F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << width) - 1)) for k in range(blocks)] if blocks > 1 else [F.bit_count("fp")]
    tile = reduce(lambda acc, c: acc * base + c + radius, ones, F.lit(0).cast("long"))
    tiled = fps.select("fp", tile.alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / chunk).cast("long").alias("n_chunks"))
    # With up to 4 blocks there are at most 17 ** 4 tiles, so their sizes can be broadcast.
    cut = tiled.join(F.broadcast(sizes) if blocks <= 4 else sizes, "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("n_chunks")).alias("chunk"), "fp")
    chunks = cut.repartition("tile", "chunk").groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps"))  # dealt by chunk: tiles in the middle are large
    chunks = staged(chunks, "tiles")
    steps = [v for v in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, v)) <= radius and v >= (0,) * blocks] if blocks <= 4 else _steps(blocks, radius)
    offsets = [sum(x * base ** (blocks - 1 - k) for k, x in enumerate(v)) for v in steps]
    keys = chunks.select("tile", "chunk")
    left = keys.select("tile", F.col("chunk").alias("chunk_a"), F.explode(F.array(*[F.lit(o).cast("long") for o in offsets])).alias("off")).withColumn("other", F.col("tile") + F.col("off"))
    met = left.join(keys.select(F.col("tile").alias("other"), F.col("chunk").alias("chunk_b")), "other").where((F.col("off") != 0) | (F.col("chunk_a") <= F.col("chunk_b")))
    met = met.join(chunks.select("tile", F.col("chunk").alias("chunk_a"), F.col("fps").alias("fps_a")), ["tile", "chunk_a"])
    return met.join(chunks.select(F.col("tile").alias("other"), F.col("chunk").alias("chunk_b"), F.col("fps").alias("fps_b")), ["other", "chunk_b"]).select("fps_a", "fps_b")


def _steps(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the integer vectors of that L1 norm at most, zero included."""

    def grow(k: int, left: int) -> Iterator[tuple[int, ...]]:
        if k == 0:
            yield ()
            return
        for x in range(-left, left + 1):
            yield from ((x, *rest) for rest in grow(k - 1, left - abs(x)))

    return [v for v in grow(blocks, radius) if v >= (0,) * blocks]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Exact copies meet in their fingerprint before anything is compared, so a
    group of copies costs one fingerprint. With ``similarity``, not pairs within
    ``radius`` but pairs whose shingle sets are so similar are linked: tiles are
    then those of ``candidates``, and the texts of pairs within WIDE bits are
    compared. Cases: null and wordless texts have fingerprint zero and are
    linked like others; a bit set in exactly half of the hashes (a tie) is 0; a
    text of any length is hashed whole; repeated rows stay; rows without an id
    have the component of their fingerprint (null if no row of it has an id);
    an empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = staged(fingerprints(docs, shingle, KEYS if similarity is not None else 0), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "keys", "hist"))
    firsts = staged(rows.groupBy("fp").agg(best.alias("m"), F.count("*").alias("n")).select("fp", F.col("m.doc_id").alias("first"), "m.text_hash", "m.keys", "m.hist", "n"), "firsts")
    linked = components(links(firsts.select("fp"), radius) if similarity is None else similar_links(docs, firsts, similarity, shingle))
    linked = linked.join(firsts, linked["node"] == firsts["fp"]).select("node", "component", "first")
    smallest = linked.groupBy("component").agg(F.min("first").alias("least")).withColumn("n", F.lit(0))
    linked = staged(linked.join(smallest, "component").select(F.col("node").alias("fp"), "least"), "components")
    of = staged(firsts.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"), "of")
    return hot_join(rows.select("doc_id", "fp"), of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest id.

    Rows of one id are one document, of which the first row found stays; rows
    without an id stay. Only documents that may go are shuffled. Null and empty
    texts are one group; texts of any length are read whole; an empty table
    stays empty; columns of any name pass through.
    """
    id_, kept, rows, maybe = (fresh(c, docs) for c in ("of_id", "kept", "rows", "maybe"))
    near = near_duplicates(docs, radius, shingle, similarity).where("doc_id is not null")
    near = near.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    doubtful = staged(near, "doubtful").toDF(id_, kept, rows)
    marked = maybe_among(docs, ["doc_id"], doubtful, [id_], maybe)
    met = marked.where(maybe).join(doubtful, docs["doc_id"].cast("long") == doubtful[id_], "left")
    more = met.where(F.col(kept)).select(*docs.columns).dropDuplicates(["doc_id"])
    return marked.where(~F.col(maybe)).select(*docs.columns).union(met.where(F.col(id_).isNull()).select(*docs.columns)).union(more)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
