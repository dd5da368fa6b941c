"""Removal of repeated substrings: longest-previous-factor arrays over a sampled suffix order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, staged

#: Bytes of a repeated string, and of the grams that anchors are chosen from.
LENGTH, GRAM = 50, 16
#: Starts of grams within one string.
SPAN = LENGTH - GRAM + 1
#: Bits of the filter of anchors seen twice: so many for a byte of text, within these powers of two (8 to 256 MB). A full
#: filter lets more segments pass, which changes no result.
BITS_A_BYTE, LEAST_BITS, MOST_BITS = 0.5, 26, 31
RANGES = 64
#: Distinct segments of one anchor that a suffix order is made of, and texts that have it; anchors with more are split by string.
BUCKET = 20_000
#: Bytes that are scanned at a time.
SLICE = 1 << 17
#: Bits of a text's hash in ``at``, which tells texts of one id apart.
HASH_BITS = 23
LOCAL = 24  # bits of a position within what is scanned at a time
PIECE = 1 << 22


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of 16 and of 32 bytes, each from the hashes of its halves."""
    h = _mix((x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    for s in (1, 2, 4, 8):
        h = _mix(h[:-s] * np.uint64(0xBF58476D1CE4E5B9) + h[s:])
    return h, _mix(h[:-16] * np.uint64(0xBF58476D1CE4E5B9) + h[16:])


def segments(text: bytes | np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor: first start, count, anchor hash, content hash.

    The anchor of a string of LENGTH bytes is its gram of least hash, the first
    of equals, so it depends on the string alone: equal strings have equal
    anchors at the same place, wherever they stand. ``valid`` marks starts.
    """
    x = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    n = len(x) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h16, h32 = gram_hashes(x)
    low = np.uint64((1 << LOCAL) - 1)
    m = (h16 & ~low) | np.arange(len(h16), dtype=np.uint64)
    for s in (1, 2, 4, 8, 16):
        m = np.minimum(m[:-s], m[s:])
    m = np.minimum(m[:n], m[SPAN - 32 : SPAN - 32 + n]) & low
    change = np.concatenate([[True], m[1:] != m[:-1]])
    if valid is not None:
        v = valid[:n]
        change |= np.concatenate([[True], v[1:] != v[:-1]])
    first = np.nonzero(change)[0]
    count = np.diff(np.concatenate([first, [n]]))
    if valid is not None:
        keep = v[first]
        first, count = first[keep], count[keep]
    a = m[first].astype(np.int64)
    c = _mix(h32[first] * np.uint64(3) + h32[first + LENGTH - 32])
    c = _mix(c * np.uint64(5) + h32[first + count // 2 + LENGTH - 32])
    c = _mix(c * np.uint64(7) + h32[first + count - 1 + LENGTH - 32])
    c = _mix(c + (count.astype(np.uint64) << np.uint64(8)) + (a - first).astype(np.uint64))
    return first, count, h16[a], c


def scan(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """``segments`` of many texts: (text number, first start, count, anchor, content), some at a time."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t if len(t) <= PIECE else t[at : at + PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                pieces.append((k, at, part))
                size += len(part)
            if size >= SLICE:
                yield _scan(pieces)
                pieces, size = [], 0
    if pieces:
        yield _scan(pieces)


def _scan(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    valid = np.ones(len(x), bool)
    for e in ends:
        valid[e - LENGTH + 1 : e] = False
    first, count, anchor, content = segments(x, valid)
    piece = np.searchsorted(ends, first, side="right")
    begin = ends - sizes
    return np.array([p[0] for p in pieces])[piece], first - begin[piece] + np.array([p[1] for p in pieces])[piece], count, anchor, content


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Filter slots (below 2 ** bits) of hashes, which are mixed anew: anchors are small hashes."""
    return (_mix(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def pack(sorted_slots: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit gaps; 65535 stands for a gap that goes on."""
    gaps = np.diff(np.concatenate([[0], sorted_slots]))
    out = np.full(int((gaps // 65535 + 1).sum()), 65535, np.uint16)
    out[np.cumsum(gaps // 65535 + 1) - 1] = gaps % 65535
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]


def seen_filter(hashed: DataFrame, times: int, bits: int) -> tuple[Broadcast, Broadcast]:
    """Of the slots that ``hashed`` (range int, slots binary) names: bits (compressed) of those named ``times`` times, and the sorted ones named BUCKET times."""
    width = (1 << bits) // RANGES

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(r: int, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(n >= times, bitorder="little").tobytes()], pa.binary()), pa.array([np.nonzero(n >= BUCKET)[0] + r * width], pa.list_(pa.int64()))], ["range", "bits", "hot"])

        now, n = -1, None
        for b in batches:
            for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r != now:
                    if n is not None:
                        yield out(now, n)
                    now, n = r, np.zeros(width, np.uint16)
                s = unpack(data)
                if len(s):
                    first = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
                    more = np.diff(np.concatenate([first, [len(s)]]))
                    n[s[first]] = np.minimum(n[s[first]] + more, 65535)
        if n is not None:
            yield out(now, n)

    all_, hot = np.zeros((1 << bits) // 8, np.uint8), [np.zeros(0, np.int64)]
    for r, part, many in hashed.repartition(RANGES, "range").sortWithinPartitions("range").mapInArrow(merge, "range int, bits binary, hot array<long>").toLocalIterator():
        all_[r * width // 8 : (r + 1) * width // 8] = np.frombuffer(part, np.uint8)
        hot.append(np.array(many, np.int64))
    spark = hashed.sparkSession.sparkContext
    return spark.broadcast(pa.compress(all_, codec="zstd", asbytes=True)), spark.broadcast(np.sort(np.concatenate(hot)))


def _bits(shared: Broadcast, bits: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(shared.value, (1 << bits) // 8, codec="zstd"), np.uint8)


def _has(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0


def _emit(all_slots: list[np.ndarray], bits: int) -> pa.RecordBatch:
    s = np.sort(np.concatenate(all_slots)) if all_slots else np.zeros(0, np.int64)
    width = (1 << bits) // RANGES
    cut = np.searchsorted(s, np.arange(RANGES + 1) * width)
    part = [r for r in range(RANGES) if cut[r + 1] > cut[r]]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pack(s[cut[r] : cut[r + 1]] - r * width) for r in part], pa.binary())], ["range", "slots"])


def bucket(ah: np.ndarray) -> np.ndarray:
    """32 bits of anchor hashes; anchors that agree in them merely share a bucket."""
    return (_mix(ah * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of each row's run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _rows(ah: np.ndarray, sh: np.ndarray, doc: np.ndarray, at: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """Segments of a task's texts. ``known``: a smaller document here has the same, so the row goes.

    This pre-aggregates before the shuffle: however many copies there are, the
    bucket of an anchor gets each content from a batch once.
    """
    order = np.lexsort((doc, sh, ah))
    ah, sh, doc, at, many = ah[order], sh[order], doc[order], at[order], many[order]
    g = _groups(ah, sh)
    known = doc > doc[np.searchsorted(g, np.arange(g[-1] + 1))][g] if len(g) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(ah), pa.array(sh), pa.array(doc), pa.array(at), pa.array(known), pa.array(many)], ["ah", "sh", "doc", "at", "known", "many"])


def _whole_buckets(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes from batches in order of ``ah``, none of which cuts a bucket."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n < size:
            continue
        t = pa.Table.from_batches(held)
        ah = t.column("ah").to_numpy()
        cut = int(np.searchsorted(ah, ah[-1]))  # the last bucket may go on
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = t.to_batches(), 0
    if held:
        yield pa.Table.from_batches(held)


def _judged(ah: np.ndarray, sh: np.ndarray, doc: np.ndarray, at: np.ndarray, known: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """Which segments a smaller document has as a whole, and which must be compared string by string.

    Known rows stand in any partition, so they are set aside first. Of an anchor
    that very ``many`` texts have, only segments of one content stand together.
    """
    open_ = ~known
    out = [(doc[known], at[known], np.ones(int(known.sum()), bool), np.zeros(int(known.sum()), bool), ah[known])]
    ah, sh, doc, at, many = ah[open_], sh[open_], doc[open_], at[open_], many[open_]
    if len(ah):
        seg, buck = _groups(ah, sh), _groups(ah)
        whole = doc > doc[np.searchsorted(seg, np.arange(seg[-1] + 1))][seg]
        first = np.searchsorted(buck, np.arange(buck[-1] + 2))
        n_segs = seg[first[1:] - 1] - seg[first[:-1]] + 1
        keep = whole | many | (n_segs[buck] > 1)
        out.append((doc[keep], at[keep], whole[keep], many[keep] | (n_segs[buck][keep] > BUCKET), ah[keep]))
    doc, at, whole, hot, ah = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(whole), pa.array(ah, mask=~hot)], ["doc", "at", "whole", "hot"])


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each suffix, the longest prefix it shares with a suffix of a smaller place.

    ``order`` lists suffixes in suffix order, lcp[k] is what order[k - 1] and
    order[k] share (lcp[0] = 0), and ``place`` is a suffix's place in the text,
    or its document's number: equal places do not count. The best match is the
    previous or the next smaller place in suffix order. Both are found for all
    suffixes at once by jumping: whoever points at a place that is not smaller
    takes over its pointer, and the least common prefix on the way.
    """
    out = np.zeros(len(order), np.int64)
    for flip in (False, True):
        p = place[order][::-1] if flip else place[order]
        shared = np.concatenate([[0], lcp[1:][::-1]]) if flip else lcp.copy()
        to = np.arange(len(order)) - 1
        open_ = np.nonzero((to >= 0) & (p[to] >= p))[0]
        while len(open_):
            via = to[open_]
            shared[open_], to[open_] = np.minimum(shared[open_], shared[via]), to[via]
            open_ = open_[(to[open_] >= 0) & (p[to[open_]] >= p[open_])]
        best = np.where(to >= 0, shared, 0)
        where = order[::-1] if flip else order
        out[where] = np.maximum(out[where], best)
    return out


def string_order(strings: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of (n, LENGTH) bytes within buckets, and common prefixes of neighbours."""
    padded = np.zeros((len(strings), 56), np.uint8)
    padded[:, :LENGTH] = strings
    keys = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([*(keys[:, k] for k in range(6, -1, -1)), bucket])
    same = strings[order[1:]] == strings[order[:-1]]
    lcp = np.where(same.all(1), LENGTH, same.argmin(1)) * (bucket[order[1:]] == bucket[order[:-1]])
    return order, np.concatenate([[0], lcp]).astype(np.int64)


def repeated_starts(bucket: np.ndarray, parts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the strings in ``parts`` that a smaller document has in the same bucket."""
    count = np.array([len(p) - LENGTH + 1 for p in parts])
    x = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum([0, *map(len, parts[:-1])])
    row = np.repeat(np.arange(len(parts)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    strings = np.lib.stride_tricks.sliding_window_view(x, LENGTH)[begin[row] + start]
    order, lcp = string_order(strings, bucket[row])
    hit = longest_previous_factor(order, lcp, doc[row]) >= LENGTH
    return row[hit], start[hit]


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of a row as (row, first, bytes covered)."""
    first = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))[0] if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(row)]]))
    return row[first], start[first], count + LENGTH - 1


def _factors(rows: DataFrame) -> DataFrame:
    """(doc, hash, start, size) of repeated strings in rows (ah, part, doc, at), bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_buckets(batches):
            row, start = repeated_starts(t.column("ah").to_numpy(), t.column("part").to_pylist(), t.column("doc").to_numpy())
            row, start, n = _runs(row, start)
            at = t.column("at").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(t.column("doc").to_numpy()[row]), pa.array(at >> 40), pa.array((at >> 8 & (1 << 32) - 1) + start), pa.array(n)], ["doc", "hash", "start", "size"])

    return rows.repartition("ah").sortWithinPartitions("ah").mapInArrow(run, "doc long, hash long, start long, size long")


def removals(docs: DataFrame) -> DataFrame:
    """(doc, hash, start, size): bytes of each row (doc, hash, text binary) that a smaller document has too.

    ``hash`` (HASH_BITS) tells texts of one id apart. A segment's place is one
    number, ``at``: the hash, its first start (32 bits), its count (8 bits).

    1. A filter of bounded size learns which anchors occur twice, and which very
       often; tasks send it packed slot numbers, about two bytes for 18 bytes of
       text.
    2. Segments of such anchors are compared as a whole: those of equal content
       belong to the smallest document that has them. Segments of an anchor that
       very many texts have are dealt by their content.
    3. Strings of distinct segments that share an anchor are put into suffix
       order, and their longest previous factors say which occur earlier.
    """
    spark = docs.sparkSession
    docs = docs.where("doc is not null")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, BITS_A_BYTE * n_bytes)))))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for k, _, _, ah, _ in scan(b.column("text").to_pylist()):
                s = slots(ah, n_bits)
                both = np.unique(s | k << n_bits)  # a text counts once
                held.append(both & (1 << n_bits) - 1)
                size += len(both)
                if size > 4_000_000:
                    yield _emit(held, n_bits)
                    held, size = [], 0
        yield _emit(held, n_bits)

    twice, often = seen_filter(docs.select("text").mapInArrow(anchors, "range int, slots binary"), 2, n_bits)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = _bits(twice, n_bits), often.value
        for b in batches:
            doc, high = b.column("doc").to_numpy(), b.column("hash").to_numpy() << 40
            found = []
            for k, first, count, ah, sh in scan(b.column("text").to_pylist()):
                s = slots(ah, n_bits)
                hit = _has(bits, s)
                k, s = k[hit], s[hit]
                found.append((bucket(ah[hit]), sh[hit].view(np.int64), doc[k], high[k] | first[hit] << 8 | count[hit], np.isin(s, hot)))
            if found:
                yield _rows(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_buckets(batches):
            yield _judged(*(t.column(c).to_numpy() for c in ("ah", "sh", "doc", "at", "known", "many")))

    rows = docs.select("doc", "hash", "text").mapInArrow(shared, "ah int, sh long, doc long, at long, known boolean, many boolean")
    rows = rows.repartition(F.when(F.col("known"), F.hash("doc", "at")).when(F.col("many"), F.hash("sh")).otherwise(F.col("ah"))).sortWithinPartitions("ah", "sh", "doc")
    judged = staged(rows.mapInArrow(judge, "doc long, at long, whole boolean, hot int"), "judged")
    hot = staged(judged.where("hot is not null").select(F.col("hot").alias("ah"), F.lit(True).alias("hot")).distinct(), "hot")
    twice.destroy()
    often.destroy()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _emit([slots(_key(b.column("doc").to_numpy(), b.column("at").to_numpy()), n_bits)], n_bits)

    unsure, _ = seen_filter(judged.where("not whole").select("doc", "at").mapInArrow(named, "range int, slots binary"), 1, n_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(unsure, n_bits)
        for b in batches:
            texts = b.column("text").to_pylist()
            doc, high = b.column("doc").to_numpy(), b.column("hash").to_numpy() << 40
            for k, first, count, ah, _ in scan(texts):
                at = high[k] | first << 8 | count
                hit = np.nonzero(_has(bits, slots(_key(doc[k], at), n_bits)))[0]
                parts = [texts[j][f : f + c + LENGTH - 1] for j, f, c in zip(k[hit], first[hit], count[hit], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket(ah[hit])), pa.array(parts, pa.binary()), pa.array(doc[k[hit]]), pa.array(at[hit])], ["ah", "part", "doc", "at"])

    parts = docs.select("doc", "hash", "text").mapInArrow(cut, "ah int, part binary, doc long, at long")
    start = F.shiftright("at", 8).bitwiseAND((1 << 32) - 1)
    if hot.isEmpty():
        found = _factors(parts)
    else:
        parts = staged(parts.join(hot, "ah", "left"), "parts")
        found = _factors(parts.where("hot is null").drop("hot"))
        strings = parts.where("hot").select("doc", "at", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("part") - (LENGTH - 1)), lambda i: F.substring("part", i, F.lit(LENGTH)))).alias("k", "string"))
        least = strings.groupBy("string").agg(F.min("doc").alias("least"))
        found = found.union(strings.join(least, "string").where("doc > least").select("doc", F.shiftright("at", 40).alias("hash"), (start + F.col("k")).alias("start"), F.lit(LENGTH).cast("long")))
    whole = judged.where("whole").select("doc", F.shiftright("at", 40).alias("hash"), start.alias("start"), (F.col("at").bitwiseAND(255) + (LENGTH - 1)).alias("size"))
    return whole.union(found)


def _key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mix(_mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + at.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def strip_repeats(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without the spans (start, size), and the number of removed runs."""
    kept, at, n = [], 0, 0
    runs: list[list[int]] = []
    for start, size in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + size)
        else:
            runs.append([start, start + size])
    for a, b in runs:
        kept.append(text[at:a])
        at, n = b, n + 1
    kept.append(text[at:])
    return b"".join(kept), n


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) for each row of ``docs``.

    Texts are UTF-8 bytes; every byte goes that lies in a string of LENGTH bytes
    that a document of smaller doc_id has too, as they were given. Cases: null
    texts are empty; shorter texts stay whole; longer ones are scanned in pieces of
    4 MB that overlap; rows without an id stay whole and come before none; rows
    of one id do not shorten each other (a tie); an empty table gives no rows;
    other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).bitwiseAND((1 << HASH_BITS) - 1).alias("hash"), text.cast("binary").alias("text"))
    spans = removals(rows).groupBy(F.col("doc").alias("of"), F.col("hash").alias("of_hash")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for t, s in zip(texts, b.column("spans").to_pylist(), strict=True):
                out.append(strip_repeats(t, [(x["start"], x["size"]) for x in s]) if s else (t, 0))
            n = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([o[0] for o in out], pa.binary()), pa.array(n, pa.int64()), pa.array([m - len(o[0]) for m, o in zip(n, out, strict=True)], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = rows.join(spans, (rows["doc"] == spans["of"]) & (rows["hash"] == spans["of_hash"]), "left").select("doc", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
