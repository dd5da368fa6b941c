"""Ranked lexical search: compressed postings by shard, merged document by document."""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, staged

#: Bytes of text from which a task closes a shard, so that a shard fits in a task whatever its input.
SHARD_BYTES = 16 << 20
TOP = 10
#: Pairs of item and term that one pass over the postings takes to every task; more items take several passes.
PASS_TERMS = 1_000_000
#: ASCII letters and digits stand (letters in lower case), other ASCII ends a term, all bytes beyond belong to terms.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))

POSTINGS = "shard string, term binary, df int, postings binary, doc_ids binary, lengths binary"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of 7 bits, the last without the high bit; and the length of each."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k) if k < 9 else 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
        out[(ends - size)[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def from_varints(data: bytes) -> np.ndarray:
    """The integers that ``varints`` wrote."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def packed(ids: list[int | None]) -> bytes:
    """Ascending ids with nulls last: their count, then the gaps, zigzag for the first."""
    known = np.array([i for i in ids if i is not None], np.int64)
    gaps = np.diff(known, prepend=0)
    if len(gaps):
        gaps[0] = gaps[0] * 2 if gaps[0] >= 0 else -2 * gaps[0] - 1
    return varints(np.concatenate([[len(ids) - len(known)], gaps]))[0].tobytes()


def unpacked(data: bytes) -> list[int | None]:
    nulls, *_ = got = from_varints(data)
    gaps = got[1:].copy()
    if len(gaps):
        gaps[0] = gaps[0] // 2 if gaps[0] % 2 == 0 else -(gaps[0] + 1) // 2
    return [*np.cumsum(gaps).tolist(), *[None] * int(nulls)]


def shard_rows(name: str, ids: list[int | None], bags: list[array], known: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Postings of one shard: documents by doc_id are numbered from 0; a term's postings are gaps of numbers and counts.

    ``bags`` are the places of a document's terms in ``known``. The row without a term holds the ids and lengths of the documents.
    """
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    lengths = np.array([len(bags[k]) for k in order], np.int64)
    words = pa.array(known, pa.binary())
    pair = np.concatenate([np.frombuffer(bags[k], np.int32).astype(np.int64) * len(ids) + d for d, k in enumerate(order)])
    pair.sort()
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    tf = np.diff(starts, append=len(pair))
    term, doc = np.divmod(pair[starts], max(len(ids), 1))
    head = np.flatnonzero(np.diff(term, prepend=-1))
    gap = np.diff(doc, prepend=0)
    gap[head] = doc[head]
    data, size = varints(np.column_stack([gap, tf]).ravel())
    at = np.concatenate([[0], np.cumsum(size)])[np.append(2 * head, len(size))]
    for lo in range(0, len(head), 100_000):
        own = at[lo : lo + 100_001]
        rows = len(own) - 1
        posts = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer((own - own[0]).astype(np.int32).tobytes()), pa.py_buffer(data[own[0] : own[-1]].tobytes())])
        df = np.diff(np.append(head, len(term)))[lo : lo + rows]
        none = pa.nulls(rows, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([name] * rows), words.take(pa.array(term[head[lo : lo + rows]])), pa.array(df, pa.int32()), posts, none, none], names=["shard", "term", "df", "postings", "doc_ids", "lengths"])
    last = [[name], [None], [int((lengths > 0).sum())], [varints(np.array([lengths.sum()]))[0].tobytes()], [packed([ids[k] for k in order])], [varints(lengths)[0].tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(last, (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "term", "df", "postings", "doc_ids", "lengths"])


def numbered() -> defaultdict:
    """A number from 0 for each key that is asked for."""
    out = defaultdict()
    out.default_factory = out.__len__
    return out


def build_index(docs: DataFrame) -> DataFrame:
    """The postings of every document as a stage table, a row per shard and term.

    Shards are the input's partitions, cut at SHARD_BYTES of text: nothing is
    shuffled, a frequent term has a row in each shard, and no task holds more
    than a shard and one text.
    """

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, size, ids, bags, known = TaskContext.get().partitionId(), 0, 0, [], [], numbered()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id)
                bags.append(array("i", map(known.__getitem__, terms(text))))
                size += 64 + len(text)
                if size >= SHARD_BYTES:
                    yield from shard_rows(f"{part}-{count}", ids, bags, list(known))
                    count, size, ids, bags, known = count + 1, 0, [], [], numbered()
        if ids:
            yield from shard_rows(f"{part}-{count}", ids, bags, list(known))

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(invert, POSTINGS), "postings")


def query_terms(items: DataFrame) -> DataFrame:
    """A row per item and term: item_id, term, ``times`` it stands in the item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, n in Counter(terms(text)).items()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "term", "times"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(split, "item_id long, term binary, times long")


def best(lists: list[tuple[list[int], list[int], int, int]], top: int) -> list[tuple[int, int]]:
    """The ``top`` documents (score, number) of a merge of posting lists: ascending numbers, gains, largest gain, times.

    A heap holds the next document of each list; a document's gains are summed
    when it comes up. Lists that cannot lift a document into the result, all
    together, leave the heap and are only looked up for the documents that the
    others bring. Of equal scores the smaller number stays.
    """
    lists = sorted(lists, key=lambda x: x[2] * x[3])
    reach = [0]  # the sum of the first k bounds
    for x in lists:
        reach.append(reach[-1] + x[2] * x[3])
    k = len(lists)
    at = [0] * k
    heap = [(x[0][0], j) for j, x in enumerate(lists)]
    heapq.heapify(heap)
    found: list[tuple[int, int]] = []  # (score, -number): the worst is on top
    idle, floor = 0, 0  # lists below ``idle`` are out of the heap
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            j = heap[0][1]
            if j < idle:
                heapq.heappop(heap)
                continue
            docs, gains, _, times = lists[j]
            p = at[j]
            score += gains[p] * times
            at[j] = p = p + 1
            if p < len(docs):
                heapq.heapreplace(heap, (docs[p], j))
            else:
                heapq.heappop(heap)
        if not score:
            continue
        for j in range(idle - 1, -1, -1):
            if score + reach[j + 1] <= floor:
                break
            docs, gains, _, times = lists[j]
            at[j] = p = bisect_left(docs, doc, at[j])
            if p < len(docs) and docs[p] == doc:
                score += gains[p] * times
        if score > floor:
            if len(found) < top:
                heapq.heappush(found, (score, -doc))
            else:
                heapq.heapreplace(found, (score, -doc))
            if len(found) == top:
                floor = found[0][0]
                while idle < k and reach[idle + 1] <= floor:
                    idle += 1
    return sorted(((s, -d) for s, d in found), key=lambda x: (-x[0], x[1]))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def shard_hits(rows: pd.DataFrame, queries: dict[int, list[tuple[bytes, int]]], weights: dict[bytes, int], n_docs: int, n_terms: int, top: int) -> list[tuple[int, int | None, int]]:
    """The best documents (item_id, doc_id, score) of each query in one shard."""
    index, ids, length = {}, [], None
    for term, postings, doc_ids, lengths in zip(rows["term"], rows["postings"], rows["doc_ids"], rows["lengths"]):
        if term is None:
            ids, length = unpacked(doc_ids), from_varints(lengths)
        else:
            index[term] = postings
    norm = 8 * (25 + 75 * length * n_docs // max(n_terms, 1))
    lists, out = {}, []
    for term, postings in index.items():
        both = from_varints(postings)
        docs, tf = np.cumsum(both[::2]), both[1::2]
        gains = weights[term] * (1_000_000_000 * tf // (1000 * tf + norm[docs]))
        if (some := gains > 0).any():
            lists[term] = (docs[some].tolist(), gains[some].tolist(), int(gains.max()))
    for item, bag in queries.items():
        out += [(item, ids[d], s) for s, d in best([(*lists[t], n) for t, n in bag if t in lists], top)]
    return out


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of ``index`` for each item: item_id, rank, doc_id, score.

    Every shard sends its ``top`` for each item to a merge by item, so what is
    merged grows with shards and items alone, and each task cuts it to ``top``
    an item before it is sent. Items whose terms exceed PASS_TERMS are dealt
    to several passes over the postings.
    Cases: null or termless items and documents find nothing; an item_id that
    repeats is one item of all its texts; documents of one doc_id are each a
    document, ranked one after the other; ids that are null rank last among
    equal scores; empty tables give an empty result.
    """
    asked = query_terms(items).groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    heads = index.where("term is null")
    n_docs, n_terms = heads.agg(F.sum("df")).first()[0] or 0, sum_lengths(heads)
    passes = 1 + asked.count() // PASS_TERMS
    parts = [asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) for k in range(passes)]
    hits = reduce(DataFrame.union, [shard_search(index, part, n_docs, n_terms, top) for part in parts])
    by_item = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def shard_search(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The ``top`` documents of each shard for the items of ``asked``, about PASS_TERMS rows at most."""
    queries: dict[int, list[tuple[bytes, int]]] = {}
    for r in asked.collect():
        queries.setdefault(r["item_id"], []).append((bytes(r["term"]), r["times"]))
    wanted = index.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    weights = {bytes(r["term"]): weight(n_docs, r["df"]) for r in wanted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        queries_, weights_ = shared.value
        hits = shard_hits(rows, queries_, weights_, n_docs, n_terms, top)
        return pd.DataFrame({c: pd.array([h[k] for h in hits], "Int64") for k, c in enumerate(("item_id", "doc_id", "score"))})

    # Only the query terms of a shard travel, and a shard's size is bounded.
    cols = ["shard", "term", "postings", "doc_ids", "lengths"]
    rows = wanted.select(cols).union(index.where("term is null").select(cols))
    return rows.groupBy("shard").applyInPandas(merge, "item_id long, doc_id long, score long")


def sum_lengths(heads: DataFrame) -> int:
    """All terms of all documents, with repeats."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(from_varints(x).sum()) for batch in batches for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return heads.select("postings").mapInArrow(add, "n long").agg(F.sum("n")).first()[0] or 0


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``search`` of an index built of ``docs``; texts of any length are read whole."""
    return search(build_index(docs), items, top)


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
