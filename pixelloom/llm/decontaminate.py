"""Benchmark decontamination: pigeonhole edit matching, verified by Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, fresh

#: Edits allowed, as a share of an item's characters.
RATE = 0.08
#: From this character on, scripts write words without spaces.
UNSPACED = "\u2e80"
#: Characters of items that one broadcast block holds, about.
BLOCK_CHARS = 2_000_000
#: Blocks that one pass over the documents searches.
PASS_BLOCKS = 8


def squeeze(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def joined(left: str, right: str) -> bool:
    """Whether two neighbours, of which one may lack, belong to one word."""
    return left.isalnum() and right.isalnum() and max(left, right) < UNSPACED


def distance(masks: dict[str, int], m: int, text: str, budget: int) -> int:
    """Least edit distance of a pattern of m characters to any part of ``text``.

    One column of the distance matrix is two integers of m bits; ends at 0.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    get = masks.get
    left = len(text)
    for c in text:
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        left -= 1
        if best > budget and score - left > budget:
            return best
        ph <<= 1
        plus = (mh << 1 | ~(xv | ph)) & full
        minus = ph & xv & full
    return best


class Matcher:
    """Finds items in texts with up to ``rate`` times their characters in edits."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.masks = [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            m, k, masks = len(text), int(len(text) * rate), {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            n = len(self.items)
            self.items.append((item, text, k))
            self.masks.append(masks)
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.automaton.add_word(p, (len(p), at))
        if pieces:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(item, least distance) of the items found."""
        if not self.items:
            return
        starts: dict[int, list[int]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for n, a in at:
                starts.setdefault(n, []).append(end - size + 1 - a)
        for n, where in starts.items():
            item, pattern, k = self.items[n]
            m = len(pattern)
            if not k:
                if any(not joined(text[a - 1 : a], pattern[0]) and not joined(pattern[-1], text[a + m : a + m + 1]) for a in where):
                    yield item, 0
                continue
            if pattern in text:
                yield item, 0
                continue
            best, last = m, None
            for lo, hi in self._windows(sorted(where), m, k):
                best = min(best, distance(self.masks[n], m, text[max(0, lo) : hi], k))
                last = hi
            if last is not None and best <= k:
                yield item, best

    @staticmethod
    def _windows(where: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
        """The ranges in which a match that holds an exact piece can lie, merged."""
        lo, hi = where[0] - k, where[0] + m + k
        for s in where[1:]:
            if s - k <= hi:
                hi = s + m + k
            else:
                yield lo, hi
                lo, hi = s - k, s + m + k
        yield lo, hi


def contaminated(docs: DataFrame, bench: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance) for each row of ``docs`` and item whose text it holds.

    Each item is cut into one piece more than it may have edits, so some piece of
    a match is unchanged: exact pieces are found by one automaton, and the text
    around them is verified. Items are broadcast in blocks of bounded size, of
    which one pass searches several. Items too short for an edit must stand whole:
    no letter or digit joins them on either side.
    Cases: null and empty items match nothing; null texts hold nothing; repeated
    rows give repeated results, repeated items one; of several places the least
    distance counts; a text of any length is read whole; a null doc_id or
    item_id stays null; an empty table on either side gives no rows; other
    columns are not read.
    """
    items = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_chars))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts, blocks = [], []
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).distinct().collect()  # about block_chars
        block = sorted({(r[0], squeeze(r[1])) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        blocks.append(docs.sparkSession.sparkContext.broadcast([r for r in block if r[1]]))
        if len(blocks) == PASS_BLOCKS or k == n_blocks - 1:
            parts.append(_search(docs, blocks, rate))
            blocks = []
    return reduce(DataFrame.union, parts)


def _search(docs: DataFrame, blocks: list[Broadcast], rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(b.value, rate) for b in blocks]
        for b in batches:
            texts = map(squeeze, b.column(1).to_pylist())
            out = [(d, item, n) for d, t in zip(b.column(0).to_pylist(), texts, strict=True) for m in matchers for item, n in m.hits(t)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "distance"])

    return docs.mapInArrow(run, "doc_id long, item_id long, distance int")


def drop_contaminated(docs: DataFrame, bench: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without an id are matched by text.

    Cases are those of ``contaminated``: rows with a null text stay, as it holds
    nothing; repeated rows stay or go together; texts of any length are read
    whole; if either table is empty, all rows stay; columns of any name pass
    through.
    """
    texts = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    bad = fresh("bad", docs)
    found = contaminated(texts, bench, rate).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == found[bad], "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
