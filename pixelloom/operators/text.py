"""Texts split for setting: scripts, levels of direction, visual order, places where lines may break.

The core of the published bidirectional rules: a paragraph's level is that of
its first strong character; letters take their own direction; digits after
right-to-left letters stand above them; neutrals between two of one direction
take it, others the paragraph's. There are no embeddings or isolates, so levels
are 0, 1 and 2. Each text is one row's arrays of code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First and last code point of each block, and its script.
SCRIPTS = [
    (0x0041, 0x024F, "Latn"), (0x0370, 0x03FF, "Grek"), (0x0400, 0x052F, "Cyrl"), (0x0530, 0x058F, "Armn"), (0x0590, 0x05FF, "Hebr"), (0x0600, 0x06FF, "Arab"), (0x0750, 0x077F, "Arab"), (0x08A0, 0x08FF, "Arab"), (0x0900, 0x097F, "Deva"),
    (0x0980, 0x09FF, "Beng"), (0x0B80, 0x0BFF, "Taml"), (0x0E00, 0x0E7F, "Thai"), (0x1100, 0x11FF, "Hang"), (0x1E00, 0x1EFF, "Latn"), (0x3040, 0x309F, "Hira"), (0x30A0, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Hani"), (0x4E00, 0x9FFF, "Hani"),
    (0xAC00, 0xD7AF, "Hang"), (0xF900, 0xFAFF, "Hani"), (0xFB1D, 0xFB4F, "Hebr"), (0xFB50, 0xFDFF, "Arab"), (0xFE70, 0xFEFF, "Arab"), (0xFF21, 0xFF3A, "Latn"), (0xFF41, 0xFF5A, "Latn"), (0xFF66, 0xFF9F, "Kana"), (0x20000, 0x2FA1F, "Hani"),
]
COMMON = "Zyyy"
DIGITS = [(0x30, 0x39), (0x0660, 0x0669), (0x06F0, 0x06F9)]
#: Common characters below 0x41 and in these blocks are neutral; others count as left to right.
NEUTRAL = [(0x0300, 0x036F), (0x2000, 0x2BFF), (0x3000, 0x303F)]
UNSPACED = {"Hani", "Hira", "Kana", "Hang"}
SPACES, DASHES, ZERO_SPACE = (0x20, 0x09, 0x3000), tuple(map(ord, "-‐–—")), 0x200B
#: Characters that may not begin or end a line.
NO_START = tuple(map(ord, "、。，．：；？！）」』】〕〉》’”ゝゞーぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ・…‥々〻"))
NO_END = tuple(map(ord, "（「『【〔〈《‘“"))

_FIRST, _LAST, _NAMES = (np.array(c) for c in zip(*SCRIPTS))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def _within(cp: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([(cp >= a) & (cp <= b) for a, b in ranges])


def scripts(cp: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_FIRST, cp, side="right") - 1
    known = (at >= 0) & (cp <= _LAST[np.maximum(at, 0)])
    letters = _within(cp, [(0x41, 0x5A), (0x61, 0x7A)])
    known &= letters | (cp >= 0xC0) & (cp != 0xD7) & (cp != 0xF7)
    return np.where(known, _NAMES[np.maximum(at, 0)], COMMON)


def directions(cp: np.ndarray) -> np.ndarray:
    """L and R for strong characters, E for digits, N for neutral ones."""
    script = scripts(cp)
    neutral = (script == COMMON) & ((cp < 0x41) | _within(cp, NEUTRAL))
    return np.select([_within(cp, DIGITS), (script == "Hebr") | (script == "Arab"), neutral], ["E", "R", "N"], "L")


def paragraph_level(kind: np.ndarray) -> int:
    strong = np.flatnonzero((kind == "L") | (kind == "R"))
    return int(len(strong) > 0 and kind[strong[0]] == "R")


def _carried(values: np.ndarray, known: np.ndarray, first) -> np.ndarray:
    """The last known value up to each place; ``first`` before there is one."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(at < 0, first, values[np.maximum(at, 0)])


def levels(kind: np.ndarray, base: int) -> np.ndarray:
    """The level of each character."""
    if not len(kind):
        return np.zeros(0, np.int64)
    left, own = 2 * base, "R" if base else "L"
    strong = _carried(kind, (kind == "L") | (kind == "R"), own)
    side = np.where(kind == "E", "R", kind)  # digits count as right to left for their neighbours
    before, after = _carried(side, kind != "N", own), _carried(side[::-1], (kind != "N")[::-1], own)[::-1]
    neutral = np.where(before == after, before, own)
    return np.select([kind == "L", kind == "R", kind == "E"], [left, 1, np.where(strong == "R", 2, left)], np.where(neutral == "R", 1, left))


def visual_order(level: np.ndarray) -> np.ndarray:
    """Places of the characters from left to right: from the highest level down to the lowest odd one, runs at or above it are reversed."""
    order = np.arange(len(level))
    for limit in range(int(level.max(initial=0)), 0, -1):
        high = level[order] >= limit
        edge = np.flatnonzero(np.diff(high, prepend=False, append=False))
        for a, b in zip(edge[::2], edge[1::2]):
            order[a:b] = order[a:b][::-1]
    return order


def break_places(cp: np.ndarray) -> np.ndarray:
    """The places before which a line may end, the end of the text included: after spaces and dashes, around characters of scripts without spaces."""
    if not len(cp):
        return np.zeros(1, np.int64)
    space = np.isin(cp, SPACES)
    script = scripts(cp)
    unspaced = np.isin(script, list(UNSPACED))
    letter = np.array([chr(c).isalpha() for c in cp.tolist()])
    a, b = slice(None, -1), slice(1, None)
    dash = np.isin(cp, DASHES)[a] & ~space[b] & letter[b]
    between = (unspaced[a] | unspaced[b]) & ~space[a] & ~space[b] & ~np.isin(cp, NO_START)[b] & ~np.isin(cp, NO_END)[a]
    return np.append(np.flatnonzero(space[a] & ~space[b] | dash | (cp[a] == ZERO_SPACE) | between) + 1, len(cp))


#: Arrow's kinds for those of Spark that the results have.
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


#: Code points whose rows are sent on together.
CHUNK = 1 << 18


def _each(docs: DataFrame, columns: dict[str, str], one: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Rows of doc_id and ``columns`` (name: kind) that ``one`` makes of each text's code points.

    ``one`` gives a sequence for each column. A task holds the results of CHUNK code points, or of one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, held, points = [b.schema.field(0).type, *(ARROW[k] for k in columns.values())], [], 0
            send = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()  # noqa: B023, E731
            for k in range(b.num_rows):
                cp = code_points(b.column(1)[k].as_py())
                made = one(cp)
                if len(made[0]):
                    doc = pa.array([b.column(0)[k].as_py()] * len(made[0]), kinds[0])
                    held.append(pa.RecordBatch.from_arrays([doc, *(pa.array(v, kind) for v, kind in zip(made, kinds[1:]))], names=["doc_id", *columns]))
                points += len(cp)
                if held and points >= CHUNK:
                    yield from send()
                    held, points = [], 0
            if held:
                yield from send()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} {k}" for c, k in columns.items()))


def items(docs: DataFrame) -> DataFrame:
    """(doc_id, base, first, n, script, level): runs of one script and level; common characters go with what stands before them.

    A null or empty text has no runs. Texts of any length are read whole.
    """

    def one(cp: np.ndarray) -> tuple:
        if not len(cp):
            return ([],) * 5
        kind = directions(cp)
        base = paragraph_level(kind)
        level, script = levels(kind, base), scripts(cp)
        script = _carried(script, script != COMMON, COMMON)
        first = np.flatnonzero(np.append(True, (level[1:] != level[:-1]) | (script[1:] != script[:-1])))
        size = np.diff(np.append(first, len(cp)))
        return np.full(len(first), base), first, size, script[first].tolist(), level[first]

    return _each(docs, {"base": "int", "first": "long", "n": "long", "script": "string", "level": "int"}, one)


def visual(docs: DataFrame) -> DataFrame:
    """(doc_id, base, text): the characters as they stand from left to right on one line. A null text is empty."""

    def one(cp: np.ndarray) -> tuple:
        kind = directions(cp)
        base = paragraph_level(kind)
        return [base], [cp[visual_order(levels(kind, base))].astype("<u4").tobytes().decode("utf-32-le", "replace")]

    return _each(docs, {"base": "int", "text": "string"}, one)


def breaks(docs: DataFrame) -> DataFrame:
    """(doc_id, places): the numbers of the code points before which a line may end, and that of all of them."""
    return _each(docs, {"places": "array<long>"}, lambda cp: ([break_places(cp)],))
