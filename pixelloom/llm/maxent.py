"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, staged

#: Branches of a node of the tree of classes.
WIDTH = 16
#: Groups, by form, of the words that are not in the tree.
TAILS = 6
#: Most frequent words whose counts are broadcast and that are leaves of the tree; the counts of the others are joined.
KNOWN = 200_000
#: Rows of the hashed table: so many times the root of the number of tokens, within these powers of two (4 to 256 MB).
ROWS_BY, LEAST_BITS, MOST_BITS = 8, 16, 22
#: Training passes, each over another part of the corpus; parameters are averaged after each.
ROUNDS = 2
#: Step of updates, and what their sum of squares begins with.
RATE, SQUARES = 1.5, 4.0
BATCH = 8192
#: Words that a task counts before it sends what it has.
COUNTED = 800_000
#: Rows that occur so many times in a batch at most are summed one after the other, the rest of others at once.
FEW = 4
#: Table rows in one record of parameters.
BLOCK = 256
#: Training tasks: as many as the input has parts, but at most so many for each core and in all.
TASKS_A_CORE, TASKS = 4, 64


def tail_class(word: bytes) -> int:
    """Group of a word outside the classes of frequent words: by its bytes and whether it is ASCII."""
    n = len(word)
    return (0 if n <= 4 else 1 if n <= 7 else 2 if n <= 10 else 3) if word.isascii() else 4 if n <= 6 else 5


def tail_column(word):
    n = F.octet_length(word)
    return F.when(n == F.length(word), F.when(n <= 4, 0).when(n <= 7, 1).when(n <= 10, 2).otherwise(3)).otherwise(F.when(n <= 6, 4).otherwise(5))


class Ids(dict):
    """Word to number; an absent word gets the number of its tail class."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + tail_class(word)


def tree(weights: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of classes of leaves, frequent leaves near the root (Huffman's order).

    Returns, for the path of each leaf, ``starts`` (n + 1), ``nodes`` and
    ``branches``; and ``bias``, the log share of each branch of each node.
    """
    n = len(weights)
    spare = -(n - 1) % (width - 1)
    heap = [(0.0, -1 - k, -1) for k in range(spare)] + [(float(w), k, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, branch, shares = {}, {}, []
    while len(heap) > 1:
        low = [heapq.heappop(heap) for _ in range(width)]
        node = len(shares)
        for b, (_, _, child) in enumerate(low):
            parent[child], branch[child] = node, b
        shares.append([w for w, _, _ in low])
        heapq.heappush(heap, (sum(w for w, _, _ in low), n + node, n + node))
    starts, nodes, branches = np.zeros(n + 1, np.int64), [], []
    for leaf in range(n):
        path, at = [], leaf
        while at in parent:
            path.append((parent[at], branch[at]))
            at = n + parent[at]
        nodes += [p for p, _ in reversed(path)]
        branches += [b for _, b in reversed(path)]
        starts[leaf + 1] = len(nodes)
    shares = np.array(shares)
    with np.errstate(divide="ignore"):
        bias = np.log(shares / shares.sum(1, keepdims=True))
    return starts, np.array(nodes, np.int32), np.array(branches, np.uint8), np.maximum(bias, -60).astype(np.float32)


class Vocabulary:
    """The KNOWN most frequent words with counts, totals, and the tree; word 0 is the end of a text.

    Leaves of the tree are these words and the groups of all others.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, tail_total: np.ndarray, tail_distinct: np.ndarray, paths: tuple | None = None):
        self.words, self.counts, self.total, self.distinct, self.tail_total, self.tail_distinct = words, counts, total, distinct, tail_total, tail_distinct
        self.n = n = len(words)
        self.bos = n + TAILS
        self.paths = paths or tree(np.concatenate([counts + 0.5, tail_total + 0.5 * (tail_distinct + 1)]))
        self.starts, self.nodes, self.branches, self.bias = self.paths
        self.ids = Ids({w: i for i, w in enumerate(words) if i})
        # Number 0 stands for the end, a key that no text has.
        self.ids[b" "] = 0
        log = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        self.base = np.concatenate([log, np.zeros(TAILS)])

    def plain(self) -> tuple:
        """What makes it again, without classes of this package: to be broadcast."""
        return self.words, self.counts, self.total, self.distinct, self.tail_total, self.tail_distinct, self.paths

    def table_bits(self) -> int:
        return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(ROWS_BY * math.sqrt(max(1, self.total))))))


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(ids: np.ndarray, starts: np.ndarray, bos: int) -> list[np.ndarray]:
    """Hashed features of each token: the last word and the last two (with the token n-grams), and the word before the last (a skip)."""
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[starts] = bos
    two[starts] = bos
    later = starts[starts + 1 < len(ids)] + 1
    two[later] = bos
    return [_hash(one, 1), _hash(two, 2), _hash(one * (bos + 1) + two, 3)]


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2 ** 32, by 16 bits at a time, which numpy sorts by digits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


#: Sums of rows by a product are faster than along a short axis.
ONES = np.ones(WIDTH, np.float32)


class Model:
    """The tree's decisions, each a softmax over the branches of a node by the hashed features."""

    def __init__(self, vocab: Vocabulary, table: np.ndarray):
        self.vocab, self.table = vocab, table
        self.shift = np.uint64(64 - int(math.log2(len(table))))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        look, flat, sizes, all_words = self.vocab.ids.__getitem__, [], [], []
        for t in texts:
            ws = t.lower().split()
            flat.extend(map(look, ws))
            flat.append(0)
            sizes.append(len(ws) + 1)
            all_words.append(ws)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        return np.array(flat, np.int64), starts, all_words

    def decisions(self, ids: np.ndarray, hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """For each decision on the paths of words: node, branch, table rows; and each word's first."""
        v = self.vocab
        size = v.starts[ids + 1] - v.starts[ids]
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(ids)), size)
        at = np.arange(ends[-1] if len(ends) else 0) + (v.starts[ids] - ends + size)[word]
        node = v.nodes[at]
        salt = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        rows = [(((h[word] ^ salt) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int32) for h in hashed]
        return node, v.branches[at], rows, ends - size

    def weights(self, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Sums of the parameters of each branch, to be exponentiated."""
        z = np.take(self.vocab.bias, node, axis=0)
        for r in rows:
            z += np.take(self.table, r, axis=0)
        return np.minimum(z, 60, out=z)  # within what float32 can exponentiate

    def logs(self, node: np.ndarray, branch: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Log probability of the branch taken at each decision."""
        z = self.weights(node, rows)
        taken = z[np.arange(len(z)), branch]
        return taken - np.log(np.exp(z, out=z) @ ONES)

    def train(self, texts: list[bytes], squares: np.ndarray, seen: np.ndarray) -> None:
        ids, starts, _ = self.ids(texts)
        hashed = features(ids, starts, self.vocab.bos)
        for lo in range(0, len(ids), BATCH):
            s = slice(lo, lo + BATCH)
            node, branch, rows, _ = self.decisions(ids[s], [h[s] for h in hashed])
            g = self.weights(node, rows)
            np.exp(g, out=g)
            g *= (-1 / (g @ ONES))[:, None]
            g[np.arange(len(g)), branch] += 1
            all_ = np.concatenate(rows)
            order = _order(all_)
            key = all_[order]
            first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            size = np.diff(np.concatenate([first, [len(key)]]))
            order = np.take(np.tile(np.arange(len(g)), len(rows)), order)  # the decision, of whichever feature
            u = key[first]
            sums = np.take(g, order[first], axis=0)  # most rows occur once in a batch, most others a few times
            for k in range(1, FEW):
                more = np.nonzero(size > k)[0]
                sums[more] += np.take(g, order[first[more] + k], axis=0)
            many = np.nonzero(size > FEW)[0]
            if len(many):
                left = size[many] - FEW
                begin = np.cumsum(left) - left
                at = np.arange(left.sum()) + np.repeat(first[many] + FEW - begin, left)
                sums[many] += np.add.reduceat(np.take(g, order[at], axis=0), begin, axis=0)
            steep = np.take(squares, u) + np.einsum("ij,ij->i", sums, sums)
            squares[u] = steep
            sums *= (RATE / np.sqrt(steep))[:, None]
            sums += np.take(self.table, u, axis=0)
            self.table[u] = sums
            seen[u] += size

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """For each text: tokens, known tokens, base and model score without absent words, and these."""
        v = self.vocab
        ids, starts, all_words = self.ids(texts)
        hashed = features(ids, starts, v.bos)
        logs = np.empty(len(ids))
        for lo in range(0, len(ids), BATCH):
            s = slice(lo, lo + BATCH)
            node, branch, rows, first = self.decisions(ids[s], [h[s] for h in hashed])
            logs[s] = np.add.reduceat(self.logs(node, branch, rows), first)
        known = ids < v.n
        sums = lambda x: np.add.reduceat(x, starts)
        absent = [[ws[k] for k in np.nonzero(~known[a : a + len(ws)])[0]] for a, ws in zip(starts, all_words, strict=True)]
        return sums(np.ones(len(ids), np.int64)), sums(((v.counts[np.minimum(ids, v.n - 1)] > 0) & known).astype(np.int64)), sums(v.base[ids]), sums(logs) / math.log(10), absent


def _texts(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in b.column(name).to_pylist()]


def _slices(b: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of text."""
    n = max(1, min(b.num_rows, b.nbytes // size))
    for k in range(n):
        lo, hi = b.num_rows * k // n, b.num_rows * (k + 1) // n
        if hi > lo:
            yield b.slice(lo, hi - lo)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all of ``texts`` (text binary). Counts are combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for t in _texts(b):
                counts.update(t.lower().split())
                if len(counts) > COUNTED:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    def out(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def build_vocabulary(counts: DataFrame, n_docs: int, known: int = KNOWN) -> Vocabulary:
    """Totals of all counts, and the ``known`` most frequent words (a fixed bound)."""
    top = counts.orderBy(F.desc("n"), "word").limit(known - 1).collect()
    words_, ns = [b" ", *(r["word"].encode() for r in top)], [n_docs, *(r["n"] for r in top)]
    tails = {r["t"]: r for r in counts.groupBy(tail_column(F.col("word")).alias("t")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = n_docs + sum(r["n"] for r in tails.values()), (n_docs > 0) + sum(r["v"] for r in tails.values())
    tail_total, tail_distinct = np.zeros(TAILS), np.zeros(TAILS)
    for t, r in tails.items():
        tail_total[t], tail_distinct[t] = r["n"], r["v"]
    for w, n in list(zip(words_, ns, strict=True))[1:]:
        tail_total[tail_class(w)] -= n
        tail_distinct[tail_class(w)] -= 1
    return Vocabulary(words_, np.array(ns, np.float64), total, distinct, tail_total, tail_distinct)


def train_model(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Trains on all of ``texts`` (text binary, part int) by distributed gradient updates.

    Each of the ``rounds`` takes another part of the texts, so more rounds mean
    less data in each. In a round every task starts from the same parameters,
    makes updates over its texts, and returns the table rows it touched with how
    often; Spark averages each row over the tasks by that number. The table
    grows with the root of the number of tokens, up to a bound of memory.
    """
    spark = texts.sparkSession
    table = np.zeros((1 << vocab.table_bits(), WIDTH), np.float32)
    cores = spark.sparkContext.defaultParallelism
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((vocab.plain(), table))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            plain, table = shared.value
            model = Model(Vocabulary(*plain), table.copy())
            squares, seen = np.full(len(table), SQUARES, np.float32), np.zeros(len(table), np.int64)
            for b in batches:
                for part in _slices(b):
                    model.train(_texts(part), squares, seen)
            for k in range(0, len(table), BLOCK):
                m = np.minimum(seen[k : k + BLOCK], 2**31 - 1).astype(np.int32)
                if m.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary()), pa.array([model.table[k : k + BLOCK][m > 0].astype(np.float16).tobytes()], pa.binary())], ["key", "n", "w"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for key, n, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    m = np.frombuffer(n, np.int32)
                    s = sums.setdefault(key, [np.zeros(len(m)), np.zeros((len(m), WIDTH), np.float32)])
                    s[0] += m
                    s[1][m > 0] += np.frombuffer(w, np.float16).reshape(-1, WIDTH).astype(np.float32) * m[m > 0, None]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s[0] > 0).tobytes() for s in sums.values()], pa.binary()), pa.array([(s[1] / np.maximum(s[0], 1)[:, None]).astype(np.float16).tobytes() for s in sums.values()], pa.binary())], ["key", "n", "w"])

        schema = "key int, n binary, w binary"
        parts = texts.where(F.col("part") % rounds == r).select("text").coalesce(max(TASKS, TASKS_A_CORE * cores))
        done = parts.mapInArrow(fit, schema).repartition(2 * cores, "key").mapInArrow(add, schema).toLocalIterator()  # the table
        table = table.copy()
        for key, n, w in done:
            m = np.frombuffer(n, bool)
            table[key : key + len(m)][m] = np.frombuffer(w, np.float16).reshape(len(m), WIDTH)[m]
        shared.unpersist()
    return Model(vocab, table)


def lm_scores(docs: DataFrame, fold: int = 1, folds: int = 5) -> DataFrame:
    """Model and base log10 probabilities of each row of ``docs``, learnt outside one fold.

    Training rows are those whose crc32 of the id as text, modulo ``folds``, is
    not ``fold``. Words outside the broadcast ones are scored by a join with
    all counts. The model's score depends a little on how Spark splits the
    table, as tasks train side by side.
    Cases: null and empty texts are one end token; a null id counts as the empty
    text, so it is trained on; repeated rows are trained on and scored as often;
    of equally frequent words at the edge of the broadcast ones the first by
    code point is taken; a text of any length is read whole; an empty table, or
    one without training rows, has N and V of 0 (every token is then unknown);
    other columns are not read.
    """
    spark = docs.sparkSession
    fold_of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    rows = docs.select(F.col("doc_id").cast("long"), (fold_of == fold).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)).cast("int").alias("part"))
    train = rows.where(~F.col("held_out"))
    counts = staged(word_counts(train.select("text")), "counts")
    vocab = build_vocabulary(counts, train.count())
    model = train_model(train, vocab)
    shared = spark.sparkContext.broadcast((vocab.plain(), model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, table = shared.value
        model, row = Model(Vocabulary(*plain), table), TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in _slices(whole):
                n, known, base, score, absent = model.score(_texts(b))
                ids = np.arange(row, row + b.num_rows)
                row += b.num_rows
                lists = pa.array(absent, pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), lists], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "absent"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, absent array<binary>"
    scored = staged(rows.select("doc_id", "held_out", "text").mapInArrow(run, schema), "scored")
    absent = scored.select("row", F.explode("absent").alias("w")).groupBy("row", F.col("w").cast("string").alias("word")).agg(F.count("*").alias("times"))
    absent = absent.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    base_norm = math.log10(vocab.total + 0.5 * (vocab.distinct + 1))
    norms = [math.log10(vocab.tail_total[t] + 0.5 * (vocab.tail_distinct[t] + 1)) for t in range(TAILS)]
    norm = F.get(F.array(*map(F.lit, norms)), tail_column(F.col("word")))
    more = absent.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - base_norm)).alias("b"), F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - norm)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"))
    zero = F.lit(0.0)
    return scored.drop("absent").join(more, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
