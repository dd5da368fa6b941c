"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import io
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import documents

#: Labelled rows of each class that the network is fitted on, at most; a seeded choice.
MAX_ROWS = 3000
#: Words in a window; windows begin every STRIDE words and cover the whole text.
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, POOL = 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 12
#: Leading bytes of a word that have an embedding of their own.
STEM = 5
#: Rows of words and stems of fewer training texts stay 0, so rare ones are known by their characters alone.
MIN_TEXTS = 6
EPOCHS = 10
#: Share of words whose word, stem or character input is left out in a step.
DROPOUT = (0.5, 0.2, 0.2)
RATE = 0.03
THRESHOLD = 0.7
#: Distinct words that a task keeps gate inputs of; then it starts anew.
CACHE = 150_000
#: Windows that are run at a time.
CHUNK = 2048


class Rows:
    """Table rows of words: ``word`` and ``stem`` (n), and all ``chars`` with the ``starts`` and ``sizes`` of each word's."""

    def __init__(self, word: np.ndarray, stem: np.ndarray, chars: np.ndarray, sizes: np.ndarray):
        self.word, self.stem, self.chars, self.sizes = word, stem, chars, sizes.astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)

    @classmethod
    def of(cls, words: list[bytes]) -> Rows:
        """Hashed words, and the hashed trigrams of each word with its ends marked."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"^" + b"$^".join(words) + b"$\0\0", np.uint8).astype(np.uint32)
        hashed = (text[:-2] * np.uint32(0x9E3779B1) ^ text[1:-1] * np.uint32(0x85EBCA77) ^ text[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)
        ends = np.cumsum(sizes + 2)
        within = np.ones(len(hashed), bool)
        within[ends - 1] = within[ends - 2] = False
        of = lambda ws: np.fromiter(map(crc32, ws), np.int64, len(words)) % WORD_ROWS
        return cls(of(words), of([stem(w) for w in words]), (hashed[within] % CHAR_ROWS).astype(np.int64), sizes)

    def take(self, k: np.ndarray) -> Rows:
        sizes = self.sizes[k].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[k] - ends + sizes, sizes)
        return Rows(self.word[k], self.stem[k], self.chars[at], sizes)


def stem(word: bytes) -> bytes:
    return b"^" + word[:STEM]


def windows(n: int) -> np.ndarray:
    """Positions (k, WINDOW) of all windows over n words; -1 beyond the end. At least one."""
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE) if n > WINDOW else np.zeros(1, np.int64)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place."""
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row, as a table of n rows."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        key = rows[order]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        out[key[first]] = np.add.reduceat(np.take(values, order, axis=0), first, axis=0)
    return out


class Network:
    """Word and character embeddings, two gated recurrent layers, attention, one logit per window."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        h, e = HIDDEN, 3 * EMBED
        self.p = params or {
            "word": n(WORD_ROWS, EMBED, scale=0.1), "stem": n(WORD_ROWS, EMBED, scale=0.1), "char": n(CHAR_ROWS, EMBED, scale=0.1),
            "wx": n(2, e, 3 * h, scale=0.4), "u": n(2, h, 3 * h, scale=0.3), "b": np.zeros((2, 3 * h), np.float32),
            "a": n(2 * h, POOL, scale=0.4), "ab": np.zeros(POOL, np.float32), "v": n(POOL, scale=0.4), "o": n(2 * h, scale=0.4), "ob": np.zeros(1, np.float32),
        }

    def embed(self, words: Rows) -> np.ndarray:
        """Inputs of words: the embeddings of the word and of its stem, and the mean of its trigrams'."""
        if not len(words.word):
            return np.zeros((0, 3 * EMBED), np.float32)
        mean = np.add.reduceat(self.p["char"][words.chars], words.starts, axis=0) / words.sizes[:, None]
        return np.concatenate([self.p["word"][words.word], self.p["stem"][words.stem], mean], axis=1)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Gate inputs: update, reset and candidate of the one direction, then of the other.

        Each is contiguous; the last row, all zero, stands for no word.
        """
        out = []
        for d in (0, 1):
            g = x @ self.p["wx"][d] + self.p["b"][d]
            out += [np.concatenate([g[:, k * HIDDEN : (k + 1) * HIDDEN], np.zeros((1, HIDDEN), g.dtype)]) for k in range(3)]
        return out

    def forward(self, gates: list[np.ndarray], idx: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers (-1: none). ``keep``: also what the gradient needs."""
        n, h = len(idx), HIDDEN
        kind = gates[0].dtype
        steps = np.ascontiguousarray(idx.T)
        mask = (steps >= 0).astype(kind)
        steps = np.where(steps < 0, len(gates[0]) - 1, steps)
        full = mask.all(1)
        states = np.zeros((2, WINDOW, n, h), kind)
        memory: tuple[list, list] = ([], [])
        for d in (0, 1):
            s = np.zeros((n, h), kind)
            uz, ur, uc = (np.ascontiguousarray(self.p["u"][d][:, k * h : (k + 1) * h]) for k in range(3))
            gz, gr, gc = gates[3 * d : 3 * d + 3]
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                i = steps[t]
                z = logistic(np.take(gz, i, axis=0, mode="clip") + s @ uz)
                r = logistic(np.take(gr, i, axis=0, mode="clip") + s @ ur)
                su = s @ uc
                c = 2 * logistic(2 * (np.take(gc, i, axis=0, mode="clip") + r * su)) - 1
                step = z * (c - s)
                if not full[t]:
                    step *= mask[t][:, None]
                if keep:
                    memory[d].append((s, su, z, r, c))
                s = s + step
                states[d, t] = s
        pooled = np.tanh(states[0] @ self.p["a"][:h] + states[1] @ self.p["a"][h:] + self.p["ab"])
        e = (pooled @ self.p["v"]) + np.where(mask > 0, 0, -1e9).astype(kind)
        e -= e.max(0)
        w = np.exp(e) * mask
        w /= np.maximum(w.sum(0), 1e-9)
        rep = np.concatenate([(w[:, :, None] * states[d]).sum(0) for d in (0, 1)], axis=1)
        logit = rep @ self.p["o"] + self.p["ob"][0]
        return (logit, (mask, states, memory, pooled, w, rep)) if keep else logit

    def gradient(self, words: Rows, idx: np.ndarray, y: np.ndarray, keep: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss, back through both directions. ``keep``: factors of the inputs (dropout)."""
        x = self.embed(words)
        x = x if keep is None else x * keep
        gates = self.gates(x)
        logit, (mask, states, memory, pooled, w, rep) = self.forward(gates, idx, keep=True)
        p, h, n = self.p, HIDDEN, len(idx)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((sigmoid(logit) - y) / n).astype(logit.dtype)
        g["ob"][0] = dl.sum()
        g["o"] = rep.T @ dl
        drep = dl[:, None] * p["o"]
        both = np.concatenate([states[0], states[1]], axis=2)
        dw = np.einsum("nh,tnh->tn", drep, both)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tn,tnk->k", de, pooled)
        dpool = de[:, :, None] * p["v"] * (1 - pooled**2)
        g["a"] = both.reshape(-1, 2 * h).T @ dpool.reshape(-1, POOL)
        g["ab"] = dpool.sum((0, 1))
        dstates = w[:, :, None] * drep + dpool @ p["a"].T
        flat, dx = np.where(idx < 0, len(x), idx).T.ravel(), np.zeros_like(x)
        for d in (0, 1):
            u, ds = p["u"][d], np.zeros((n, h), logit.dtype)
            dgates = np.zeros((WINDOW, n, 3 * h), logit.dtype)
            order = range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1)
            for t, (s, su, z, r, c) in zip(reversed(order), reversed(memory[d]), strict=True):
                m = mask[t][:, None]
                ds = ds + dstates[t, :, d * h : (d + 1) * h]
                dc = ds * m * z * (1 - c**2)
                dz = ds * m * (c - s) * z * (1 - z)
                dr = dc * su * r * (1 - r)
                dsu = np.concatenate([dz, dr, dc * r], axis=1)
                g["u"][d] += s.T @ dsu
                dgates[t] = np.concatenate([dz, dr, dc], axis=1)
                ds = ds * (1 - m * z) + dsu @ u.T
            part = scatter(flat, dgates.reshape(-1, 3 * h), len(x) + 1)[:-1]
            g["wx"][d] = x.T @ part
            g["b"][d] = part.sum(0)
            dx += part @ p["wx"][d].T
        dx = dx if keep is None else dx * keep
        g["word"] = scatter(words.word, dx[:, :EMBED], WORD_ROWS)
        g["stem"] = scatter(words.stem, dx[:, EMBED : 2 * EMBED], WORD_ROWS)
        g["char"] = scatter(words.chars, np.repeat(dx[:, 2 * EMBED :] / words.sizes[:, None], words.sizes.astype(np.int64), axis=0), CHAR_ROWS)
        return g

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        return cls(dict(np.load(io.BytesIO(data))))


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Fits a network to labelled texts.

    A text is toxic if some window is: toxic texts train the window that scores
    highest so far (first, several at random), the others their highest and a
    random one. Adam, with everything seeded.
    """
    rng, net = np.random.default_rng(seed), Network(seed=seed)
    number: dict[bytes, int] = {}
    wins, owner, seen = [], [], {"word": np.zeros(WORD_ROWS, np.int64), "stem": np.zeros(WORD_ROWS, np.int64)}
    for k, t in enumerate(texts):
        own = set(t.lower().split())
        seen["word"][list({crc32(w) % WORD_ROWS for w in own})] += 1
        seen["stem"][list({crc32(stem(w)) % WORD_ROWS for w in own})] += 1
        ids = np.array([number.setdefault(w, len(number)) for w in t.lower().split()] or [-1], np.int64)
        at = windows(len(ids))
        wins.append(np.where(at >= 0, ids[at], -1))
        owner.append(np.full(len(at), k))
    wins, owner, y = np.concatenate(wins), np.concatenate(owner), np.array(labels, np.float32)
    words = Rows.of(list(number))
    often = {k: (n >= MIN_TEXTS).astype(np.float32)[:, None] for k, n in seen.items()}
    for k, keep in often.items():
        net.p[k] *= keep
    first = np.searchsorted(owner, np.arange(len(texts)))
    size = np.bincount(owner, minlength=len(texts))
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        noise = rng.random(len(wins))
        by = lambda score: np.lexsort((score, owner))[first + size - 1]  # noqa: E731  the last of each text
        if epoch < 3:
            rank = np.empty(len(wins), np.int64)
            rank[np.lexsort((noise, owner))] = np.arange(len(wins))
            chosen = np.nonzero(rank - first[owner] < 6)[0]
        else:
            gates = net.gates(net.embed(words))
            logit = np.concatenate([net.forward(gates, wins[lo : lo + CHUNK]) for lo in range(0, len(wins), CHUNK)])
            chosen = np.unique(np.concatenate([by(logit), by(noise)[y == 0]]))
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), 256):
            pick = chosen[lo : lo + 256]
            used, idx = np.unique(wins[pick], return_inverse=True)
            idx = idx.reshape(len(pick), WINDOW)
            if used[0] < 0:
                used, idx = used[1:], idx - 1
            kept = (rng.random((len(used), 3)) >= DROPOUT).astype(np.float32) / (1 - np.array(DROPOUT, np.float32))
            g = net.gradient(words.take(used), idx, y[owner[pick]], np.repeat(kept, EMBED, axis=1))
            for k, keep in often.items():
                g[k] *= keep
            step += 1
            rate = RATE * (0.15 if epoch > 0.7 * epochs else 1) / (1 + 0.1 * epoch)
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.001 * (v * v - m2[k])
                net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


class Numbers(dict):
    """Word to number in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.numbers, self.table = Numbers(), [np.zeros((1, HIDDEN), np.float32)] * 6

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The highest probability over all windows of each text."""
        if len(self.numbers) > CACHE:
            self.reset()
        old, look, wins, sizes = len(self.numbers), self.numbers.__getitem__, [], []
        for t in texts:
            ids = np.array(list(map(look, t.lower().split())) or [-1], np.int64)
            at = windows(len(ids))
            wins.append(np.where(at >= 0, ids[at], -1))
            sizes.append(len(at))
        fresh = list(self.numbers)[old:]
        if fresh:
            self.table = [np.concatenate([a[:-1], b]) for a, b in zip(self.table, self.net.gates(self.net.embed(Rows.of(fresh))), strict=True)]
        wins = np.concatenate(wins)
        logit = np.concatenate([self.net.forward(self.table, wins[lo : lo + CHUNK]) for lo in range(0, len(wins), CHUNK)])
        # Even odds, where the network decides, score the threshold.
        return sigmoid(np.maximum.reduceat(logit, np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(np.float64) + np.log(THRESHOLD / (1 - THRESHOLD)))


def _parts(b: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    n = max(1, min(b.num_rows, b.nbytes // size))
    for k in range(n):
        lo, hi = b.num_rows * k // n, b.num_rows * (k + 1) // n
        if hi > lo:
            yield b.slice(lo, hi - lo)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, fold: int = 1, folds: int = 3) -> bytes:
    """Parameters of a network fitted on up to ``max_rows`` training rows of each class.

    The rows are chosen by a seeded hash among all labels outside the fold; one
    task fits them, one text of each, so what it reads is bounded by the
    parameter. Documents with both labels are left out.
    """
    known = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where("of is not null and toxic in (0, 1)").where(F.crc32(F.col("of").cast("string")) % folds != fold)
    known = known.groupBy("of").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    pick = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("of", F.lit(9)), "of").limit(max_rows) for y in (0, 1)]
    chosen = F.broadcast(pick[0].union(pick[1]))  # 2 * max_rows rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(chosen, F.col("doc_id") == F.col("of"))
    rows = rows.groupBy("of", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(o, y, t) for b in batches for o, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit([r[2] for r in rows], [r[1] for r in rows]).save()], pa.binary())], ["net"])

    out = rows.repartition(1).mapInArrow(run, "net binary").collect()
    return bytes(out[0]["net"]) if out else Network().save()


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, from its whole text alone.

    Cases: null and empty texts are one empty window; a text of any length is
    scored in all its windows; a null id counts as the empty text in the fold;
    repeated rows stay; of several texts of one labelled id the least is learnt
    from; labels that are null, other than 0 and 1, contradictory or without a
    document are not used; without labels the scores are
    those of an untrained network; an empty table gives no rows; other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold=fold, folds=folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network.load(shared.value))
        for whole in batches:
            for b in _parts(whole):
                s = scorer.score([t or b"" for t in b.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
