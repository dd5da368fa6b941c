"""Mixing sources to target weights: min-cost flow over membership patterns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, fresh, staged, words

#: Patterns up to which their plan is broadcast; beyond, Spark chooses the join.
FEW_PATTERNS = 100_000
#: Rows that the band is made for in which a quota ends, and bands of a pattern at most.
BAND_ROWS, MAX_BANDS = 1_000, 65_536
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words for each source: sources by code point, null last, take the weights in turn.

    All share ``share`` times all sizes; who would get over ``most`` times its
    size gets that, and the rest is shared again until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict[str | None, float], most: int = 2) -> dict[tuple, float]:
    """Min-cost flow: words that each membership pattern gives to the quotas of its sources.

    Each further pass over a pattern costs one more per word, so all patterns
    are used once before any is repeated, as far as quotas allow. Cheapest
    paths are augmented one after another (with undoing of earlier choices) in
    each connected part of the graph. Returns pattern -> words.
    """
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in patterns:
        for s in p:
            parent[find(("p", p))] = find(("s", s))
    parts: dict = {}
    for p in patterns:
        if p:
            parts.setdefault(find(("p", p)), []).append(p)
    out = dict.fromkeys(patterns, 0.0)
    for part in parts.values():
        flow = {(p, s): 0.0 for p in part for s in p}
        used, left = dict.fromkeys(part, 0.0), {s: quotas.get(s, 0.0) for p in part for s in p}
        at: dict = {}
        for p, s in flow:
            at.setdefault(s, []).append(p)
        # Only the passes over a pattern cost, the same for all patterns, so all paths of one pass come before those of the next.
        for level in range(1, most + 1):
            closed: set = set()  # patterns and sources from which no open source is reached any more in this pass
            for first in part:
                while first not in closed and (room := level * patterns[first] - used[first]) > 1e-6:
                    path = _path(first, left, flow, at, closed)
                    if path is None:
                        break
                    push = min([left[path[0][1]], room, *(flow[p, back] for p, _, back in path if back is not NONE)])
                    for p, s, back in path:
                        flow[p, s] += push
                        if back is not NONE:
                            flow[p, back] -= push
                    used[first] += push
                    left[path[0][1]] -= push
        out |= used
    return out


NONE = object()  # a source may be None


def _path(first: tuple, left: dict, flow: dict, at: dict, closed: set) -> list | None:
    """A path from a pattern to a source with room, as (pattern, source it gives more to, source it gives less to) from its end; else closes all it saw."""
    came_p, came_s, queue = {first: NONE}, {}, [first]
    for p in queue:
        for s in p:
            if s in came_s or ("s", s) in closed:
                continue
            came_s[s] = p
            if left[s] > 1e-6:
                path = []
                while s is not NONE:
                    p = came_s[s]
                    path.append((p, s, came_p[p]))
                    s = came_p[p]
                return path
            for q in at[s]:
                if q not in came_p and q not in closed and flow[q, s] > 1e-6:
                    came_p[q] = s
                    queue.append(q)
    closed |= set(queue) | {("s", s) for s in came_s}
    return None


def _rows(docs: DataFrame, seed: int, members: str | None) -> tuple[Column, Column, Column]:
    """Columns of a document: its size, its pattern and its place in the seeded order.

    The pattern is JSON of an array in an array, as to_json drops null fields, not null items.
    """
    member = F.sort_array(F.array_distinct(F.coalesce(F.col(members), F.array().cast("array<string>")))) if members else F.array(F.col("source"))
    return F.size(words(F.col("text"))).cast("long"), F.to_json(F.array(member)), F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))


def _decide(rows: DataFrame, quotas: dict | None, most: int) -> tuple[DataFrame, DataFrame]:
    """What is taken of ``rows`` (doc_id, size, pattern, key, n: so many equal rows).

    Returns a row per pattern (pattern, passes, n_bands, source_size, target,
    end_band, rest): rows of bands before ``end_band`` get one pass more. And
    the rows of the end bands with ``more``, of how many of the n rows one pass
    more is taken.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("pattern").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()  # a row per pattern
    by_text = {r["pattern"]: tuple(json.loads(r["pattern"])[0]) for r in sums}
    sizes = {by_text[r["pattern"]]: r["size"] for r in sums}
    source_size: dict = {}
    for p, n in sizes.items():
        for s in p:
            source_size[s] = source_size.get(s, 0) + n
    goal = quotas or targets(source_size)
    flow = route({p: n for p, n in sizes.items() if n}, goal, most)
    plan = []
    for r in sums:
        p, size = by_text[r["pattern"]], r["size"]
        words_ = flow.get(p, 0.0)
        passes = min(most, int((words_ + 1e-6) // size)) if size else 0
        need = words_ - passes * size if passes < most else 0.0
        if size and need > size - 0.5:  # nearer to the whole pass than to any part of it
            passes, need = passes + 1, 0.0
        plan.append((r["pattern"], passes, need if need >= 0.5 else 0.0, min(MAX_BANDS, max(1, r["n"] // BAND_ROWS)), size if len(p) == 1 else sum(source_size[s] for s in p), float(sum(goal.get(s, 0.0) for s in p))))
    plan_df = spark.createDataFrame(plan, "pattern string, passes long, need double, n_bands long, source_size long, target double")
    hint = F.broadcast if len(plan) <= FEW_PATTERNS else lambda df: df
    banded = rows.join(hint(plan_df), "pattern").withColumn("band", F.pmod("key", F.col("n_bands")))
    bands = banded.where("need > 0").groupBy("pattern", "band").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("need").alias("need"))
    bands = bands.withColumn("until", F.sum("words").over(Window.partitionBy("pattern").orderBy("band")))  # MAX_BANDS rows at most
    ends = bands.where((F.col("until") > F.col("need")) & (F.col("until") - F.col("words") <= F.col("need"))).select("pattern", F.col("band").alias("end_band"), (F.col("need") - F.col("until") + F.col("words")).alias("rest"))
    ends = staged(plan_df.join(hint(ends), "pattern", "left"), "ends")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id", "size"])
        rest, more = float(pdf["rest"].iloc[0]), []
        for size, n in zip(pdf["size"], pdf["n"], strict=True):
            take = min(n, int(rest // size)) if size else 0
            rest -= take * size
            more.append(take)
        # The least document not taken, if with it the sum comes nearer.
        over = [(size, i) for i, (size, n, k) in enumerate(zip(pdf["size"], pdf["n"], more, strict=True)) if size and k < n]
        if over and min(over)[0] - rest < rest:
            more[min(over)[1]] += 1
        return pdf.assign(more=more)[["pattern", "doc_id", "size", "key", "n", "passes", "source_size", "target", "more"]]

    at_end = rows.join(hint(ends.where("end_band is not null")), "pattern").where(F.pmod("key", F.col("n_bands")) == F.col("end_band"))
    schema = "pattern string, doc_id long, size long, key long, n long, passes long, source_size long, target double, more long"
    part = at_end.select("pattern", "doc_id", "size", "key", "n", "passes", "source_size", "target", "rest").groupBy("pattern").applyInPandas(fill, schema)
    return ends, staged(part, "end_rows")


def mix(docs: DataFrame, seed: int = 11, members: str | None = None, quotas: dict | None = None, most: int = 2) -> DataFrame:
    """Each row of ``docs`` with the words that the mix takes of it.

    Documents are aggregated by membership pattern (``members``: an array
    column; else the one source), ``route`` gives each pattern its words, and
    documents are chosen in the order of a seeded hash: whole passes first, then
    hash bands, and in the band where the quota ends the rows that still fit.
    Only sums by pattern reach the driver. Returns doc_id, size, source_size,
    target, taken and ``pattern``.

    Cases: a null source is a source of its own, last in order; null texts have
    size 0 and nothing is taken of them; equal rows of one doc_id are counted
    first and each taken by itself; ties in the order of the hash go by doc_id,
    then size; a text of any length is one size; an empty table gives no rows;
    other columns are not read.
    """
    size, pattern, key = _rows(docs, seed, members)
    rows = docs.select(F.col("doc_id").cast("long"), size.alias("size"), pattern.alias("pattern"), key.alias("key")).groupBy("doc_id", "size", "pattern", "key").agg(F.count("*").alias("n"))
    rows = staged(rows, "sizes")
    ends, part = _decide(rows, quotas, most)
    hint = F.broadcast if ends.count() <= FEW_PATTERNS else lambda df: df
    band = F.pmod("key", F.col("n_bands"))
    whole = rows.join(hint(ends), "pattern").where(F.col("end_band").isNull() | (band != F.col("end_band")))
    whole = whole.withColumn("times", F.struct("n", (F.col("passes") + F.coalesce((band < F.col("end_band")).cast("long"), F.lit(0))).alias("reps")))
    split = F.explode(F.array(F.struct(F.col("more").alias("n"), (F.col("passes") + 1).alias("reps")), F.struct((F.col("n") - F.col("more")).alias("n"), F.col("passes").alias("reps"))))
    cols = ["doc_id", "size", "source_size", "target", "times", "pattern"]
    out = whole.select(cols).union(part.withColumn("times", split).select(cols)).where("times.n > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times.n"))))
    return out.select("doc_id", "size", "source_size", "target", F.col("times.reps").alias("reps"), "pattern", (F.col("size") * F.col("times.reps")).alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 11, members: str | None = None, quotas: dict | None = None, most: int = 2) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them.

    Only the rows of the bands in which quotas end are joined; of the others the
    band decides where they are read. Equal rows of one doc_id in an end band
    are taken from the least of them.
    """
    of = {c: fresh(c, docs) for c in ("pattern", "key", "n", "passes", "n_bands", "end_band", "more", "reps", "size", "of_key", "of_id")}
    size, pattern, key = _rows(docs, seed, members)
    rows = docs.select(F.col("doc_id").cast("long"), size.alias("size"), pattern.alias("pattern"), key.alias("key")).groupBy("doc_id", "size", "pattern", "key").agg(F.count("*").alias("n"))
    ends, part = _decide(staged(rows, "sizes"), quotas, most)
    hint = F.broadcast if ends.count() <= FEW_PATTERNS else lambda df: df
    plan = ends.select(*(F.col(c).alias(of[c]) for c in ("pattern", "passes", "n_bands", "end_band")))
    keyed = docs.withColumn(of["pattern"], pattern).withColumn(of["key"], key).join(hint(plan), of["pattern"])
    band = F.pmod(of["key"], F.col(of["n_bands"]))
    here = F.col(of["end_band"]).isNotNull() & (band == F.col(of["end_band"]))
    whole = keyed.where(~here).withColumn(of["reps"], F.col(of["passes"]) + F.coalesce((band < F.col(of["end_band"])).cast("long"), F.lit(0)))
    chosen = part.select(F.col("key").alias(of["of_key"]), F.col("doc_id").alias(of["of_id"]), F.col("pattern").alias(of["size"]), (F.col("n") * F.col("passes") + F.col("more")).alias(of["reps"]))
    once = keyed.where(here).groupBy(of["pattern"], of["key"], F.col("doc_id").cast("long").alias(of["n"])).agg(F.min(F.struct(*docs.columns)).alias(of["more"]))
    once = once.join(chosen, (once[of["key"]] == chosen[of["of_key"]]) & (once[of["pattern"]] == chosen[of["size"]]) & once[of["n"]].eqNullSafe(chosen[of["of_id"]]))
    some = once.select(*(F.col(of["more"])[c].alias(c) for c in docs.columns), of["reps"])
    out = whole.select(*docs.columns, of["reps"]).union(some).where(F.col(of["reps"]) > 0)
    return out.withColumn(of["reps"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(of["reps"])))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
