"""Filter interaction audit: a histogram of failure masks, from which every order of the filters is read off."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, words

#: The filters; the bit of filter k in a mask is 1 << k.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Orders of the filters, and the orders in which a given one of k filters is the first of them.
ORDERS = 120


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D, which the text alone decides."""
    ws = words(text)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [
        F.size(ws) < MIN_WORDS,
        100 * F.size(F.array_distinct(ws)) < MIN_DISTINCT_PERCENT * F.size(ws),
        100 * upper > MAX_UPPER_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row per part and mask that occurs: ``n`` documents, ``good`` and ``toxic`` ones among them.

    Texts are told apart by SHA-256, so they are not shuffled themselves. Rows
    are summed up by text, part and labels before the least doc_id of a text
    meets them: copies of one text are one row then for each part and label.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("key"), text_mask(text).alias("mask"), F.coalesce(part, F.lit("")).alias("part"))
    rows = rows.groupBy("doc_id", "key", "mask", "part").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    # Rows without an id have no labels; they all would meet in one task of the join.
    named = rows.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("of"), "left").select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    rows = named.union(rows.where("doc_id is null").select(*rows.columns, F.lit(False), F.lit(False)))
    kinds = rows.groupBy("key", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    firsts = kinds.groupBy(F.col("key").alias("of")).agg(F.min("least.doc_id").alias("first"))
    kinds = kinds.join(firsts, F.col("key") == F.col("of"))
    # Neither the least id's rows nor those without an id repeat a smaller one.
    fresh = F.col("n_null") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), fresh.alias("k")), F.struct((F.col("mask") + e).alias("m"), (F.col("n") - fresh).alias("k"))))
    counted = kinds.select("part", "good", "toxic", both.alias("x")).where("x.k > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("x.k")).otherwise(0)).alias(c)
    return counted.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.k").alias("n"), of("good"), of("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, bit of its filter, bits of the filters before it: 600 rows."""
    out = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [("".join(order), k + 1, bit, sum(bits[:k])) for k, bit in enumerate(bits)]
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, order of the five filters and step: what the step keeps, removes and loses.

    One pass builds the masks; the (at most 32) cells of a part are gathered in
    one row, and all 120 orders are read off them. ``shapley`` sums a filter's
    removals over all orders: a document that fails k filters is removed by
    each of them in 120 / k orders.
    Cases: a null text is empty, and equal to an empty one; a null part is the
    empty string; rows without an id are never repeats, have no labels, and do
    not count as anyone's smaller id; repeated rows of one id are documents
    each, none the repeat of the other; ids with several labels count as good
    or toxic if one label says so; texts of any length are read whole; an empty
    table has no parts, hence no rows; other columns are not read.
    """
    own = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    every = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, k, bit, before in steps()))
    rows = own.select("part", "cells", F.explode(every).alias("s")).select("part", "cells", "s.*")

    def total(where, what="n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c["mask"]), c[what]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) > 0
    passed = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & passed(m)
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["mask"]), c["n"] * F.expr(f"{ORDERS}L") / F.bit_count(c["mask"])).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & passed(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
