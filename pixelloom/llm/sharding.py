"""Sharding by balanced label propagation, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import documents, drop_table, staged

#: Rows that one window partition of the slot numbering is made for.
RANK_ROWS = 20_000
#: Hash bands of each size of group in which moves are let in until a shard's quota is reached.
BANDS = 64
#: A cell holds this part of a quota at most; larger groups are split into several.
PARTS = 256


def _wanted() -> Column:
    """The shards (shard, room) that a group should stand in, from ``at`` (shard, here, room) and ``all`` its rows.

    One shard, if one can hold the group: that with most of its members. Else so
    many of those with most members as can hold it.
    """
    order = F.sort_array(F.transform("at", lambda x: F.struct((x["here"] + x["room"] < F.col("all")).alias("partly"), (-x["here"]).alias("less"), F.xxhash64("g1", x["shard"]).alias("tie"), x["shard"].alias("shard"), x["room"].alias("room"))))
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<shard:int,room:bigint>>").alias("to"))
    more = lambda acc, x: F.struct((acc["sum"] - x["less"] + x["room"]).alias("sum"), F.concat(acc["to"], F.array(F.struct(x["shard"].alias("shard"), x["room"].alias("room")))).alias("to"))
    return F.aggregate(order, none, lambda acc, x: F.when(acc["sum"] < F.col("all"), more(acc, x)).otherwise(acc))["to"]


def propagate(cells: DataFrame, n_shards: int, quota: int, rounds: int) -> DataFrame:
    """Moves the cells of linked documents towards their neighbours' shards.

    ``cells`` (g1, g2, sub, origin, n): n documents of a group, begun in shard
    ``origin``. In each round every group looks for the shard with most of its
    members that has room for it, or for several if none has; cells in other
    shards ask to move there.
    Requests are let in while the quota holds: those of small groups first, and
    within a size in hash bands that are ordered anew each round. A hot group
    stands in many small cells, which take what room is left and keep none out.
    """
    now = staged(cells.withColumn("shard", F.col("origin")), "cells")
    spark = cells.sparkSession
    shards = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    for k in range(rounds):
        loads = shards.join(now.groupBy("shard").agg(F.sum("n").alias("load")), "shard", "left").select("shard", (F.lit(quota) - F.coalesce("load", F.lit(0))).alias("room"))
        here = now.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("here"))
        groups = here.join(F.broadcast(loads), "shard").groupBy("g1", "g2").agg(F.collect_list(F.struct("shard", "here", F.greatest("room", F.lit(0)).alias("room"))).alias("at"), F.sum("here").alias("all")).where(F.size("at") > 1)  # n_shards rows
        groups = groups.withColumn("wanted", _wanted()).select("g1", "g2", "all", "wanted", F.aggregate("wanted", F.lit(0).cast("long"), lambda n, x: n + x["room"]).alias("open"))
        want = now.join(groups, ["g1", "g2"], "left").withColumn("band", F.floor(F.log2("all")).cast("int") * BANDS + F.pmod(F.xxhash64("g1", "g2", "sub", F.lit(k)), F.lit(BANDS)).cast("int"))
        at = F.pmod(F.xxhash64("g1", "g2", "sub", "origin", F.lit(k)), F.col("open"))
        none = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("shard"))
        pick = F.aggregate("wanted", none, lambda acc, x: F.struct((acc["sum"] + x["room"]).alias("sum"), F.when(acc["shard"].isNull() & (at < acc["sum"] + x["room"]), x["shard"]).otherwise(acc["shard"]).alias("shard")))["shard"]
        want = want.withColumn("target", F.when(F.col("wanted").isNotNull() & (F.col("open") > 0) & ~F.array_contains("wanted.shard", F.col("shard")), pick)).drop("wanted", "open")
        bands = want.where("target is not null").groupBy("target", "band").agg(F.sum("n").alias("n"))
        bands = bands.withColumn("so_far", F.sum("n").over(Window.partitionBy("target").orderBy("band")))  # 64 * BANDS rows at most
        let_in = bands.join(F.broadcast(loads), bands["target"] == loads["shard"]).where("so_far <= room").select(F.col("target").alias("t"), F.col("band").alias("b"), F.lit(True).alias("ok"))
        moved = want.join(F.broadcast(let_in), (want["target"] == let_in["t"]) & (want["band"] == let_in["b"]), "left")  # n_shards * 64 * BANDS rows at most
        ok = F.coalesce("ok", F.lit(False))
        new = staged(moved.select("g1", "g2", "sub", "origin", "n", F.when(ok, F.col("target")).otherwise(F.col("shard")).alias("shard"), ok.alias("moved")), "cells")
        n_moved = new.where("moved").count()
        drop_table(now)
        now = new.drop("moved")
        if not n_moved:
            break
    return now


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Replaces ``nth``, the place in the input, by a number among the rows of equal id and text (0 if there is one).

    Such rows are told apart by nothing else, so it does not matter which gets
    which number: the result does not depend on how the input is split. Rows of
    one kind are counted in bands, so that many of them are many tasks' work.
    """
    keys = ["doc_id", "g1", "g2"]
    again = rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1").toDF("k_id", "k1", "k2", "copies")
    same = rows["doc_id"].eqNullSafe(F.col("k_id")) & (F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2"))
    rows = rows.join(again, same, "left").drop("k_id", "k1", "k2")
    single = rows.where("copies is null").drop("copies").withColumn("nth", F.lit(0).cast("long"))
    many = rows.where("copies is not null").withColumn("band", F.pmod(F.xxhash64("nth"), F.floor(F.col("copies") / RANK_ROWS) + 1))
    sizes = many.groupBy(*keys, "band").agg(F.count("*").alias("n"))
    sizes = sizes.select(*(F.col(c).alias(f"s_{c}") for c in (*keys, "band")), (F.sum("n").over(Window.partitionBy(*keys).orderBy("band")) - F.col("n")).alias("before"))
    many = many.withColumn("in_band", F.row_number().over(Window.partitionBy(*keys, "band").orderBy("nth")) - 1)
    many = many.join(sizes, [many[c].eqNullSafe(sizes[f"s_{c}"]) for c in (*keys, "band")])
    return single.unionByName(many.withColumn("nth", F.col("before") + F.col("in_band")).select(*single.columns))


def shard(docs: DataFrame, n_shards: int = 8, rounds: int = 5) -> DataFrame:
    """Puts the rows of ``docs`` into shards whose row counts differ by one at most.

    Rows start in the shard of their hash. Documents of equal text are linked:
    ``propagate`` brings groups together under the quota of a shard. Then each
    shard gives its surplus, unlinked rows first, to those that lack rows.
    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law
    (``rows``), shard, slot (gapless from 0 in the shard), grown_shard (null).

    Cases: a null text has no bytes and equals the empty text; rows without an
    id and repeated rows are rows like others, equal ones in any order; the
    result does not depend on how the input is split; of shards with equally many members a hash takes one; a group
    larger than a shard fills several; texts of any length are read whole, for
    size and hash alone; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(text, F.lit(1)).alias("g2"), F.monotonically_increasing_id().alias("nth"))
    first = staged(rows, "read")
    rows = numbered_copies(first)
    rows = staged(rows.withColumn("origin", F.pmod(F.xxhash64("doc_id", "g1", "nth"), F.lit(n_shards)).cast("int")), "rows")
    drop_table(first)
    total = rows.count()
    quota = total // n_shards
    unit = max(1, quota // PARTS)
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("all")).where("all > 1")
    large = groups.where(F.col("all") > max(unit, n_shards)).select("g1", "g2", F.ceil(F.col("all") / (unit * n_shards)).alias("subs"))
    sub = F.pmod(F.xxhash64("doc_id", "nth", F.lit(3)), F.coalesce("subs", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(large), ["g1", "g2"], "left").withColumn("sub", sub).drop("subs")  # n_shards * PARTS rows at most
    cells = rows.groupBy("g1", "g2", "sub", "origin").agg(F.count("*").alias("n"))
    cells = propagate(cells.join(groups, ["g1", "g2"], "left_semi"), n_shards, quota, rounds)
    rows = rows.join(cells.select("g1", "g2", "sub", "origin", F.col("shard").alias("label")), ["g1", "g2", "sub", "origin"], "left")
    rows = rows.select("doc_id", "size", "text_crc32", "g1", "g2", "nth", F.coalesce("label", "origin").alias("label"), F.col("label").isNull().cast("int").alias("single"))
    band = F.pmod(F.xxhash64("doc_id", "g1", "nth", F.lit(7)), F.lit(max(1, total // n_shards // RANK_ROWS))).cast("int")
    rows = staged(rows.withColumn("band", band), "labels")
    bands = rows.groupBy("label", "single", "band").agg(F.count("*").alias("n"))
    bands = bands.select("label", "single", "band", (F.sum("n").over(Window.partitionBy("label").orderBy("single", "band")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("in_band", F.row_number().over(Window.partitionBy("label", "single", "band").orderBy("doc_id", "g1", "g2", "nth")) - 1)
    ranked = ranked.join(bands, ["label", "single", "band"]).withColumn("rank", F.col("before") + F.col("in_band"))
    counts = dict(rows.groupBy("label").count().collect())  # n_shards rows
    shard_, slot = _spread(counts, total, n_shards)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard_.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _spread(counts: dict[int, int], total: int, n_shards: int) -> tuple[Column, Column]:
    """Columns for the final shard and slot from ``label`` and ``rank``.

    Of a label's rows the first ``own`` stay; the others are numbered through all
    labels, and that number falls into the gap of one shard.
    """
    large = sorted(range(n_shards), key=lambda s: (-counts.get(s, 0), s))[: total % n_shards]
    own = {s: total // n_shards + (s in large) for s in range(n_shards)}
    surplus, gaps = {}, []
    n = m = 0
    for s in range(n_shards):
        have = counts.get(s, 0)
        surplus[s] = n
        n += max(0, have - own[s])
        if have < own[s]:
            gaps.append((m, m + own[s] - have, s, have))
            m += own[s] - have
    pick = lambda values: reduce(lambda c, kv: c.when(F.col("label") == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(0)))
    over = F.col("rank") - pick(own) + pick(surplus)
    to_shard, to_slot = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0))
    for lo, hi, s, have in gaps:
        to_shard = to_shard.when(over < hi, F.lit(s))
        to_slot = to_slot.when(over < hi, over - lo + have)
    stays = F.col("rank") < pick(own)
    return F.when(stays, F.col("label")).otherwise(to_shard), F.when(stays, F.col("rank")).otherwise(to_slot)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
