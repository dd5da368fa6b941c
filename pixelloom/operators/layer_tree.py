"""Layer trees of many documents as one table, changed and read in bulk.

A row is a layer: doc, id (of its document), parent (id of its group, null at
the root), z (0...n-1 from below among its siblings), name, kind, and further
properties. Changes take tables of targets, so any number of documents is
changed by joins on doc; siblings are the largest window partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pixelloom.operators.staging import cut

COLUMNS = ("doc", "id", "parent", "z", "name", "kind", "visible", "expanded", "clipped", "opacity", "source")


def _siblings() -> WindowSpec:
    return Window.partitionBy("doc", "parent")


def _numbered(layers: DataFrame, *order: Column) -> DataFrame:
    """Siblings numbered anew."""
    return layers.withColumn("z", (F.row_number().over(_siblings().orderBy(*order)) - 1).cast("long")).select(*COLUMNS)


def _marked(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``hit``, and what else the targets (doc, id) say."""
    return layers.join(targets.withColumn("hit", F.lit(True)), ["doc", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def paths(layers: DataFrame, **marks: Column) -> DataFrame:
    """Adds ``path``, the places from the root down, and for each mark whether a group around a layer has it.

    One join a level of nesting, from the root; each level is written down, so
    it is made once. Layers that no root leads to are left out.
    """
    rows = layers.withColumns({f"own_{m}": c for m, c in marks.items()})
    level = rows.where("parent is null").withColumns({"path": F.array("z")} | {m: F.lit(False) for m in marks})
    levels = []
    while True:
        level = cut(level)
        levels.append(level)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).drop(*(f"own_{m}" for m in marks))
        up = level.where("kind = 'group'").select("doc", F.col("id").alias("parent"), F.col("path").alias("p"), *((F.col(m) | F.col(f"own_{m}")).alias(f"p_{m}") for m in marks))
        level = rows.join(up, ["doc", "parent"]).select(*rows.columns, F.concat("p", F.array("z")).alias("path"), *(F.col(f"p_{m}").alias(m) for m in marks))


def walk(layers: DataFrame) -> DataFrame:
    """(doc, id, depth, place): depth first from below, each group before what it holds."""
    at = paths(layers)
    return at.select("doc", "id", (F.size("path") - 1).cast("long").alias("depth"), (F.row_number().over(Window.partitionBy("doc").orderBy("path")) - 1).cast("long").alias("place"))


def panel(layers: DataFrame) -> DataFrame:
    """(doc, id, depth, place) from above, without what closed groups hold."""
    at = paths(layers, shut=~F.col("expanded")).where("not shut")
    order = Window.partitionBy("doc").orderBy(F.transform("path", lambda z: -z))
    return at.select("doc", "id", (F.size("path") - 1).cast("long").alias("depth"), (F.row_number().over(order) - 1).cast("long").alias("place"))


def counts(layers: DataFrame) -> DataFrame:
    """(doc, layers, groups, visible, sources): sizes of trees; ``sources`` are shared contents used more than once."""
    shared = layers.where("source is not null").groupBy("doc", "source").agg(F.count("*").alias("n")).where("n > 1").groupBy("doc").agg(F.count("*").alias("sources"))
    of = layers.groupBy("doc").agg(F.count("*").alias("layers"), F.count_if(F.col("kind") == "group").alias("groups"), F.count_if("visible").alias("visible"))
    return of.join(shared, "doc", "left").select("doc", "layers", "groups", "visible", F.coalesce("sources", F.lit(0)).alias("sources"))


def instances(layers: DataFrame) -> DataFrame:
    return layers.where("source is not null").groupBy("doc", "source").agg(F.count("*").alias("n"))


def deleted(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """Without the targets and what they hold; those left close the gaps."""
    at = paths(_marked(layers, targets), gone=F.col("hit"))
    return _numbered(at.where("not gone and not hit"), F.col("z"))


def updated(layers: DataFrame, targets: DataFrame, **values: Column) -> DataFrame:
    """New properties for the targets."""
    at = _marked(layers, targets)
    return at.select(*(F.when(F.col("hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in COLUMNS))


def clipped(layers: DataFrame, targets: DataFrame, on: bool = True) -> DataFrame:
    """Clips the targets to the layer below; the lowest of its siblings has none."""
    at = _marked(layers, targets)
    to = F.when(F.col("hit") & ((F.col("z") > 0) | F.lit(not on)), F.lit(on)).otherwise(F.col("clipped"))
    return at.withColumn("clipped", to).select(*COLUMNS)


def inserted(layers: DataFrame, new: DataFrame, above: bool = True) -> DataFrame:
    """``new`` layers (the columns but parent and z, and ``beside``, an id) above or below that layer; at the top where it is null."""
    beside = layers.select("doc", F.col("id").alias("beside"), F.col("parent").alias("b_parent"), F.col("z").alias("b_z"))
    at = new.join(beside, ["doc", "beside"], "left")
    own = [c for c in COLUMNS if c not in ("parent", "z")]
    made = at.select(*own, F.col("b_parent").alias("parent"), F.coalesce("b_z", F.lit(1 << 40)).cast("double").alias("at"), F.lit(1 if above else -1).alias("side"))
    old = layers.select(*own, "parent", F.col("z").cast("double").alias("at"), F.lit(0).alias("side"))
    return _numbered(old.unionByName(made).withColumn("z", F.lit(0)), F.col("at"), F.col("side"), F.col("id"))


def duplicated(layers: DataFrame, targets: DataFrame, first_id: int) -> DataFrame:
    """Copies above the targets, with all they hold; ids of copies are the old ones from ``first_id`` on, names get ``copy``."""
    inside = paths(_marked(layers, targets), within=F.col("hit")).withColumnRenamed("hit", "top").where("top or within")
    copies = inside.select("doc", (F.col("id") + first_id).alias("id"), F.when(F.col("top"), F.col("parent")).otherwise(F.col("parent") + first_id).alias("parent"), (F.col("z") + F.when(F.col("top"), 0.5).otherwise(0.0)).alias("z"), F.when(F.col("top"), F.concat("name", F.lit(" copy"))).otherwise(F.col("name")).alias("name"), *COLUMNS[5:])
    return _numbered(layers.select(*COLUMNS).withColumn("z", F.col("z").cast("double")).unionByName(copies), F.col("z"))


def reordered(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """Moves targets (doc, id, delta) among their siblings, as far as there are any; one target for each set of siblings."""
    at = _marked(layers, targets)
    at = at.withColumns({"from": F.max(F.when(F.col("hit"), F.col("z"))).over(_siblings()), "by": F.max("delta").over(_siblings()), "last": F.max("z").over(_siblings())})
    at = at.withColumn("to", F.greatest(F.lit(0), F.least(F.col("last"), F.col("from") + F.col("by"))))
    z = F.when(F.col("to").isNull(), F.col("z")).when(F.col("hit"), F.col("to")).when((F.col("z") > F.col("from")) & (F.col("z") <= F.col("to")), F.col("z") - 1).when((F.col("z") < F.col("from")) & (F.col("z") >= F.col("to")), F.col("z") + 1).otherwise(F.col("z"))
    return at.withColumn("z", z.cast("long")).select(*COLUMNS)


def grouped(layers: DataFrame, targets: DataFrame, new_id: int, name: str = "Group") -> DataFrame:
    """The targets of each document put into one new group, in their order, where the topmost was. They must be siblings; other documents stay."""
    at = _marked(layers, targets)
    of = at.where("hit").groupBy("doc").agg(F.countDistinct(F.coalesce("parent", F.lit(-1))).alias("n"), F.first("parent").alias("g_parent"), F.max("z").alias("top")).where("n = 1").drop("n")
    at = at.join(of.withColumn("made", F.lit(True)), "doc", "left")
    inside = F.col("hit") & F.coalesce("made", F.lit(False))
    moved = at.select("doc", "id", F.when(inside, F.lit(new_id).cast("long")).otherwise(F.col("parent")).alias("parent"), *COLUMNS[3:])
    group = of.select("doc", F.lit(new_id).cast("long").alias("id"), F.col("g_parent").alias("parent"), F.col("top").alias("z"), F.lit(name).alias("name"), F.lit("group").alias("kind"), F.lit(True).alias("visible"), F.lit(True).alias("expanded"), F.lit(False).alias("clipped"), F.lit(1.0).alias("opacity"), F.lit(None).cast("long").alias("source"))
    return _numbered(moved.unionByName(group), F.col("z"))


def ungrouped(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """Target groups replaced by what they hold."""
    gone = _marked(layers, targets).where("hit and kind = 'group'").select(F.col("doc").alias("g_doc"), F.col("id").alias("g_id"), F.col("parent").alias("g_parent"), F.col("z").alias("g_z"))
    at = layers.join(gone.select(F.col("g_doc").alias("doc"), F.col("g_id").alias("id")), ["doc", "id"], "left_anti")
    at = at.join(gone, (F.col("doc") == F.col("g_doc")) & (F.col("parent") == F.col("g_id")), "left")
    out = F.col("g_id").isNotNull()
    at = at.withColumns({"parent": F.when(out, F.col("g_parent")).otherwise(F.col("parent")), "first": F.when(out, F.col("g_z")).otherwise(F.col("z")), "second": F.when(out, F.col("z")).otherwise(F.lit(0))})
    return _numbered(at, F.col("first"), F.col("second"))


def next_names(layers: DataFrame, base: str) -> DataFrame:
    """(doc, name): ``base`` with the number after the highest that is used."""
    n = F.regexp_extract("name", f"^\\Q{base}\\E ([0-9]+)$", 1)
    return layers.groupBy("doc").agg(F.concat(F.lit(base + " "), (F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)) + 1).cast("string")).alias("name"))
