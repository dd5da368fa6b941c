"""Helpers shared by the text operators: stage tables, hashing and components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of one row of a filter (what bitmap_construct_agg makes), and rows at most: 128 MB are broadcast.
BITMAP, BITMAPS = 32_768, 32_768
#: Rows from which a key may be joined by broadcast, and such keys at most.
HOT_ROWS, HOT_KEYS = 50_000, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master, whose executors are threads of the driver, may do
    without: it gets a temporary folder. A cluster without the setting raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    This cuts the lineage: a lost executor costs no more than the tasks it was
    running, and what is costly is computed once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a stage table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        drop_path(df.sparkSession, file.rsplit("/", 1)[0])


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_among(rows: DataFrame, by: list[str], table: DataFrame, keys: list[str], name: str = "maybe") -> DataFrame:
    """``rows`` with the column ``name``: whether ``table`` has their key; errs on the side of yes.

    The keys of ``table`` set bits of a filter of bounded size, which is
    broadcast, so rows that cannot match need not be shuffled for a join.
    """
    n = table.count()
    if not n:
        return rows.withColumn(name, F.lit(False))
    maps = min(BITMAPS, 1 + 16 * n // BITMAP)
    slot, at, bits = (fresh(c, rows) for c in ("slot", "map", "bits"))
    place = lambda key: F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)), F.lit(maps * BITMAP))
    filter_ = table.select(place(keys).alias(slot)).groupBy(F.floor(F.col(slot) / BITMAP).alias(at)).agg(F.bitmap_construct_agg(F.col(slot) % BITMAP).alias(bits))
    marked = rows.withColumn(slot, place(by)).withColumn(at, F.floor(F.col(slot) / BITMAP))
    marked = marked.join(F.broadcast(filter_), at, "left")  # BITMAPS rows of 4 KB at most
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(({slot} % {BITMAP}) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col(slot) % 8).cast("int")) > 0
    return marked.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))


def hot_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, a staged table of a row per key with ``n``, the rows that have it.

    Keys of very many rows are broadcast, at most HOT_KEYS of them, so that
    their rows stay where they are.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    if table.where(hot).isEmpty():
        return rows.join(table, key)
    heavy = F.broadcast(table.where(hot))
    cool = rows.join(heavy.select(key), key, "left_anti").join(table.where(~hot), key)
    return cool.unionByName(rows.join(heavy, key))


def words(text: Column) -> Column:
    """The runs of anything but white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as rows (node, component).

    The component is its smallest node. Large-star and small-star rounds: each
    is one aggregation and one join on the node, so no neighbour list is ever
    gathered; every round is written to the shared folder. Rounds grow with the
    logarithm of the longest path. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large.where("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = staged(small, "small")
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (now, large):
            drop_table(old)
        now = new
        if sums == state:
            return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = sums
