"""Rasters as relations (x, y, r, g, b, a: long, straight 8-bit values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 100


def event_pixels(events: DataFrame, *more: str) -> DataFrame:
    """One pixel an event, WIDTH pixels a row; errors are transparent."""
    return events.select(
        *more, (F.col("event_id") % WIDTH).alias("x"), F.floor(F.col("event_id") / WIDTH).alias("y"),
        (F.floor("value") % 256).alias("r"), (F.col("user_id") * 37 % 256).alias("g"), (F.col("event_id") * 11 % 256).alias("b"),
        F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 128).otherwise(255).cast("long").alias("a"),
    )


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background raster."""
    return event_pixels(spark.read.parquet(f"{sf_dir}/events.parquet"))


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer raster, taller than the background."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        (F.col("o_orderkey") % WIDTH).alias("x"), F.floor(F.col("o_orderkey") / WIDTH).alias("y"),
        (F.floor("o_totalprice") % 256).alias("r"), (F.floor(F.col("o_totalprice") / 256) % 256).alias("g"), (F.col("o_custkey") * 37 % 256).alias("b"),
        F.when(F.col("o_orderstatus") == "P", 128).otherwise(255).cast("long").alias("a"),
    )


def wide_raster(spark: SparkSession, sf_dir: str, width: int = 750) -> DataFrame:
    """The orders again, ``width`` pixels a row: wider than two tiles."""
    at = F.col("y") * WIDTH + F.col("x")
    return orders_raster(spark, sf_dir).select((at % width).alias("x"), F.floor(at / width).alias("y"), "r", "g", "b", "a")


def sparse_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents (doc) of the events, in strips of 20 rows; pixels of errors are absent."""
    px = events_raster(spark, sf_dir).where("a <> 0")
    strip = F.floor(F.col("y") / 20)
    return px.select((strip % 2).alias("doc"), "x", (F.floor(strip / 2) * 20 + F.col("y") % 20).alias("y"), "r", "g", "b", "a")


def layer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region: its nations are groups, its customers their layers."""
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    place = lambda by, order: (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("long")
    groups = nation.select(
        F.col("n_regionkey").cast("long").alias("doc"), F.col("n_nationkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), place("n_regionkey", "n_nationkey").alias("z"), F.concat(F.lit("Group "), F.col("n_nationkey").cast("string")).alias("name"),
        F.lit("group").alias("kind"), F.lit(True).alias("visible"), (F.col("n_nationkey") % 4 != 0).alias("expanded"), F.lit(False).alias("clipped"), F.lit(1.0).alias("opacity"), F.lit(None).cast("long").alias("source"),
    )
    layers = customer.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"]).select(  # nations are few by definition
        F.col("n_regionkey").cast("long").alias("doc"), (F.col("c_custkey") + 1000).cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("parent"), place("c_nationkey", "c_custkey").alias("z"), F.concat(F.lit("Layer "), F.col("c_custkey").cast("string")).alias("name"),
        F.lit("pixel").alias("kind"), (F.col("c_acctbal") > 0).alias("visible"), F.lit(False).alias("expanded"), F.lit(False).alias("clipped"), F.lit(0.5).alias("opacity"), (F.col("c_custkey") % 7).cast("long").alias("source"),
    )
    return groups.unionByName(layers)
