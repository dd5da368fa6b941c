"""Histograms of pixels that arrive as a stream, by window of event time."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.raster import RGB
from pixelloom.sources.rasters import event_pixels


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; as a pattern, the path may be one file or a folder of parts."""
    return spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double").parquet(f"{sf_dir}/events.parque[t]")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of the events table as a stream, each with its time."""
    return event_pixels(_events(spark, sf_dir), "ts")


def windowed_histogram(px: DataFrame, every: str = "30 days", late: str = "7 days", bins: int = 16) -> DataFrame:
    """(begins, channel, bin, n) of pixels that are not transparent; pixels later than ``late`` are left out of closed windows.

    The state holds a row for each open window, channel and bin.
    """
    levels = F.array(*(F.struct(F.lit(c).alias("channel"), F.floor(F.col(c) * bins / 256).alias("bin")) for c in RGB))
    rows = px.withWatermark("ts", late).where("a <> 0").select("ts", F.explode(levels).alias("e"))
    return rows.groupBy(F.window("ts", every).alias("w"), "e.channel", "e.bin").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), "channel", "bin", "n")


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """Runs what is there, keeping the whole result as a table under ``path``, and reads it; a rerun goes on from its checkpoint."""
    to = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/table")
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(to).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that executors share; a local master may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='pixelloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def samples_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as samples of pens: eight strokes, by user; places on a raster of 100 pixels a row, pressures from values."""
    return _events(spark, sf_dir).where("event_id % 25 = 0").select(
        (F.col("user_id") % 8).alias("stroke"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_id") * 7 % 100 + 0.5).cast("double").alias("x"), (F.floor("value") % 60 + 0.25).cast("double").alias("y"),
        ((F.floor("value") % 7 + 2) / 8).cast("double").alias("pressure"),
    )
