"""Moments of a stream of frames, kept up to date batch by batch.

Moments of parts merge into moments of the whole, so each micro-batch leaves its own partial
moments, keyed by its number, and the current moments are one aggregation of those. A batch
that is delivered twice overwrites its own part, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators.moments import class_moments


def write_partials(frames: DataFrame, target: str, path: str, checkpoint: str, features: str = "features"):
    """Starts a query over a stream of frames; returns it."""

    def merge(batch: DataFrame, number: int) -> None:
        class_moments(batch, target, features).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str, target: str) -> DataFrame:
    """target, pos, n, mean, ss over all batches so far."""
    parts = spark.read.parquet(path).where("n > 0")
    total = parts.groupBy(target, "pos").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    joined = parts.join(total.select(target, "pos", F.col("mean").alias("grand")), [target, "pos"])
    spread = joined.groupBy(target, "pos").agg(F.sum(F.col("ss") + F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ss"))
    return total.join(spread, [target, "pos"])


def windowed(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """key, window, n, mean per tumbling window; rows later than the watermark are dropped."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
