"""Verdicts as a stream (an extension: batch use needs none of this)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attesta.operators.agreement import latest


def deduplicated(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each (reviewer, corpus, item_id, ts) once; state older than the watermark is dropped."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["reviewer", "corpus", "item_id", "ts"])


def counts(stream: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Verdicts per corpus, status and window."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", window), "corpus", "status").agg(F.count(F.lit(1)).alias("n"))


def upsert(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch under its number, so that a batch that runs again replaces itself; read with `current`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The latest verdict of each reviewer on an item over all batches."""
    return latest(spark.read.parquet(path))
