"""Streams of writes as eras: newest era of each block, and writesets of recent eras."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def newest_era(writes: DataFrame) -> DataFrame:
    """block, era of a stream of writes (block, era); state is one number for each block. Output mode update or complete."""
    return writes.groupBy("block").agg(F.max("era").alias("era"))


def writesets(writes: DataFrame, delay: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Distinct blocks of each window of time of a stream (block, ts). Late rows beyond the delay are dropped with their window's state."""
    return writes.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "block").agg(F.count("*").alias("n")).select("w.start", "w.end", "block", "n")


def merge_into(path: str):
    """A foreachBatch function: folds a batch (block, era) into the Parquet table at path, a new version for each batch id."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{batch_id - 1}") if batch_id else batch.limit(0)
        newest_era(old.select("block", "era").unionByName(batch.select("block", "era"))).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return fold
