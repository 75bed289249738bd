"""Write tracking: what was written since an era."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .islands import islands


def _ranges(blocks: DataFrame) -> DataFrame:
    return islands(blocks, [], "block").select("begin", (F.col("begin") + F.col("len")).alias("end"))


def marked_ranges(writesets: DataFrame) -> DataFrame:
    """era, begin, end of the blocks set in each writeset."""
    return islands(writesets.distinct(), ["era"], "block").select("era", "begin", (F.col("begin") + F.col("len")).alias("end"))


def invalidated_blocks(writesets: DataFrame, array: DataFrame, since: int, eras: DataFrame | None = None) -> DataFrame:
    """Blocks written in or after an era. The array counts only if no writeset reaches back to that era.

    eras lists the archived eras, for writesets without a block set; by default those of the rows.
    """
    oldest = (eras if eras is not None else writesets).agg(F.min("era").alias("oldest"))
    new = writesets.filter(F.col("era") >= since).select("block")
    digested = array.filter(F.col("era") >= since).join(F.broadcast(oldest)).filter(F.col("oldest").isNull() | (F.col("oldest") > since)).select("block")
    return new.unionByName(digested).distinct()


def invalidate(writesets: DataFrame, array: DataFrame, since: int, eras: DataFrame | None = None) -> DataFrame:
    return _ranges(invalidated_blocks(writesets, array, since, eras))


def all_writesets(archived: DataFrame, current: DataFrame) -> DataFrame:
    """Archived writesets with the current one; an era in both raises."""
    both = archived.select("era").distinct().join(current.select("era").distinct(), "era")
    out = archived.unionByName(current)
    flag = F.broadcast(both.agg(F.count("*").alias("_n")))
    checked = F.when(F.col("_n") > 0, F.raise_error(F.lit("the current era is archived too"))).otherwise(F.col("era"))
    return out.join(flag).withColumn("era", checked).drop("_n")


def missing_eras(eras: DataFrame, current_era: int) -> DataFrame:
    """Eras from the oldest on to the current one that have no writeset."""
    span = eras.agg(F.min("era").alias("low")).select(F.explode(F.sequence(F.col("low"), F.greatest(F.col("low"), F.lit(current_era).cast("long")))).alias("era"))
    return span.join(eras.select("era").distinct(), "era", "left_anti")


def logical(writesets: DataFrame, array: DataFrame) -> DataFrame:
    """block, era: the newest writeset that holds the block, else the array's era."""
    newest = writesets.groupBy("block").agg(F.max("era").alias("newest"))
    return array.join(newest, "block", "left").select("block", F.coalesce("newest", "era").alias("era"))


def check_array(array: DataFrame, current_era: int) -> DataFrame:
    """Blocks whose era is after the current one."""
    return array.filter(F.col("era") > current_era)
