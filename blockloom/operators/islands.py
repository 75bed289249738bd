"""Runs and gaps of whole numbers, cut into buckets so that no window spans a whole volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Places of a bucket. A window sorts one bucket of one key; only runs that touch a bucket's ends meet across buckets.
BUCKET = 1 << 20


def div(a: Column, b) -> Column:
    return F.call_function("div", a, F.lit(b) if not isinstance(b, Column) else b)


def stitch(runs: DataFrame, keys: list[str], bucket: int, first: list[str] = ()) -> DataFrame:
    """Joins runs (begin, len) that meet at a bucket's end.

    Only runs that touch a bucket's end, two for each key and bucket at most, are brought together by key; each of the
    others is a group of its own. One pass, so what made the runs is not computed twice.
    """
    end = F.col("begin") + F.col("len")
    touches = (F.col("begin") % bucket == 0) | (end % bucket == 0)
    x = runs.withColumn("_group", F.when(touches, F.lit(-1)).otherwise(F.col("begin")))
    w = Window.partitionBy(*keys, "_group").orderBy("begin")
    x = x.withColumn("_new", F.when(F.lag(end).over(w) == F.col("begin"), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = x.groupBy(*keys, "_group", "_run").agg(F.sum("len").alias("len"), F.min(F.struct("begin", *first)).alias("_first"))
    return joined.select(*keys, F.col("_first.begin").alias("begin"), "len", *(F.col(f"_first.{c}").alias(c) for c in first))


def islands(df: DataFrame, keys: list[str], pos: str, first: list[str] = (), bucket: int = BUCKET) -> DataFrame:
    """Maximal runs of consecutive pos within keys: keys, begin, len and, of the first row, the columns `first`.

    Rows are distinct in keys and pos. Empty input gives no runs.
    """
    w = Window.partitionBy(*keys, "_bucket").orderBy(pos)
    x = df.withColumn("_bucket", div(F.col(pos), bucket))
    x = x.withColumn("_run", F.col(pos) - F.row_number().over(w))
    runs = x.groupBy(*keys, "_bucket", "_run").agg(F.count("*").alias("len"), F.min(F.struct(F.col(pos).alias("begin"), *first)).alias("_first"))
    runs = runs.select(*keys, F.col("_first.begin").alias("begin"), "len", *(F.col(f"_first.{c}").alias(c) for c in first))
    return stitch(runs, list(keys), bucket, list(first))


def gaps(spark: SparkSession, used: DataFrame, pos: str, blocks: int, bucket: int = BUCKET) -> DataFrame:
    """Maximal ranges of [0, blocks) without a row of used: begin, len."""
    if blocks <= 0:
        return spark.createDataFrame([], "begin long, len long")
    inside = used.filter((F.col(pos) >= 0) & (F.col(pos) < blocks)).select(F.col(pos).cast("long").alias("p")).distinct()
    # Each bucket's start less one and end are sentinels, so free buckets show and gaps end at buckets' ends.
    cells = spark.range((blocks + bucket - 1) // bucket).select(F.col("id").alias("b"))
    ends = cells.select("b", F.explode(F.array(F.col("b") * bucket - 1, F.least((F.col("b") + 1) * bucket, F.lit(blocks)))).alias("p"))
    points = inside.select(div(F.col("p"), bucket).alias("b"), "p").unionByName(ends)
    w = Window.partitionBy("b").orderBy("p")
    free = points.withColumn("next", F.lead("p").over(w)).filter("next > p + 1").select((F.col("p") + 1).alias("begin"), (F.col("next") - F.col("p") - 1).alias("len"))
    return stitch(free, [], bucket)


def bit_runs(bits: DataFrame, keys: list[str], pos: str, value: str, bucket: int = BUCKET) -> DataFrame:
    """Alternating runs of a boolean column: keys, value, begin, len."""
    return islands(bits, [*keys, value], pos, bucket=bucket)


def expand(runs: DataFrame, begin: str = "begin", length: str = "len", out: str = "block") -> DataFrame:
    """Runs to blocks."""
    return runs.filter(F.col(length) > 0).withColumn(out, F.explode(F.sequence(F.col(begin), F.col(begin) + F.col(length) - 1)))
