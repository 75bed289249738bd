"""Joins of ranges that overlap, as equi-joins on bucket numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .islands import div


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str] = (), bucket: int = 4096, how: str = "inner") -> DataFrame:
    """Rows of left (begin, len, ...) with rows of right (r_begin, r_len, ...) that overlap: both, and begin, len cut to the overlap as o_begin, o_len.

    Each range is listed under the buckets it covers; a pair is kept in the bucket where its overlap begins, so it comes once.
    """
    cells = lambda b, n: F.explode(F.sequence(div(F.col(b), bucket), div(F.col(b) + F.col(n) - 1, bucket)))
    a = left.filter("len > 0").withColumn("_cell", cells("begin", "len"))
    b = right.filter("r_len > 0").withColumn("_cell", cells("r_begin", "r_len"))
    begin, end = F.greatest("begin", "r_begin"), F.least(F.col("begin") + F.col("len"), F.col("r_begin") + F.col("r_len"))
    both = a.join(b, [*keys, "_cell"], how).withColumn("o_begin", begin).withColumn("o_len", end - begin)
    return both.filter((F.col("o_len") > 0) & (div(F.col("o_begin"), bucket) == F.col("_cell"))).drop("_cell")
