"""Integrity checks: violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .islands import BUCKET, div


def space_map_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Blocks (data_block, expected, actual) whose counts differ; a block absent from a side counts 0 there."""
    a, b = expected.select("data_block", F.col("ref_count").alias("expected")), actual.select("data_block", F.col("ref_count").alias("actual"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return a.join(b, "data_block", "full_outer").select("data_block", z("expected"), z("actual")).filter("expected <> actual")


def space_map_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The differences with kind leak (expected 0, held 1) or bad."""
    leak = (F.col("expected") == 0) & (F.col("actual") == 1)
    return space_map_diff(expected, actual).withColumn("kind", F.when(leak, "leak").otherwise("bad"))


def space_map_repair(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Counts as they are after leaks are freed."""
    leaks = space_map_check(expected, actual).filter("kind = 'leak'").select("data_block")
    return actual.join(leaks, "data_block", "left_anti")


def overflow_counts(small: DataFrame, overflow: DataFrame) -> DataFrame:
    """Two-bit counts (block, bits) with those of 3 looked up in the overflow rows (block, ref_count)."""
    return small.join(overflow.select("block", F.col("ref_count").alias("_big")), "block", "left").select(
        "block", F.when(F.col("bits") == 3, F.col("_big")).otherwise(F.col("bits")).cast("long").alias("ref_count"))


def device_ids(devices: DataFrame, mappings: DataFrame) -> DataFrame:
    """Ids on one side only: dev_id, kind."""
    a, b = devices.select("dev_id", F.lit(1).alias("_d")).distinct(), mappings.select("dev_id", F.lit(1).alias("_m")).distinct()
    return a.join(b, "dev_id", "full_outer").filter("_d is null or _m is null").select("dev_id", F.when(F.col("_d").isNull(), "no details").otherwise("no mappings").alias("kind"))


def mapped_counts(devices: DataFrame, mappings: DataFrame) -> DataFrame:
    """Devices whose declared count differs from the rows found: dev_id, declared, found, kind."""
    n = mappings.groupBy("dev_id").agg(F.count("*").alias("found"))
    x = devices.join(n, "dev_id", "left").select("dev_id", F.col("mapped_blocks").alias("declared"), F.coalesce("found", F.lit(0)).alias("found"))
    return x.filter("declared <> found").withColumn("kind", F.when(F.col("found") == 0, "missing root").otherwise("count differs"))


def out_of_bounds(mappings: DataFrame, blocks: int) -> DataFrame:
    return mappings.filter(F.col("data_block") >= blocks)


def snapshot_only(snapshot: DataFrame, main: DataFrame) -> DataFrame:
    """Devices of a metadata snapshot that the main tree does not have with the same root."""
    return snapshot.join(main.select("dev_id", "root"), ["dev_id", "root"], "left_anti")


def details_join(devices: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings with their device's details, by id (never by position)."""
    return mappings.join(devices, "dev_id")


def underfull(nodes: DataFrame, max_entries: int = 252) -> DataFrame:
    """Nodes (loc, is_root, nr_entries) below a third of their room."""
    return nodes.filter(~F.col("is_root") & (F.col("nr_entries") < max_entries // 3))


def key_ranges(children: DataFrame) -> DataFrame:
    """Children (parent, pos, parent_key, key_low, key_high) with keys outside their parent's range."""
    from pyspark.sql import Window

    high = F.lead("parent_key").over(Window.partitionBy("parent").orderBy("pos"))
    return children.withColumn("end", high).filter((F.col("key_low") < F.col("parent_key")) | F.coalesce(F.col("end") < F.col("key_high"), F.lit(False)))


def overlaps(children: DataFrame) -> DataFrame:
    """Siblings whose least key is not above the greatest of those before."""
    from pyspark.sql import Window

    w = Window.partitionBy("parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return children.withColumn("before", F.max("key_high").over(w)).filter("key_low <= before")


def outcome(violations: DataFrame) -> DataFrame:
    """The worst severity (0 fine, 1 non-fatal, 2 fatal) of rows with severity."""
    return violations.agg(F.coalesce(F.max("severity"), F.lit(0)).alias("severity"))


def needs_check(outcome: DataFrame, clear: bool, repaired: bool) -> DataFrame:
    """Whether the flag needs_check may be cleared: on request, if nothing fatal was found and non-fatal finds are repaired."""
    ok = (F.col("severity") == 0) | ((F.col("severity") == 1) & F.lit(repaired))
    return outcome.select(F.lit(clear).__and__(ok).alias("clear_flag"))


def block_sizes(superblocks: DataFrame) -> DataFrame:
    """Superblocks whose data_block_size, in sectors, cannot be restored: outside 128 .. 2097152 or no multiple of 128; null is one too."""
    size = F.col("data_block_size")
    return superblocks.filter(~F.coalesce(size.between(128, 2097152) & (size % 128 == 0), F.lit(False)))


def thin_overlaps(runs: DataFrame, key: str = "dev_id", bucket: int = BUCKET) -> DataFrame:
    """Runs (key, thin_begin, data_begin, len, ...) that begin before an earlier one of their key ends: a restore takes blocks in rising order.

    Of runs with one start the first by data_begin is the earlier. Windows span a bucket of starts; of each bucket only its furthest end is carried on.
    """
    x = runs.filter("len > 0").withColumn("_bucket", div(F.col("thin_begin"), bucket)).withColumn("_end", F.col("thin_begin") + F.col("len"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = x.groupBy(key, "_bucket").agg(F.max("_end").alias("_far")).withColumn("_far", F.max("_far").over(before))
    within = Window.partitionBy(key, "_bucket").orderBy("thin_begin", "data_begin").rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumn("_near", F.max("_end").over(within)).join(carried, [key, "_bucket"])
    return y.filter(F.col("thin_begin") < F.greatest("_near", "_far")).select(*runs.columns)
