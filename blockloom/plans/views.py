"""Block-mapping relations derived from the general tables by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POOL_BLOCKS, SHRUNK_BLOCKS, BLOCK_SECTORS = 3_000_000, 400_000, 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thin_mappings(spark, d) -> DataFrame:
    """Six volumes; one region is shared, each has a private one."""
    x = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("dev_id"), F.col("l_orderkey").alias("thin_block")).agg(
        F.max(F.when(F.col("l_linenumber") >= 6, 1).otherwise(0)).alias("priv"))
    own = F.col("priv") == 1
    return x.select("dev_id", "thin_block",
                    F.when(own, F.col("thin_block") + 400000 * (F.col("dev_id") + 1)).otherwise(F.col("thin_block")).cast("long").alias("data_block"),
                    F.when(own, 1 + F.col("dev_id")).otherwise(0).cast("long").alias("map_time"))


def thin_devices(spark, d) -> DataFrame:
    """Declared counts; that of device 5 is wrong by 3."""
    return devices_of(thin_mappings(spark, d))


def devices_of(mappings: DataFrame) -> DataFrame:
    dev = F.col("dev_id")
    return mappings.groupBy("dev_id").agg(F.count("*").alias("n")).select(
        "dev_id", (F.col("n") + F.when(dev == 5, 3).otherwise(0)).alias("mapped_blocks"), (dev + 1).alias("transaction_id"),
        dev.alias("creation_time"), dev.alias("snapshotted_time"))


def disk_ref_counts(spark, d) -> DataFrame:
    """Counts as a space map holds them, with some too large and some leaks."""
    used = thin_mappings(spark, d).groupBy("data_block").agg((F.count("*") + F.when(F.col("data_block") % 997 == 0, 1).otherwise(0)).alias("ref_count"))
    leaks = table(spark, d, "part").filter("p_size <= 5").select((F.lit(2800000) + F.col("p_partkey")).cast("long").alias("data_block"), F.lit(1).cast("long").alias("ref_count"))
    return used.unionByName(leaks)


def _purchases(spark, d) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'purchase'").select(F.dayofmonth("ts").cast("long").alias("era"), (F.col("event_id") % 2000).alias("block"))


def era_writesets(spark, d) -> DataFrame:
    """Era is the day of the month; eras before 15 are digested into the era array."""
    return _purchases(spark, d).filter("era >= 15").distinct()


def era_array(spark, d) -> DataFrame:
    blocks = table(spark, d, "events").select((F.col("event_id") % 2000).alias("block")).distinct()
    old = _purchases(spark, d).filter("era < 15").groupBy("block").agg(F.max("era").alias("era"))
    return blocks.join(old, "block", "left").select("block", F.coalesce("era", F.lit(0)).cast("long").alias("era"))


def cache_mappings(spark, d) -> DataFrame:
    """Cache blocks; some origin blocks occur twice."""
    o = table(spark, d, "orders").filter("o_orderkey > 0")
    empty, key = F.col("o_orderstatus") == "P", F.col("o_orderkey")
    return o.select(key.alias("cblock"),
                    F.when(empty, 0).when(key % 101 == 0, key - 1).otherwise(key).cast("long").alias("oblock"),
                    F.when(empty, 0).otherwise(1).alias("is_valid"),
                    F.when(~empty & (F.col("o_totalprice") > 200000), 1).otherwise(0).alias("is_dirty"))
