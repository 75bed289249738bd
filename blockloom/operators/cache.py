"""Cache mappings: what is valid, dirty, to be written back, and what breaks the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def valid(mappings: DataFrame) -> DataFrame:
    return mappings.filter("is_valid = 1").select("cblock", "oblock", "is_dirty")


def dirty_v1(mappings: DataFrame) -> DataFrame:
    """Dirty by the mapping's own flag."""
    return mappings.filter("is_valid = 1 and is_dirty = 1").select("cblock", "oblock")


def dirty_v2(mappings: DataFrame, bits: DataFrame) -> DataFrame:
    """Dirty by a bitset's rows (cblock)."""
    return mappings.filter("is_valid = 1").join(bits.select("cblock"), "cblock", "left_semi").select("cblock", "oblock")


def with_dirty(mappings: DataFrame, bits: DataFrame) -> DataFrame:
    """Valid mappings with dirty from a checked bitset (cblock, dirty); an unreadable bit counts as dirty."""
    b = bits.select(F.col("cblock"), F.col("dirty"))
    return mappings.filter("is_valid = 1").join(b, "cblock", "left").select("cblock", "oblock", F.coalesce("dirty", F.lit(True)).alias("dirty"))


def writeback(mappings: DataFrame, clean_shutdown: bool, version: int, bits: DataFrame | None = None) -> DataFrame:
    """src (cache) and dst (origin) blocks to copy: after an unclean shutdown all that are valid."""
    x = valid(mappings).select("cblock", "oblock") if not clean_shutdown else dirty_v1(mappings) if version == 1 else dirty_v2(mappings, bits)
    return x.select(F.col("cblock").alias("src"), F.col("oblock").alias("dst"))


def sorted_copies(copies: DataFrame) -> DataFrame:
    return copies.orderBy("dst", "src")


def count_where(mappings: DataFrame, predicate) -> DataFrame:
    return mappings.agg(F.count_if(predicate).alias("n"))


def writeback_outcome(copies: DataFrame, failed: DataFrame) -> DataFrame:
    """Copies with their state: copied, read error or write error; failed has (src, kind)."""
    worst = failed.groupBy("src").agg(F.min("kind").alias("kind"))
    return copies.join(worst, "src", "left").select("src", "dst", F.coalesce("kind", F.lit("copied")).alias("state"))


def writeback_stats(outcome: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("state") == s)
    return outcome.agg(F.count("*").alias("nr_blocks"), is_("copied").alias("nr_copied"), is_("read").alias("nr_read_errors"), is_("write").alias("nr_write_errors"))


def cleaned(mappings: DataFrame, outcome: DataFrame) -> DataFrame:
    """Mappings with the dirty flag cleared where the block was copied."""
    done = outcome.filter("state = 'copied'").select(F.col("src").alias("cblock"), F.lit(1).alias("_done"))
    return mappings.join(done, "cblock", "left").withColumn("is_dirty", F.when(F.col("_done") == 1, 0).otherwise(F.col("is_dirty"))).drop("_done")


def hints_of_valid(hints: DataFrame, mappings: DataFrame) -> DataFrame:
    return hints.join(mappings.filter("is_valid = 1").select("cblock"), "cblock", "left_semi")


def duplicate_origins(mappings: DataFrame) -> DataFrame:
    """Valid mappings whose origin block an earlier cache block has."""
    rank = F.row_number().over(Window.partitionBy("oblock").orderBy("cblock"))
    return mappings.filter("is_valid = 1").withColumn("_rank", rank).filter("_rank > 1").select("cblock", "oblock")


def check(mappings: DataFrame, origin_blocks: int | None = None, version: int = 1, dirty_bits: DataFrame | None = None) -> DataFrame:
    """kind, cblock, oblock of each breach. Flags are in column flags, if there is one."""
    bound = origin_blocks if origin_blocks else 1 << 48
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), "cblock", "oblock")
    is_valid = F.col("is_valid") == 1
    out = rows(mappings.filter(is_valid & (F.col("oblock") >= bound)), "out of bounds")
    out = out.unionByName(rows(mappings.filter(~is_valid & (F.col("oblock") > 0)), "mapped but invalid"))
    if version == 1:
        out = out.unionByName(rows(mappings.filter(~is_valid & (F.col("is_dirty") == 1)), "dirty but invalid"))
    elif dirty_bits is not None:
        out = out.unionByName(rows(mappings.filter(~is_valid).join(dirty_bits.select("cblock"), "cblock", "left_semi"), "dirty but invalid"))
    if "flags" in mappings.columns:
        known = 3 if version == 1 else 1
        out = out.unionByName(rows(mappings.filter(F.col("flags").bitwiseAND(F.lit(~known & 0xFFFF)) != 0), "unknown flags"))
    return out.unionByName(rows(duplicate_origins(mappings), "duplicate origin"))


def check_superblock(sb: DataFrame) -> DataFrame:
    """Breaches of a superblock (version, dirty_root, hint_size)."""
    found = F.filter(F.array(
        F.when(~F.col("version").isin(1, 2), F.lit("unknown version")),
        F.when((F.col("version") >= 2) & (F.coalesce("dirty_root", F.lit(0)) == 0), F.lit("no dirty bitset")),
        F.when(F.col("hint_size") != 4, F.lit("hint size is not 4"))), lambda x: x.isNotNull())
    return sb.select(F.explode(found).alias("kind"))
