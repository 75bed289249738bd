"""Packed values and checks of the block-mapping relations. All counts and places are LONG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the data model.
SECTOR_SHIFT = 9
MIN_BLOCK_SECTORS, MAX_BLOCK_SECTORS = 128, 2097152
MAX_METADATA_BLOCKS = 4161600
FLAG_VALID, FLAG_DIRTY = 1, 2


def unpack_block_time(packed: Column) -> tuple[Column, Column]:
    """(data_block, time) of a packed mapping value."""
    return F.shiftrightunsigned(packed, 24), packed.bitwiseAND(F.lit((1 << 24) - 1))


def pack_block_time(block: Column, time: Column) -> Column:
    return F.shiftleft(block, 24).bitwiseOR(time.bitwiseAND(F.lit((1 << 24) - 1)))


def unpack_cache_mapping(packed: Column) -> tuple[Column, Column]:
    """(oblock, flags) of a packed cache mapping."""
    return F.shiftrightunsigned(packed, 16), packed.bitwiseAND(F.lit(0xFFFF))


def pack_cache_mapping(oblock: Column, flags: Column) -> Column:
    return F.shiftleft(oblock, 16).bitwiseOR(flags.bitwiseAND(F.lit(0xFFFF)))


def unsigned(df: DataFrame, *columns: str) -> DataFrame:
    """Raises where a column holds a value of 2^63 or more, which a LONG shows as negative."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c}: 2^63 or more"))).otherwise(F.col(c)))
    return df
