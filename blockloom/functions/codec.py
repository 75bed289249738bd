"""Checksums, block kinds and list codecs of the binary formats."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

# The checksum function travels to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096
#: Salts by which a block's checksum tells its kind (fixed values of the format).
SALTS = {
    "thin superblock": 160774, "cache superblock": 9031977, "era superblock": 146538381, "bitmap": 240779,
    "index": 160478, "node": 121107, "array": 595846735,
}
#: Header of a pack file (fixed values of the format), and the blocks that this writer puts into a chunk.
PACK_MAGIC, PACK_VERSION, PACK_CHUNK = 0xA537A0AA6309EF77, 3, 1024
POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _table()


def crc32c_rows(data: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of a byte matrix: one step for each column, all rows at once."""
    crc = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for k in range(data.shape[1]):
        crc = TABLE[(crc ^ data[:, k]) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of a binary column; rows of like length are computed together."""
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    sizes = data.map(lambda x: -1 if x is None else len(x))
    for n, rows in data[sizes >= 0].groupby(sizes[sizes >= 0]):
        matrix = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), n) if n else np.zeros((len(rows), 0), np.uint8)
        out[rows.index] = crc32c_rows(matrix).astype(np.int64)
    return out


def le(data: Column, start: int, n: int) -> Column:
    """Bytes start .. start + n - 1 (from 1) in reverse order."""
    return F.concat(*(F.substring(data, start + k, 1) for k in reversed(range(n))))


def le_number(data: Column, start: int, n: int) -> Column:
    """A little-endian unsigned number of n bytes at start (from 1)."""
    return F.conv(F.hex(le(data, start, n)), 16, 10).cast("decimal(20,0)").cast("long")


def block_kind(data: Column) -> Column:
    """The kind of a 4096-byte block, from its checksum; unknown if no salt fits."""
    salt = crc32c(F.substring(data, 5, BLOCK)).bitwiseXOR(F.lit(0xFFFFFFFF)).bitwiseXOR(le_number(data, 1, 4))
    out = F.lit("unknown")
    for kind, s in SALTS.items():
        out = F.when(salt == s, F.lit(kind)).otherwise(out)
    return out


def delta_encode(values: Column) -> Column:
    """An array of longs as steps: the first value (base), then runs of equal steps: array of (kind, delta, count).

    Kinds are base, const, pos and neg. A run goes on while each value differs from the one before by the same step.
    """
    step = "struct<kind:string,delta:bigint,count:bigint>"

    def add(s: Column, x: Column) -> Column:
        d = x - s["last"]
        kind = F.when(d == 0, "const").when(d > 0, "pos").otherwise("neg")
        tail = F.element_at(s["out"], -1)
        more = (F.size(s["out"]) > 1) & (tail["kind"] == kind) & (tail["delta"] == F.abs(d))
        new = F.struct(kind.alias("kind"), F.abs(d).alias("delta"), F.lit(1).cast("long").alias("count"))
        grown = F.struct(kind.alias("kind"), F.abs(d).alias("delta"), (tail["count"] + 1).alias("count"))
        out = F.when(more, F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(grown))).otherwise(F.concat(s["out"], F.array(new)))
        return F.struct(out.cast(f"array<{step}>").alias("out"), x.alias("last"))

    first = F.get(values, F.lit(0))
    start = F.struct(F.array(F.struct(F.lit("base").alias("kind"), first.alias("delta"), F.lit(1).cast("long").alias("count"))).cast(f"array<{step}>").alias("out"), first.alias("last"))
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) == 0, F.array().cast(f"array<{step}>")).otherwise(F.aggregate(rest, start, add)["out"])


def delta_decode(steps: Column) -> Column:
    """The values that delta_encode() was given."""
    def add(out: Column, s: Column) -> Column:
        sign = F.when(s["kind"] == "neg", -s["delta"]).otherwise(s["delta"])
        last = F.element_at(out, -1)
        return F.when(s["kind"] == "base", F.array(s["delta"])).otherwise(F.concat(out, F.transform(F.sequence(F.lit(1).cast("long"), s["count"]), lambda k: last + k * sign)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), add)


def lcg(seed: int, words: int) -> list[int]:
    """Test data: words of a linear congruential generator from a seed."""
    out, x = [], seed & (1 << 64) - 1
    for _ in range(words):
        out.append(x)
        x = (6364136223846793005 * x + 1442695040888963407) & (1 << 64) - 1
    return out
