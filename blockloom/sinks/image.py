"""Binary metadata blocks from relations: nodes, trees, arrays, superblocks. An image is a relation (loc, data)."""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.codec import BLOCK, PACK_CHUNK, PACK_MAGIC, PACK_VERSION, SALTS, block_kind, crc32c_rows
from ..functions.packing import pack_block

# What packs blocks travels to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries of a node with 8-byte values, and values of an array block (fixed by the block size).
ROOM, ARRAY_ROOM = 252, 509


def room(value_size: int) -> int:
    """Entries of a node: as many as fit, in threes."""
    return (BLOCK - 32) // (8 + value_size) // 3 * 3


def seal(blocks: np.ndarray, kind: str) -> np.ndarray:
    """Puts the checksums of a kind into a matrix of blocks, one in a row."""
    crc = crc32c_rows(blocks[:, 4:]) ^ np.uint32(0xFFFFFFFF) ^ np.uint32(SALTS[kind])
    blocks[:, :4] = crc.astype("<u4")[:, None].view(np.uint8)
    return blocks


def _packed(fill, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blocks = np.zeros((batch.num_rows, BLOCK), np.uint8)
                for block, row in zip(blocks, zip(*(c.to_pylist() for c in batch.columns))):
                    fill(block, *row)
                seal(blocks, kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in blocks], pa.binary())], ["loc", "data"])

    return run


def pack_nodes(nodes: DataFrame, value_size: int = 8) -> DataFrame:
    """loc, data of nodes (loc, is_leaf, keys, values); values are longs, or binaries of value_size bytes in leaves."""
    def fill(block, loc, is_leaf, keys, values):
        size = value_size if is_leaf else 8
        most = room(size)
        struct.pack_into("<IIQIII", block, 0, 0, 2 if is_leaf else 1, loc, len(keys), most, size)
        block[32 : 32 + 8 * len(keys)] = np.array(keys, "<i8").view(np.uint8)
        body = b"".join(values) if values and isinstance(values[0], (bytes, bytearray)) else np.array(values, "<i8").tobytes()
        block[32 + 8 * most : 32 + 8 * most + len(body)] = np.frombuffer(body, np.uint8)

    return nodes.select("loc", "is_leaf", "keys", "values").mapInArrow(_packed(fill, "node"), "loc long, data binary")


def pack_arrays(values: DataFrame, first: int) -> DataFrame:
    """loc, data of array blocks that hold values (index, value): element i of block k is number k * ARRAY_ROOM + i, zero if it has no row. A block's values are bounded by its size."""
    def fill(block, loc, found):
        got = np.zeros(found[-1]["index"] % ARRAY_ROOM + 1, "<i8")
        got[[v["index"] % ARRAY_ROOM for v in found]] = [v["value"] for v in found]
        struct.pack_into("<IIIIQ", block, 0, 0, ARRAY_ROOM, len(got), 8, loc)
        block[24 : 24 + 8 * len(got)] = got.view(np.uint8)

    at = F.call_function("div", F.col("index"), F.lit(ARRAY_ROOM))
    blocks = values.groupBy((at + first).alias("loc")).agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("found"))
    return blocks.mapInArrow(_packed(fill, "array"), "loc long, data binary")


def pack_superblock(fields: DataFrame, kind: str, layout: list[tuple[str, int, int]]) -> DataFrame:
    """loc 0, data of a superblock; layout has (field, place, bytes) of numbers, and of texts with a negative number of bytes."""
    def fill(block, loc, *row):
        for (_, at, n), v in zip(layout, row):
            body = (v or "").encode()[:-n].ljust(-n, b"\0") if n < 0 else int(v or 0).to_bytes(n, "little")
            block[at : at + abs(n)] = np.frombuffer(body, np.uint8)

    return fields.select(F.lit(0).cast("long").alias("loc"), *(name for name, _, _ in layout)).mapInArrow(_packed(fill, f"{kind} superblock"), "loc long, data binary")


def pack_trees(entries: DataFrame, first: int, value_size: int = 8, max_depth: int = 32) -> tuple[DataFrame, DataFrame]:
    """(image, roots) of trees of entries (tree, key, value): blocks (loc, data) from loc `first` on, and (tree, root).

    Leaves are filled evenly, by rank within their tree, then the levels above. A level has a row for each node, and a row for
    each tree meets in one window to number the blocks.
    """
    level, leaf, images, roots = entries.select("tree", "key", "value"), True, None, None
    for _ in range(max_depth):
        size = value_size if leaf else 8
        order = Window.partitionBy("tree").orderBy("key")
        counts = level.groupBy("tree").agg(F.count("*").alias("n"))
        counts = counts.withColumn("nodes", F.ceil(F.col("n") / room(size))).withColumn("base", F.sum("nodes").over(Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)))
        ranked = level.withColumn("r", F.row_number().over(order) - 1).join(counts, "tree")
        slot = F.call_function("div", F.col("r") * F.col("nodes"), F.col("n"))
        nodes = ranked.groupBy("tree", "nodes", (F.lit(first) + F.coalesce("base", F.lit(0)) + slot).alias("loc")).agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("e")).persist()
        packed = pack_nodes(nodes.select("loc", F.lit(leaf).alias("is_leaf"), F.col("e.key").alias("keys"), F.col("e.value").alias("values")), size)
        images = packed if images is None else images.unionByName(packed)
        done = nodes.filter("nodes = 1").select("tree", F.col("loc").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        first += counts.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
        level, leaf = nodes.filter("nodes > 1").select("tree", F.col("e")[0]["key"].alias("key"), F.col("loc").alias("value")), False
        if level.isEmpty():
            return images, roots
    raise ValueError("trees deeper than max_depth")


def write_file(image: DataFrame, path: str) -> None:
    """The blocks of an image in order of loc, as one file; places without a block are zero. A file is written by one writer, the driver, a block at a time."""
    jvm = image.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(image.sparkSession._jsc.hadoopConfiguration()).create(at, True)
    try:
        place = 0
        for row in image.orderBy("loc").toLocalIterator():
            while place < row.loc:
                out.write(bytearray(BLOCK))
                place += 1
            out.write(bytearray(row.data))
            place += 1
    finally:
        out.close()


def packed_chunks(image: DataFrame) -> DataFrame:
    """(chunk, body): the blocks of an image (loc, data) whose checksum tells a kind, as compressed bytecode, PACK_CHUNK places in a chunk."""
    known = image.select("loc", "data", block_kind(F.col("data")).alias("kind")).filter("kind <> 'unknown'")

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("loc", "data", "kind"))))
        body = zlib.compress(b"".join(struct.pack("<Q", loc) + pack_block(data, kind) for loc, data, kind in rows))
        return pa.table({"chunk": pa.array([rows[0][0] // PACK_CHUNK], pa.int64()), "body": pa.array([body], pa.binary())})

    return known.groupBy(F.call_function("div", F.col("loc"), F.lit(PACK_CHUNK))).applyInArrow(pack, "chunk long, body binary")


def write_pack(image: DataFrame, path: str, nr_blocks: int) -> None:
    """A pack file of an image of nr_blocks blocks; executors compress, the driver writes a chunk at a time. Blocks of unknown kind are dropped."""
    jvm = image.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(image.sparkSession._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(struct.pack("<QQQQ", PACK_MAGIC, PACK_VERSION, BLOCK, nr_blocks)))
        for row in packed_chunks(image).orderBy("chunk").toLocalIterator():
            out.write(bytearray(struct.pack("<Q", len(row.body)) + row.body))
    finally:
        out.close()
