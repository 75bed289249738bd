"""Binary metadata images: blocks, nodes, trees, arrays, bitmaps, superblocks."""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.codec import BLOCK, PACK_MAGIC, PACK_VERSION, block_kind, le_number
from ..functions.packing import Reader

# What decodes blocks travels to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the node, array and bitmap headers (fixed values of the format).
NODE_HEADER, ARRAY_HEADER, BITMAP_HEADER = 32, 24, 16
ENTRIES = "array<struct<key:bigint,value:bigint,raw:binary>>"


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """loc, data of each 4096-byte block. The image is split at block bounds, so tasks read ranges of it, from any store Spark reads."""
    kind = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    numbered = spark.sparkContext.newAPIHadoopFile(path, kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{kind}.recordLength": str(BLOCK)})
    return spark.createDataFrame(numbered.map(lambda x: (x[0], bytearray(x[1]))), "loc long, data binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The compressed chunks of pack files, one a row."""
    for batch in batches:
        for cell in batch.column(0):
            file = cell.as_buffer()
            magic, version, size, _ = struct.unpack_from("<QQQQ", file)
            if magic != PACK_MAGIC:
                raise ValueError("not a pack file")
            if version != PACK_VERSION or size != BLOCK:
                raise ValueError(f"pack file of version {version} with blocks of {size} bytes")
            at = 32
            while at < file.size:
                n = struct.unpack_from("<Q", file, at)[0] if at + 8 <= file.size else file.size
                if at + 8 + n > file.size:
                    raise ValueError("pack file ends early")
                yield pa.RecordBatch.from_arrays([pa.array([file.slice(at + 8, n).to_pybytes()], pa.binary())], ["body"])
                at += 8 + n


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column(0):
            code = Reader(zlib.decompress(cell.as_py()))
            locs, blocks = [], []
            while code.at < len(code.code):
                locs.append(int.from_bytes(code.take(8), "little"))
                code.last = 0
                blocks.append(code.run(BLOCK))
                if len(blocks[-1]) != BLOCK:
                    raise ValueError(f"packed block {locs[-1]} has {len(blocks[-1])} bytes")
            yield pa.RecordBatch.from_arrays([pa.array(locs, pa.int64()), pa.array(blocks, pa.binary())], ["loc", "data"])


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """loc, data of each block of a pack file of up to 2 GB. One task cuts it into chunks, which are decoded apart.

    Places without a block are zero in the image that was packed or of unknown kind there; they have no row. A file that is none, of another version, cut
    off or with broken code raises.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen() < 32:  # an empty file would be no row
        raise ValueError("not a pack file")
    chunks = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_chunks, "body binary")
    return chunks.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_unpacked, "loc long, data binary")


def with_kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", block_kind(F.col("data")))


def _node(data: bytes, loc: int, value_size: int, is_root: bool, strict: bool) -> tuple:
    """Header fields, the first breach in order, keys, values as numbers and as bytes."""
    flags, block, nr, most, size = struct.unpack_from("<IQIII", data, 4)
    leaf = flags == 2
    head = (leaf, block - (1 << 64) if block >> 63 else block, nr, most, size)
    fail = lambda error: (*head, error, None, None)
    if leaf and size != value_size:
        return fail("value size mismatch")
    if (size + 8) * most + NODE_HEADER > BLOCK:
        return fail("max entries too large")
    if nr > most:
        return fail("too many entries")
    if strict and most % 3:
        return fail("max entries not divisible by 3")
    if strict and not is_root and nr < most // 3:
        return fail("too few entries")
    keys = np.frombuffer(data, "<i8", nr, NODE_HEADER)
    size = size if leaf else 8
    start = NODE_HEADER + 8 * most
    values = np.frombuffer(data, "<i8", nr, start) if size == 8 else None
    if (keys < 0).any() or values is not None and (values < 0).any():
        return fail("number of 2^63 or more")
    if (keys[1:] <= keys[:-1]).any():
        return fail("keys out of order")
    if block != loc:
        return fail("block number mismatch")
    return *head, None, keys, values if size == 8 else [data[start + size * k : start + size * (k + 1)] for k in range(nr)]


def nodes(df: DataFrame, value_size: int = 8, roots: list[int] | None = (), ignore_non_fatal: bool = False) -> DataFrame:
    """loc, header fields, error (the first breach in order) and entries (key, value, raw), null where the node is in error.

    Values of internal nodes and of leaves with 8-byte values are numbers; other leaves give their bytes, raw. Numbers of 2^63 or more are
    an error, as LONG cannot hold them. roots may hold few entries; None: any node may be one.
    """
    known = None if roots is None else frozenset(int(r) for r in roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            locs = batch.column(0).to_pylist()
            rows = [_node(d.as_py(), loc, value_size, known is None or loc in known, not ignore_non_fatal) for loc, d in zip(locs, batch.column(1))]
            if not rows:
                continue
            sizes = [0 if r[6] is None else len(r[6]) for r in rows]
            keys = [r[6] for r in rows if r[6] is not None]
            numbers, raws = [], []
            for r in rows:
                if r[6] is not None:
                    plain = isinstance(r[7], np.ndarray)
                    numbers += r[7].tolist() if plain else [None] * len(r[6])
                    raws += [None] * len(r[6]) if plain else r[7]
            entry = pa.StructArray.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(numbers, pa.int64()), pa.array(raws, pa.binary())], ["key", "value", "raw"])
            offsets = pa.array([None if r[6] is None else o for r, o in zip(rows, np.cumsum([0, *sizes]).tolist())] + [sum(sizes)], pa.int32())
            fields = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fields, pa.ListArray.from_arrays(offsets, entry)],
                                             ["loc", "is_leaf", "block", "nr_entries", "max_entries", "value_size", "error", "entries"])

    schema = f"loc long, is_leaf boolean, block long, nr_entries long, max_entries long, value_size long, error string, entries {ENTRIES}"
    return df.select("loc", "data").mapInArrow(run, schema)


def walk(decoded: DataFrame, roots: DataFrame, max_depth: int = 32) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of the trees under roots (root): root, key, value, raw, leaf (its loc), path (locs from the root); and root, loc, error, key_low, key_high, path.

    A tree visits each node once, however many of its parents point at it; the range of a shared one is that of the first path. What is
    below a node in error, or one that cannot be read, is left out, and the node is an error with the keys that are missing; its siblings
    are visited. A level is one join of the nodes with the frontier; decoded is best kept (persist, checkpoint or a table).
    """
    none = F.lit(None).cast("long")
    frontier = roots.select("root", F.col("root").alias("loc"), none.alias("key_low"), none.alias("key_high"), F.array("root").alias("path"))
    found = broken = None
    union = lambda a, b: b if a is None else a.unionByName(b)
    for _ in range(max_depth):
        x = frontier.join(decoded.select("loc", "is_leaf", "error", "entries"), "loc", "left")
        first, last = F.col("entries")[0]["key"], F.element_at("entries", -1)["key"]
        out = (F.size("entries") > 0) & (F.coalesce(first < F.col("key_low"), F.lit(False)) | F.coalesce(last >= F.col("key_high"), F.lit(False)))
        x = x.withColumn("error", F.coalesce("error", F.when(F.col("is_leaf").isNull(), "unreadable"), F.when(out, "keys outside the parent's range")))
        found = union(found, x.filter("error is null and is_leaf").select("root", F.col("loc").alias("leaf"), "path", F.explode("entries").alias("e")).select("root", "e.key", "e.value", "e.raw", "leaf", "path"))
        broken = union(broken, x.filter("error is not null").select("root", "loc", "error", "key_low", "key_high", "path"))
        down = x.filter("error is null and not is_leaf").select("root", "path", "entries", F.col("key_high").alias("upto"), F.posexplode("entries").alias("i", "e"))
        child = F.struct(F.col("e.key").alias("key_low"), F.coalesce(F.get(F.col("entries"), F.col("i") + 1)["key"], F.col("upto")).alias("key_high"), F.concat("path", F.array("e.value")).alias("path"))
        frontier = down.groupBy("root", F.col("e.value").alias("loc")).agg(F.min(child).alias("c")).select("root", "loc", "c.*").persist()
        if frontier.isEmpty():
            return found, broken
    raise ValueError("tree deeper than max_depth")


def tree(decoded: DataFrame, root: int, max_depth: int = 32) -> DataFrame:
    """key, value, leaf (its loc) of the tree under root; walk() tells what is broken."""
    return walk(decoded, decoded.sparkSession.createDataFrame([(int(root),)], "root long"), max_depth)[0].select("key", "value", "leaf")


def key_set(entries: DataFrame) -> DataFrame:
    """The keys of walked trees."""
    return entries.select("root", "key").distinct()


def block_counts(entries: DataFrame) -> DataFrame:
    """Blocks of each walked tree, shared ones once."""
    return entries.select("root", F.explode("path").alias("loc")).distinct().groupBy("root").agg(F.count("*").alias("n_blocks"))


def iterate(entries: DataFrame, start: int, steps: int) -> DataFrame:
    """The first `steps` entries of each tree from key `start` on, in order: a cursor's get and step."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("root").orderBy("key"))
    return entries.filter(F.col("key") >= start).withColumn("step", at).filter(F.col("step") <= steps)


def details_columns() -> list[Column]:
    """dev_id, mapped_blocks, transaction_id, creation_time, snapshotted_time of an entry (key, raw) with 24 bytes."""
    f = lambda at, n: le_number(F.col("raw"), at + 1, n)
    return [F.col("key").alias("dev_id"), f(0, 8).alias("mapped_blocks"), f(8, 8).alias("transaction_id"), f(16, 4).alias("creation_time"), f(20, 4).alias("snapshotted_time")]


def device_details(entries: DataFrame) -> DataFrame:
    """The details in leaves with 24-byte values, as details_columns()."""
    return entries.select(*details_columns())


def bitmap_counts(data: Column) -> Column:
    """Two-bit counts of a bitmap block; the two bits are stored swapped, and 3 means: look in the overflow tree."""
    hexed = F.hex(F.substring(data, BITMAP_HEADER + 1, BLOCK - BITMAP_HEADER))
    # Byte by byte: entries of a little-endian word follow its bytes in order.
    byte = lambda k: F.conv(F.substring(hexed, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    raw = lambda b, i: F.shiftright(b, 2 * i).bitwiseAND(F.lit(3))
    swap = lambda v: F.when(v == 1, 2).when(v == 2, 1).otherwise(v)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - BITMAP_HEADER - 1)), lambda k: F.transform(F.array(byte(k)), lambda b: F.array(*(swap(raw(b, i)) for i in range(4))))[0]))


def space_map(bitmaps: DataFrame, overflow: DataFrame, blocks_: int) -> DataFrame:
    """block, ref_count from bitmap blocks (index, data) and overflow rows (block, ref_count)."""
    from ..operators.check import overflow_counts

    per = (BLOCK - BITMAP_HEADER) * 4
    small = bitmaps.select("index", F.posexplode(bitmap_counts(F.col("data"))).alias("i", "bits")).select((F.col("index") * per + F.col("i")).alias("block"), "bits").filter(F.col("block") < blocks_)
    return overflow_counts(small, overflow)


def arrays(df: DataFrame, words: bool = False) -> DataFrame:
    """loc, max_entries, values of array blocks (loc, data) with 8-byte values; error where a block does not hold what it says. words: values are 64 bits, not numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d in batch.column(1):
                data = d.as_py()
                most, n, size = struct.unpack_from("<III", data, 4)
                wrong = size != 8 or n > most or ARRAY_HEADER + 8 * most > BLOCK
                got = np.zeros(0, "<i8") if wrong else np.frombuffer(data, "<i8", n, ARRAY_HEADER)
                error = "bad array header" if wrong else "number of 2^63 or more" if not words and (got < 0).any() else None
                out.append((most, None if error else got.tolist(), error))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.string()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["loc", "max_entries", "values", "error"])

    return df.select("loc", "data").mapInArrow(run, "loc long, max_entries long, values array<bigint>, error string")


def array_scan(decoded: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, errors) of an array: index has (key, value), the number and place of each array block. Elements are (index, value); blocks in error are left out, the rest is read."""
    x = index.select(F.col("key").alias("number"), F.col("value").alias("loc")).join(decoded, "loc", "left").withColumn("error", F.coalesce("error", F.when(F.col("max_entries").isNull(), "unreadable")))
    good = x.filter("error is null").select("number", "max_entries", F.posexplode("values").alias("i", "value"))
    return good.select((F.col("number") * F.col("max_entries") + F.col("i")).alias("index"), "value"), x.filter("error is not null").select("number", "loc", "error")


def bits(words: DataFrame, nr_bits: int) -> DataFrame:
    """element, value of a bitset whose words are an array's elements (index, value): bit i of word w is element 64 w + i; a null word's bits are unknown."""
    x = words.select("index", "value", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return x.select((F.col("index") * 64 + F.col("i")).alias("element"), (F.call_function("bit_get", F.col("value"), F.col("i")) == 1).alias("value")).filter(F.col("element") < nr_bits)


def thin_superblock(data: Column) -> Column:
    """Fields of a thin superblock."""
    f = lambda start, n: le_number(data, start + 1, n)
    return F.struct(
        (f(4, 4).bitwiseAND(F.lit(1)) > 0).alias("needs_check"), f(8, 8).alias("block"), f(40, 4).alias("version"), f(44, 4).alias("time"),
        f(48, 8).alias("transaction"), f(56, 8).alias("metadata_snap"), F.substring(data, 65, 128).alias("data_sm_root"),
        F.substring(data, 193, 128).alias("metadata_sm_root"), f(320, 8).alias("mapping_root"), f(328, 8).alias("details_root"),
        f(336, 4).alias("data_block_size"), f(344, 8).alias("nr_metadata_blocks"))


def cache_superblock(data: Column) -> Column:
    """Fields of a cache superblock; dirty_root from version 2 on only."""
    f = lambda start, n: le_number(data, start + 1, n)
    numbers = [("block", 8, 8), ("version", 40, 4), ("hint_size", 60, 4), ("mapping_root", 192, 8), ("hint_root", 200, 8), ("discard_root", 208, 8), ("discard_block_size", 216, 8),
               ("discard_nr_blocks", 224, 8), ("data_block_size", 232, 4), ("cache_blocks", 240, 4), ("compat_flags", 244, 4), ("compat_ro_flags", 248, 4), ("incompat_flags", 252, 4),
               ("read_hits", 256, 4), ("read_misses", 260, 4), ("write_hits", 264, 4), ("write_misses", 268, 4)]
    return F.struct(
        (f(4, 4).bitwiseAND(F.lit(1)) > 0).alias("clean_shutdown"), (f(4, 4).bitwiseAND(F.lit(2)) > 0).alias("needs_check"), *(f(at, n).alias(name) for name, at, n in numbers),
        F.element_at(F.split(F.substring(data, 45, 16).cast("string"), "\0"), 1).alias("policy"), F.array(f(272, 4), f(276, 4), f(280, 4)).alias("policy_version"),
        F.substring(data, 65, 128).alias("metadata_sm_root"), F.when(f(40, 4) >= 2, f(284, 8)).alias("dirty_root"))


def era_superblock(data: Column) -> Column:
    """Fields of an era superblock."""
    f = lambda start, n: le_number(data, start + 1, n)
    numbers = [("block", 8, 8), ("version", 40, 4), ("data_block_size", 172, 4), ("nr_blocks", 180, 4), ("current_era", 184, 4), ("nr_bits", 188, 4), ("current_root", 192, 8),
               ("writeset_tree_root", 200, 8), ("era_array_root", 208, 8), ("metadata_snap", 216, 8)]
    return F.struct((f(4, 4).bitwiseAND(F.lit(1)) > 0).alias("clean_shutdown"), *(f(at, n).alias(name) for name, at, n in numbers), F.substring(data, 45, 128).alias("metadata_sm_root"))


FIELDS = {"thin": thin_superblock, "cache": cache_superblock, "era": era_superblock}


def superblock(spark: SparkSession, image: DataFrame, snapshot: bool = False, kind: str = "thin") -> DataFrame:
    """The superblock at block 0 or, for a snapshot (not of a cache), at its metadata_snap; no snapshot, or a bad checksum, raises."""
    main = image.filter("loc = 0")
    if snapshot:
        loc = main.select(FIELDS[kind](F.col("data"))["metadata_snap"]).first()[0]
        if not loc:
            raise ValueError("no metadata snapshot")
        main = image.filter(F.col("loc") == loc)
    ok = F.when(F.col("kind") == f"{kind} superblock", F.col("kind")).otherwise(F.raise_error(F.lit("bad checksum in superblock")))
    return with_kind(main).withColumn("kind", ok).select("kind", FIELDS[kind](F.col("data")).alias("sb")).select("kind", "sb.*")
