"""Queries over images and XML: what the sinks write is read by the sources, and compared with the relation it was written from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..functions import packing
from ..operators import cache, check, era, repair, thin
from ..sinks import image as to_image, text
from ..sources import image, xml
from . import views as V
from .queries import _RUNS, query, runs_sql

#: Places of the fields written here (fixed values of the formats).
THIN_FIELDS = [("magic", 32, 8), ("version", 40, 4), ("time", 44, 4), ("transaction", 48, 8), ("mapping_root", 320, 8), ("details_root", 328, 8), ("data_block_size", 336, 4), ("nr_metadata_blocks", 344, 8)]
CACHE_FIELDS = [("flags", 4, 4), ("version", 40, 4), ("policy", 44, -16), ("hint_size", 60, 4), ("mapping_root", 192, 8), ("data_block_size", 232, 4), ("cache_blocks", 240, 4), ("dirty_root", 284, 8)]
ERA_FIELDS = [("flags", 4, 4), ("version", 40, 4), ("data_block_size", 172, 4), ("nr_blocks", 180, 4), ("current_era", 184, 4), ("nr_bits", 188, 4), ("era_array_root", 208, 8)]


def scratch(spark, name: str) -> str:
    """A new place in the warehouse, which all executors share; it goes when the driver ends."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch/{uuid.uuid4().hex}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    return path


def kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def little(c, n: int):
    """A number as n bytes, the least first."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(n)))


def thin_image(spark, d) -> DataFrame:
    """(loc, data) of a pool: superblock, mapping trees and the tree of their roots, details tree."""
    packed = schema.pack_block_time(F.col("data_block"), F.col("map_time"))
    trees, roots = to_image.pack_trees(V.thin_mappings(spark, d).select(F.col("dev_id").alias("tree"), F.col("thin_block").alias("key"), packed.alias("value")), 1)
    trees, roots = kept(trees), kept(roots)
    n = trees.count() + 1
    one = F.lit(0).cast("long").alias("tree")
    top, top_root = to_image.pack_trees(roots.select(one, F.col("tree").alias("key"), F.col("root").alias("value")), n)
    top, n = kept(top), n
    detail = F.concat(little(F.col("mapped_blocks"), 8), little(F.col("transaction_id"), 8), little(F.col("creation_time"), 4), little(F.col("snapshotted_time"), 4))
    details, detail_root = to_image.pack_trees(V.thin_devices(spark, d).select(one, F.col("dev_id").alias("key"), detail.alias("value")), n + top.count(), 24)
    details = kept(details)
    fields = top_root.select(F.col("root").alias("mapping_root")).crossJoin(detail_root.select(F.col("root").alias("details_root"))).select(
        "*", F.lit(27022010).alias("magic"), F.lit(2).alias("version"), F.lit(6).alias("time"), F.lit(7).alias("transaction"), F.lit(V.BLOCK_SECTORS).alias("data_block_size"), F.lit(n + top.count() + details.count()).alias("nr_metadata_blocks"))
    return kept(to_image.pack_superblock(fields, "thin", THIN_FIELDS).unionByName(trees).unionByName(top).unionByName(details))


def decoded(img: DataFrame, value_size: int = 8) -> DataFrame:
    return kept(image.nodes(image.with_kind(img).filter("kind = 'node'"), value_size, roots=None))


def volumes(spark, img: DataFrame) -> DataFrame:
    """dev_id, root, key, value, path of all mapping trees, from the superblock on. Whatever is broken raises."""
    nodes = decoded(img)
    top, lost = image.walk(nodes, image.superblock(spark, img).select(F.col("mapping_root").alias("root")))
    devices = top.select(F.col("key").alias("dev_id"), F.col("value").alias("root"))
    entries, broken = image.walk(nodes, devices.select("root"))
    if not lost.unionByName(broken).isEmpty():
        raise ValueError("broken trees")
    return entries.join(devices, "root")


#: Blocks of each mapping tree: leaves, and what is above them.
_BLOCKS = """, lv as (select dev_id, count(*) as n, ceil(count(*) / 252.0)::bigint as l1 from m group by dev_id),
lw as (select *, case when l1 > 1 then ceil(l1 / 252.0)::bigint else 0 end as l2 from lv), bl as (select *, l1 + l2 + case when l2 > 1 then ceil(l2 / 252.0)::bigint else 0 end as blocks from lw)
"""
_KINDS = _BLOCKS + "select 'thin superblock' as kind, 1 as n union all select 'node', (select sum(blocks) from bl)::bigint + 2"
_KINDS = _KINDS.replace("1 as n union", "1::bigint as n union")


@query(_KINDS)
def src_kind(spark, d):
    """Kinds of the blocks of an image, from their checksums."""
    return image.with_kind(thin_image(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(_KINDS)
def src_image(spark, d):
    """The same from a file of blocks."""
    path = scratch(spark, "image.bin")
    to_image.write_file(thin_image(spark, d), path)
    return image.with_kind(image.blocks(spark, path)).groupBy("kind").agg(F.count("*").alias("n"))


@query("select dev_id, thin_block, data_block, map_time from m")
def snk_thin_bin(spark, d):
    """Volumes written as an image file and read back from its superblock on."""
    path = scratch(spark, "image.bin")
    to_image.write_file(thin_image(spark, d), path)
    block, time = schema.unpack_block_time(F.col("value"))
    return volumes(spark, kept(image.blocks(spark, path))).select("dev_id", F.col("key").alias("thin_block"), block.alias("data_block"), time.alias("map_time"))


def packed(spark, d) -> DataFrame:
    """Blocks of an image after packing and unpacking, with a block of no kind behind them, which is dropped."""
    path = scratch(spark, "image.pack")
    img = thin_image(spark, d)
    n = img.count()
    stray = spark.range(1).select(F.lit(n).cast("long").alias("loc"), F.expr("cast(repeat('x', 4096) as binary)").alias("data"))
    to_image.write_pack(img.unionByName(stray), path, n + 1)
    return image.unpack(spark, path)


@query(_KINDS)
def src_pack(spark, d):
    return image.with_kind(packed(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("select dev_id, thin_block, data_block, map_time from m")
def snk_pack(spark, d):
    """Volumes packed, unpacked and read from the superblock on."""
    block, time = schema.unpack_block_time(F.col("value"))
    return volumes(spark, kept(packed(spark, d))).select("dev_id", F.col("key").alias("thin_block"), block.alias("data_block"), time.alias("map_time"))


def _set_hex(c: str) -> str:
    """SQL: the instruction that sets a number, with its operand's bytes from the least on."""
    byte = lambda k: f"printf('%02x', ({c} >> {8 * k}) & 255)"
    return f"case when {c} < 256 then '01' || {byte(0)} when {c} < 65536 then '02' || {byte(0)} || {byte(1)} else '04' || {' || '.join(byte(k) for k in range(4))} end"


@query(f"select k, to_base64(unhex('06' || {_set_hex('k')} || '1' || printf('%x', n) || '36')) as path, k + n - 6 as leaf from (select o_orderkey as k, 9 + o_custkey % 7 as n from orders)", views=False)
def fn_path(spark, d):
    """Paths (superblock, k, k + n, k + n - 6) as text, and the last place of the text read again."""
    k, n = F.col("o_orderkey"), 9 + F.col("o_custkey") % 7
    x = V.table(spark, d, "orders").select(k.alias("k"), packing.encode_path(F.array(F.lit(0).cast("long"), k, k + n, k + n - 6)).alias("path"))
    return x.select("k", "path", F.element_at(packing.decode_path("path"), -1).alias("leaf"))


@query("select thin_block as key, (data_block << 24) | map_time as value from m union all select dev_id, null from d")
def src_node(spark, d):
    """Entries of all leaves with 8-byte values but those of the tree of roots, whose values are places, not mappings."""
    img = thin_image(spark, d)
    nodes = decoded(img)
    top = image.superblock(spark, img).select(F.col("mapping_root").alias("loc"))
    leaves = nodes.filter("is_leaf and error is null").join(F.broadcast(top.withColumn("is_top", F.lit(True))), "loc", "left")
    return leaves.select("is_top", F.explode("entries").alias("e")).select("e.key", F.when(F.col("is_top").isNull(), F.col("e.value")).alias("value"))


@query("select dev_id, thin_block as key, (data_block << 24) | map_time as value from m")
def src_btree(spark, d):
    """All mapping trees under the tree of their roots."""
    return volumes(spark, thin_image(spark, d)).select("dev_id", "key", "value")


@query(_BLOCKS + "select dev_id, n as n_keys, blocks as n_blocks from bl")
def src_btree_map(spark, d):
    """Keys and blocks of each tree."""
    e = kept(volumes(spark, thin_image(spark, d)).select("dev_id", "root", "key", "path"))
    keys = image.key_set(e).groupBy("root").agg(F.count("*").alias("n_keys"))
    return e.select("dev_id", "root").distinct().join(keys, "root").join(image.block_counts(e), "root").select("dev_id", "n_keys", "n_blocks")


@query("select dev_id, thin_block as key, step from (select *, row_number() over (partition by dev_id order by thin_block) as step from m where thin_block >= 1000) where step <= 500")
def src_iter(spark, d):
    """500 steps of a cursor on each tree from key 1000 on."""
    e = volumes(spark, thin_image(spark, d)).select("dev_id", "root", "key")
    return image.iterate(e, 1000, 500).select("dev_id", "key", F.col("step").cast("long").alias("step"))


@query("select dev_id, mapped_blocks, transaction_id, creation_time, snapshotted_time from d")
def src_details(spark, d):
    """Device details: leaves with 24-byte values."""
    img = thin_image(spark, d)
    return image.device_details(image.walk(decoded(img, 24), image.superblock(spark, img).select(F.col("details_root").alias("root")))[0])


@query("""select 'thin' as kind, 2::bigint as version, 128::bigint as block_size, 7::bigint as n, '' as policy union all
select 'cache', 2, 512, (select count(*) from c), 'smq' union all select 'era', 1, 128, (select count(*) from ea), ''""")
def src_sb(spark, d):
    """Superblocks of the three kinds."""
    one = lambda **v: spark.range(1).select(*((x if hasattr(x, "alias") else F.lit(x)).alias(k) for k, x in v.items()))
    caches = V.cache_mappings(spark, d).agg(F.count("*").alias("cache_blocks")).join(one(flags=1, version=2, policy="smq", hint_size=4, mapping_root=1, data_block_size=512, dirty_root=2))
    eras = V.era_array(spark, d).agg(F.count("*").alias("nr_blocks")).join(one(flags=1, version=1, data_block_size=128, current_era=31, nr_bits=2000, era_array_root=1))
    a = image.superblock(spark, thin_image(spark, d)).select(F.lit("thin").alias("kind"), "version", F.col("data_block_size").alias("block_size"), F.col("transaction").alias("n"), F.lit("").alias("policy"))
    b = image.superblock(spark, to_image.pack_superblock(caches, "cache", CACHE_FIELDS), kind="cache").filter("dirty_root = 2 and clean_shutdown and not needs_check")
    c = image.superblock(spark, to_image.pack_superblock(eras, "era", ERA_FIELDS), kind="era").filter("current_era = 31 and era_array_root = 1 and clean_shutdown")
    return a.unionByName(b.select(F.lit("cache").alias("kind"), "version", F.col("data_block_size").alias("block_size"), F.col("cache_blocks").alias("n"), "policy")).unionByName(
        c.select(F.lit("era").alias("kind"), "version", F.col("data_block_size").alias("block_size"), F.col("nr_blocks").alias("n"), F.lit("").alias("policy")))


@query("select cblock, oblock, is_valid::bigint as is_valid, is_dirty::bigint as is_dirty from c where is_valid = 1 or is_dirty = 1")
def src_array(spark, d):
    """Cache mappings as an array: a tree from block numbers to array blocks, and their elements."""
    c = V.cache_mappings(spark, d)
    flags = F.col("is_valid") + 2 * F.col("is_dirty")
    values = c.select(F.col("cblock").alias("index"), (F.col("oblock") * 65536 + flags).cast("long").alias("value"))
    blocks = kept(to_image.pack_arrays(values, 1_000_000))
    tree, root = to_image.pack_trees(blocks.select(F.lit(0).cast("long").alias("tree"), (F.col("loc") - 1_000_000).alias("key"), F.col("loc").alias("value")), 1)
    nodes, root = decoded(kept(tree)), kept(root)
    found, broken = image.array_scan(image.arrays(image.with_kind(blocks).filter("kind = 'array'")), image.walk(nodes, root.select("root"))[0])
    if not broken.isEmpty():
        raise ValueError("broken array")
    flag = lambda k: F.shiftrightunsigned("value", k).bitwiseAND(F.lit(1))
    return found.filter("value <> 0").select(F.col("index").alias("cblock"), F.shiftrightunsigned("value", 16).alias("oblock"), flag(0).alias("is_valid"), flag(1).alias("is_dirty"))


@query(_BLOCKS + """, o as (select unnest(range(1, (select sum(l1) from bl)::bigint + 1)) as loc)
select loc, case loc % 5 when 1 then 'block number mismatch' when 2 then 'too few entries' when 3 then 'max entries not divisible by 3' else 'value size mismatch' end as error from o where loc % 5 > 0""")
def chk_node(spark, d):
    """Errors of leaves of which four in five are damaged: a wrong place, too few entries, a wrong room, a wrong value size."""
    img = thin_image(spark, d)
    leaves = image.nodes(image.with_kind(img).filter("kind = 'node'"), roots=None).filter("is_leaf and error is null").select("loc")
    top = image.superblock(spark, img).select(F.col("mapping_root").alias("loc"))
    put = lambda at, b: F.concat(F.substring("data", 1, at), F.lit(b), F.substring("data", at + 5, image.BLOCK))
    kind = F.col("loc") % 5
    data = F.when(kind == 1, put(8, b"\xff\xff\xff\x00")).when(kind == 2, put(16, b"\x01\0\0\0")).when(kind == 3, put(20, b"\xfd\0\0\0")).when(kind == 4, put(24, b"\x09\0\0\0")).otherwise(F.col("data"))
    damaged = img.join(leaves.join(top, "loc", "left_anti"), "loc", "left_semi").select("loc", data.alias("data"))
    return image.nodes(damaged, roots=[]).filter("error is not null").select("loc", "error")


@query(_BLOCKS + """, t as (select (select sum(blocks) from bl)::bigint + 1 as top)
select top as mapping_root, top + 2 as details_root, greatest((select max(map_time) from m), (select max(greatest(creation_time, snapshotted_time)) from d))::bigint as time, (select max(transaction_id) + 1 from d)::bigint as transaction_id,
(select max(data_block) + 1 from m)::bigint as nr_data_blocks, (select string_agg(map_time || ':' || n, ',' order by map_time desc) from (select map_time, count(*) as n from m group by all)) as history from t""")
def op_discover_roots(spark, d):
    """Roots of a pool without its superblock; of its two trees of details the first has a wrong count, the second the right ones."""
    img = thin_image(spark, d)
    n = img.count()
    counts = V.thin_mappings(spark, d).groupBy("dev_id").agg(F.count("*").alias("n"))
    fixed = V.thin_devices(spark, d).join(counts, "dev_id")
    detail = F.concat(little(F.col("n"), 8), little(F.col("transaction_id"), 8), little(F.col("creation_time"), 4), little(F.col("snapshotted_time"), 4))
    more, _ = to_image.pack_trees(fixed.select(F.lit(0).cast("long").alias("tree"), F.col("dev_id").alias("key"), detail.alias("value")), n, 24)
    rest = kept(img.filter("loc > 0").unionByName(more))
    found = repair.discover(decoded(rest), decoded(rest, 24), n + more.count())
    return found.withColumn("history", F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["time"], h["n"])), ","))


@query("select p_partkey as k, p_size * 64 as data_block_size from part where p_size * 64 < 128 or p_size * 64 > 2097152 or p_size % 2 = 1", views=False)
def chk_block_size(spark, d):
    """Sizes that a restore refuses."""
    return check.block_sizes(V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 64).alias("data_block_size")))


@query(f"""select dev_id, thin_begin, data_begin, n as len, map_time from (select *, max(thin_begin + n) over (partition by dev_id order by thin_begin, data_begin rows between unbounded preceding and 1 preceding) as p
 from (select dev_id, thin_begin, data_begin, n + case when thin_begin % 5 = 0 then 40 else 0 end as n, map_time from {_RUNS} r) s) t where thin_begin < p""")
def chk_restore_order(spark, d):
    """Runs that begin inside an earlier one of their volume, where one in five is 40 blocks too long."""
    runs = thin.dump_runs(V.thin_mappings(spark, d))
    return check.thin_overlaps(runs.withColumn("len", F.col("len") + F.when(F.col("thin_begin") % 5 == 0, 40).otherwise(0)))


def _document(lines: DataFrame) -> str:
    """Lines as one file: a dump is a document. Executors write its parts, the driver puts their bytes one behind the other."""
    spark = lines.sparkSession
    parts, path = scratch(spark, "lines"), scratch(spark, "dump.xml")
    lines.write.text(parts)
    text.join_files(spark, parts, path)
    return path


@query(f"select dev_id, thin_begin, data_begin, n as len, map_time from {_RUNS}")
def src_xml_thin(spark, d):
    """Runs of a volume dump, written and read; unknown attributes raise."""
    sb = spark.range(1).selectExpr("'a&\"b<' as uuid", "6 as time", "7 as transaction", "2 as version", "128 as data_block_size", "3000000 as nr_data_blocks")
    m = kept(V.thin_mappings(spark, d))
    read = xml.read_thin(spark, _document(text.thin_xml(sb, V.devices_of(m), kept(thin.dump_runs(m)))))
    if read["superblock"].first().uuid != 'a&"b<':
        raise ValueError("the text of an attribute changed")
    return read["runs"]


@query("select cblock, oblock, is_dirty::bigint as is_dirty, case when cblock % 3 = 0 then 'h' || cblock end as hint from c where is_valid = 1")
def src_xml_cache(spark, d):
    """Mappings and hints of a cache dump, written and read."""
    sb = spark.range(1).selectExpr("'' as uuid", "512 as block_size", "4096 as nr_cache_blocks", "'smq' as policy", "4 as hint_width")
    c = cache.valid(V.cache_mappings(spark, d))
    hints = c.filter("cblock % 3 = 0").select("cblock", F.concat(F.lit("h"), F.col("cblock").cast("string")).cast("binary").alias("hint"))
    read = xml.read_cache(spark, _document(text.cache_xml(sb, c, hints)))
    return read["mappings"].join(read["hints"], "cblock", "left").select("cblock", "oblock", F.col("is_dirty").cast("long").alias("is_dirty"), F.col("hint").cast("string").alias("hint"))


@query("select 'writeset' as part, era, block from ws union all select 'array', era, block from ea")
def src_xml_era(spark, d):
    """Writesets and array of an era dump, written and read."""
    sb = spark.range(1).selectExpr("'' as uuid", "128 as block_size", "2000 as nr_blocks", "31 as current_era")
    w = V.era_writesets(spark, d)
    read = xml.read_era(spark, _document(text.era_xml(sb, w.select("era", F.lit(2000).alias("nr_bits")).distinct(), era.marked_ranges(w), V.era_array(spark, d))))
    part = lambda name, x: x.select(F.lit(name).alias("part"), "era", "block")
    return part("writeset", read["writesets"]).unionByName(part("array", read["array"]))
