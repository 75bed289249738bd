"""Scalars, codecs, XML round trips and binary images."""

import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom import schema
from blockloom.functions import codec, packing, scalar
from blockloom.operators import repair, thin
from blockloom.plans import format_queries
from blockloom.sinks import image as to_image, text
from blockloom.sources import image, xml


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_sizes(spark):
    n = lambda x: F.lit(x).cast("long")
    assert one(spark, scalar.thin_metadata_bytes(n(2097152), n(128), n(1)) / 512) == (1064.0,)
    assert one(spark, scalar.cache_metadata_bytes(n(1024), n(1)) / 512, scalar.cache_metadata_bytes(n(67108864), n(1)) / 512) == (8248.0, 3678208.0)


def test_units(spark):
    rows = [("16", 8192), ("3b", 3), ("2KiB", 2048), ("2K", 2000), ("1m", 1 << 20), ("5exabyte", 5 * 10**18), ("16EiB", None), ("18446744073709551615b", (1 << 64) - 1), ("18446744073709551616b", None), ("9223372036854775807b", (1 << 63) - 1), ("99999999999999999999E", None), ("x", None), ("", None), ("4 k", None), ("1Kb", None)]
    df = spark.createDataFrame([(t, None if n is None else Decimal(n)) for t, n in rows], "t string, n decimal(38,0)").select("t", "n", scalar.parse_size(F.col("t")).alias("got"))
    assert all(r.n == r.got for r in df.collect())
    pretty = [(0, "0b"), (8192, "8192b"), (8193, "8KiB"), (1 << 20, "1024KiB"), (8192 << 10, "8192KiB"), ((8192 << 10) + 512, "8192KiB"), (8193 << 10, "8MiB"), (1 << 40, "1024GiB"), (9000 << 30, "9Tib"), (1 << 62, "4096PiB")]
    df = spark.createDataFrame(pretty, "n long, t string").select("n", "t", scalar.pretty_size(F.col("n")).alias("got"))
    assert [(r.n, r.got) for r in df.collect() if r.got != r.t] == []


@pytest.mark.parametrize("bad", ["23,7890", "23..six", "found..7890", "89..88", "89..89", "89..", "", "89...99"])
def test_ranges(spark, bad):
    assert one(spark, scalar.parse_range(F.lit(bad)).isNull(), scalar.parse_range(F.lit("4..9"))["end"]) == (True, 9)


def test_packing(spark):
    x = schema.pack_block_time(F.lit((1 << 40) - 1).cast("long"), F.lit(77).cast("long"))
    block, time = schema.unpack_block_time(x)
    assert one(spark, block, time) == ((1 << 40) - 1, 77)
    with pytest.raises(Exception, match="2\\^63"):
        schema.unsigned(spark.createDataFrame([(-1,)], "x long"), "x").collect()


def test_crc32c(spark):
    rows = [("123456789", 0xE3069283), ("", 0), ("a", 0xC1D04330)]
    df = spark.createDataFrame(rows, "t string, crc long").select("crc", codec.crc32c(F.col("t").cast("binary")).alias("got"))
    assert all(r.crc == r.got for r in df.collect())


def test_delta_lists(spark):
    lists = [[], [5], [1, 2, 3, 3, 3, 9, 7, 5], [4, 4], [0, 10, 20, 25]]
    df = spark.createDataFrame([(x,) for x in lists], "v array<bigint>").select("v", codec.delta_encode(F.col("v")).alias("e")).select("v", "e", codec.delta_decode(F.col("e")).alias("d"))
    for r in df.collect():
        assert r.v == r.d
    steps = df.filter("size(v) = 8").first().e
    assert [tuple(s) for s in steps] == [("base", 1, 1), ("pos", 1, 2), ("const", 0, 2), ("pos", 6, 1), ("neg", 2, 2)]


def test_lcg():
    assert codec.lcg(0, 3) == [0, 1442695040888963407, (6364136223846793005 * 1442695040888963407 + 1442695040888963407) % (1 << 64)]


def seal(block: bytearray, kind: str) -> bytes:
    crc = int(codec.crc32c_rows(np.frombuffer(bytes(block[4:]), np.uint8)[None, :])[0])
    block[:4] = struct.pack("<I", crc ^ 0xFFFFFFFF ^ codec.SALTS[kind])
    return bytes(block)


def node(loc, leaf, keys, values, room=252):
    b = bytearray(4096)
    struct.pack_into("<IIQIII", b, 0, 0, 2 if leaf else 1, loc, len(keys), room, 8)
    for k, (key, v) in enumerate(zip(keys, values)):
        struct.pack_into("<Q", b, 32 + 8 * k, key)
        struct.pack_into("<Q", b, 32 + 8 * room + 8 * k, v)
    return seal(b, "node")


def test_image(spark, tmp_path):
    sb = bytearray(4096)
    struct.pack_into("<IIQ16sQIIQQ", sb, 0, 0, 1, 0, b"", 27022010, 2, 3, 9, 0)
    struct.pack_into("<QQIIQ", sb, 320, 1, 5, 128, 8, 64)
    bitmap = bytearray(4096)
    struct.pack_into("<IIQQ", bitmap, 0, 0, 0, 4, 0b11_01_10_00)
    full = list(range(100, 200))
    data = [seal(sb, "thin superblock"), node(1, False, [0, 100, 500], [2, 3, 7]), node(2, True, range(90), [k << 24 | 5 for k in range(90)]), node(3, True, full, [k * 2 for k in full]),
            seal(bitmap, "bitmap"), node(5, True, [1, 2], [3, 4]), b"\0" * 4096, node(9, True, list(range(100)), range(100)), node(8, True, [3, 2, *range(10, 100)], range(92))]
    path = tmp_path / "image.bin"
    path.write_bytes(b"".join(data))
    im = image.blocks(spark, str(path))
    kinds = [r.kind for r in image.with_kind(im).orderBy("loc").collect()]
    assert kinds == ["thin superblock", "node", "node", "node", "bitmap", "node", "unknown", "node", "node"]
    s = image.superblock(spark, im).first()
    assert (s.transaction, s.time, s.mapping_root, s.details_root, s.data_block_size, s.nr_metadata_blocks, s.needs_check) == (9, 3, 1, 5, 128, 64, True)
    with pytest.raises(ValueError):
        image.superblock(spark, im, snapshot=True)
    decoded = image.nodes(image.with_kind(im).filter("kind = 'node'"), roots=[1])
    errors = {r.loc: r.error for r in decoded.collect()}
    assert errors == {1: None, 2: None, 3: None, 5: "too few entries", 7: "block number mismatch", 8: "keys out of order"}
    got = {r.key: r.value for r in image.tree(decoded, 1).collect()}
    assert got == {k: k << 24 | 5 for k in range(90)} | {k: 2 * k for k in full}
    sm = image.space_map(im.filter("loc = 4").selectExpr("0L as index", "data"), spark.createDataFrame([(3, 40)], "block long, ref_count long"), 5)
    assert {r.block: r.ref_count for r in sm.collect()} == {0: 0, 1: 1, 2: 2, 3: 40, 4: 0}


def test_walk_reports_what_is_broken(spark):
    """Siblings of a broken, a missing and a misplaced child are read; the errors tell which keys are lost."""
    full = lambda lo: list(range(lo, lo + 100))
    data = {1: node(1, False, [0, 100, 200, 300], [2, 3, 4, 6]), 2: node(2, True, full(0), full(0)), 3: node(9, True, full(100), full(0)), 6: node(6, True, full(250), full(0)), 7: node(7, True, [1 << 63], [0])}
    im = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "loc long, data binary")
    decoded = image.nodes(im, roots=[1, 7])
    entries, errors = image.walk(decoded, spark.createDataFrame([(1,), (7,)], "root long"))
    assert sorted(r.key for r in entries.collect()) == full(0) and entries.first().path == [1, 2]
    assert {(r.loc, r.error, r.key_low, r.key_high) for r in errors.collect()} == {
        (3, "block number mismatch", 100, 200), (4, "unreadable", 200, 300), (6, "keys outside the parent's range", 300, None), (7, "number of 2^63 or more", None, None)}


def test_delta_and_era_documents(spark):
    sb = spark.createDataFrame([("u&'<", 1, 2, 128, 900)], "uuid string, time long, transaction long, data_block_size long, nr_data_blocks long")
    pieces = [("same", 0, 5, None, None, 2), ("differ", 2, None, 7, 9, 1), ("differ", 3, None, 1, 2, 1), ("left_only", 9, 4, None, None, 3)]
    delta = spark.createDataFrame(pieces, "kind string, thin_begin long, data_begin long, left_data_begin long, right_data_begin long, len long")
    lines = [r.line for r in text.delta_xml(delta, sb, 1, 2).collect()]
    assert lines[0].startswith('<superblock uuid="u&amp;&apos;&lt;"') and lines[1] == '  <diff left="1" right="2">' and lines[-2:] == ["  </diff>", "</superblock>"]
    assert lines[2:-2] == ['    <same begin="0" length="2"/>', '    <different begin="2" length="1"/>', '    <different begin="3" length="1"/>', '    <left_only begin="9" length="3"/>']
    lines = [r.line.strip() for r in text.delta_xml(delta, sb, 1, 2, verbose=True).collect()]
    assert lines[2:-2] == ["<same>", '<range begin="0" data_begin="5" length="2"/>', "</same>", "<different>", '<range begin="2" left_data_begin="7" right_data_begin="9" length="1"/>',
                           '<range begin="3" left_data_begin="1" right_data_begin="2" length="1"/>', "</different>", "<left_only>", '<range begin="9" data_begin="4" length="3"/>', "</left_only>"]
    era_sb = spark.range(1).selectExpr("'x' as uuid", "128 as block_size", "4 as nr_blocks", "5 as current_era")
    bits = text.era_xml(era_sb, spark.createDataFrame([(3, 4)], "era long, nr_bits long"), spark.createDataFrame([(3, 1, 3)], "era long, begin long, end long"), spark.createDataFrame([], "block long, era long"), compact=False)
    assert [r.line.strip() for r in bits.collect()][2:6] == ['<bit block="%d" value="%s"/>' % (k, "true" if k in (1, 2) else "false") for k in range(4)]


def test_array_block(spark):
    b = bytearray(4096)
    struct.pack_into("<IIIIQ", b, 0, 0, 509, 3, 8, 7)
    struct.pack_into("<QQQ", b, 24, 11, 1 << 40, 13)
    df = spark.createDataFrame([(bytearray(seal(b, "array")),)], "data binary")
    assert image.arrays(df.selectExpr("7L as loc", "data")).first()["values"] == [11, 1 << 40, 13]
    assert image.with_kind(df).first().kind == "array"


def test_thin_xml_round_trip(spark, tmp_path):
    sb = spark.createDataFrame([("u", 1, 2, 2, 128, 900)], "uuid string, time long, transaction long, version long, data_block_size long, nr_data_blocks long")
    dev = spark.createDataFrame([(1, 4, 1, 0, 0), (2, 2, 1, 0, 0)], "dev_id long, mapped_blocks long, transaction_id long, creation_time long, snapshotted_time long")
    m = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 6, 1), (1, 2, 7, 2), (1, 9, 1, 0), (2, 0, 5, 1), (2, 4, 4, 4)], "dev_id long, thin_block long, data_block long, map_time long")
    runs = thin.dump_runs(m)
    lines = [r.line for r in text.thin_xml(sb, dev, runs).collect()]
    assert lines[0].startswith("<superblock ") and lines[-1] == "</superblock>" and lines[1].startswith("  <device dev_id=\"1\"") and "range_mapping" in lines[2]
    path = tmp_path / "dump.xml"
    path.write_text("\n".join(lines))
    got = xml.read_thin(spark, str(path), strict=False)
    assert sorted(map(tuple, got["runs"].collect())) == sorted(map(tuple, runs.select("dev_id", "thin_begin", "data_begin", "len", "map_time").collect()))
    assert got["superblock"].first().nr_data_blocks == 900 and got["devices"].count() == 2
    (tmp_path / "bad.xml").write_text("\n".join(lines).replace('creation_time="0"', 'creation_tim="0"', 1))
    assert xml.unknown_attributes(spark, str(tmp_path / "bad.xml"), "thin", "device") == ["creation_tim"]
    with pytest.raises(Exception, match="creation_time is missing"):
        xml.read_thin(spark, str(tmp_path / "bad.xml"), strict=False)["devices"].collect()


def test_thin_xml_in_splits(spark, tmp_path):
    """A dump is read in splits, with comments, other spellings and devices that cross them; what is broken raises."""
    doc = """<?xml version="1.0" encoding="UTF-8"?>
<!-- <device dev_id="9"> --><!-- a > b
<single_mapping origin_block="1" data_block="2" time="3"/>
-->
<superblock uuid="a&amp;&quot;&#x41;&#10;-->" time='6' transaction="7" data_block_size="128" nr_data_blocks="3000000">
<def name="d &lt; 'x' time=&quot;5&quot;"><range_mapping length="3" origin_begin="1" data_begin="5" time="0"/><single_mapping origin_block="1" data_block="2" time="3"/></def>
  <device dev_id="1" mapped_blocks="4" transaction="1" creation_time="0" snap_time="0">
    <single_mapping origin_block="10" data_block="20" time="3"/> text
    <!-- gone: <range_mapping origin_begin="1" data_begin="5" length="3" time="0"/>
    <single_mapping origin_block="11" data_block="21" time="3"/> --><single_mapping  origin_block = '12' data_block="22" time="3" />
    <ref name="d &lt; 'x' time=&quot;5&quot;"/>
  </device>
  <device dev_id="2" mapped_blocks="0" transaction="1" creation_time="0" snap_time="0"/>
"""
    for d in range(3, 12):
        runs = "".join(f'    <range_mapping origin_begin="{k}" data_begin="{k + 1}" length="2" time="0"/>\n' for k in range(0, d * 7, 3))
        doc += f'  <device dev_id="{d}" mapped_blocks="9" transaction="1" creation_time="0" snap_time="0">\n{runs}  </device>\n'
    doc += "</superblock>\n"
    want = sorted([(1, 10, 20, 1, 3), (1, 12, 22, 1, 3)] + [(d, k, k + 1, 2, 0) for d in range(3, 12) for k in range(0, d * 7, 3)])
    path = tmp_path / "dump.xml"
    conf = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        path.write_text(doc)
        got = xml.read_thin(spark, str(path))
        assert xml._tags(spark, str(path)).rdd.getNumPartitions() > 5
        assert sorted(map(tuple, got["runs"].collect())) == want
        assert got["superblock"].first().uuid == 'a&"A\n-->' and sorted(r.dev_id for r in got["devices"].collect()) == [*range(1, 12)]
        name = "d < 'x' time=\"5\""
        assert [tuple(r) for r in got["refs"].collect()] == [(1, name)] and sorted(map(tuple, got["defs"].collect())) == [(name, 1, 2, 1, 3), (name, 1, 5, 3, 0)]
        for a, b, why in [('creation_time="0"', 'creation_tim="0"', "unknown attributes"), (' transaction="7"', "", "transaction is missing"), ("</superblock>", "", "not complete"), ("</device>", "", "may not"),
                          ('data_block="20"', 'data_block="x"', "no number"), ('data_block="20"', 'data_block="20" foo="1"', "unknown attributes"), ("<ref ", "<reff ", "unknown: <reff")]:
            path.write_text(doc.replace(a, b, 1))
            with pytest.raises(ValueError, match=why):
                xml.read_thin(spark, str(path))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_thin_document_is_written_by_executors(spark):
    """Parts of a dump are written side by side and follow each other in one file."""
    lines = spark.range(0, 50000, 1, 12).selectExpr("cast(id as string) as line")
    path = format_queries._document(lines)
    assert spark.read.text(path).inputFiles()[0].endswith("dump.xml") and [int(r.value) for r in spark.read.text(path).collect()] == [*range(50000)]


def test_cache_and_era_xml(spark, tmp_path):
    sb = spark.range(1).selectExpr("'x' as uuid", "512 as block_size", "9 as nr_cache_blocks", "'smq' as policy", "4 as hint_width")
    c = spark.createDataFrame([(1, 5, 1), (2, 6, 0)], "cblock long, oblock long, is_dirty int")
    hints = spark.createDataFrame([(1, bytearray(b"abcd"))], "cblock long, hint binary")
    (tmp_path / "c.xml").write_text("\n".join(r.line for r in text.cache_xml(sb, c, hints).collect()))
    got = xml.read_cache(spark, str(tmp_path / "c.xml"))
    assert sorted((r.cblock, r.oblock, r.is_dirty) for r in got["mappings"].collect()) == [(1, 5, 1), (2, 6, 0)] and bytes(got["hints"].first().hint) == b"abcd"
    era_sb = spark.range(1).selectExpr("'x' as uuid", "128 as block_size", "16 as nr_blocks", "5 as current_era")
    eras = spark.createDataFrame([(3, 16), (4, 16)], "era long, nr_bits long")
    marked = spark.createDataFrame([(3, 0, 2), (4, 4, 6), (4, 9, 10)], "era long, begin long, end long")
    array = spark.createDataFrame([(k, k % 3) for k in range(16)], "block long, era long")
    (tmp_path / "e.xml").write_text("\n".join(r.line for r in text.era_xml(era_sb, eras, marked, array).collect()))
    got = xml.read_era(spark, str(tmp_path / "e.xml"))
    assert sorted((r.era, r.block) for r in got["writesets"].collect()) == [(3, 0), (3, 1), (4, 4), (4, 5), (4, 9)]
    assert got["array"].count() == 16 and got["superblock"].first().current_era == 5


def test_grid(spark):
    df = spark.createDataFrame([(1, "abc"), (20, "x")], "dev long, n string")
    assert [r.line for r in text.grid(df, ["dev"]).collect()] == ["dev   n ", "  1 abc ", " 20   x "]


def played(code, n):
    reader = packing.Reader(code)
    out = np.frombuffer(reader.run(8 * n), "<u8").tolist()
    assert reader.at == len(code)
    return out


def test_packed_numbers():
    """Bytes of each instruction, worked out by hand; then whatever numbers come back."""
    assert packing.pack_numbers([]) == b"" and packing.pack_numbers([7]) == bytes([0x01, 7])
    assert packing.pack_numbers([300, 302, 304, 306]) == bytes([0x02, 0x2C, 1, 0x73, 0x12])
    assert packing.pack_numbers([70000, 69999, 69999]) == bytes([0x04, 0x70, 0x11, 1, 0, 0x31, 0x51])
    assert packing.pack_numbers([0] * 21) == bytes([0x01, 0, 0x60, 20]) and packing.pack_numbers([0, 16]) == bytes([0x01, 0, 0x21, 16])
    assert packing.pack_numbers([1 << 32, 0])[0] == 0x08 and packing.pack_numbers([1 << 32, 0])[9] == 0x48
    assert packing.pack_split([(5 << 24) | 1, (6 << 24) | 1]) == bytes([0xB0, 2, 0x01, 5, 0x11, 0x01, 1, 0x51])
    rng = np.random.default_rng(3)
    top = (1 << 64) - 1
    for numbers in [[top, 0, top], [0] * 9000, list(range(0, 30000, 3)), rng.integers(0, top, 500, dtype=np.uint64).tolist(), np.cumsum(rng.integers(0, 3, 2000)).tolist()]:
        assert played(packing.pack_numbers(numbers), len(numbers)) == numbers
        assert played(packing.pack_split(numbers[:4000]), len(numbers[:4000])) == numbers[:4000]
    for n in (0, 15, 16, 255, 256, 4096, 70000):
        data = rng.bytes(n)
        assert packing.Reader(packing.pack_bytes(data)).run(n) == data
    for bad in (b"\xf0", b"\x03\x01", b"\x04\x01", b"", b"\x9f\x01"):
        with pytest.raises(ValueError):
            packing.Reader(bad).run(8)


def test_packed_paths(spark):
    paths = [[], [0], [0, 0], [1], [0, 1, 2], [9, 5, 1 << 40], [0, *range(3, 130)], None]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k long, p array<bigint>").withColumn("t", packing.encode_path("p"))
    got = {r.k: (r.t, r.q) for r in df.select("k", "t", packing.decode_path("t").alias("q")).collect()}
    assert [got[k][1] for k in range(len(paths))] == paths
    assert got[0][0] == "AQ==" and got[1][0] == "AA=="  # one byte: no place, and the superblock alone
    for bad in ("", "AQ", "BA==", "!!!!"):
        with pytest.raises(ValueError):
            packing.text_path(bad)


def test_pack_file(spark, tmp_path):
    """Nodes of both value sizes, an inner node, a superblock, a node whose header lies; a block of no kind goes."""
    keys = lambda n: [5 * k for k in range(n)]
    nodes = spark.createDataFrame([(1, True, keys(200), [(k + 9) << 24 | k % 3 for k in range(200)]), (2, False, keys(90), list(range(90))), (3000, True, [], [])], "loc long, is_leaf boolean, keys array<long>, values array<long>")
    details = spark.createDataFrame([(4, True, keys(3), [bytes([k]) * 24 for k in range(3)])], "loc long, is_leaf boolean, keys array<long>, values array<binary>")
    top = to_image.pack_superblock(spark.range(1).select(F.lit(27022010).alias("magic")), "thin", [("magic", 32, 8)])
    lying = bytearray(4096)
    struct.pack_into("<IIQIII", lying, 0, 0, 2, 7, 1, 60000, 8)
    lying = to_image.seal(np.frombuffer(bytes(lying), np.uint8).reshape(1, -1).copy(), "node").tobytes()
    rest = spark.createDataFrame([(7, bytearray(lying)), (8, bytearray(b"x" * 4096))], "loc long, data binary")
    img = to_image.pack_nodes(nodes).unionByName(to_image.pack_nodes(details, 24)).unionByName(top).unionByName(rest)
    path = tmp_path / "image.pack"
    to_image.write_pack(img, str(path), 3001)
    data = path.read_bytes()
    assert struct.unpack_from("<QQQQ", data) == (0xA537A0AA6309EF77, 3, 4096, 3001) and len(data) < 4096
    want = {r.loc: bytes(r.data) for r in img.collect() if r.loc != 8}
    got = image.unpack(spark, str(path)).collect()
    assert len(got) == len(want) and {r.loc: bytes(r.data) for r in got} == want
    to_image.write_pack(img.limit(0), str(path), 5)
    assert image.unpack(spark, str(path)).count() == 0
    for k, bad in enumerate((b"", b"x" * 40, data[:8] + b"\4" + data[9:], data[:-3], data + b"\1")):
        (tmp_path / f"bad{k}").write_bytes(bad)
        with pytest.raises(Exception, match="pack file"):
            image.unpack(spark, str(tmp_path / f"bad{k}")).collect()


def test_discover_roots(spark):
    """A pool of two volumes, an older tree with one of them, and a tree that points at no node; with details for the pool, then without."""
    mapping = lambda k, t: ((k + 400) << 24) | t
    entries = [(1, k, mapping(k, k % 3)) for k in range(600)] + [(2, k, mapping(900 + k, 7)) for k in range(5)]
    trees, roots = to_image.pack_trees(spark.createDataFrame(entries, "tree long, key long, value long"), 1)
    at = {r.tree: r.root for r in roots.collect()}
    n = trees.count() + 1
    tops = [(n, True, [1, 2], [at[1], at[2]]), (n + 1, True, [1], [at[1]]), (n + 2, True, [1, 2], [at[1], n + 9])]
    top = to_image.pack_nodes(spark.createDataFrame(tops, "loc long, is_leaf boolean, keys array<long>, values array<long>"))
    detail = lambda mapped, tid, time: struct.pack("<QQII", mapped, tid, time, time)
    trees24 = [(n + 3, True, [1, 2], [detail(600, 4, 1), detail(5, 6, 9)]), (n + 4, True, [1, 2], [detail(600, 4, 1), detail(6, 6, 9)]), (n + 5, True, [1, 3], [detail(600, 4, 1), detail(5, 6, 9)])]
    details = to_image.pack_nodes(spark.createDataFrame(trees24, "loc long, is_leaf boolean, keys array<long>, values array<binary>"), 24)

    def found(img):
        img = img.persist()
        return [(*tuple(r)[:5], [tuple(h) for h in r.history]) for r in repair.discover(image.nodes(img, roots=None).persist(), image.nodes(img, 24, roots=None).persist(), n + 6).collect()]

    history = [(2, 200), (1, 200), (0, 200)]
    assert found(trees.unionByName(top).unionByName(details)) == [(n, n + 3, 9, 7, 900 + 4 + 401, [(7, 5), *history])]
    assert found(trees.unionByName(top)) == [(n, None, 8, 1, 1305, [(7, 5), *history]), (n + 1, None, 3, 1, 1000, history)]
    assert found(trees.limit(0)) == []
