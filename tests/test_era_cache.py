"""Eras and caches: known results."""

import pytest

from blockloom.operators import cache, era

ARRAY = [(7 * k + k * k) % 4 for k in range(24)]
WRITESETS = [(e, b) for e in (5, 6, 8) for b in range(24) if (b * e) % 11 < 2]


def ranges(blocks):
    out = []
    for b in sorted(blocks):
        if out and out[-1][1] == b:
            out[-1] = (out[-1][0], b + 1)
        else:
            out.append((b, b + 1))
    return out


@pytest.mark.parametrize("writesets", [WRITESETS, []])
@pytest.mark.parametrize("since", [0, 2, 3, 4, 5, 6, 9])
def test_invalidate(spark, since, writesets):
    """The array counts only if eras older than the oldest writeset are asked for."""
    found = {b for e, b in writesets if e >= since}
    if not writesets or min(e for e, _ in writesets) > since:
        found |= {b for b, e in enumerate(ARRAY) if e >= since}
    ws, arr = spark.createDataFrame(writesets, "era long, block long"), spark.createDataFrame(list(enumerate(ARRAY)), "block long, era long")
    assert sorted(map(tuple, era.invalidate(ws, arr, since).collect())) == ranges(found)


def test_eras(spark):
    ws = spark.createDataFrame(WRITESETS, "era long, block long")
    arr = spark.createDataFrame(list(enumerate(ARRAY)), "block long, era long")
    got = {r.block: r.era for r in era.logical(ws, arr).collect()}
    assert got == {b: max([e for e, x in WRITESETS if x == b], default=ARRAY[b]) for b in range(24)}
    assert sorted(r.era for r in era.missing_eras(ws, 9).collect()) == [7, 9]
    assert era.all_writesets(ws, spark.createDataFrame([(9, 1)], "era long, block long")).count() == len(WRITESETS) + 1
    with pytest.raises(Exception, match="archived"):
        era.all_writesets(ws, spark.createDataFrame([(5, 1)], "era long, block long")).collect()


C = "cblock long, oblock long, is_valid int, is_dirty int"


def test_cache(spark):
    c = spark.createDataFrame([(0, 5, 1, 1), (1, 6, 1, 0), (2, 0, 0, 0), (3, 5, 1, 0), (4, 9, 0, 1), (5, 70, 1, 1)], C)
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(cache.writeback(c, True, 1)) == [0, 5]
    assert ids(cache.writeback(c, False, 1)) == [0, 1, 3, 5]
    assert ids(cache.writeback(c, True, 2, spark.createDataFrame([(1,), (2,)], "cblock long"))) == [1]
    found = sorted((r.kind, r.cblock) for r in cache.check(c, 50).collect())
    assert found == [("dirty but invalid", 4), ("duplicate origin", 3), ("mapped but invalid", 4), ("out of bounds", 5)]
    bits = spark.createDataFrame([(0, False), (1, None)], "cblock long, dirty boolean")
    assert {r.cblock: r.dirty for r in cache.with_dirty(c, bits).collect()} == {0: False, 1: True, 3: True, 5: True}
    flags = c.selectExpr("*", "cast(case when cblock = 0 then 7 when cblock = 1 then 2 else 1 end as bigint) as flags")
    assert sorted(r.cblock for r in cache.check(flags, version=1).filter("kind = 'unknown flags'").collect()) == [0]
    assert sorted(r.cblock for r in cache.check(flags, version=2, dirty_bits=spark.createDataFrame([], "cblock long")).filter("kind = 'unknown flags'").collect()) == [0, 1]


def test_stream(spark, tmp_path):
    from blockloom.streaming import era_tracker

    for k, rows in enumerate(([(1, 3), (2, 4)], [(1, 7), (3, 1)])):
        spark.createDataFrame(rows, "block long, era long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("block long, era long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(era_tracker.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "v1")).select("block", "era").collect())) == [(1, 7), (2, 4), (3, 1)]
