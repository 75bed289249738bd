"""Volumes: known listings, deltas, runs, remaps, atomic sequences, gaps."""

import random

import pytest

from blockloom.operators import check, islands, rangejoin, repair, thin

M = "dev_id long, thin_block long, data_block long, map_time long"


def blocks(*runs):
    """Rows of (dev, thin, data, len) runs."""
    return [(d, t + k, b + k, 0) for d, t, b, n in runs for k in range(n)]


@pytest.mark.parametrize("runs,expected", [
    ([], []),
    ([(1, 30, 0, 700), (2, 5, 700, 40)], [(1, 700, 700, 0, 729), (2, 40, 40, 0, 44)]),
    ([(3, 0, 90, 60), (4, 8, 100, 20), (3, 300, 7, 5), (4, 64, 1, 3)], [(3, 65, 45, 20, 304), (4, 23, 3, 20, 66)]),
])
def test_listing(spark, runs, expected):
    m = spark.createDataFrame(blocks(*runs), M)
    assert sorted(tuple(r) for r in thin.usage(m).collect()) == expected


def test_listing_fields(spark):
    dev = spark.createDataFrame([(1, 3, 9, 4, 5), (2, 0, 9, 4, 5)], "dev_id long, mapped_blocks long, transaction_id long, creation_time long, snapshotted_time long")
    m = spark.createDataFrame(blocks((1, 10, 0, 3)), M)
    rows = thin.listing(dev, m, ["DEV", "MAPPED", "MAPPED_BLOCKS", "HIGHEST_BLOCK", "HIGHEST_SECTOR", "HIGHEST_BYTE"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "192KiB", 3, 12, 13 * 128 - 1, 13 * 65536 - 1), (2, "0b", 0, 0, 127, 65535)]
    assert thin.listing(dev, None, ["DEV", "TRANSACTION"]).count() == 2
    with pytest.raises(ValueError):
        thin.listing(dev, m, ["NONE"])


def delta_by_blocks(left, right):
    """(kind, thin_begin, len, left's data_begin, right's) of stretches of one kind, a block at a time."""
    out = []
    for t in sorted({*left, *right}):
        x, y = left.get(t), right.get(t)
        kind = "left_only" if y is None else "right_only" if x is None else "same" if x == y else "differ"
        if out and out[-1][0] == kind and out[-1][1] + out[-1][2] == t:
            out[-1][2] += 1
        else:
            out.append([kind, t, 1, x, y])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_delta(spark, seed):
    """Random runs of two volumes, with shared, moved and own stretches."""
    rng = random.Random(seed)
    left = {t: 1000 + t for t in range(120) if rng.random() < 0.8}
    right = {t: b + rng.choice([0, 0, 500]) * (t // 9 % 2) for t, b in left.items() if t // 13 % 3} | {t: 5000 + t for t in range(100, 140) if t not in left}
    m = spark.createDataFrame([(1, t, b, 0) for t, b in left.items()] + [(2, t, b, 0) for t, b in right.items()], M)
    got = sorted(map(tuple, thin.delta(m, 1, 2, verbose=True).collect()), key=lambda r: r[1])
    assert got == [tuple(x) for x in delta_by_blocks(left, right)]


def test_runs(spark):
    m = spark.createDataFrame([(0, k, b, 0) for k, b in zip(range(1, 6), (100, 101, 104, 105, 110))], M)
    assert sorted(tuple(r)[1:] for r in thin.runs(m).collect()) == [(1, 100, 2), (3, 104, 2), (5, 110, 1)]


@pytest.mark.parametrize("bucket", [1, 4, 7, 1 << 20])
def test_islands_and_gaps_in_any_bucket(spark, bucket):
    rng = random.Random(bucket)
    used = sorted(rng.sample(range(200), 90))
    df = spark.createDataFrame([(k % 1, x) for k, x in enumerate(used)], "k long, x long")
    runs, free = [], []
    for x in used:
        if runs and sum(runs[-1]) == x:
            runs[-1] = (runs[-1][0], runs[-1][1] + 1)
        else:
            runs.append((x, 1))
    for x in range(230):
        if x not in used:
            if free and sum(free[-1]) == x:
                free[-1] = (free[-1][0], free[-1][1] + 1)
            else:
                free.append((x, 1))
    assert sorted((r.begin, r.len) for r in islands.islands(df, ["k"], "x", bucket=bucket).collect()) == runs
    assert sorted((r.begin, r.len) for r in islands.gaps(spark, df, "x", 230, bucket).collect()) == free


def test_bit_runs(spark):
    df = spark.createDataFrame([(i, c == "T") for i, c in enumerate("FTTFFFT")], "i long, v boolean")
    got = sorted((r.begin, r.begin + r.len, r.v) for r in islands.bit_runs(df, [], "i", "v").collect())
    assert got == [(0, 1, False), (1, 3, True), (3, 6, False), (6, 7, True)]


@pytest.mark.parametrize("bucket", [3, 16, 4096])
def test_overlap_join(spark, bucket):
    rng = random.Random(1)
    a = [(rng.randrange(300), rng.randrange(1, 40)) for _ in range(40)]
    b = [(rng.randrange(300), rng.randrange(1, 40)) for _ in range(40)]
    want = sorted((x, n, y, m, max(x, y), min(x + n, y + m) - max(x, y)) for x, n in a for y, m in b if x < y + m and y < x + n)
    j = rangejoin.overlap_join(spark.createDataFrame(a, "begin long, len long"), spark.createDataFrame(b, "r_begin long, r_len long"), bucket=bucket)
    assert sorted(tuple(r) for r in j.select("begin", "len", "r_begin", "r_len", "o_begin", "o_len").collect()) == want


def test_shrink(spark):
    m = spark.createDataFrame(blocks((1, 0, 0, 5), (1, 5, 95, 10), (2, 0, 98, 4), (2, 9, 7, 1)), M)
    remaps = thin.shrink_remaps(spark, m, 30)
    move = {}
    for r in remaps.collect():
        for k in range(r.len):
            move[r.src_begin + k] = r.dst_begin + k
    above, free = range(95, 105), [x for x in range(30) if x not in {0, 1, 2, 3, 4, 7}]
    assert move == dict(zip(above, free))
    out = thin.remap_runs(thin.dump_runs(m), remaps)
    got = {(r.dev_id, r.thin_begin + k): r.data_begin + k for r in out.collect() for k in range(r.len)}
    assert got == {(d, t): move.get(b, b) for d, t, b, _ in blocks((1, 0, 0, 5), (1, 5, 95, 10), (2, 0, 98, 4), (2, 9, 7, 1))}
    assert thin.insufficient_space(spark, m, 30).first().fits and not thin.insufficient_space(spark, m, 10).first().fits


def test_ranks_over_buckets(spark):
    df = spark.createDataFrame([(5, 2), (9, 3), (20, 1), (40, 10)], "begin long, len long")
    assert sorted((r.begin, r.rank) for r in thin.ranked(df, 8).collect()) == [(5, 0), (9, 2), (20, 5), (40, 6)]


@pytest.mark.parametrize("seqs,expected", [
    ([[1, 2, 3, 4]], [([1, 2, 3, 4], False)]),
    ([[1, 2, 3, 4], [2, 3, 4, 5]], [([1], False), ([2, 3, 4], True), ([5], False)]),
    ([[1, 2, 3], [1, 2, 3]], [([1, 2, 3], True)]),
    ([[1, 2, 3], [4, 5]], [([1, 2, 3], False), ([4, 5], False)]),
    ([[1, 2, 3], [1, 5, 3]], [([1], True), ([2], False), ([3], True), ([5], False)]),
])
def test_atomic_sequences(spark, seqs, expected):
    df = spark.createDataFrame([(s, p, leaf) for s, x in enumerate(seqs) for p, leaf in enumerate(x)], "seq long, pos long, leaf long")
    atoms = {}
    for r in thin.atomic_sequences(df).collect():
        atoms.setdefault((r.atom, r.shared), {})[r.pos] = r.leaf
    assert sorted(([x[k] for k in sorted(x)], shared) for (_, shared), x in atoms.items()) == sorted(expected)


def test_migrate_and_regions(spark):
    m = spark.createDataFrame(blocks((1, 5, 50, 3), (1, 20, 9, 1)), M)
    assert sorted(map(tuple, thin.migrate_chunks(m, 1).collect()), key=lambda r: r[1]) == [("skip", 0, 5), ("copy", 5, 3), ("skip", 8, 12), ("copy", 20, 1)]
    assert thin.migrate_chunks(m, 7).count() == 0
    with pytest.raises(ValueError):
        thin.in_regions(m, [(5, 5)])
    assert thin.in_regions(m, [(50, 52), (51, 53)]).count() == 3


def test_root_ranking_and_pairs(spark):
    t = spark.createDataFrame([(1, 5, 10), (1, 4, 3), (2, 5, 10), (3, 6, 1)], "root long, time long, n long")
    assert [r.root for r in repair.ranked_roots(t).collect()] == [3, 1, 2]
    a = spark.createDataFrame([(10, 1, 4), (10, 2, 6), (11, 1, 10)], "root long, dev_id long, mappings long")
    b = spark.createDataFrame([(20, 1, 5), (20, 2, 5), (21, 3, 10)], "root long, dev_id long, mappings long")
    assert [tuple(r) for r in repair.root_pairs(a, b).collect()] == [(10, 20)]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "loc long")
    assert {r.loc for r in repair.unreferenced(nodes, spark.createDataFrame([(2,)], "child long")).collect()} == {1, 3}


def test_space_map_kinds(spark):
    a = spark.createDataFrame([(1, 2), (2, 1)], "data_block long, ref_count long")
    b = spark.createDataFrame([(1, 2), (3, 1), (4, 2)], "data_block long, ref_count long")
    assert sorted(map(tuple, check.space_map_check(a, b).collect())) == [(2, 1, 0, "bad"), (3, 0, 1, "leak"), (4, 0, 2, "bad")]
    assert sorted(r.data_block for r in check.space_map_repair(a, b).collect()) == [1, 4]


def test_missing_refs(spark):
    e = spark.createDataFrame([(1, "a", None), (2, "b", None)], "dev_id long, ref_name string, thin_block long")
    got, lost = thin.expand_refs(e, spark.createDataFrame([("a", 7)], "def_name string, thin_block long"))
    assert [tuple(r) for r in got.collect()] == [(1, 7)] and [tuple(r) for r in lost.collect()] == [(2, "b")]


@pytest.mark.parametrize("bucket", [4, 16, 1 << 20])
def test_rank_align_over_buckets(spark, bucket):
    """Ranges longer than buckets, ties of both sides' starts, and free space left over: block by block as by rank."""
    wanted = [(1000, 3), (1010, 1), (1020, 40), (1100, 7), (1200, 0)]
    free = [(0, 3), (5, 2), (10, 1), (20, 30), (60, 10**12)]
    ranges = lambda x: spark.createDataFrame(x, "begin long, len long")
    got = sorted((r.src_begin + k, r.dst_begin + k) for r in thin.rank_align(ranges(wanted), ranges(free), bucket).collect() for k in range(r.len))
    blocks = lambda x: [b + k for b, n in x for k in range(min(n, 99))]
    assert got == list(zip(blocks(wanted), blocks(free)))
    assert thin.rank_align(ranges(wanted), ranges([]), bucket).count() == 0 and thin.rank_align(ranges([]), ranges(free), bucket).count() == 0


def test_remap_runs_in_pieces(spark):
    """A run with pieces moved at its start, middle and end, one wholly moved, one untouched."""
    runs = spark.createDataFrame([(1, 0, 100, 10, 5), (2, 7, 100, 2, 1), (3, 50, 900, 4, 0)], "dev_id long, thin_begin long, data_begin long, len long, map_time long")
    remaps = spark.createDataFrame([(99, 9, 3), (104, 20, 2), (109, 40, 1)], "src_begin long, dst_begin long, len long")
    moves = {s + k: t + k for s, t, n in [(99, 9, 3), (104, 20, 2), (109, 40, 1)] for k in range(n)}
    got = sorted((r.dev_id, r.thin_begin + k, r.data_begin + k, r.map_time) for r in thin.remap_runs(runs, remaps).collect() for k in range(r.len))
    assert got == sorted((d, t + k, moves.get(b + k, b + k), time) for d, t, b, n, time in [(1, 0, 100, 10, 5), (2, 7, 100, 2, 1), (3, 50, 900, 4, 0)] for k in range(n))


@pytest.mark.parametrize("bucket", [4, 1 << 20])
def test_restore_checks(spark, bucket):
    runs = spark.createDataFrame([(1, 0, 0, 30, 0), (1, 9, 50, 2, 0), (1, 29, 60, 1, 0), (1, 30, 70, 5, 0), (2, 9, 0, 1, 0), (2, 9, 80, 1, 0), (2, 3, 90, 0, 0), (3, 5, 1, 5, 0), (3, 10, 1, 5, 0)],
                                 "dev_id long, thin_begin long, data_begin long, len long, map_time long")
    assert sorted((r.dev_id, r.thin_begin, r.data_begin) for r in check.thin_overlaps(runs, bucket=bucket).collect()) == [(1, 9, 50), (1, 29, 60), (2, 9, 80)]
    sizes = spark.createDataFrame([(128,), (64,), (192,), (2097152,), (2097280,), (None,), (256,)], "data_block_size long")
    assert [r[0] for r in check.block_sizes(sizes).collect()] == [64, 192, 2097280, None]
