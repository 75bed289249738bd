"""Volumes and snapshots: listing, deltas, reverse maps, runs, statistics, trim, shrink, migration, device and region selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .islands import BUCKET, div, gaps, islands
from .rangejoin import overlap_join

#: Fields of the listing that need no mapping scan.
DETAIL_FIELDS = {"DEV", "TRANSACTION", "CREATE_TIME", "SNAP_TIME"}
DEFAULT_FIELDS = ["DEV", "MAPPED", "CREATE_TIME", "SNAP_TIME"]


def ref_counts(mappings: DataFrame) -> DataFrame:
    """data_block, ref_count: owners of each block."""
    return mappings.groupBy("data_block").agg(F.count("*").alias("ref_count"))


def ref_counts_saturated(mappings: DataFrame, most: int = 2) -> DataFrame:
    return mappings.groupBy("data_block").agg(F.least(F.count("*"), F.lit(most)).cast("long").alias("ref_count"))


def first_seen(mappings: DataFrame) -> DataFrame:
    """Blocks at their first owner in order of device and thin block."""
    return mappings.groupBy("data_block").agg(F.min(F.struct("dev_id", "thin_block")).alias("x")).select("data_block", "x.dev_id", "x.thin_block")


def with_sharing(mappings: DataFrame) -> DataFrame:
    """Mappings with shared: whether their block has over one owner row."""
    counts = ref_counts(mappings).select("data_block", (F.col("ref_count") > 1).alias("shared"))
    return mappings.join(counts, "data_block")


def usage(mappings: DataFrame) -> DataFrame:
    """Per device: mapped, exclusive, shared and highest mapped thin block."""
    return with_sharing(mappings).groupBy("dev_id").agg(
        F.count("*").alias("mapped"), F.count_if(~F.col("shared")).alias("exclusive"), F.count_if("shared").alias("shared"),
        F.max("thin_block").alias("highest"))


def node_summary(mappings: DataFrame) -> DataFrame:
    """Per device: least and greatest key, mappings, shared mappings."""
    return with_sharing(mappings).groupBy("dev_id").agg(
        F.min("thin_block").alias("key_low"), F.max("thin_block").alias("key_high"), F.count("*").alias("nr_mappings"), F.count_if("shared").alias("nr_shared"))


def listing(devices: DataFrame, mappings: DataFrame | None, fields: list[str] | None = None, block_sectors: int = 128) -> DataFrame:
    """The chosen fields for each device; a device without mappings has zeros. mappings is not read if no field counts them."""
    from ..functions.scalar import pretty_size

    fields = fields or DEFAULT_FIELDS
    x = devices
    if set(fields) - DETAIL_FIELDS:
        x = x.join(usage(mappings), "dev_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    columns = {"DEV": lambda: F.col("dev_id"), "TRANSACTION": lambda: F.col("transaction_id"), "CREATE_TIME": lambda: F.col("creation_time"), "SNAP_TIME": lambda: F.col("snapshotted_time")}
    for name, c in (("MAPPED", "mapped"), ("EXCLUSIVE", "exclusive"), ("SHARED", "shared")):
        columns[f"{name}_BLOCKS"] = lambda c=c: z(c)
        columns[f"{name}_SECTORS"] = lambda c=c: z(c) * block_sectors
        columns[f"{name}_BYTES"] = lambda c=c: F.shiftleft(z(c) * block_sectors, 9)
        columns[name] = lambda c=c: pretty_size(F.shiftleft(z(c) * block_sectors, 9))
    columns["HIGHEST_BLOCK"] = lambda: z("highest")
    columns["HIGHEST_SECTOR"] = lambda: (z("highest") + 1) * block_sectors - 1
    columns["HIGHEST_BYTE"] = lambda: F.shiftleft((z("highest") + 1) * block_sectors, 9) - 1
    columns["HIGHEST_MAPPED"] = lambda: pretty_size(F.shiftleft((z("highest") + 1) * block_sectors, 9))
    unknown = set(fields) - set(columns)
    if unknown:
        raise ValueError(f"unknown field: {sorted(unknown)}")
    return x.select(*(columns[f]().alias(f) for f in fields))


def select_devices(df: DataFrame, dev_ids: list[int]) -> DataFrame:
    """Rows of the devices named; ids that are absent are ignored."""
    return df.filter(F.col("dev_id").isin([int(x) for x in dev_ids]))


def in_regions(df: DataFrame, regions: list[tuple[int, int]], column: str = "data_block") -> DataFrame:
    """Rows whose block is in any of the half-open regions; regions that overlap do not repeat rows."""
    for a, b in regions:
        if b <= a:
            raise ValueError("end <= begin")
    hit = F.lit(False)
    for a, b in regions:
        hit = hit | ((F.col(column) >= a) & (F.col(column) < b))
    return df.filter(hit) if regions else df


def _runs(mappings: DataFrame, keys: list[str], first: list[str] = ()) -> DataFrame:
    return islands(mappings.withColumn("offset", F.col("data_block") - F.col("thin_block")), [*keys, "offset"], "thin_block", first)


def dump_runs(mappings: DataFrame) -> DataFrame:
    """Runs contiguous in thin and data blocks, of one time."""
    return _runs(mappings, ["dev_id", "map_time"]).select("dev_id", F.col("begin").alias("thin_begin"), (F.col("begin") + F.col("offset")).alias("data_begin"), "len", "map_time")


def runs(mappings: DataFrame) -> DataFrame:
    """Runs contiguous in thin and data blocks, whatever their time."""
    return _runs(mappings, ["dev_id"]).select("dev_id", F.col("begin").alias("thin_begin"), (F.col("begin") + F.col("offset")).alias("data_begin"), "len")


def rmap(mappings: DataFrame, regions: list[tuple[int, int]] = ()) -> DataFrame:
    """Who owns the data blocks of the regions: data_begin, data_end, dev_id, thin_begin. Every owner is listed."""
    x = in_regions(mappings, list(regions)).withColumn("offset", F.col("data_block") - F.col("thin_block"))
    return islands(x, ["dev_id", "offset"], "data_block").select(
        F.col("begin").alias("data_begin"), (F.col("begin") + F.col("len")).alias("data_end"), "dev_id", (F.col("begin") - F.col("offset")).alias("thin_begin"))


def sorted_rmap(regions: DataFrame) -> DataFrame:
    return regions.orderBy("data_begin", "data_end", "dev_id", "thin_begin")


def delta_blocks(mappings: DataFrame, left: int, right: int) -> DataFrame:
    """thin_block, left_data, right_data, kind: left_only, right_only, same or differ; times do not count."""
    side = lambda dev, name: mappings.filter(F.col("dev_id") == dev).select("thin_block", F.col("data_block").alias(name))
    a, b = F.col("left_data"), F.col("right_data")
    kind = F.when(b.isNull(), "left_only").when(a.isNull(), "right_only").when(a == b, "same").otherwise("differ")
    return side(left, "left_data").join(side(right, "right_data"), "thin_block", "full_outer").withColumn("kind", kind)


def delta(mappings: DataFrame, left: int, right: int, verbose: bool = False) -> DataFrame:
    """Delta runs: kind, thin_begin, len and, if verbose, the data blocks of the first piece. Data need not be contiguous."""
    first = ["left_data", "right_data"] if verbose else []
    x = islands(delta_blocks(mappings, left, right), ["kind"], "thin_block", first)
    return x.select("kind", F.col("begin").alias("thin_begin"), "len", *first)


def histogram(counts: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Values of column with how often each occurs, and its percentage."""
    h = counts.groupBy(column).agg(F.count("*").alias(out))
    total = h.agg(F.sum(out).alias("_total"))
    return h.join(F.broadcast(total)).select(column, out, (F.col(out) / F.col("_total") * 100).alias("pct"))


def run_histogram(mappings: DataFrame) -> DataFrame:
    return runs(mappings).groupBy("len").agg(F.count("*").alias("n"))


def time_counts(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("map_time").agg(F.count("*").alias("n"))


def trim(spark, counts: DataFrame, blocks: int) -> DataFrame:
    """Free ranges [begin, end) of the pool."""
    return gaps(spark, counts.filter("ref_count > 0"), "data_block", blocks).select("begin", (F.col("begin") + F.col("len")).alias("end"))


def alloc_counts(counts: DataFrame, blocks: int) -> DataFrame:
    n = F.count_if(F.col("ref_count") > 0)
    return counts.agg(n.alias("nr_allocated"), F.greatest(F.lit(0), F.lit(blocks) - n).cast("long").alias("nr_free"))


def migrate_chunks(mappings: DataFrame, dev_id: int) -> DataFrame:
    """kind copy for runs of thin blocks and skip for the gaps before each; nothing after the last."""
    mine = mappings.filter(F.col("dev_id") == dev_id).select("thin_block")
    end = mine.agg(F.max("thin_block")).first()[0]
    copies = islands(mine, [], "thin_block")
    skips = gaps(mappings.sparkSession, mine, "thin_block", 0 if end is None else end + 1)
    return copies.select(F.lit("copy").alias("kind"), "begin", "len").unionByName(skips.select(F.lit("skip").alias("kind"), "begin", "len"))


def split_at(ranges: DataFrame, at: int) -> DataFrame:
    """Ranges (begin, len) cut at a place, with below: whether the piece is before it."""
    end = F.col("begin") + F.col("len")
    below = ranges.filter(F.col("begin") < at).withColumn("len", F.least(end, F.lit(at)) - F.col("begin")).withColumn("below", F.lit(True))
    above = ranges.filter(end > at).withColumn("_b", F.greatest("begin", F.lit(at))).withColumn("len", end - F.col("_b")).withColumn("begin", F.col("_b")).drop("_b").withColumn("below", F.lit(False))
    return below.unionByName(above)


def ranked(ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Ranges (begin, len) with rank, the sum of the lengths before: sums within buckets of begin, plus those of whole buckets before.

    Only the bucket totals, one row for each bucket, meet in a window of their own.
    """
    x = ranges.select("begin", "len").withColumn("_bucket", div(F.col("begin"), bucket))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("_bucket").agg(F.sum("len").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy("_bucket").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("_in", F.sum("len").over(within) - F.col("len")).join(totals, "_bucket").select("begin", "len", (F.col("_base") + F.col("_in")).alias("rank"))


def rank_align(wanted: DataFrame, free: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The i-th block of wanted gets the i-th of free: both are ranges (begin, len), aligned by the sums of lengths before them.

    Each side's ranks have no gaps, so a piece begins where a range of either side does and ends where one of the two does. Each bucket of
    ranks finds its latest ranges itself, with those of the buckets before carried in: rows grow with the ranges, however long they are.
    Output: src_begin, dst_begin, len.
    """
    side = lambda df, name: ranked(df.filter("len > 0"), bucket).select("rank", F.struct("rank", "begin", "len").alias(name))
    x = side(wanted, "src").unionByName(side(free, "dst"), allowMissingColumns=True).withColumn("_bucket", div(F.col("rank"), bucket))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = x.groupBy("_bucket").agg(F.max("src").alias("_s"), F.max("dst").alias("_d"))
    carried = carried.select("_bucket", F.last("_s", True).over(before).alias("_s"), F.last("_d", True).over(before).alias("_d"))
    upto = Window.partitionBy("_bucket").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    latest = lambda c, old: F.coalesce(F.last(c, True).over(upto), F.col(old))
    y = x.join(carried, "_bucket").select("rank", F.col("src").isNotNull().alias("_own"), latest("src", "_s").alias("src"), latest("dst", "_d").alias("dst"))
    ends = F.least(F.col("src.rank") + F.col("src.len"), F.col("dst.rank") + F.col("dst.len"))
    # Where both sides begin a range, the piece is listed once.
    pieces = y.filter(F.col("_own") | (F.col("src.rank") < F.col("rank"))).filter("src is not null and dst is not null")
    at = lambda c: (F.col(f"{c}.begin") + F.col("rank") - F.col(f"{c}.rank")).alias(f"{c}_begin")
    return pieces.select(at("src"), at("dst"), (ends - F.col("rank")).alias("len")).filter("len > 0")


def shrink_remaps(spark, mappings: DataFrame, new_blocks: int) -> DataFrame:
    """Ranges of data blocks at or above the new size, and where each moves: src_begin, dst_begin, len."""
    blocks = mappings.select("data_block").distinct()
    above = islands(blocks.filter(F.col("data_block") >= new_blocks), [], "data_block")
    return rank_align(above, gaps(spark, blocks, "data_block", new_blocks))


def insufficient_space(spark, mappings: DataFrame, new_blocks: int) -> DataFrame:
    """One row: blocks to move, blocks free below, and whether that is enough."""
    b = mappings.select("data_block").distinct().agg(F.count_if(F.col("data_block") >= new_blocks).alias("to_move"), (F.lit(new_blocks) - F.count_if(F.col("data_block") < new_blocks)).alias("free"))
    return b.withColumn("fits", F.col("to_move") <= F.col("free"))


def remap_runs(mapped: DataFrame, remaps: DataFrame) -> DataFrame:
    """Runs (dev_id, thin_begin, data_begin, len, map_time) with the pieces that remaps cover moved, times kept."""
    a = mapped.select("dev_id", "thin_begin", "map_time", F.col("data_begin").alias("begin"), "len")
    b = remaps.select(F.col("src_begin").alias("r_begin"), F.col("len").alias("r_len"), "dst_begin")
    o = overlap_join(a, b)
    # A mark at each run's end, so that one window finds what no remap covers before each piece and behind the last.
    marks = a.withColumn("o_begin", F.col("begin") + F.col("len")).withColumn("o_len", F.lit(0).cast("long")).withColumn("to", F.lit(None).cast("long"))
    cut = o.withColumn("to", F.col("dst_begin") + F.col("o_begin") - F.col("r_begin")).select(*marks.columns).unionByName(marks)
    w = Window.partitionBy("dev_id", "thin_begin", "begin", "len", "map_time").orderBy("o_begin")
    stays = F.coalesce(F.lag(F.col("o_begin") + F.col("o_len")).over(w), F.col("begin"))
    piece = lambda at, to, n: F.struct(at.alias("at"), to.alias("to"), n.alias("n"))
    pieces = cut.withColumn("_b", stays).select("dev_id", "thin_begin", "begin", "map_time", F.explode(F.array(
        piece(F.col("_b"), F.col("_b"), F.col("o_begin") - F.col("_b")), piece(F.col("o_begin"), F.col("to"), F.col("o_len")))).alias("p")).filter("p.n > 0")
    return pieces.select("dev_id", (F.col("thin_begin") + F.col("p.at") - F.col("begin")).alias("thin_begin"), F.col("p.to").alias("data_begin"), F.col("p.n").alias("len"), "map_time")


def atomic_sequences(sequences: DataFrame) -> DataFrame:
    """Maximal leaf sequences that are shared as a whole.

    Input (seq, pos, leaf); output (atom, pos, leaf, shared), where atom is the first leaf. A leaf begins an atom if it begins a
    sequence, has other than one predecessor, or that one has other than one successor or ends a sequence.
    """
    w = Window.partitionBy("seq").orderBy("pos")
    x = sequences.withColumn("prev", F.lag("leaf").over(w)).withColumn("next", F.lead("leaf").over(w))
    facts = x.groupBy("leaf").agg(F.count("*").alias("uses"), F.count_if(F.col("prev").isNull()).alias("starts"), F.count_if(F.col("next").isNull()).alias("stops"),
                                  F.count_distinct("prev").alias("n_prev"), F.count_distinct("next").alias("n_next"))
    tail = facts.select(F.col("leaf").alias("prev"), ((F.col("stops") > 0) | (F.col("n_next") != 1)).alias("prev_tail"))
    y = x.join(facts.select("leaf", "uses", "starts", "n_prev"), "leaf").join(tail, "prev", "left")
    y = y.withColumn("head", (F.col("starts") > 0) | (F.col("n_prev") != 1) | F.coalesce("prev_tail", F.lit(False)))
    run = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    y = y.withColumn("atom", F.last(F.when(F.col("head"), F.col("leaf")), ignorenulls=True).over(run)).withColumn("at", F.last(F.when(F.col("head"), F.col("pos")), ignorenulls=True).over(run))
    return y.select("atom", (F.col("pos") - F.col("at")).alias("pos"), "leaf", (F.col("uses") > 1).alias("shared")).distinct()


def expand_refs(entries: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Device entries (dev_id, name or a run) with refs replaced by the runs of their defs; and the refs whose def is missing."""
    refs = entries.filter("ref_name is not null")
    direct = entries.filter("ref_name is null").drop("ref_name")
    found = refs.select("dev_id", "ref_name").join(defs, refs.ref_name == defs.def_name).select("dev_id", *[c for c in direct.columns if c != "dev_id"])
    return direct.unionByName(found), refs.join(defs, refs.ref_name == defs.def_name, "left_anti").select("dev_id", "ref_name")
