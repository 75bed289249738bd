"""Root discovery for repair: candidate roots from node summaries, paired and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import image


def unreferenced(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """Nodes (loc, ...) that no other points at (references: child)."""
    return nodes.join(references.select(F.col("child").alias("loc")).distinct(), "loc", "left_anti")


def root_stats(members: DataFrame) -> DataFrame:
    """Per root: devices, mappings, greatest time, greatest transaction, highest block. Rows: root, dev_id, mappings, age, tid, highest."""
    return members.groupBy("root").agg(F.count_distinct("dev_id").alias("nr_devices"), F.sum("mappings").alias("nr_mappings"), F.max("age").alias("age"), F.max("tid").alias("tid"), F.max("highest").alias("highest"))


def ranked_roots(time_counts: DataFrame) -> DataFrame:
    """Roots (root, time, n) best first: their (time, n) lists, latest first, compared place by place; of equal heads the longer list."""
    lists = time_counts.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("time", "n")), asc=False).alias("history"))
    return lists.orderBy(F.col("history").desc(), F.col("root").desc())


def root_pairs(device_roots: DataFrame, detail_roots: DataFrame) -> DataFrame:
    """(device_root, details_root) with the same mapping total and device ids. Rows on each side: root, dev_id, mappings."""
    def summary(df, name):
        return df.groupBy(F.col("root").alias(name)).agg(F.sum("mappings").alias("total"), F.sort_array(F.collect_set("dev_id")).alias("ids"))

    return summary(device_roots, "device_root").join(summary(detail_roots, "details_root"), ["total", "ids"]).select("device_root", "details_root")


def best_root(ranked: DataFrame) -> DataFrame:
    return ranked.limit(1)


def synthesized_details(roots: DataFrame) -> DataFrame:
    """Details for roots without a details tree."""
    return roots.select("dev_id", F.col("mappings").alias("mapped_blocks"), F.lit(1).cast("long").alias("transaction_id"), (F.col("age") + 1).alias("creation_time"), (F.col("age") + 1).alias("snapshotted_time"))


def override(sb: DataFrame, transaction: int | None = None, nr_data_blocks: int | None = None, data_block_size: int | None = None) -> DataFrame:
    """Superblock overrides: the greater transaction and block count stand, the block size is replaced."""
    if data_block_size is not None and not (128 <= data_block_size <= 2097152 and data_block_size % 128 == 0):
        raise ValueError("data block size out of range")
    greater = lambda c, v: F.greatest(F.col(c), F.lit(v)).cast("long") if v is not None else F.col(c)
    return sb.withColumn("transaction", greater("transaction", transaction)).withColumn("nr_data_blocks", greater("nr_data_blocks", nr_data_blocks)).withColumn(
        "data_block_size", F.lit(data_block_size).cast("long") if data_block_size is not None else F.col("data_block_size"))


def _links(nodes: DataFrame) -> DataFrame:
    """parent, nr_entries, child of sound internal nodes."""
    return nodes.filter("error is null and not is_leaf").select(F.col("loc").alias("parent"), "nr_entries", F.explode("entries").alias("e")).select("parent", "nr_entries", F.col("e.value").alias("child"))


def _above(links: DataFrame, leaves: DataFrame, max_depth: int) -> DataFrame:
    """loc of the leaves and of all nodes above them, level by level."""
    level = found = leaves.select("loc").distinct().persist()
    for _ in range(max_depth):
        level = links.join(level, links.child == level["loc"], "left_semi").select(F.col("parent").alias("loc")).distinct().persist()
        if level.isEmpty():
            return found.distinct()
        found = found.unionByName(level)
    raise ValueError("tree deeper than max_depth")


def subtree_times(links: DataFrame, leaves: DataFrame, max_depth: int = 32) -> DataFrame:
    """loc, time, n, highest: the mappings of each time below each node, and their highest data block; leaves are nodes of packed mappings.

    From the leaves up, so that a shared node is summed once; a node with a child that is not sound has no rows. An empty leaf has one without a time.
    """
    e = leaves.select("loc", F.explode_outer("entries.value").alias("v"))
    level = e.groupBy("loc", F.col("v").bitwiseAND(F.lit((1 << 24) - 1)).alias("time")).agg(F.count("v").alias("n"), F.max(F.shiftrightunsigned("v", 24)).alias("highest")).persist()
    found = level
    for _ in range(max_depth):
        known = level.select(F.col("loc").alias("child")).distinct()
        whole = links.join(known, "child").groupBy("parent", "nr_entries").count().filter("count = nr_entries").select("parent")
        below = level.withColumnRenamed("loc", "child")
        level = links.join(whole, "parent").join(below, "child").groupBy(F.col("parent").alias("loc"), "time").agg(F.sum("n").alias("n"), F.max("highest").alias("highest")).persist()
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError("tree deeper than max_depth")


def discover(maps: DataFrame, details: DataFrame, nr_blocks: int, max_depth: int = 32) -> DataFrame:
    """Roots for a lost superblock, best first: mapping_root, details_root, time, transaction_id, nr_data_blocks, history (time, n).

    maps and details are all nodes of an image, decoded with 8-byte and with 24-byte values (image.nodes, best kept). Candidates are sound nodes that no other points
    at: trees of devices, whose leaves hold places of blocks, and trees of details. A pair has the same device ids and mapping totals.
    Without a pair each tree of devices stands alone, details_root null. No tree of devices gives no row.
    """
    links, leaves = _links(maps).persist(), maps.filter("error is null and is_leaf")
    tops = (F.size("entries") > 0) & F.forall("entries", lambda e: e["value"] <= nr_blocks)
    top_leaves = leaves.filter(tops).persist()
    children = links.select("child").unionByName(top_leaves.select(F.explode("entries.value").alias("child")))
    sums = subtree_times(links, leaves.filter(~tops), max_depth).persist()

    def whole(nodes, at):
        """Entries of the candidate trees above some leaves, without those trees in which something is broken."""
        roots = unreferenced(_above(links, at, max_depth), children).select(F.col("loc").alias("root"))
        entries, broken = image.walk(nodes, roots, max_depth)
        return entries.join(broken.select("root").distinct(), "root", "left_anti").persist()

    devices = whole(maps, top_leaves).select("root", F.col("key").alias("dev_id"), F.col("value").alias("loc"))
    devices = devices.join(devices.join(sums.select("loc").distinct(), "loc", "left_anti").select("root").distinct(), "root", "left_anti")
    times = devices.join(sums, "loc").persist()
    entries = whole(details, details.filter("error is null and is_leaf"))
    listed = entries.select("root", *image.details_columns())
    pairs = root_pairs(times.groupBy("root", "dev_id").agg(F.sum("n").alias("mappings")), listed.withColumnRenamed("mapped_blocks", "mappings")).persist()
    found = times.groupBy(F.col("root").alias("mapping_root")).agg(F.max("time").alias("age"), (F.max("highest") + 1).alias("nr_data_blocks"))
    history = times.filter("time is not null").groupBy("root", "time").agg(F.sum("n").alias("n")).groupBy(F.col("root").alias("mapping_root")).agg(F.sort_array(F.collect_list(F.struct("time", "n")), asc=False).alias("history"))
    found = found.join(history, "mapping_root", "left")
    if pairs.isEmpty():
        age = F.coalesce("age", F.lit(0)) + 1
        out = found.select("mapping_root", F.lit(None).cast("long").alias("details_root"), age.alias("time"), F.lit(1).cast("long").alias("transaction_id"), F.coalesce("nr_data_blocks", F.lit(1)).alias("nr_data_blocks"), "history")
    else:
        last = listed.groupBy(F.col("root").alias("details_root")).agg((F.max("transaction_id") + 1).alias("transaction_id"), F.max(F.greatest("creation_time", "snapshotted_time")).alias("_age"))
        both = found.join(pairs.withColumnRenamed("device_root", "mapping_root"), "mapping_root").join(last, "details_root")
        out = both.select("mapping_root", "details_root", F.greatest("age", "_age").alias("time"), "transaction_id", F.coalesce("nr_data_blocks", F.lit(1)).alias("nr_data_blocks"), "history")
    return out.orderBy(F.col("history").desc_nulls_last(), F.col("mapping_root").desc(), "details_root")
