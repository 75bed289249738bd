"""Exact dedup: heavy digests are found by Misra-Gries counters and removed on the map side; the rest are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RE, checkpoint, stored, table

#: Counters of each partition's summary, and so the most heavy digests there can be.
COUNTERS = 2048


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space made one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " "), 256)


def misra_gries(counters: int):
    """Summarises the `digest` column of a partition: at most `counters` rows, each count short by n / counters at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        total = 0
        for batch in batches:
            pairs = pa.compute.value_counts(batch.column(0))
            total += batch.num_rows
            for k, n in zip(pairs.field("values").to_pylist(), pairs.field("counts").to_pylist()):
                kept[k] = kept.get(k, 0) + n
            if len(kept) > counters:
                # Merge rule for summaries: take the (counters + 1)th largest count from all.
                least = sorted(kept.values(), reverse=True)[counters]
                kept = {k: n - least for k, n in kept.items() if n > least}
        yield pa.RecordBatch.from_pydict({"digest": list(kept), "n": list(kept.values()), "total": [total] * len(kept)},
                                         schema=pa.schema([("digest", pa.string()), ("n", pa.int64()), ("total", pa.int64())]))

    import pyarrow.compute  # noqa: F401

    return run


def heavy_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates that may hold over 1 / counters of the rows each.

    Summed over the partitions, a digest's counter is short by at most (rows / counters), so one with over
    2 / counters of all rows keeps a counter of rows / counters; counters sum to the rows at most, so no more than
    `counters` digests reach that. The bound holds whatever the data.
    """
    summary = rows.select("digest").mapInArrow(misra_gries(counters), "digest string, n long, total long")
    sums = summary.groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_rows")))).filter(F.col("n") * counters >= F.greatest(F.col("all_rows"), F.lit(2 * counters))).select("digest")


def classes(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs, and row, its monotonically_increasing_id.

    Null texts are empty texts. Of equal texts the smallest doc_id stays, a null id last; of rows that repeat an id
    and its text just one is kept. An empty table gives an empty one. Other columns are not read, and long texts move as their digests.
    """
    rows = checkpoint(docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")
    size = F.count("*").alias("group_size")
    # Verified: the winners' exact counts and smallest ids come from a pass over the rows.
    candidates = heavy_digests(rows, counters)
    winners = checkpoint(rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(best, size))
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(best, size), "digest")
    return heavy.unionByName(light).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"), "row")


def op3_exact_dedup(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).drop("row")


OP3_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
"""


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that classes() keeps, with all their columns. Rows are told apart by their places; a frame that does not read a stored table is written first."""
    docs = stored(docs)
    gone = classes(docs).filter("not kept").select(F.col("row").alias("_row"))
    return docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")).join(gone, "_row", "left_anti").select("doc.*")
