"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the word and line contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this machine."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="shared-")
        shared_dir.own = found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder; the files go when the frame is collected, if the session cleans checkpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt_by(df: DataFrame, column: str) -> DataFrame:
    """The rows dealt out and sorted by a column, kept in the shared folder: joins and aggregates by that column do not shuffle them again.

    Only a plan that is not adaptive tells how its rows are dealt out; this one has nothing to adapt.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    try:
        conf.set("spark.sql.adaptive.enabled", "false")
        return checkpoint(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), column).sortWithinPartitions(column))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, reread; it goes when the driver ends. For frames too wide for checkpoint()."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plans that give the same rows in the same places each time they run.
STEADY = {"LogicalRelation", "LogicalRDD", "LocalRelation", "Project", "Filter"}


def stored(df: DataFrame) -> DataFrame:
    """df if it reads a table as it is stored, else df written to the shared folder: what tells rows apart by their places reads them more than once."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in STEADY:
            return written(df)
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return df


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column, pattern: str = SPACE_RE, strip: str = SPACE_CHARS) -> Column:
    """Words between matches of pattern; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(strip))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, pattern))


def held(make, *args):
    """make(*args), kept for the life of a Python worker. What travels by value has no module to keep it in, so it hangs on sys."""
    import sys

    kept = sys.__dict__.setdefault("_kept_by_workers", {})
    key = (make.__name__, *args)
    if key not in kept:
        kept[key] = make(*args)
    return kept[key]
