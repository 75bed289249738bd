"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint, split_words, stored, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
BLOCK = 768
TINY = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs -> those and target.

    Sources in code point order, null last, take the weights in turn. Targets share all sizes by weight, but none is
    above `most` times its source's size. With sources in order of the level at which they reach that bound, the bounded
    ones are a prefix: one is bounded if its bound is below its share of what those before it leave.
    The windows run over one row for each source.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("bounded", F.col("cap") * F.col("rest_w") < F.col("rest") * F.col("w"))
    s = s.withColumn("level", F.max(F.when(~F.col("bounded"), F.struct(F.col("rest_w"), F.col("rest")))).over(everything))
    share = F.col("level.rest") * F.col("w") / F.col("level.rest_w")
    return s.select("source", "source_size", "n_docs", F.when(F.col("bounded") | F.col("level").isNull(), F.col("cap")).otherwise(share).alias("target"))


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys only (splitmix64)."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight of the cube method for units of one source: moves probabilities to 0 or 1 with the sums of p and of p * size unchanged.

    The direction is that of the first open unit, projected into the null space of the two constraints over all open ones, so
    the others share in making good for it. The sense is drawn so that the mean of each p stays. Units come in order of falling
    size: the large ones are settled while many are open, and the two that stay open at most are small.
    """
    p = np.where(p < TINY, 0.0, np.where(p > 1 - TINY, 1.0, p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    moves = 0
    while len(open_) > 1:
        x = size[open_] - size[open_].mean()
        square = x @ x
        level = square <= TINY * max(1.0, size[open_[0]] ** 2) * len(open_)
        for k in range(len(open_)):
            u = np.full(len(open_), -1.0 / len(open_)) - (0.0 if level else x * (x[k] / square))
            u[k] += 1.0
            if np.abs(u).max() > 1e-7:
                break
        else:
            break  # no direction is left: one open unit, or two of unlike size
        u /= np.abs(u).max()
        u[np.abs(u) < 1e-12] = 0.0
        q = p[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + (up if draws[moves % len(draws)] * (up + down) < down else -down) * u
        p[open_] = np.where(q < TINY, 0.0, np.where(q > 1 - TINY, 1.0, q))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
        moves += 1
    return p


def land(p: np.ndarray, size: np.ndarray, near: float = 0.001, more: int = 8) -> np.ndarray:
    """The open units, two at most after a flight, take the values that leave the sum of p * size nearest to what it is; of equals, those that change the count least.

    Where that still misses by over `near` of the sum, as an outlier among few units may, up to `more` settled units of about the
    size missed are tried with them.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p

    def tried(units: np.ndarray) -> tuple[np.ndarray, float]:
        ways = np.array(list(product((0.0, 1.0), repeat=len(units)))) - p[units]
        off, count = np.abs(ways @ size[units]), np.abs(ways.sum(1))
        best = np.lexsort((count, np.round(off, 6)))[0]
        out = p.copy()
        out[units] = np.round(p[units] + ways[best])
        return out, off[best]

    out, off = tried(open_)
    if off > near * (p @ size):
        apart = np.abs(size - off)
        apart[open_] = np.inf
        out, _ = tried(np.r_[open_, np.argsort(apart, kind="stable")[: min(more, len(p) - len(open_))]])
    return out


def settle(last: bool):
    def run(pdf):
        pdf = pdf.sort_values(["key", "doc_id", "row"], kind="stable", na_position="last").sort_values("size", ascending=False, kind="stable")
        draws = uniform(pdf["key"].to_numpy(np.int64).view(np.uint64) ^ np.arange(len(pdf), dtype=np.uint64))
        size = pdf["size"].to_numpy(float)
        p = flight(pdf["p"].to_numpy(float), size, draws)
        return pdf.assign(p=land(p, size) if last else p)

    return run


def copies(docs: DataFrame, weights=WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """row (monotonically_increasing_id of docs), doc_id, size, source, source_size, target, copies.

    A document is taken floor(target / source_size) times, and once more with the fraction that is left, drawn by the
    cube method. Sources are cut into blocks of about `block` documents by a hash of the document, so a large source is
    many groups; each block leaves two open units at most, its smallest, which meet in the next round's blocks, until a source has a
    single block. Only that one lands: words and documents of a source miss by what a few documents hold, and until then
    each document's chance is the one it had. Draws come from document hashes: reruns agree, whatever the partitions.

    Null sources are one source, the last; null texts have size 0; a source without words is not taken. Documents of equal size are
    ordered by a hash. Repeated rows count each. A long text is its number of words here. An empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = checkpoint(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.size(split_words(text)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("key")))
    stats = checkpoint(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most))
    a, b = rows.alias("a"), stats.alias("b")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "n_docs", "target", ratio.alias("r"))
    base = F.when(F.abs(F.round("r") - F.col("r")) < TINY, F.round("r")).otherwise(F.floor("r")).cast("long")
    units = checkpoint(joined.withColumn("base", base).withColumn("p", F.greatest(F.col("r") - F.col("base"), F.lit(0.0))).withColumn("blocks", F.ceil(F.col("n_docs") / block)).drop("r", "n_docs"))
    schema = units.schema
    done, most_blocks = [units.filter(F.col("p") < TINY)], stats.agg(F.max(F.ceil(F.col("n_docs") / block))).first()[0] or 0
    left, level = units.filter(F.col("p") >= TINY), 0
    while True:
        last = most_blocks <= 1
        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1 + level), "key", "doc_id"), F.greatest(F.col("blocks"), F.lit(1))))
        moved = checkpoint(dealt.groupBy("source", "block").applyInPandas(_without_block(settle(last)), schema))
        if last:
            done.append(moved)
            break
        # Blocks hold two open units each at most, so this many blocks of the next round are as full as these were.
        settled = (F.col("p") < TINY) | (F.col("p") > 1 - TINY)
        done.append(moved.filter(settled))
        left = moved.filter(~settled).withColumn("blocks", F.ceil(F.col("blocks") * 2 / F.lit(block)))
        most_blocks, level = -(-most_blocks * 2 // block), level + 1
    total = done[0]
    for x in done[1:]:
        total = total.unionByName(x)
    return total.select("row", "doc_id", "size", "source", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies"))


def _without_block(run):
    def apply(pdf):
        return run(pdf).drop(columns=["block"])

    return apply


def op8_mix(spark, sf_dir):
    x = copies(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows are told apart by their places; a frame that does not read a stored table is written first."""
    docs = stored(docs)
    taken = copies(docs, **options).filter("copies > 0").select(F.col("row").alias("_row"), "copies")
    whole = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row"))
    return whole.join(taken, "_row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
