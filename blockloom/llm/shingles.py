"""Links between texts whose five-word shingle sets are alike: min-hash bands propose, the sets themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, dealt_by

#: Sorensen-Dice similarity of two shingle sets, 2 |A and B| / (|A| + |B|); 0.8 is a Jaccard similarity of 2/3.
WIDTH, THRESHOLD = 5, 0.8
#: A band is equal for sets of Jaccard similarity s with probability of about s^TAKE; one of TABLES is, at 2/3, with 0.999.
TABLES, TAKE = 20, 3
#: Members of a band that one comparison holds at a time, if they have KEEP shingles each on average at most (16 KB each); fewer if they have more.
CELL, KEEP = 768, 4096
SALTS = 16
_SALT = np.array([(0x9E3779B97F4A7C15 * (t + 1)) % (1 << 64) for t in range(TABLES)], np.uint64)[:, None]


def shingle_hashes(text: str | None, width: int, hash64) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white space bytes only
    if not words:
        return np.array([], np.uint64)
    body = b" ".join(words)
    if len(words) <= width:
        return np.array([hash64(body)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return np.unique(np.array([hash64(body[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One value for each table: of the TAKE hashes that are least under the table's permutation."""
    if not len(hashes):
        return []
    least = None
    for k in range(0, len(hashes), 1 << 15):  # tables x hashes at a time
        mixed = (hashes[k : k + (1 << 15)] ^ _SALT) * np.uint64(0xFF51AFD7ED558CCD)  # bare multiples of a hash would be small together
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed if least is None else np.concatenate([least, mixed], axis=1)
        least = np.partition(mixed, TAKE - 1, axis=1)[:, :TAKE] if mixed.shape[1] > TAKE else mixed
    x = np.arange(1, TABLES + 1, dtype=np.uint64)
    for v in np.sort(least, axis=1).T:
        x = (x ^ v) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x.view(np.int64).tolist()


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (distinct shingles), shingles (their hashes, 32 bits each, sorted), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            n, sets, band = [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), width, xxh64_intdigest)
                n.append(len(h))
                sets.append((h >> np.uint64(32)).astype("<u4").tobytes())
                band.append(bands(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "n", "shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, shingles binary, bands array<long>")


def clusters(ids: np.ndarray, n: np.ndarray, sets: list[bytes], threshold: float, root: np.ndarray | None = None, first: int | None = None) -> np.ndarray:
    """For each member the smallest id of its component. A member is compared with those only that are not yet in its component.

    root has the components known before; with first, only that many members are compared with those after them.
    """
    values = [np.frombuffer(b, "<u4") for b in sets]
    size = np.array([len(v) for v in values])
    start = np.r_[0, np.cumsum(size)]
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(len(ids)), size)
    least = round(1000 * threshold)
    root = (ids if root is None else root).copy()
    for i in range(len(ids) - 1 if first is None else min(first, len(ids) - 1)):
        j = np.arange(i + 1, len(ids))
        j = j[(root[j] != root[i]) & (2000 * np.minimum(n[i], n[j]) >= least * (n[i] + n[j]))]
        if not len(j) or not size[i]:
            continue
        mine = values[i]
        if 4 * len(j) < len(ids) - i:  # few are left
            other = np.concatenate([values[k] for k in j])
            of = np.repeat(j, size[j])
        else:
            other, of = flat[start[i + 1] :], owner[start[i + 1] :]
        both = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
        inter = np.bincount(of[both], minlength=len(ids))[j]
        near = root[j[2000 * inter >= least * (n[i] + n[j])]]
        if len(near):
            old = np.unique(np.r_[near, root[i]])
            root[np.isin(root, old)] = old[0]
    return root


def _meet(threshold: float):
    """Rows (band, cell, doc_id, n, shingles, known, active) in order of band and cell: edges (root, doc_id) from the root known of a member to the one found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out, waiting = [], None, [], 0

        def flush():
            held.sort(key=lambda x: not x[4])
            ids, n, known = (np.array([x[k] for x in held], np.int64) for k in (0, 1, 3))
            return np.full(len(ids), key[0], np.int64), clusters(ids, n, [x[2] for x in held], threshold, known, sum(x[4] for x in held)), known

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["band", "root", "doc_id"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if row[:2] != key:
                    if held:
                        out.append(flush())
                        waiting += len(held)
                    held, key = [], row[:2]
                    if waiting > 50_000:
                        yield batch_of(out)
                        out, waiting = [], 0
                held.append(row[2:])
        if held:
            out.append(flush())
        if out:
            yield batch_of(out)

    return run


def _compared(members: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """(band, root, doc_id): the root found for the root known, of members (band, cell, doc_id, known, active); active members are compared with all others."""
    full = members.join(prints.select("doc_id", "n", "shingles"), "doc_id").select("band", "cell", "doc_id", "n", "shingles", "known", "active")
    return full.repartition("band", "cell").sortWithinPartitions("band", "cell").mapInArrow(_meet(threshold), "band long, root long, doc_id long")


def _cells(size: Column, weight: Column) -> Column:
    """Cells for so many members with so many shingles together."""
    return F.greatest(F.ceil(size / CELL), F.ceil(weight / (CELL * KEEP)))


def _dealt(cells: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "band", F.lit(salt)), cells)


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root): the components of edges (root, doc_id)."""
    from .simhash import components

    return components(edges.select(F.least("root", "doc_id").alias("u"), F.greatest("root", "doc_id").alias("v")).filter("u <> v").distinct())


def _known(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with the root of what they are known as so far."""
    at = members.join(roots, members["known"] == roots["node"], "left")
    return at.select(*(c for c in members.columns if c != "known"), F.coalesce("root", "known").alias("known"))


def _members(spread: DataFrame) -> DataFrame:
    """band, cells, cell, doc_id, n, known of the members of bands (band, doc_id, n, known) that hold two components or more.

    Of bands with the same members one is enough. Large bands are summed up in parts and dealt to cells.
    """
    salted = spread.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    shared = salted.groupBy("band").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("who"), F.min("doc_id").alias("least"), F.sum("n").alias("weight"),
        F.min("known").alias("lo"), F.max("known").alias("hi")).filter("lo <> hi")
    shared = shared.groupBy("size", "who", "least").agg(F.min(F.struct("band", "weight")).alias("b"))
    shared = shared.select("b.band", _cells(F.col("size"), F.col("b.weight")).alias("cells"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return checkpoint(salted.join(shared, ["band", "salt"]).select("band", "cells", _dealt(F.col("cells"), 0).alias("cell"), "doc_id", "n", "known"))


def _met(members: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """Edges found by comparing the members of each cell that are not yet known as one."""
    return checkpoint(_compared(members.select("band", "cell", "doc_id", "known", F.lit(True).alias("active")), prints, threshold))


def _heads(members: DataFrame, met: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """Edges between the components of different cells of a band, by one member of each. Joins most of a large group of near copies."""
    bands_ = members.filter("cells > 1").select("band").distinct()
    heads = met.join(bands_, "band", "left_semi").select("band", F.col("root").alias("doc_id")).distinct().join(prints.select("doc_id", "n"), "doc_id")
    room = heads.groupBy("band").agg(_cells(F.count("*"), F.sum("n")).alias("cells"))
    heads = heads.join(room, "band").select("band", _dealt(F.col("cells"), 1).alias("cell"), "doc_id", F.col("doc_id").alias("known"), F.lit(True).alias("active"))
    return _compared(heads, prints, threshold).filter("root <> doc_id")


def _rest(members: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """Edges between the components that are left in bands of several cells.

    Members outside a band's largest component meet all that are not in theirs: each cell of the first with each cell of the band, as a task of its own.
    """
    count = members.groupBy("band", "known").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    whole = count.groupBy("band").agg(F.max(F.struct("size", "weight", "known")).alias("stay"), F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    left = F.col("size") - F.col("stay.size"), F.col("weight") - F.col("stay.weight")
    open_ = whole.filter(left[0] > 0).select("band", F.col("stay.known").alias("stay"), _cells(*left).alias("rests"))
    at = checkpoint(members.join(open_, "band"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    task = lambda i, j: (i * (1 << 31) + j).alias("cell")
    active = at.filter("known <> stay").withColumn("i", _dealt(F.col("rests"), 2)).withColumn("j", upto(F.col("cells")))
    others = at.withColumn("i", upto(F.col("rests")))
    met = active.select("band", task(F.col("i"), F.col("j")), "doc_id", "known", F.lit(True).alias("active")).unionByName(
        others.select("band", task(F.col("i"), F.col("cell")), "doc_id", "known", F.lit(False).alias("active")))
    return _compared(met, prints, threshold)


def links(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, known: DataFrame | None = None) -> DataFrame:
    """Edges (u < v, doc_ids) whose components are those of documents alike to the threshold; known (doc_id, head): components that need not be found again.

    A band in which all members are one component already is left out.
    A band of over CELL members is dealt to cells; one member of each component found in a cell meets those of others, which
    joins most of a large group of near copies. What then is in several components of a band is compared member by member.
    Null texts, texts without words and null ids have no links; repeated rows are members like others. An empty table has no
    links. Other columns are not read. A long text costs 4 bytes for each distinct shingle, whole.
    """
    # The sets are shuffled once: later joins by doc_id find them where they are.
    prints = dealt_by(sketches(docs.filter("doc_id is not null"), width).filter("n > 0"), "doc_id")
    base = prints.select("doc_id", "n", "bands")
    base = base.withColumn("known", F.col("doc_id")) if known is None else base.join(known.select("doc_id", F.col("head").alias("known")), "doc_id")
    members = _members(base.select("doc_id", "n", "known", F.explode("bands").alias("band")))
    met = _met(members, prints, threshold)
    edges = met.select("root", "doc_id").filter("root <> doc_id")
    large = members.filter("cells > 1")
    if not large.isEmpty():
        edges = checkpoint(edges.unionByName(_heads(members, met, prints, threshold).select("root", "doc_id")))
        edges = edges.unionByName(_rest(_known(large, _roots(edges)), prints, threshold).select("root", "doc_id").filter("root <> doc_id"))
    return edges.select(F.least("root", "doc_id").alias("u"), F.greatest("root", "doc_id").alias("v")).distinct()
