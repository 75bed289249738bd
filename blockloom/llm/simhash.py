"""SimHash near-dedup by anchor-point covering, with connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shingles
from .common import checkpoint, stored, table

SEED = 42
LOW31 = (1 << 31) - 1
PAIRS = 1 << 20
#: Rows of an anchor that one task compares.
CROWD = 1 << 15


def shingle_bits(text: str | None, width: int, hash64) -> int:
    """The 64-bit fingerprint; zero without words. A bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white space bytes only
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= width:
        return hash64(body, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    hashes = [hash64(body[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.array(hashes[k : k + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fp = np.array([shingle_bits(t.as_py(), width, xxh64_intdigest) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of the [31, 26] Hamming code: the xor of the places (from 1) of the bits set; 0 for a code word, else the place of the one wrong bit."""
    s = np.zeros(x.shape, np.int64)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        s |= (np.bitwise_count(x & np.int64(mask)).astype(np.int64) & 1) << k
    return s


#: For each syndrome the pairs of places whose xor it is: what leads to the code words at distance two.
_PAIRS = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] if s else [0] * 15 for s in range(32)], np.int64)


def cover(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, home) rows.

    The fingerprint has two halves, so of two that differ in three bits at most, one half differs in one bit at most.
    Anchors are the code words of the perfect [31, 26] Hamming code over 31 bits of a half: covering radius 1, so each
    half has one home anchor, and whatever is within a bit of it is within 1 + 1 = 2 of that anchor. A fingerprint
    is replicated to all code words within 2: its home and the 15 others at distance two (none for a code word).
    """
    anchors, values, homes = [], [], []
    for half in (0, 1):
        x = (fp >> (32 * half)) & LOW31
        s = syndrome(x)
        home = np.where(s > 0, x ^ (np.int64(1) << np.maximum(s - 1, 0)), x)
        anchors.append((home << 1) | half)
        values.append(fp)
        homes.append(np.ones(len(fp), bool))
        off = s > 0
        far = x[off][:, None] ^ _PAIRS[s[off]]
        anchors.append(((far << 1) | half).ravel())
        values.append(np.repeat(fp[off], 15))
        homes.append(np.zeros(far.size, bool))
    return np.concatenate(anchors), np.concatenate(values), np.concatenate(homes)


def _cover_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 8192):
            a, v, h = cover(batch.column(0).slice(k, 8192).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(v), pa.array(h)], ["anchor", "fp", "home"])


class Forest:
    """Union-find over sorted values; union() takes arrays of places."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def compare_sorted(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different fingerprints that meet at an anchor, as edges of a forest: one less than there are members, not all pairs.

    Rows come in order of anchor. Each home row is compared with every row of its anchor, in blocks of PAIRS.
    """
    cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.array([], int)
    size = np.diff(np.r_[cuts, len(anchor)])
    group = np.repeat(np.arange(len(cuts)), size)
    at = np.flatnonzero(home & (size[group] > 1) if len(anchor) else home)
    values, place = np.unique(fp, return_inverse=True)
    forest = Forest(len(values))
    work = np.cumsum(size[group[at]])
    done = 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + PAIRS, side="right")))
        rows = at[done:upto]
        n = size[group[rows]]
        for lo in range(0, int(n.max()), PAIRS):  # a single row's anchor may itself hold over PAIRS rows
            m = np.clip(n - lo, 0, PAIRS)
            left = np.repeat(rows, m)
            right = np.repeat(cuts[group[rows]] + lo, m) + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= bits  # signed values would count the bits of their absolute value
            a, b = place[left[near]], place[right[near]]
            forest.union(a[a != b], b[a != b])
        done = upto
    root = forest.find(np.arange(len(values)))
    tied = np.flatnonzero(root != np.arange(len(values)))
    return values[root[tied]], values[tied]


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None

        def flush(parts):
            a, f, h = (np.concatenate(x) for x in zip(*parts))
            u, v = compare_sorted(a, f, h, bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held = 0
        for batch in batches:
            a, f, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(a):
                continue
            if held >= 200_000 and a[-1] != last:
                # Flush whole anchors only: the tail that continues into this batch goes with its anchor.
                k = int(np.searchsorted(a, last, side="right"))
                parts.append((a[:k], f[:k], h[:k]))
                yield flush(parts)
                parts, held = [], 0
                a, f, h = a[k:], f[k:], h[k:]
            parts.append((a, f, h))
            held, last = held + len(a), a[-1]
        if parts:
            yield flush(parts)

    return run


def links(distinct: DataFrame, bits: int = 3, crowd: int = CROWD) -> DataFrame:
    """Edges (u < v as stored) whose components are those of all links between the distinct fingerprints.

    The rows of an anchor are compared in one task. Those of an anchor with over crowd rows are dealt to k cells of crowd rows or so,
    and each pair of cells is a task of its own: its home rows of one cell with all rows of the other, so none is left out.
    """
    spread = distinct.select("fp").mapInArrow(_cover_batches, "anchor long, fp long, home boolean")
    dealt = spread.repartition("anchor").withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    alone = dealt.filter(F.col("n") <= crowd).select("anchor", "fp", "home").sortWithinPartitions("anchor")
    k = F.ceil(F.col("n") / crowd)
    busy = dealt.filter(F.col("n") > crowd).withColumn("k", k).withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("k")))
    others = F.sequence(F.lit(0).cast("long"), F.col("k") - 1)
    homes = busy.filter("home").select("anchor", "fp", F.lit(True).alias("home"), F.col("cell").alias("i"), F.explode(others).alias("j"))
    members = busy.select("anchor", "fp", F.lit(False).alias("home"), F.explode(others).alias("i"), F.col("cell").alias("j"))
    # A pair of cells is named by a hash: where two pairs share one, more rows are compared, never fewer.
    paired = homes.unionByName(members).select(F.xxhash64("anchor", "i", "j").alias("anchor"), "fp", "home")
    paired = paired.repartition("anchor").sortWithinPartitions("anchor")
    run = _compare(bits)
    return alone.mapInArrow(run, "u long, v long").unionByName(paired.mapInArrow(run, "u long, v long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges, by contraction.

    Each round hooks a node to its smallest neighbour if that is smaller, halves the paths, and carries the edges to
    the roots; loops and repeats go, until no edge is left: each round joins at least two nodes of each component that is left. A round moves the edges that are left, aggregated, so a hub costs no more than others.
    """
    left, maps = checkpoint(edges.select("u", "v")), []
    while not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        p = checkpoint(p)
        for _ in range(2):  # pointer jumping
            q = p.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            p = p.join(q, p.root == q.mid, "left").select("node", F.coalesce("top", "root").alias("root"))
        p = checkpoint(p)
        maps.append(p)
        a, b = p.select(F.col("node").alias("u"), F.col("root").alias("ru")), p.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = left.join(a, "u").join(b, "v").select("ru", "rv")
        # A root that is not yet a root of its own keeps its tie to what is above it.
        q = p.select(F.col("node").alias("mid"), F.col("root").alias("rv"))
        above = p.select(F.col("root").alias("ru")).distinct().join(q, F.col("ru") == q.mid).select("ru", "rv")
        left = checkpoint(moved.union(above).filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    total = maps[-1]
    for p in reversed(maps[:-1]):
        up = total.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        total = p.join(up, p.root == up.mid, "left").select("node", F.coalesce("top", "root").alias("root"))
    return total


def groups(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component).

    Null texts count as empty; texts without words have fingerprint zero and link as others do. Repeated rows
    each give a row. Null ids join components but name one only if it has no other. An empty table gives an empty one; other
    columns are not read. A long text is read whole, its shingles summed a few thousand at a time.
    """
    prints = checkpoint(fingerprints(docs, width))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, bits))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = checkpoint(named.join(ids, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike(docs: DataFrame, width: int = 3, bits: int = 3, threshold: float = shingles.THRESHOLD) -> DataFrame:
    """doc_id, head: the smallest doc_id of its group. docs has unique ids that are not null, and text.

    Groups are those of the fingerprints, joined where texts are alike in five-word shingles (shingles.THRESHOLD):
    such texts often differ in four to eleven bits, further than anchors can reach.
    """
    found = checkpoint(groups(docs, width, bits).select("doc_id", F.col("component_id").alias("head")))
    a, b = found.select(F.col("doc_id").alias("u"), F.col("head").alias("hu")), found.select(F.col("doc_id").alias("v"), F.col("head").alias("hv"))
    edges = shingles.links(docs, threshold=threshold, known=found).join(a, "u").join(b, "v").filter("hu <> hv").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v")).distinct()
    roots = components(edges)
    return found.join(roots, found["head"] == roots["node"], "left").select("doc_id", F.coalesce("root", "head").alias("head"))


def keep_one(docs: DataFrame, width: int = 3, bits: int = 3, threshold: float = shingles.THRESHOLD) -> DataFrame:
    """Of each group of alike rows the one with the smallest doc_id, null ids last; of rows with the same id one.

    Texts without words (null ones too) are alike. Long texts are judged whole. An empty table gives an empty one. All columns of the
    input stay, whatever their names. Rows are told apart by their places; a frame that does not read a stored table is written first.
    """
    docs = stored(docs)
    at = F.monotonically_increasing_id()
    found = alike(docs.select(at.alias("doc_id"), "text"), width, bits, threshold).select(F.col("doc_id").alias("row"), "head")
    ids = docs.select(at.alias("row"), F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    named = checkpoint(found.join(ids, "row").select("head", order.alias("order")))
    kept = named.groupBy("head").agg(F.min("order").alias("best")).select(F.col("best.row").alias("_row"))
    # By row, not by head: the rows of a large group stay dealt out.
    dropped = named.select(F.col("order.row").alias("_row")).join(kept, "_row", "left_anti")
    return docs.select(F.struct("*").alias("doc"), at.alias("_row")).join(dropped, "_row", "left_anti").select("doc.*")
