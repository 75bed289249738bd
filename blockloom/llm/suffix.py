"""Suffix-array dedup: every byte covered by a long string that starts elsewhere too is removed.

Suffixes are taken at anchors: in each window of WINDOW starts, the place whose 8-byte gram hashes lowest. Equal strings
of SHORT bytes or more have their anchor at the same place within, so comparing the strings around anchors that share
their first CORE bytes finds every repeat, with one suffix for about 80 bytes of text. Sampled splitters deal the suffixes
out by their leading bytes and each bucket sorts by multikey quicksort. How far a string goes on equal to the right is read off the
common prefixes of neighbours in that order, to the left off the bytes before the anchor; the classes at a bucket's two ends are
compared with the neighbouring buckets' by digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, stored, table, written

#: What is removed: strings of so many bytes.
LENGTH = 400
#: What counts as a repeated passage: strings of SHORT bytes, in runs of WORDS words or more.
SHORT, WORDS = 256, 50
WORD_RE = r"[^\x20\x09-\x0D]+"
WINDOW = 160
GRAM = 8
#: Bytes that all strings with the same anchor share.
CORE = SHORT - WINDOW + 1
#: Bytes of a suffix, padded to whole words.
SUFFIX = -(-LENGTH // 8) * 8
#: Leading bytes by which suffixes are dealt out.
LEAD = 8
#: Suffixes of a bucket, about: what a task sorts at once.
BUCKET = 40_000
#: Members of a class that are compared pair by pair; more are grouped.
PAIRED = 12
#: Bytes handled at once; anchors' places fit the low 24 bits of their keys.
SEGMENT = 2 << 20
PLACE = np.uint64(0xFFFFFF)


def anchors(buf: np.ndarray, docs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) for the starts of strings of SHORT bytes of the texts buf[a:b], SEGMENT starts of each at most; an anchor serves a run of starts."""
    none = np.zeros(0, np.int64)
    n = len(buf) - (GRAM - 1)
    if len(buf) < SHORT:
        return none, none, none
    key = np.empty(n, np.uint64)
    for r in range(min(GRAM, n)):
        key[r::GRAM] = np.frombuffer(buf[r : r + len(key[r::GRAM]) * GRAM].tobytes(), "<u8")
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key &= ~PLACE
    key |= np.arange(n, dtype=np.uint64)
    wide = 1  # key[i] is the least of the keys i .. i + wide - 1
    while wide < WINDOW:
        step = min(wide, WINDOW - wide)
        np.minimum(key[:-step], key[step:], out=key[:-step])
        wide += step
    valid = np.zeros(len(buf), bool)
    for a, b in docs:
        if b - a >= SHORT:
            valid[a : min(b - SHORT + 1, a + SEGMENT)] = True
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none
    q = (key[start] & PLACE).astype(np.int64)
    first = np.r_[True, q[1:] != q[:-1]]
    last = np.r_[first[1:], True]
    return q[first], start[first], start[last]


def segments(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of about SEGMENT bytes with (text number, offset of the text's part in the text, from, to). Long texts come in parts of SEGMENT starts each, that overlap by LENGTH - 1."""
    held, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SHORT + 1), SEGMENT):
            part = t[at : at + SEGMENT + LENGTH - 1]
            if size and size + len(part) > SEGMENT:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
            held.append(part)
            parts.append((i, at, size, size + len(part)))
            size += len(part)
    if held:
        yield b"".join(held), parts


def _anchored(texts: list[bytes]):
    """For each part of a text with anchors: (text number, offset, buffer, part's end in it, places, first starts, last starts, core hashes)."""
    from xxhash import xxh3_64_intdigest

    for buf, parts in segments(texts):
        q, lo, hi = anchors(np.frombuffer(buf, np.uint8), [(a, b) for _, _, a, b in parts])
        # Starts, not anchors, tell the parts apart: an anchor is never before its first start.
        at = np.searchsorted(lo, [a for _, _, a, _ in parts] + [len(buf)])
        for (i, offset, a, b), x, y in zip(parts, at[:-1].tolist(), at[1:].tolist()):
            if x < y:
                places = q[x:y].tolist()
                cores = [xxh3_64_intdigest(buf[p : p + CORE]) - (1 << 63) for p in places]
                yield i, offset - a, buf, b, places, lo[x:y].tolist(), hi[x:y].tolist(), cores


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cores of each text, over all its parts, and whether they are at two places in it."""
    for batch in batches:
        rows, cores, prints, twice = [], [], [], []
        for i, parts in groupby(_anchored([t.as_py() for t in batch.column(1)]), key=lambda x: x[0]):
            places, found = [], []
            for _, shift, _, _, at, _, _, hashes in parts:
                places.append(np.array(at, np.int64) + shift)
                found.append(np.array(hashes, np.int64))
            # Two parts may share an anchor; it counts once.
            _, once = np.unique(np.concatenate(places), return_index=True)
            v, n = np.unique(np.concatenate(found)[once], return_counts=True)
            rows.append(np.full(len(v), batch.column(0)[i].as_py(), np.int64))
            prints.append(np.full(len(v), batch.column(2)[i].as_py(), np.int64))
            cores.append(v)
            twice.append(n > 1)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, cores, prints, twice)], ["row", "core", "print", "twice"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes from anchors whose core is wanted: bytes from the anchor on, bytes before it, and the anchor's places in the text with just these bytes around."""
    names = ["suffix", "head", "row", "place", "low", "high", "places"]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    for batch in batches:
        wanted = [set(x) for x in batch.column(2).to_pylist()]
        found: dict[tuple, list[int]] = {}
        size = 0

        def flush():
            rows = [(s, h, r, p[0], lo, hi, p) for (r, lo, hi, h, s), p in found.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        done = -1
        for i, shift, buf, end, places, lo, hi, cores in _anchored([t.as_py() for t in batch.column(1)]):
            if i != done and size > 4 << 20:
                yield flush()
                found, size = {}, 0
            done, want, row = i, wanted[i], batch.column(0)[i].as_py()
            for p, a, b, c in zip(places, lo, hi, cores):
                if c in want:
                    # Starts are p - high .. p - low.
                    at = found.setdefault((row, p - b, p - a, buf[a:p], buf[p : min(b + LENGTH, end)]), [])
                    if not at:
                        size += b + LENGTH - a + 100
                    at.append(p + shift)
        if found:
            yield flush()


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of words (suffixes as big-endian 8-byte words): three-way partition by one word, equal rows go on to the next."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, col = todo.pop()
        if hi - lo < 2 or col == words.shape[1]:
            continue
        rows = order[lo:hi]
        if hi - lo <= 24:
            order[lo:hi] = rows[np.lexsort(words[rows, col:].T[::-1])]
            continue
        v = words[rows, col]
        pivot = np.sort(v[:: max(1, len(v) // 32)])
        pivot = pivot[len(pivot) // 2]
        less, same = v < pivot, v == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(same.sum())
        order[lo:hi] = np.concatenate([rows[less], rows[same], rows[~(less | same)]])
        todo += [(lo, a, col), (a, b, col + 1), (b, hi, col)]
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of words shares with the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4096):
        a, b = words[order[lo - 1 : lo + 4095]], words[order[lo : lo + 4096]]
        differ = a[: len(b)] ^ b
        at = np.where((differ != 0).any(1), (differ != 0).argmax(1), words.shape[1])
        x = differ[np.arange(len(b)), np.minimum(at, words.shape[1] - 1)]
        # Leading zero bytes of the first word that differs.
        zeros = sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        out[lo : lo + 4096] = 8 * at + np.where(at < words.shape[1], zeros, 0)
    return out


def runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def repeated_starts(known: list[tuple], reach: list[int], size: int) -> Iterator[tuple[int, list[list[int]]]]:
    """(d, groups): members whose strings of `size` bytes from d bytes before the anchor are equal.

    known: (head, suffix, least and most bytes before the anchor of a start) in suffix order; reach: bytes that a suffix shares with the one
    before it. Strings are equal if the suffixes go on equal for size - d bytes, which is a run of neighbours, and the d bytes before are equal.
    """
    first = min(max(low, size - len(suffix)) for _, suffix, low, _ in known)
    for d in range(first, max(x[3] for x in known) + 1):
        groups: dict[tuple[int, bytes], list[int]] = {}
        run = 0
        for j, (head, suffix, low, high) in enumerate(known):
            if reach[j] < size - d:
                run += 1
            if low <= d <= high and len(suffix) >= size - d:
                groups.setdefault((run, head[high - d :]), []).append(j)
        if groups:
            yield d, list(groups.values())


def equal_pairs(known: list[tuple], reach: list[int], size: int) -> Iterator[tuple[int, int, int, int]]:
    """repeated_starts() for a few members, as (member, member, least d, most d)."""
    for i, (head, suffix, low, high) in enumerate(known):
        right = SUFFIX
        for j in range(i + 1, len(known)):
            right = min(right, reach[j])
            if right < CORE:
                break
            other = known[j]
            n = min(high, other[3])
            differ = int.from_bytes(head[high - n :], "little") ^ int.from_bytes(other[0][other[3] - n :], "little")
            left = n - (differ.bit_length() + 7) // 8
            near = max(low, other[2], size - min(right, len(suffix), len(other[1])))
            if near <= left:
                yield i, j, near, left


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of repeated strings in a bucket: rows (row, low, high) of starts, with the strings' size; and for the classes at the bucket's ends, rows with a digest to be compared with the other buckets'."""
    from xxhash import xxh3_128_digest

    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    if not rows:
        return
    words = np.frombuffer(b"".join(r[0].ljust(SUFFIX, b"\0") for r in rows), ">u8").reshape(len(rows), -1).astype(np.uint64)
    order = multikey_quicksort(words)
    shared = common_prefixes(words, order).tolist()
    order = order.tolist()
    del words
    out: list[tuple] = []

    def batch():
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["digest", "many", "size", "row", "low", "high"])
        out.clear()
        return done

    def class_of(lo: int, hi: int, edge: bool) -> None:
        """order[lo:hi] share CORE bytes."""
        same: dict[tuple, list[int]] = {}
        reach: list[int] = []
        least = 0
        for k in range(lo, hi):
            suffix, head, _, _, low, high, _, _ = rows[order[k]]
            least = min(least, shared[k]) if k > lo else 0
            own = same.setdefault((head, suffix, low, high), [])
            if not own:
                reach.append(least)
                least = SUFFIX
            own.append(order[k])
        known, members = list(same), list(same.values())
        settled = [len(own) > 1 or len(rows[own[0]][6]) > 1 for own in members]
        for size in (SHORT, LENGTH):
            for (head, suffix, low, high), own, many in zip(known, members, settled):
                near = max(low, size - len(suffix))  # starts nearer to the anchor have no such string
                if many and near <= high:
                    out.extend((None, None, size, rows[k][2], p - high, p - near) for k in own for p in rows[k][6])
            if len(known) == 1 and not edge:
                continue
            hits: dict[int, list[tuple[int, int]]] = {}
            if not edge and len(known) <= PAIRED:
                for i, j, lo_d, hi_d in equal_pairs(known, reach, size):
                    for x in (i, j):
                        hits.setdefault(x, []).append((lo_d, hi_d + 1))
            else:
                for d, groups in repeated_starts(known, reach, size):
                    for js in groups:
                        many = len(js) > 1 or settled[js[0]]
                        if many:
                            for j in js:
                                hits.setdefault(j, []).append((d, d + 1))
                        if edge:
                            head, suffix, _, high = known[js[0]]
                            row = rows[members[js[0]][0]]
                            out.append((xxh3_128_digest(head[high - d :] + suffix[: size - d]), many, size, None if many else row[2], row[3] - d, row[3] - d))
            for j, ds in hits.items():
                if not settled[j]:
                    row, place = rows[members[j][0]][2:4]
                    out.extend((None, None, size, row, place - y + 1, place - x) for x, y in runs(ds))

    # Classes at the bucket's ends, in the order by which suffixes were dealt out, may go on in the next bucket.
    ends = [f((r[0][:LEAD], r[7]) for r in rows) for f in (min, max)]
    start = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or shared[k] < CORE:
            edge = (rows[order[start]][0][:LEAD], rows[order[start]][7]) in ends
            if edge or k - start > 1 or len(rows[order[start]][6]) > 1:
                class_of(start, k, edge)
            start = k
            if len(out) > 20000:
                yield batch()
    if out:
        yield batch()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes that the repeated strings of LENGTH bytes cover; counts passages among what those of SHORT bytes cover."""
    for batch in batches:
        out = []
        for row, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            gone = runs([(s["low"], s["high"] + LENGTH) for s in spans if s["size"] == LENGTH])
            kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)]))
            passages = [n for a, b in runs([(s["low"], s["high"] + SHORT) for s in spans if s["size"] == SHORT]) if (n := len(text[a:b].split())) >= WORDS]
            out.append((row, len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(passages), sum(passages), kept))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                                             ["row", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", "kept"])


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words and, if asked for, kept (the bytes left).

    Strings of LENGTH bytes that start elsewhere too are removed. Shorter repeats stay and are reported: a passage is a maximal run of
    bytes that repeated strings of SHORT bytes cover, if it holds WORDS words or more (parts of words at its ends count); n_passages
    and passage_words (words in them) tell of those, removed ones included.

    Texts are UTF-8 bytes, null is empty. Equal texts are found first, by their SHA-256: all of each is a repeat,
    and one of them stands for all in the search. Repeated rows are equal texts; null ids are documents like others.
    Long texts go through the search in parts that overlap, of SEGMENT bytes. An empty table gives an empty one; other columns are not read.
    Rows are told apart by their places; a frame that does not read a stored table is written first.
    """
    spark, docs = docs.sparkSession, stored(docs)
    bytes_ = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), bytes_.alias("text"))
    words = F.when(F.octet_length("text") >= SHORT, F.regexp_count(F.col("text").cast("string"), F.lit(WORD_RE))).otherwise(0)
    meta = checkpoint(texts.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), words.cast("long").alias("n_words"), F.unhex(F.sha2("text", 256)).alias("sha")))
    same = checkpoint(meta.filter(F.col("n_bytes") >= SHORT).groupBy("sha").agg(F.min("row").alias("row"), F.count("*").alias("n_same")))

    # A core counts as repeated if texts that differ hold it, or one text does twice; equal texts do not make it so.
    cores = texts.filter(F.octet_length("text") >= SHORT).select("row", "text", F.xxhash64("text").alias("print")).mapInArrow(
        _cores, "row long, core long, print long, twice boolean")
    repeated = cores.groupBy("core").agg(F.min("print").alias("a"), F.max("print").alias("b"), F.max("twice").alias("twice")).filter("twice or a <> b").select("core")
    wanted = cores.select("row", "core").join(repeated, "core", "left_semi").groupBy("row").agg(F.collect_list("core").alias("cores")).join(same.select("row"), "row", "left_semi")
    # Texts with a wanted core, once: the search and the cut read them.
    near = written(texts.select("row", "text").join(wanted, "row").select("row", "text", "cores"))
    suffixes = near.mapInArrow(_suffixes, "suffix binary, head binary, row long, place long, low int, high int, places array<long>")
    n = near.agg(F.sum(F.size("cores"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
    # Splitters are short: a suffix's leading bytes, then a hash of its core, which keeps a class together, then its place, which cuts large classes.
    dealt = suffixes.withColumn("lead", F.substring("suffix", 1, LEAD)).withColumn("core", F.xxhash64(F.substring("suffix", 1, CORE)))
    found = checkpoint(dealt.repartitionByRange(buckets, "lead", "core", "row", "place").drop("lead").mapInArrow(_compare, "digest binary, many boolean, size int, row long, low long, high long"))

    ends = found.filter("digest is not null")
    twice = ends.groupBy("digest").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).filter("n > 1").select("digest")
    across = ends.filter("row is not null").join(twice, "digest", "left_semi")
    spans = found.filter("digest is null").select("row", "size", "low", "high").unionByName(across.select("row", "size", "low", "high"))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("size", "low", "high")).alias("spans"))
    single = same.filter("n_same = 1").select("row")
    cut = near.select("row", "text").join(spans.join(single, "row"), "row").select("row", "text", "spans").mapInArrow(
        _cut, "row long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long, kept binary")
    cut = cut if with_text else cut.drop("kept")

    copied = meta.join(same.filter("n_same > 1").select("sha"), "sha", "left_semi").select("row", F.lit(True).alias("copied"))
    copy = F.coalesce("copied", F.lit(False))
    whole, passage = copy & (F.col("n_bytes") >= LENGTH), copy & (F.col("n_words") >= WORDS)
    none = F.lit(0).cast("long")
    rows = meta.join(cut, "row", "left").join(copied, "row", "left")
    out = [
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy, passage.cast("long")).otherwise(F.coalesce("n_passages", none)).alias("n_passages"),
        F.when(passage, F.col("n_words")).when(copy, none).otherwise(F.coalesce("passage_words", none)).alias("passage_words"),
    ]
    if with_text:
        rows = rows.join(texts.select("row", "text"), "row")
        out.append(F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "text")).alias("kept"))
    return rows.select(*out)


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
