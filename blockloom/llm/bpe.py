"""Byte-level BPE encoding and decoding: speculate with greedy longest match, verify adjacent pairs, merge only what fails."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held, table

#: The pre-tokenizer's pattern (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words are remembered up to so many bytes in each Python worker.
MEMORY = 100 << 20
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE model file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.text: list[bytes] = [b""] * size
        for word, i in ids.items():
            self.text[i] = word.encode() if word in self.special else bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.text[i] = word.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        # Of a token: when it is made (-1: a byte, from the start) and of what.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = ids[a], ids[b], ids[a + b]
            if (i, j) not in self.rank:
                self.rank[i, j] = (r, k)
                if self.made[k] < 0:
                    self.made[k], self.left[k], self.right[k] = r, i, j
        self.byte_id = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        keys = np.array([(i << 32) | j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        specials = set(self.special.values())
        # Tokens that greedy matching may propose: those that merging makes of their own bytes.
        self.by_bytes = {t: i for i, t in enumerate(self.text) if t and i not in specials and (len(t) == 1 or self.made[i] >= 0)}
        whole = [i for i in self.by_bytes.values() if self.made[i] >= 0]
        good = self.compatible(self.left[whole], self.right[whole], self.made[whole])
        for i, ok in zip(whole, good):
            if not ok and self.merge(self.text[i]) != [i]:
                del self.by_bytes[self.text[i]]
        self.longest = max(map(len, self.by_bytes))

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b, side by side, stay as they are: no merge across the seam comes before those that make them.

        Merges are taken back in turn, latest first, on either side of the seam. Between the two tokens that stand
        there at a time, a merge that ranks before the one just taken back would have come first; at equal rank
        the one further left comes first. before: look only at merges that rank below it.
        """
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        good = np.ones(len(x), bool)
        limit = np.full(len(x), NEVER) if before is None else np.array(before, np.int64)
        live = np.arange(len(x))
        while len(live):
            xs, ys = x[live], y[live]
            bad = self.pair_rank(xs, ys) < limit[live]
            good[live[bad]] = False
            live, xs, ys = live[~bad], xs[~bad], ys[~bad]
            mx, my = self.made[xs], self.made[ys]
            go = (mx >= 0) | (my >= 0)
            live, xs, ys, mx, my = live[go], xs[go], ys[go], mx[go], my[go]
            # At equal rank the left token was made first, so the right one is taken back first.
            from_left = mx > my
            x[live] = np.where(from_left, self.right[xs], xs)
            y[live] = np.where(from_left, ys, self.left[ys])
            limit[live] = np.where(from_left, mx, my + 1)
        return good

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, known = [], 0, len(word), self.by_bytes
        while at < n:
            end = min(n, at + self.longest)
            while (i := known.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost at a tie, with a heap over a linked list."""
        ids = [self.byte_id[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        n = len(ids)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.rank[a, b][1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], left, *p))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out = [self.greedy(w) for w in words]
        flat = np.fromiter((i for ids in out for i in ids), np.int64)
        if len(flat) < 2:
            return out
        word = np.repeat(np.arange(len(out)), [len(ids) for ids in out])
        seam = np.flatnonzero(word[1:] == word[:-1])
        pairs, place = np.unique((flat[seam] << 32) | flat[seam + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        for k in np.unique(word[seam[~good[place]]]).tolist():
            out[k] = self.merge(words[k])
        return out


class Encoder:
    """Encodes texts; remembers words between texts."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        specials = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else (lambda t: [t])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, np.ndarray] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if self.held > MEMORY:
            self.forget()
            new = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, ids in zip(new, raw, self.vocabulary.encode_words(raw)):
            self.known[w] = np.array(ids, "<u4").tobytes()
            self.held += len(b) + 4 * len(ids) + 150

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a special token's string in a text is that token."""
        special = self.vocabulary.special
        split = [[[p] if p in special else self.find(p) for p in self.cut(t or "")] for t in texts]
        new = {w for parts in split for words in parts for w in words}
        new.difference_update(special)
        self.learn(new)
        known = {w: np.array([i], "<u4").tobytes() for w, i in special.items()}
        return [b"".join([b"".join([(known if words[0] in special else self.known)[w] for w in words]) for words in parts if words]) for parts in split]

    def decode(self, ids: bytes) -> str:
        pieces = self.vocabulary.text
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, if asked for), ids_sha256, decoded_sha256.

    path is the model file, on every executor; None looks up the public byte-level vocabulary there. Null texts are empty
    ones, of no tokens. Rows are judged one by one: repeated rows and null ids each give a row; an empty table gives an
    empty one. Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(Encoder, path or vocabulary_path("byte_bpe_50k.json"))
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                all_ids, hashes, decoded = enc.encode_all(part.column(1).to_pylist()), [], []
                for ids in all_ids:
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                columns = [part.column(0), pa.array([len(x) // 4 for x in all_ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in all_ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                                                 ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def op4_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
