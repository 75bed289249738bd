"""Token counts: huge documents are encoded in overlapping chunks, spliced at boundaries proven stable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import vocabulary_path
from .common import held, table

#: Characters of a chunk and of the overlap it starts with.
CHUNK, OVERLAP = 16384, 256
LIMIT = 4096


class Counter:
    """Counts a sentencepiece model's tokens.

    A place in a text is stable if no piece holds the two characters on its sides next to each other: no token can
    cover both, so no merge crosses it, and the tokens on either side do not depend on what is beyond. An encoding of any
    stretch around such a place has a token boundary there, and from there on equals that of the whole text.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        model, size = self.model, self.model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(size)]
        self.joined = {p[k : k + 2] for p, ok in zip(pieces, plain) if ok for k in range(len(p) - 1)}
        # Bytes of the normalised text that a token covers; that of unknown tokens cannot be told (there are none with byte fallback).
        self.width = np.array([len(p.encode()) if ok else 1 for p, ok in zip(pieces, plain)], np.int64)
        self.whole_only = not any(map(model.is_byte, range(size)))

    def stable(self, a: str, b: str) -> bool:
        return a.replace(" ", "▁") + b.replace(" ", "▁") not in self.joined

    def count(self, text: str | None) -> int:
        text = text or ""
        if len(text) <= self.chunk or self.whole_only:
            return len(self.model.encode(text))
        total, cut, start, last = 0, 0, 0, len(text)
        ends = self.offsets(text[: self.chunk])
        end = self.chunk
        while True:
            # Tokens of this chunk count from `cut` on, up to a place that the next chunk's encoding has too.
            if end >= last:
                return total + len(ends) - self.index(ends, text, start, cut)
            overlap = self.overlap
            while True:
                next_start, next_end = max(start + 1, end - overlap), min(last, end - overlap + self.chunk if overlap < self.chunk else end + overlap)
                next_ends = self.offsets(text[next_start:next_end])
                place = self.splice(text, start, end, ends, next_start, next_ends, cut)
                if place is not None:
                    break
                if overlap >= end - start:  # nothing in all of this chunk: it grows instead
                    end = min(last, start + 2 * (end - start))
                    ends = self.offsets(text[start:end])
                    if end >= last:
                        break
                overlap *= 2
            if place is None:
                continue
            total += self.index(ends, text, start, place) - self.index(ends, text, start, cut)
            cut, start, end, ends = place, next_start, next_end, next_ends

    def offsets(self, part: str) -> np.ndarray:
        """Where each token ends, in bytes of the normalised part."""
        return np.cumsum(self.width[self.model.encode(part)])

    def at(self, text: str, start: int, place: int) -> int:
        """The byte of the part from start on at which the character `place` begins; the model puts a space before the part."""
        return len(("▁" + text[start:place].replace(" ", "▁")).encode())

    def index(self, ends: np.ndarray, text: str, start: int, place: int) -> int:
        """Tokens before `place`."""
        return 0 if place == 0 else int(np.searchsorted(ends, self.at(text, start, place), side="right"))

    def splice(self, text, start, end, ends, next_start, next_ends, cut) -> int | None:
        """A stable place in the overlap at which both encodings have a boundary, from the middle outwards."""
        middle = (next_start + end) // 2
        for k in range(end - next_start):
            place = middle + (k + 1) // 2 * (1 if k % 2 else -1)
            if max(next_start, cut) < place < end and self.stable(text[place - 1], text[place]):
                a, b = self.at(text, start, place), self.at(text, next_start, place)
                if ends[np.searchsorted(ends, a)] == a and next_ends[np.searchsorted(next_ends, b)] == b:
                    return place
        return None


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.

    path is the model file, on every executor; None looks up the public piece vocabulary there. Null texts are empty ones,
    of no tokens. Rows are judged one by one: repeated rows and null ids each give a row; an empty table gives an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(Counter, path or vocabulary_path("piece_bpe_32k.model"), chunk, overlap)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    cols = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return cols.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
