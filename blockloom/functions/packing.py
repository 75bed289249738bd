"""Bytecode of packed metadata: lists of numbers as runs of equal steps, blocks, and paths of nodes as text."""

from __future__ import annotations

import base64
import struct
import sys
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

# What packs travels to the executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Instructions by their number, the upper half of a byte (fixed values of the format). The lower half is a small operand, or the width of
#: a wide one. Names with "8" take the operand's upper four bits from the lower half and eight more from the next byte.
OPS = ["set", "up", "up wide", "down", "down wide", "same", "same8", "times", "times8", "bytes", "bytes wide", "split8"]
CODE = {name: k << 4 for k, name in enumerate(OPS)}
#: Longest run of one instruction (12 bits), low bits of a split value, and the header bytes of a node (fixed values of the format).
LONGEST, LOW, HEADER = 4095, 24, 32
WORD = (1 << 64) - 1


def _wide(op: str, value: int) -> bytes:
    """An instruction with its operand in the least of 1, 2, 4, 8 bytes that holds it."""
    width = next(w for w in (1, 2, 4, 8) if value < 1 << 8 * w)
    return bytes([CODE[op] | width]) + value.to_bytes(width, "little")


def _twelve(op: str, value: int) -> bytes:
    return bytes([CODE[op] | value >> 8, value & 255])


def _short(op: str, value: int, otherwise) -> bytes:
    """The operand in the lower half if it fits."""
    return bytes([CODE[op] | value]) if value < 16 else otherwise(value)


def pack_numbers(numbers: list[int]) -> bytes:
    """Unsigned 64-bit numbers as the first one and runs of equal steps; none give no bytes."""
    if not numbers:
        return b""
    out = [_wide("set", numbers[0])]
    for step, run in groupby(b - a for a, b in pairwise(numbers)):
        left = sum(1 for _ in run)
        while left:
            n = min(left, LONGEST)
            left -= n
            if step == 0:
                out.append(_short("same", n, lambda v: _twelve("same8", v)))
                continue
            if n > 1:
                out.append(_short("times", n, lambda v: _twelve("times8", v)))
            way = "up" if step > 0 else "down"
            out.append(_short(way, abs(step), lambda v: _wide(f"{way} wide", v)))
    return b"".join(out)


def pack_split(numbers: list[int]) -> bytes:
    """Numbers as two lists, that of the bits from LOW on and that of those below: block and time of a mapping run apart."""
    return _twelve("split8", len(numbers)) + pack_numbers([n >> LOW for n in numbers]) + pack_numbers([n & (1 << LOW) - 1 for n in numbers])


def pack_bytes(data: bytes) -> bytes:
    return _short("bytes", len(data), lambda n: _wide("bytes wide", n)) + data


class Reader:
    """Plays bytecode: run(n) gives what the next instructions give, n bytes or more. Broken code is a ValueError."""

    def __init__(self, code: bytes):
        self.code, self.at, self.last = code, 0, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.code):
            raise ValueError("packed data ends early")
        return bytes(self.code[self.at - n : self.at])

    def operand(self, low: int, wide: bool) -> int:
        if not wide:
            return low
        if low not in (1, 2, 4, 8):
            raise ValueError(f"operand of {low} bytes")
        return int.from_bytes(self.take(low), "little")

    def walk(self, step: int, times: int) -> bytes:
        """Times numbers, each step after the one before; they wrap at 64 bits."""
        out = np.uint64(self.last) + np.arange(1, times + 1, dtype=np.uint64) * np.uint64(step & WORD)
        self.last = int(out[-1]) if times else self.last
        return out.astype("<u8").tobytes()

    def one(self, times: int = 1) -> bytes:
        tag, low = divmod(self.take(1)[0], 16)
        if tag >= len(OPS):
            raise ValueError(f"unknown instruction {tag}")
        op = OPS[tag]
        if op.endswith("8"):
            low = low << 8 | self.take(1)[0]
        name, wide = op.rstrip("8").split(" ")[0], op.endswith("wide")
        if name == "split":
            high, rest = (np.frombuffer(self.run(8 * low)[: 8 * low], "<u8") for _ in range(2))
            return (high << np.uint64(LOW) | rest & np.uint64((1 << LOW) - 1)).astype("<u8").tobytes()
        if name == "times":
            return self.one(low)
        if name == "same":
            return self.walk(0, low)
        value = self.operand(low, wide or name == "set")
        if name == "bytes":
            return self.take(value)
        if name == "set":
            self.last = value
            return self.walk(0, times)
        return self.walk(value if name == "up" else -value, times)

    def run(self, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            out += self.one()
        return bytes(out)


def pack_block(data: bytes, kind: str) -> bytes:
    """A block as bytecode: keys and numbers of nodes as lists, values of leaves as split ones, all else as bytes.

    A node whose header claims more than the block holds goes as bytes too.
    """
    flags, most, size = struct.unpack_from("<I12xII", data, 4)
    leaf = flags == 2
    numbers = not leaf or size == 8
    end = HEADER + 8 * most * (2 if numbers else 1)
    if kind != "node" or end > len(data):
        return pack_bytes(data)
    listed = np.frombuffer(data, "<u8", (end - HEADER) // 8, HEADER).tolist()
    keys, values = listed[:most], listed[most:]
    body = (pack_split if leaf else pack_numbers)(values) if numbers else b""
    return pack_bytes(data[:HEADER]) + pack_numbers(keys) + body + (pack_bytes(data[end:]) if end < len(data) else b"")


def path_text(path: list[int]) -> str:
    """Places of nodes from the root on as text, 127 at most; the superblock, place 0, at the start is implied by an even first byte."""
    rest = path[1:] if path and path[0] == 0 else path
    if len(rest) > 127:
        raise ValueError("path too long")
    return base64.b64encode(bytes([2 * len(rest) + (len(rest) == len(path))]) + pack_numbers(rest)).decode()


def text_path(text: str) -> list[int]:
    code = base64.b64decode(text, validate=True)
    if not code:
        raise ValueError("empty path")
    n = code[0] >> 1
    found = np.frombuffer(Reader(code[1:]).run(8 * n), "<u8").tolist()
    if len(found) != n:
        raise ValueError("path of another length than it says")
    return found if code[0] & 1 else [0, *found]


@F.pandas_udf(StringType())
def encode_path(paths: pd.Series) -> pd.Series:
    """Arrays of places as text; null stays null."""
    return paths.map(lambda p: None if p is None else path_text([int(x) for x in p]))


@F.pandas_udf(ArrayType(LongType()))
def decode_path(texts: pd.Series) -> pd.Series:
    """The arrays that encode_path() was given. Text that is no path raises."""
    return texts.map(lambda t: None if t is None else text_path(t))
