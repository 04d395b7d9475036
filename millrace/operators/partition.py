"""Partition expressions: hash, window, and the byte-exact SipHash split."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyHash:
    """All key columns hashed into n parts; rows with null in every key go to part 0's hash like any other value."""

    keys: tuple[str, ...]
    parts: int

    def column(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")


@dataclass(frozen=True)
class Window:
    """Buckets of `size` of one whole-number column; there are no empty ones."""

    key: str
    size: int

    def column(self) -> Column:
        return F.floor(F.col(self.key) / F.lit(self.size)).cast("bigint")


def siphash13(data: bytes) -> int:
    """SipHash-1-3 with zero keys."""
    mask = (1 << 64) - 1
    v0, v1, v2, v3 = 0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573
    turn = lambda x, b: (x << b | x >> (64 - b)) & mask

    def sip():
        nonlocal v0, v1, v2, v3
        v0 = (v0 + v1) & mask
        v1 = turn(v1, 13) ^ v0
        v0 = turn(v0, 32)
        v2 = (v2 + v3) & mask
        v3 = turn(v3, 16) ^ v2
        v0 = (v0 + v3) & mask
        v3 = turn(v3, 21) ^ v0
        v2 = (v2 + v1) & mask
        v1 = turn(v1, 17) ^ v2
        v2 = turn(v2, 32)

    whole = len(data) // 8 * 8
    tail = data[whole:] + bytes(7 - len(data) % 8) + bytes([len(data) & 255])
    for k in [*range(0, whole, 8), -1]:
        m = struct.unpack("<Q", tail if k < 0 else data[k : k + 8])[0]
        v3 ^= m
        sip()
        v0 ^= m
    v2 ^= 255
    for _ in range(3):
        sip()
    return v0 ^ v1 ^ v2 ^ v3


_WIDTH = {"tinyint": "b", "smallint": "h", "int": "i", "bigint": "q"}


def siphash_part(kind: str, parts: int):
    """A pandas UDF: the part of a value by SipHash over its little-endian bytes, or its UTF-8 bytes and 0xFF. For matching tables split that way."""
    encode = (lambda v: str(v).encode() + b"\xff") if kind == "string" else (lambda v: struct.pack("<" + _WIDTH[kind], int(v)))

    @F.pandas_udf("int")
    def part(values: pd.Series) -> pd.Series:
        return values.map(lambda v: siphash13(encode(v)) % parts)

    return part
