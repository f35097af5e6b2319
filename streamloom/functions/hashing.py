"""Hashes and identifiers as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Fixed values of murmur3 (x86, 32 bits).
C1, C2, FIVE, ADD = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64
MIX1, MIX2 = 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def whole(a: Column, b: int) -> Column:
    """Integer division; ``/`` would go through doubles, which cannot hold nanoseconds."""
    return F.call_function("div", a, F.lit(b))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it (lambda bodies share nothing else)."""
    return F.transform(F.array(x), f)[0]


def _mul(x: Column, by: int) -> Column:
    """x * by modulo 2**32, in halves: a full product would overflow a signed long."""
    high, low = by >> 16, by & 0xFFFF
    return _let(x, lambda v: (F.shiftleft((v * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16) + v * F.lit(low)).bitwiseAND(F.lit(MASK)))


def _rotl(x: Column, by: int) -> Column:
    return _let(x, lambda v: (F.shiftleft(v, by).bitwiseOR(F.shiftright(v, 32 - by))).bitwiseAND(F.lit(MASK)))


def _little_endian(digits: Column) -> Column:
    """The value of up to eight hex digits read as little-endian bytes."""

    def swap(p: Column) -> Column:
        return F.concat(*[F.substring(p, at, 2) for at in (7, 5, 3, 1)])

    return F.conv(_let(F.rpad(digits, 8, "0"), swap), 16, 10).cast("long")


def murmur3_expression(key: Column) -> Column:
    """``murmur3`` without Python: built-in functions only, many times slower as lambdas are interpreted."""
    size = F.octet_length(key).cast("long")

    def scramble(block: Column) -> Column:
        return _mul(_rotl(_mul(block, C1), 15), C2)

    def hashed(digits: Column) -> Column:
        blocks = F.floor(size / 4).cast("int")
        numbers = F.filter(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), lambda i: i < blocks)

        def step(h: Column, i: Column) -> Column:
            mixed = _rotl(h.bitwiseXOR(scramble(_little_endian(F.substr(digits, i * 8 + 1, F.lit(8))))), 13)
            return (mixed * FIVE + F.lit(ADD)).bitwiseAND(F.lit(MASK))

        body = F.aggregate(numbers, F.lit(0).cast("long"), step)
        tail = F.when(size % 4 > 0, scramble(_little_endian(F.substr(digits, blocks * 8 + 1, F.lit(8))))).otherwise(F.lit(0).cast("long"))
        return body.bitwiseXOR(tail).bitwiseXOR(size)

    h = _let(F.hex(F.encode(key, "UTF-8")), hashed)
    h = _mul(_let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16))), MIX1)
    h = _mul(_let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 13))), MIX2)
    return _let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def _murmur3_matrix(data: np.ndarray) -> np.ndarray:
    """Hashes of equally long keys, a row of bytes each."""
    rows, n = data.shape
    padded = np.zeros((rows, -(-n // 4) * 4), np.uint8)
    padded[:, :n] = data
    blocks = padded.view("<u4")
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.zeros(rows, np.uint32)
    for j in range(blocks.shape[1]):
        h ^= rot(blocks[:, j] * np.uint32(C1), 15) * np.uint32(C2)
        if 4 * j + 4 <= n:
            h = rot(h, 13) * np.uint32(FIVE) + np.uint32(ADD)
    h ^= np.uint32(n)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX1)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX2)
    return h ^ (h >> np.uint32(16))


@F.pandas_udf(T.LongType())
def _murmur3(keys: pd.Series) -> pd.Series:
    """All keys of a length at once."""
    raw = [None if k is None else k.encode() for k in keys]
    sizes = np.array([-1 if x is None else len(x) for x in raw])
    out = np.zeros(len(raw), dtype=np.int64)
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        out[at] = _murmur3_matrix(np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(len(at), n))
    return pd.Series(out, dtype="Int64").where(sizes >= 0)


def murmur3(key: Column) -> Column:
    """murmur3_x86_32 of a string's UTF-8 bytes with seed 0, as a long from 0 to 2**32 - 1 (Arrow batches)."""
    ship()
    return _murmur3(key)


def murmur3_int(key: bytes) -> int:
    """The same in plain Python, for the driver and as a check."""
    h, n = 0, len(key)
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & MASK
    for at in range(0, n - n % 4 + (4 if n % 4 else 0), 4):
        part = key[at : at + 4]
        k = rot(int.from_bytes(part, "little") * C1 & MASK, 15) * C2 & MASK
        h ^= k
        if len(part) == 4:
            h = (rot(h, 13) * FIVE + ADD) & MASK
    h ^= n
    h = (h ^ (h >> 16)) * MIX1 & MASK
    h = (h ^ (h >> 13)) * MIX2 & MASK
    return h ^ (h >> 16)


def partition_for(key: Column, partitions: int) -> Column:
    """The partition of a keyed message."""
    return murmur3(key) % partitions


_CRC32C = []


def _crc32c_table() -> np.ndarray:
    if not _CRC32C:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
        _CRC32C.append(table)
    return _CRC32C[0]


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value: all values advance together, a byte of each at a time, the longest last."""
    table = _crc32c_table()
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(values), dtype=np.uint8)
    at = (np.cumsum(sizes) - sizes)[order]
    longer = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # values with a byte at each place
    crc = np.full(len(values), MASK, dtype=np.uint32)
    for j, n in enumerate(longer.tolist()):
        crc[:n] = table[(crc[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = crc ^ np.uint32(MASK)
    return out


@F.pandas_udf(T.LongType())
def _crc32c(data: pd.Series) -> pd.Series:
    known = data.notna()
    out = pd.Series([None] * len(data), index=data.index, dtype="Int64")
    out[known] = crc32c_of(data[known].tolist())
    return out


def crc32c(data: Column) -> Column:
    """CRC-32 with the Castagnoli polynomial of binary values (Arrow batches)."""
    ship()
    return _crc32c(data)


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions of a Bloom filter for n keys at false rate p."""
    bits = max(64, int(-n * math.log(p) / math.log(2) ** 2))
    bits = -(-bits // 64) * 64
    hashes = int(bits / max(n, 1) * math.log(2) + 0.5)
    return bits, min(30, max(1, hashes))


def uuid7_millis(message_id: Column) -> Column:
    """The millisecond that a version 7 UUID in canonical form was made."""
    return F.conv(F.substring(F.replace(message_id, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def uuid7(millis: Column, counter: Column, low: Column) -> Column:
    """A canonical version 7 UUID from its millisecond, a 12-bit counter and 62 more bits."""
    head = F.lpad(F.lower(F.hex(millis)), 12, "0")
    middle = F.concat(F.lit("7"), F.lpad(F.lower(F.hex(F.pmod(counter, F.lit(4096)))), 3, "0"))
    rest = F.lpad(F.lower(F.hex(low.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(-(1 << 63))))), 16, "0")
    return F.concat_ws("-", F.substring(head, 1, 8), F.substring(head, 9, 4), middle, F.substring(rest, 1, 4), F.substring(rest, 5, 12))


def fingerprint(text: Column) -> Column:
    """The first 16 bytes of a schema text's SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)
