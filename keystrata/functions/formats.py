"""Byte helpers as columns and, for single values, as plain functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def internal_key(key: Column, seq: Column) -> Column:
    """key, then the complement of seq as 8 big-endian bytes: newer versions of a key sort first."""
    return F.concat(key, F.unhex(F.lpad(F.hex(F.bitwise_not(seq)), 16, "0")))


def internal_user_key(internal: Column) -> Column:
    return F.substr(internal, F.lit(1), F.length(internal) - 8)


def internal_seq(internal: Column) -> Column:
    tail = F.hex(F.substr(internal, F.length(internal) - 7, F.lit(8)))
    # The top bit of the complement is set for every sequence a long holds.
    high, low = F.conv(F.substring(tail, 1, 8), 16, 10).cast("long"), F.conv(F.substring(tail, 9, 8), 16, 10).cast("long")
    return (F.lit(0xFFFFFFFF) - high) * F.lit(1 << 32) + (F.lit(0xFFFFFFFF) - low)


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE)."""
    return F.crc32(data)


def uvarint(n: int) -> bytes:
    """Seven bits a byte, least first; the top bit says that more follow."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_uvarint(data: bytes) -> tuple[int, int] | None:
    """The number and its length; None if the bytes end early or run over 64 bits."""
    n = 0
    for i, b in enumerate(data[:10]):
        n |= (b & 127) << 7 * i
        if b < 128:
            return (n, i + 1) if n < 1 << 64 else None
    return None


def varint(n: int) -> bytes:
    """Signed numbers by zigzag."""
    return uvarint((n << 1) ^ (n >> 63))


def read_varint(data: bytes) -> tuple[int, int] | None:
    found = read_uvarint(data)
    return found and (found[0] >> 1 ^ -(found[0] & 1), found[1])


def separator(a: bytes, b: bytes) -> bytes:
    """A short key s with a <= s < b, for a < b."""
    for i in range(min(len(a), len(b))):
        if a[i] != b[i]:
            if a[i] + 1 < b[i]:
                return a[:i] + bytes([a[i] + 1])
            break
    return a
