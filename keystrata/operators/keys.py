"""Order-preserving keys: comparators as sort-key columns, bounds and prefixes as pushable predicates."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.model import COMPARATORS, CUSTOM_COMPARATORS, NAME, InvalidArgsError


def register_comparator(name: str, encode: Callable[[Column], Column], host: Callable[[bytes], bytes]) -> None:
    """A comparator of the caller's: keys compare as the bytes that ``encode`` (a column) and ``host`` (one key) make of them.

    Keys of equal bytes are one key. Only the name is kept in the manifest: register it before the store is opened.
    """
    if name in COMPARATORS or not NAME.match(name):
        raise InvalidArgsError(f"bad comparator name {name!r}")
    CUSTOM_COMPARATORS[name] = encode, host


def merges_keys(comparator: str) -> bool:
    """Whether keys of unlike bytes may be one key."""
    return comparator == "case_insensitive" or comparator in CUSTOM_COMPARATORS


def is_descending(comparator: str) -> bool:
    """``reverse`` keeps the key and flips direction and bounds instead (a complement would misplace prefixes)."""
    return comparator == "reverse"


def sort_key(key: Column, comparator: str = "memcmp") -> Column:
    """A binary column whose unsigned byte order is the comparator's order."""
    if comparator in ("", "memcmp", "lexicographic", "reverse", "uint64"):
        # Eight big-endian bytes compare as unsigned numbers just as they compare as bytes.
        return key
    if comparator == "case_insensitive":
        text = F.translate(F.decode(key, "ISO-8859-1"), string.ascii_uppercase, string.ascii_lowercase)
        return F.encode(text, "ISO-8859-1")
    if comparator == "int64":
        head = F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(128))
        flipped = F.concat(F.unhex(F.lpad(F.hex(head), 2, "0")), F.substring(key, 2, 7))
        return F.when(F.length(key) == 8, flipped).otherwise(F.raise_error(F.lit("int64 keys have 8 bytes")).cast("binary"))
    if comparator in CUSTOM_COMPARATORS:
        return CUSTOM_COMPARATORS[comparator][0](key)
    raise InvalidArgsError(f"unknown comparator {comparator!r}")


def encode_int64(n: int) -> bytes:
    return n.to_bytes(8, "big", signed=True)


def host_sort_key(key: bytes, comparator: str = "memcmp") -> bytes:
    """``sort_key`` of one key on the driver, for bounds and pruning."""
    if comparator == "case_insensitive":
        return bytes(b + 32 if 65 <= b <= 90 else b for b in key)
    if comparator == "int64":
        if len(key) != 8:
            raise InvalidArgsError("int64 keys have 8 bytes")
        return bytes([key[0] ^ 128]) + key[1:]
    if comparator in CUSTOM_COMPARATORS:
        return CUSTOM_COMPARATORS[comparator][1](key)
    return key


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None where there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


@dataclass(frozen=True)
class Bound:
    """One end of a range: a key, included or not; ``key`` None is unbounded."""

    key: bytes | None = None
    included: bool = True


def included(key: bytes) -> Bound:
    return Bound(key, True)


def excluded(key: bytes) -> Bound:
    return Bound(key, False)


UNBOUNDED = Bound()


def within(column: Column, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, comparator: str = "memcmp") -> Column:
    """The range as comparisons with literals, which Parquet scans take as pushed filters."""
    if is_descending(comparator):
        lower, upper = upper, lower
    out = F.lit(True)
    if lower.key is not None:
        k = F.lit(host_sort_key(lower.key, comparator))
        out = column >= k if lower.included else column > k
    if upper.key is not None:
        k = F.lit(host_sort_key(upper.key, comparator))
        high = column <= k if upper.included else column < k
        out = high if lower.key is None else out & high
    return out


def has_prefix(column: Column, prefix: bytes) -> Column:
    """A prefix as the range [prefix, successor): a binary ``startswith`` would not reach the scan."""
    top = successor(prefix)
    return within(column, included(prefix), UNBOUNDED if top is None else excluded(top))
