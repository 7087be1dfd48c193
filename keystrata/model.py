"""Schemas, enums, errors and configuration of the versioned key/value engine."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: One row per version of a key. ``seq`` starts at 1; 0 in ``expires_at_ns`` means never.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value", T.BinaryType(), False),
        T.StructField("expires_at_ns", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("single_delete", T.BooleanType(), False),
    ]
)

#: One row per immutable file.
CATALOG_SCHEMA = "id long, level int, num_entries long, num_tombstones long, max_seq long, klog_size long, vlog_size long, min_key binary, max_key binary, partition string, tier string, max_entry_time long"

MAX_SEQ = (1 << 63) - 1
DEFAULT_TIER = "ssd"
NAME = re.compile(r"[A-Za-z0-9._-]{1,128}\Z")


class StoreError(Exception):
    """A failure with a stable ``kind`` and ``code``."""

    kind, code = "unknown", -15


def _error(kind: str, code: int) -> type[StoreError]:
    return type("".join(x.capitalize() for x in kind.split("_")) + "Error", (StoreError,), {"kind": kind, "code": code, "__module__": __name__})


# Kinds and codes that callers may rely on.
MemoryStoreError = _error("memory", -1)
InvalidArgsError = _error("invalid_args", -2)
NotFoundError = _error("not_found", -3)
IoError = _error("io", -4)
CorruptionError = _error("corruption", -5)
ExistsError = _error("exists", -6)
ConflictError = _error("conflict", -7)
TooLargeError = _error("too_large", -8)
MemoryLimitError = _error("memory_limit", -9)
InvalidDbError = _error("invalid_db", -10)
UnknownError = _error("unknown", -11)
LockedError = _error("locked", -12)
ReadOnlyError = _error("readonly", -13)
BusyError = _error("busy", -14)
PoisonedError = _error("poisoned", -15)


class Isolation(enum.Enum):
    """What a transaction reads and what its commit checks."""

    READ_UNCOMMITTED = "read_uncommitted"
    READ_COMMITTED = "read_committed"
    REPEATABLE_READ = "repeatable_read"
    SNAPSHOT = "snapshot"
    SERIALIZABLE = "serializable"

    @property
    def pinned(self) -> bool:
        return self in (Isolation.REPEATABLE_READ, Isolation.SNAPSHOT, Isolation.SERIALIZABLE)

    @property
    def checks_writes(self) -> bool:
        return self in (Isolation.SNAPSHOT, Isolation.SERIALIZABLE)

    @property
    def checks_reads(self) -> bool:
        return self is Isolation.SERIALIZABLE


class SyncMode(enum.Enum):
    """Accepted for compatibility: a commit here is durable once its manifest is in place."""

    NONE = "none"
    FULL = "full"
    INTERVAL = "interval"


COMPARATORS = ("", "memcmp", "lexicographic", "reverse", "uint64", "int64", "case_insensitive")
#: Comparators of callers by name, see ``keys.register_comparator``: the order as a binary Column of the key, and as bytes of one key.
CUSTOM_COMPARATORS: dict = {}
CODECS = {"none": "none", "snappy": "snappy", "lz4": "lz4", "lz4fast": "lz4", "zstd": "zstd", "flate": "gzip"}


@dataclass(frozen=True)
class PartitionRule:
    prefix: bytes
    name: str


@dataclass(frozen=True)
class TierRule:
    prefix: bytes
    tier: str
    min_age_ns: int = 0


@dataclass(frozen=True)
class ColumnFamilyConfig:
    """Configuration of one column family; ``validate`` rejects what can't be meant."""

    comparator: str = "memcmp"
    compression: tuple[str, ...] = ("zstd",)
    prefix_compression: tuple[tuple[bytes, str], ...] = ()
    write_buffer_size: int = 64 << 20
    level_size_ratio: int = 10
    l1_file_count_trigger: int = 4
    num_levels: int = 5
    klog_value_threshold: int = 512
    compaction_style: str = "leveled"
    fifo_max_bytes: int = 0
    fifo_ttl_ns: int = 0
    partition_rules: tuple[PartitionRule, ...] = ()
    tier_rules: tuple[TierRule, ...] = ()
    partition_scheme: str | None = None
    sync_mode: str = "none"
    bloom_filter: bool = False

    def validate(self) -> "ColumnFamilyConfig":
        if self.comparator not in COMPARATORS and self.comparator not in CUSTOM_COMPARATORS:
            raise InvalidArgsError(f"unknown comparator {self.comparator!r}")
        for rules in (self.partition_rules, self.tier_rules):
            prefixes = [r.prefix for r in rules]
            if len(set(prefixes)) != len(prefixes):
                raise InvalidArgsError("two rules have the same prefix")
        for r in self.partition_rules:
            if not NAME.match(r.name) or r.name in (".", ".."):
                raise InvalidArgsError(f"bad partition name {r.name!r}")
        for codec in (*self.compression, *(c for _, c in self.prefix_compression)):
            if codec not in CODECS:
                raise InvalidArgsError(f"unknown compression {codec!r}")
        if self.num_levels < 1 or self.write_buffer_size < 1:
            raise InvalidArgsError("levels and buffer size must be positive")
        if self.partition_rules and self.partition_scheme:
            raise InvalidArgsError("partition rules and a partition scheme exclude each other")
        return self

    def codec_for(self, level: int, prefix: bytes = b"") -> str:
        """The codec of a level (the last repeats), unless a longer prefix rule has its own."""
        rules = [r for r in self.prefix_compression if prefix.startswith(r[0])]
        if rules:
            return CODECS[max(rules, key=lambda r: len(r[0]))[1]]
        return CODECS[self.compression[min(level, len(self.compression) - 1)]]


@dataclass
class StoreOptions:
    read_only: bool = False
    tiers: dict[str, str] = field(default_factory=dict)
    unified: bool = False


def with_rule(config: ColumnFamilyConfig, rule: PartitionRule) -> ColumnFamilyConfig:
    if any(r.prefix == rule.prefix for r in config.partition_rules):
        raise InvalidArgsError("two rules have the same prefix")
    return replace(config, partition_rules=(*config.partition_rules, rule)).validate()


def without_rule(config: ColumnFamilyConfig, prefix: bytes) -> ColumnFamilyConfig:
    rest = tuple(r for r in config.partition_rules if r.prefix != prefix)
    if len(rest) == len(config.partition_rules):
        raise NotFoundError("no rule has this prefix")
    return replace(config, partition_rules=rest)
