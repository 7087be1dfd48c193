"""Partitions, parts and tiers: which slice of the key space a key or file belongs to, and what may happen to it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.model import DEFAULT_TIER, InvalidArgsError, PartitionRule, TierRule
from keystrata.operators.keys import has_prefix


def longest_prefix(column: Column, rules: Sequence[tuple[bytes, object]]) -> Column:
    """The value of the longest rule whose prefix the column has, else null: a chain of conditions, not a join."""
    if len({p for p, _ in rules}) != len(rules):
        raise InvalidArgsError("two rules have the same prefix")
    out = None
    for prefix, value in sorted(rules, key=lambda r: -len(r[0])):
        hit = has_prefix(column, prefix)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(None).cast("string") if out is None else out


def partition_of(column: Column, rules: Sequence[PartitionRule]) -> Column:
    return longest_prefix(column, [(r.prefix, r.name) for r in rules])


def tier_of(column: Column, rules: Sequence[TierRule]) -> Column:
    return longest_prefix(column, [(r.prefix, r.tier) for r in rules])


#: Derived schemes by name: key column -> partition name column. Opening a store resolves its scheme here.
SCHEMES: dict[str, Callable[[Column], Column]] = {}


def register_scheme(name: str, function: Callable[[Column], Column]) -> None:
    SCHEMES[name] = function


def tenant_bucket(key: Column) -> Column:
    """The scheme for keys ``tenant 00 00 bucket(8 bytes) rest``: tenant-bucket."""
    at = F.locate("0000", F.hex(key))
    # Two zero bytes start at an even hex digit; tenants hold no zero byte.
    tenant = F.decode(F.unhex(F.substr(F.hex(key), F.lit(1), F.when(at % 2 == 1, at - 1).otherwise(at))), "UTF-8")
    start = F.octet_length(tenant) + 3
    bucket = F.conv(F.hex(F.substr(key, start, F.lit(8))), 16, 10)
    return F.concat_ws("-", tenant, bucket)


register_scheme("tenant-bucket", tenant_bucket)


def files_spanning_partitions(log_with_file: DataFrame, partition: Column) -> DataFrame:
    """Files that hold keys of more than one partition (null is one); empty after a partitioned bottom compaction."""
    named = log_with_file.withColumn("_part", F.coalesce(partition, F.lit("")))
    return named.groupBy("file_id").agg(F.count_distinct("_part").cast("long").alias("partitions")).filter("partitions > 1")


def list_partitions(catalog: DataFrame, bottom: int) -> DataFrame:
    """partition, min_key, tier, files of the bottom level's named parts; parts on several tiers are left out."""
    own = catalog.filter((F.col("level") == bottom) & F.col("partition").isNotNull()).withColumn("tier", F.coalesce("tier", F.lit(DEFAULT_TIER)))
    d = own.groupBy("partition").agg(F.min("min_key").alias("min_key"), F.min("tier").alias("tier"), F.max("tier").alias("_other"), F.count("*").alias("files"))
    return d.filter("tier = _other").drop("_other")


def detach(catalog: DataFrame, bottom: int, partition: str) -> DataFrame:
    """The catalog without a partition's bottom files."""
    gone = (F.col("level") == bottom) & F.col("partition").eqNullSafe(F.lit(partition))
    return catalog.filter(~gone)


def attach_placement(catalog: DataFrame, incoming: DataFrame, bottom: int, visible_seq: int, next_id: int, now_ns: int) -> DataFrame:
    """Where attached files go: fresh ids, the bottom level unless a bottom file overlaps their span (then 0), age reset.

    ``rejected`` is true for every row if any file has versions above ``visible_seq``: all or nothing.
    """
    span = incoming.agg(F.min("min_key").alias("_low"), F.max("max_key").alias("_high"), F.max("max_seq").alias("_top"))
    hits = catalog.filter(F.col("level") == bottom).join(F.broadcast(span), (F.col("min_key") <= F.col("_high")) & (F.col("max_key") >= F.col("_low")))
    clash = hits.agg((F.count("*") > 0).alias("_clash"))
    d = incoming.join(F.broadcast(span.join(clash)))
    fresh = (F.row_number().over(Window.orderBy("id")) + F.lit(next_id - 1)).cast("long")
    return d.select(
        fresh.alias("id"),
        F.when(F.col("_clash"), F.lit(0)).otherwise(F.lit(bottom)).cast("int").alias("level"),
        "min_key",
        "max_key",
        "max_seq",
        F.lit(now_ns).cast("long").alias("max_entry_time"),
        (F.col("_top") > visible_seq).alias("rejected"),
    )


def mover_plan(catalog: DataFrame, bottom: int, rules: Sequence[TierRule], now_ns: int) -> DataFrame:
    """The parts to move: their rule's tier isn't theirs nor the default, their age is known and above the rule's."""
    own = catalog.filter((F.col("level") == bottom) & F.col("partition").isNotNull()).withColumn("tier", F.coalesce("tier", F.lit(DEFAULT_TIER)))
    unknown = F.max(F.col("max_entry_time").isNull().cast("int")).alias("_unknown")
    parts = own.groupBy("partition").agg(F.min("min_key").alias("min_key"), F.min("tier").alias("tier"), F.max("tier").alias("_other"), F.max("max_entry_time").alias("newest"), unknown)
    target = tier_of(F.col("min_key"), rules)
    least = longest_prefix(F.col("min_key"), [(r.prefix, r.min_age_ns) for r in rules]) if rules else F.lit(None).cast("long")
    d = parts.withColumn("target", target).withColumn("_least", least.cast("long"))
    moves = (F.col("target") != F.lit(DEFAULT_TIER)) & ((F.col("target") != F.col("tier")) | (F.col("tier") != F.col("_other")))
    due = (F.col("_unknown") == 0) & (F.lit(now_ns) - F.col("newest") > F.col("_least"))
    return d.filter(moves & due).select("partition", "min_key", "tier", "target", "newest")


def orphans(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listed files (id, tier) whose id the catalog knows on another tier; unknown ids are left alone."""
    known = catalog.select("id", F.coalesce("tier", F.lit(DEFAULT_TIER)).alias("_home"))
    return listing.join(known, "id").filter(F.col("tier") != F.col("_home")).drop("_home")


def duplicate_prefixes(rules: DataFrame) -> DataFrame:
    """Prefixes that more than one rule has, with how many: such a configuration is rejected."""
    return rules.groupBy("prefix").agg(F.count("*").alias("rules")).filter("rules > 1")
