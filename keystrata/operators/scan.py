"""Reads of a resolved view: lookups, bounded and prefix scans, seeks, heads and tails, membership, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.operators.keys import UNBOUNDED, Bound, has_prefix, is_descending, within
from keystrata.operators.resolve import positions, ranges, resolve


def get(log: DataFrame, key: bytes, read_seq: int | None, now_ns: int) -> DataFrame:
    """At most one row; the key predicate stands below the resolution and reaches the scan."""
    return resolve(log.filter(F.col("key") == F.lit(key)), read_seq, now_ns)


def multi_get(log: DataFrame, keys: DataFrame, read_seq: int | None, now_ns: int) -> DataFrame:
    """The rows of the asked keys. The semi join stands below the resolution: only asked keys are shuffled."""
    return resolve(log.join(keys.select("key").distinct(), "key", "left_semi"), read_seq, now_ns)


def ranged(log: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, comparator: str = "memcmp", column: str = "key") -> DataFrame:
    """The versions of keys in a range (below resolution)."""
    return log.filter(within(F.col(column), lower, upper, comparator))


def prefixed(log: DataFrame, prefix: bytes, column: str = "key") -> DataFrame:
    return log.filter(has_prefix(F.col(column), prefix))


def ordered(view: DataFrame, comparator: str = "memcmp", backward: bool = False, column: str = "sort_key") -> DataFrame:
    """A view in comparator order, with its place in that order as ``pos``."""
    return positions(view, column, descending=is_descending(comparator) != backward)


def first(view: DataFrame, n: int = 1, column: str = "sort_key", backward: bool = False) -> DataFrame:
    """The first (or last) n rows: a top-n in each task, then of all."""
    return view.orderBy(F.col(column).desc() if backward else F.col(column).asc()).limit(n)


def seek(view: DataFrame, target: bytes, column: str = "sort_key") -> DataFrame:
    """The first row at or after the target."""
    return first(view.filter(F.col(column) >= F.lit(target)), 1, column)


def seek_for_prev(view: DataFrame, target: bytes, column: str = "sort_key") -> DataFrame:
    """The last row at or before the target."""
    return first(view.filter(F.col(column) <= F.lit(target)), 1, column, backward=True)


def newest_of_each(view: DataFrame, group: Column | str, n: int, order: str = "seq") -> DataFrame:
    """The n newest rows of each group, with ``rank``."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return view.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def neighbours(view: DataFrame, column: str = "sort_key") -> DataFrame:
    """Each row with the keys before and after it in order (``prev_key``, ``next_key``; null at the ends).

    Ranges of about equal counts are walked apart; only their first and last keys meet in one place.
    """
    d = ranges(view, column)
    w = Window.partitionBy("_range").orderBy("_place")
    ends = d.groupBy("_range").agg(F.min(column).alias("_first"), F.max(column).alias("_last"))
    chain = Window.orderBy("_range")
    ends = ends.select("_range", F.lag("_last").over(chain).alias("_before"), F.lead("_first").over(chain).alias("_after"))
    d = d.withColumn("prev_key", F.lag(column).over(w)).withColumn("next_key", F.lead(column).over(w))
    d = d.join(F.broadcast(ends), "_range")
    return d.withColumn("prev_key", F.coalesce("prev_key", "_before")).withColumn("next_key", F.coalesce("next_key", "_after")).drop("_range", "_place", "_before", "_after")


def contained(keys: DataFrame, view: DataFrame) -> DataFrame:
    return keys.join(view.select("key"), "key", "left_semi")


def missing(keys: DataFrame, view: DataFrame) -> DataFrame:
    return keys.join(view.select("key"), "key", "left_anti")


def as_of_lookup(log: DataFrame, probes: DataFrame, now_ns: int, payload: list[str], bucket: int = 1 << 12) -> DataFrame:
    """For each probe (key, read_seq) the version visible there, or nulls: probes and versions are merged by sequence.

    One pass over the versions of a key for all of its probes; a hot key is cut by ``bucket`` ranges of the sequence, and
    what a bucket ends with is carried over to the next ones.
    """
    version = F.struct("seq", "tombstone", "expires_at_ns", *payload)
    a = log.select("key", F.col("seq").alias("_at"), F.lit(0).alias("_kind"), version.alias("_v"), F.lit(None).cast("long").alias("read_seq"))
    kind = a.schema["_v"].dataType
    b = probes.select("key", F.col("read_seq").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_v"), F.col("read_seq").cast("long"))
    both = a.unionByName(b).withColumn("_bucket", F.floor(F.col("_at") / bucket))
    tails = a.withColumn("_bucket", F.floor(F.col("_at") / bucket)).groupBy("key", "_bucket").agg(F.max("_v").alias("_v"))
    touched = b.select("key", F.floor(F.col("_at") / bucket).alias("_bucket")).distinct()
    spots = touched.withColumn("_wanted", F.lit(True)).join(tails, ["key", "_bucket"], "full")
    w = Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.withColumn("_carried", F.last("_v", ignorenulls=True).over(w)).filter("_wanted").select("key", "_bucket", "_carried")
    inside = Window.partitionBy("key", "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(inside)).filter("_kind = 1").join(carried, ["key", "_bucket"], "left")
    found = found.withColumn("_v", F.coalesce("_seen", "_carried"))
    alive = ~F.col("_v.tombstone") & ((F.col("_v.expires_at_ns") == 0) | (F.col("_v.expires_at_ns") > F.lit(now_ns)))
    return found.select("key", "read_seq", *(F.when(alive, F.col(f"_v.{c}")).alias(c) for c in ("seq", *payload)))


def difference(log: DataFrame, old_seq: int, new_seq: int, now_ns: int, payload: str = "value") -> DataFrame:
    """Keys whose visible value differs between two sequences: key, old, new, change (added, removed, changed).

    One shuffle by key serves both sequences.
    """
    row = F.struct("seq", "tombstone", "expires_at_ns", payload)
    a = log.filter(F.col("seq") <= new_seq).groupBy("key").agg(F.max(F.when(F.col("seq") <= old_seq, row)).alias("a"), F.max(row).alias("b"))

    def shown(side: str) -> Column:
        alive = ~F.col(f"{side}.tombstone") & ((F.col(f"{side}.expires_at_ns") == 0) | (F.col(f"{side}.expires_at_ns") > F.lit(now_ns)))
        return F.when(alive, F.struct(F.col(f"{side}.{payload}").alias("v")))

    d = a.select("key", shown("a").alias("old"), shown("b").alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return d.select("key", F.col("old.v").alias("old"), F.col("new.v").alias("new"), change.alias("change"))


def change_feed(log: DataFrame, after_seq: int, upto_seq: int) -> DataFrame:
    """The operations committed in (after_seq, upto_seq], as commit hooks report them."""
    op = F.when(F.col("tombstone"), "delete").otherwise("put")
    return log.filter((F.col("seq") > after_seq) & (F.col("seq") <= upto_seq)).withColumn("op", op)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either view, once; the first view's row where both have one."""
    return a.unionByName(b.join(a.select("key"), "key", "left_anti"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key"), "key", "left_semi")


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key"), "key", "left_anti")
