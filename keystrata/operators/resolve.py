"""Version resolution: of each key the newest version at or below a sequence, then dropped if deleted or expired.

The order of these steps is the semantics. Filters on ``seq`` go below the resolution, filters on liveness above it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, read_seq: int | None = None, keys: tuple[str, ...] = ("key",), order: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key: its newest version with seq <= read_seq, tombstones and expired ones included.

    ``row_number() = 1`` gets a group limit on both sides of the exchange, so a key with many versions is cut down before
    it is shuffled.
    """
    seen = log if read_seq is None else log.filter(F.col("seq") <= F.lit(read_seq))
    w = Window.partitionBy(*keys).orderBy(*order, F.col("seq").desc())
    return seen.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def live(versions: DataFrame, now_ns: int) -> DataFrame:
    """The versions that are neither deletes nor expired at ``now_ns`` (one literal for the whole query)."""
    return versions.filter(~F.col("tombstone") & ((F.col("expires_at_ns") == 0) | (F.col("expires_at_ns") > F.lit(now_ns))))


def resolve(log: DataFrame, read_seq: int | None, now_ns: int, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """What a reader at ``read_seq`` sees."""
    return live(newest(log, read_seq, keys), now_ns)


def resolve_with_overlay(log: DataFrame, overlay: DataFrame, read_seq: int, now_ns: int) -> DataFrame:
    """The view of a transaction: its own writes (an ``op_idx`` per write) win over every committed version."""
    mine = overlay.withColumn("seq", F.lit(read_seq).cast("long")).withColumn("_rank", F.col("op_idx") + 1)
    base = log.filter(F.col("seq") <= F.lit(read_seq)).withColumn("_rank", F.lit(0))
    both = base.unionByName(mine.select(*base.columns))
    return live(newest(both, None, order=(F.col("_rank").desc(),)), now_ns).drop("_rank")


def ranges(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """The rows in ranges of about equal counts, whatever the keys have in common: ``_range``, in key order, and ``_place`` (from 0) in it.

    Bounds of ranges come from a sample of the keys, so they are drawn once: the result is kept (and spilled) until the
    session drops it, and a lost part is made again from the same exchange.
    """
    order = F.desc(key) if descending else F.asc(key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    d = d.withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    return d.drop("_id").persist(StorageLevel.MEMORY_AND_DISK)


def positions(df: DataFrame, key: str = "sort_key", descending: bool = False, name: str = "pos") -> DataFrame:
    """Adds each row's place (from 1) in key order: its place in a range, shifted by the counts of the ranges before."""
    d = ranges(df, key, descending)
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = d.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return d.join(F.broadcast(counts), "_range").withColumn(name, F.col("_place") + F.col("_before") + 1).drop("_range", "_place", "_before")
