"""Compaction and retention as DataFrame functions over a log or a file catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(log: DataFrame, oldest_snapshot: int, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Every version above the oldest snapshot, and of the rest the newest of each key (as ``kept_below``)."""
    below = F.col("seq") <= F.lit(oldest_snapshot)
    w = Window.partitionBy(*keys, below).orderBy(F.col("seq").desc())
    d = log.withColumn("kept_below", below).withColumn("_place", F.row_number().over(w))
    return d.filter(~F.col("kept_below") | (F.col("_place") == 1)).drop("_place")


def compact(log: DataFrame, oldest_snapshot: int, now_ns: int, bottom: bool, removes: Column | None = None, literal_ttl: bool = False, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """What a compaction writes.

    At the bottom the kept version at or below the snapshot goes if it is a tombstone or expired. ``removes`` is a
    caller's filter on live versions at or below the snapshot: they go at the bottom, else become tombstones.
    ``literal_ttl`` drops expired versions above the snapshot as well, which lets older values reappear to readers
    between; it is there for comparison only.
    """
    d = collapse(log, oldest_snapshot, keys)
    expired = (F.col("expires_at_ns") > 0) & (F.col("expires_at_ns") <= F.lit(now_ns)) & ~F.col("tombstone")
    if removes is not None:
        hit = F.col("kept_below") & ~F.col("tombstone") & ~expired & F.coalesce(removes, F.lit(False))
        d = d.filter(~hit) if bottom else d.withColumn("tombstone", F.col("tombstone") | hit)
        expired = expired & ~F.col("tombstone")
    if bottom:
        dead = F.col("kept_below") & F.col("tombstone") | expired & (F.lit(True) if literal_ttl else F.col("kept_below"))
        d = d.filter(~dead)
    return d.drop("kept_below")


def pick_level(catalog: DataFrame, trigger: int = 4, buffer_bytes: int = 64 << 20, ratio: int = 10) -> DataFrame:
    """One row, ``level``: 0 if its files reach the trigger, else the first level above its capacity, else null."""
    sizes = catalog.groupBy("level").agg(F.count("*").alias("files"), F.sum(F.col("klog_size") + F.col("vlog_size")).alias("bytes"))
    capacity = F.lit(float(buffer_bytes)) * F.pow(F.lit(float(max(ratio, 2))), F.col("level") - 1)
    full = F.when(F.col("level") == 0, F.col("files") >= trigger).otherwise(F.col("bytes") > capacity)
    return sizes.agg(F.min(F.when(full, F.col("level"))).cast("int").alias("level"))


def overlapping(catalog: DataFrame, level: int) -> DataFrame:
    """A level's files and the next level's that overlap its key span (the span is one row)."""
    own = catalog.filter(F.col("level") == level)
    span = own.agg(F.min("min_key").alias("_low"), F.max("max_key").alias("_high"))
    below = catalog.filter(F.col("level") == level + 1).join(F.broadcast(span), (F.col("min_key") <= F.col("_high")) & (F.col("max_key") >= F.col("_low")))
    return own.unionByName(below.drop("_low", "_high"))


def overlap_pairs(upper: DataFrame, lower: DataFrame, buckets: Column | None = None) -> DataFrame:
    """(upper_id, lower_id) of files whose key ranges overlap; ``lower`` holds disjoint files sorted by key.

    Disjointness makes it two searches, not a theta join: a merge by key gives for each upper file the first lower file
    that may overlap, and how many start before its end.
    """
    w = Window.orderBy("min_key")
    low = lower.select(F.col("id").alias("lower_id"), "min_key", "max_key").withColumn("place", F.row_number().over(w))
    marks = low.select(F.col("max_key").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("upper_id"), F.lit(1).alias("ends"), F.lit(0).alias("starts"))
    marks = marks.unionByName(low.select(F.col("min_key").alias("k"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("upper_id"), F.lit(0).alias("ends"), F.lit(1).alias("starts")))
    marks = marks.unionByName(upper.select(F.col("min_key").alias("k"), F.lit(0).alias("kind"), F.col("id").alias("upper_id"), F.lit(0).alias("ends"), F.lit(0).alias("starts")))
    marks = marks.unionByName(upper.select(F.col("max_key").alias("k"), F.lit(0).alias("kind"), F.col("id").alias("upper_id"), F.lit(0).alias("ends"), F.lit(0).alias("starts")))
    run = Window.orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at = marks.withColumn("ended", F.sum("ends").over(run)).withColumn("begun", F.sum("starts").over(run)).filter("upper_id is not null")
    spans = at.groupBy("upper_id").agg((F.min("ended") + 1).alias("from"), F.max("begun").alias("to")).filter("from <= to")
    places = spans.select("upper_id", F.explode(F.sequence("from", "to")).alias("place"))
    return places.join(low, "place").select("upper_id", "lower_id")


def fifo_by_size(catalog: DataFrame, max_bytes: int, bucket: int = 1 << 16) -> DataFrame:
    """The files to evict: oldest ids until the rest holds at most ``max_bytes`` (0: no limit).

    A suffix sum over ids, by ranges of ids with the later ranges' totals added, so no task sorts all files.
    """
    size = F.col("klog_size") + F.col("vlog_size")
    d = catalog.withColumn("_bytes", size).withColumn("_range", F.floor(F.col("id") / bucket))
    totals = d.groupBy("_range").agg(F.sum("_bytes").alias("_n"))
    later = F.sum("_n").over(Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_range", F.coalesce(later, F.lit(0)).alias("_later"))
    own = F.sum("_bytes").over(Window.partitionBy("_range").orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_own", own).join(totals, "_range").withColumn("bytes_from_here", F.col("_own") + F.col("_later"))
    keep = F.lit(max_bytes == 0) | (F.col("bytes_from_here") <= max_bytes)
    return d.filter(~keep).drop("_bytes", "_range", "_own", "_later")


def fifo_by_age(catalog: DataFrame, ttl_ns: int, now_ns: int) -> DataFrame:
    """The files to evict by age (0: no limit); readers at old snapshots lose them too."""
    return catalog.filter(F.lit(ttl_ns > 0) & (F.lit(now_ns) - F.col("max_entry_time") > ttl_ns))


def carried_age(inputs: DataFrame) -> DataFrame:
    """One row, ``max_entry_time``: the largest of the inputs; unknown ones don't count."""
    return inputs.agg(F.max("max_entry_time").alias("max_entry_time"))
