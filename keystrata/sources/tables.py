"""Versioned logs and file catalogs derived from plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(column: Column) -> Column:
    return F.encode(column.cast("string"), "UTF-8")


def big_endian(column: Column) -> Column:
    """A long as 8 big-endian bytes (two's complement)."""
    return F.unhex(F.lpad(F.hex(column), 16, "0"))


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    days = F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
    return days * 86_400_000_000 + F.hour(column).cast("long") * 3_600_000_000 + F.minute(column).cast("long") * 60_000_000 + second


DAY_NS = 86_400_000_000_000


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: a user's key, an event's seq; errors are deletes, views expire after a week."""
    e = table(spark, sf_dir, "events")
    expires = F.when(F.col("event_type") == "view", micros(F.col("ts")) * 1000 + 7 * DAY_NS).otherwise(F.lit(0)).cast("long")
    return e.select(
        text_key(F.col("user_id")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        (F.col("event_type") == "error").alias("tombstone"),
        expires.alias("expires_at_ns"),
        "event_id",
        "value",
    )


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versions of their order: more rows, no deletes."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        big_endian(F.col("l_orderkey")).alias("key"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_returnflag") == "R").alias("tombstone"),
        F.lit(0).cast("long").alias("expires_at_ns"),
        "l_orderkey",
        "l_linenumber",
        F.length("l_returnflag").alias("size"),
        "l_quantity",
    )


def event_files(spark: SparkSession, sf_dir: str, each: int = 500) -> DataFrame:
    """A catalog in which every run of ``each`` events is a level-0 file."""
    e = table(spark, sf_dir, "events")
    d = e.select(
        F.floor(F.col("event_id") / each).cast("long").alias("id"),
        text_key(F.col("user_id")).alias("key"),
        (F.col("event_type") == "error").alias("tombstone"),
        (F.col("event_id") + 1).alias("seq"),
        F.length("props").cast("long").alias("bytes"),
        (micros(F.col("ts")) * 1000).alias("time"),
    )
    return d.groupBy("id").agg(
        F.lit(0).alias("level"),
        F.count("*").alias("num_entries"),
        F.sum(F.col("tombstone").cast("long")).alias("num_tombstones"),
        F.max("seq").alias("max_seq"),
        F.sum("bytes").alias("klog_size"),
        F.lit(0).cast("long").alias("vlog_size"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.max("time").alias("max_entry_time"),
    )


def order_files(spark: SparkSession, sf_dir: str, levels: int = 4) -> DataFrame:
    """A leveled catalog: orders in files by key range, deeper levels in wider ones; every third customer range is a named part."""
    o = table(spark, sf_dir, "orders")
    level = F.pmod("o_orderkey", F.lit(levels)).cast("int")
    width = F.pow(F.lit(2.0), F.lit(levels) - level).cast("long") * 256
    start = F.floor(F.col("o_orderkey") / width).cast("long")
    d = o.select(
        level.alias("level"),
        (start * levels + level).alias("id"),
        big_endian(F.col("o_orderkey")).alias("key"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("tombstone"),
        (micros(F.col("o_orderdate")) * 1000).alias("time"),
        F.length("o_orderpriority").cast("long").alias("bytes"),
        start.alias("place"),
    )
    d = d.groupBy("level", "id", "place").agg(
        F.count("*").alias("num_entries"),
        F.sum(F.col("tombstone").cast("long")).alias("num_tombstones"),
        F.max("seq").alias("max_seq"),
        F.sum("bytes").alias("klog_size"),
        F.lit(0).cast("long").alias("vlog_size"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.max("time").alias("max_entry_time"),
    )
    part = F.when(F.pmod("place", F.lit(3)) < 2, F.concat(F.lit("p"), F.pmod(F.floor(F.col("place") / 2), F.lit(5)).cast("string")))
    tier = F.when(F.pmod("place", F.lit(7)) == 3, "hdd")
    return d.withColumn("partition", part).withColumn("tier", tier).drop("place")
