"""Statistics of files, levels and families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_metadata(log_with_file: DataFrame) -> DataFrame:
    """file_id, num_entries, num_tombstones, max_seq, min_key, max_key of every file."""
    return log_with_file.groupBy("file_id").agg(
        F.count("*").alias("num_entries"),
        F.sum(F.col("tombstone").cast("long")).alias("num_tombstones"),
        F.max("seq").alias("max_seq"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
    )


def level_statistics(catalog: DataFrame) -> DataFrame:
    """Per level: files, bytes, entries, tombstones."""
    return catalog.groupBy("level").agg(
        F.count("*").alias("files"),
        F.sum(F.col("klog_size") + F.col("vlog_size")).alias("bytes"),
        F.sum("num_entries").alias("entries"),
        F.sum("num_tombstones").alias("tombstones"),
    )


def database_statistics(catalog: DataFrame) -> DataFrame:
    """Files and bytes by (family, level), by family, and in all: nulls stand for all."""
    return catalog.rollup("cf", "level").agg(F.count("*").alias("files"), F.sum(F.col("klog_size") + F.col("vlog_size")).alias("bytes"))


def approximate_length(catalog: DataFrame, pending: int = 0) -> DataFrame:
    """One row, ``approx_len``: all versions and tombstones of all files, and those not yet in a file."""
    return catalog.agg((F.coalesce(F.sum("num_entries"), F.lit(0)) + F.lit(pending)).cast("long").alias("approx_len"))


def separated_values(values: DataFrame, size_column: str, threshold: int = 512) -> DataFrame:
    """How many values, and bytes, stand beside keys and in the side file (values of at least ``threshold`` bytes)."""
    side = (F.col(size_column) >= threshold).alias("side_file")
    return values.groupBy(side).agg(F.count("*").alias("values"), F.sum(size_column).cast("long").alias("bytes"))
