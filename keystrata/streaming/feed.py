"""Streams of versions: a change feed over a growing log, and the latest version of each key kept up to date."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystrata.model import LOG_SCHEMA
from keystrata.operators.resolve import newest


def read_log(spark: SparkSession, path: str, schema: StructType = LOG_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Versions as a stream: each new Parquet file below ``path`` is read once; ``max_files`` bounds a trigger's work."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def operations(stream: DataFrame) -> DataFrame:
    """What commit hooks report: put or delete, by sequence."""
    return stream.select("key", "seq", F.when(F.col("tombstone"), "delete").otherwise("put").alias("op"), "value", "expires_at_ns")


def keep_latest(stream: DataFrame, target: str, checkpoint: str, partitions: int = 8):
    """A streaming query that merges each batch into a table of the newest version of each key.

    The sequence decides, not the arrival: a late older version changes nothing, and a batch that is delivered twice
    gives the same table. Tombstones and expired versions stay in the table (readers drop them at their own time); a table
    is written beside the last one and then named by a small pointer file. Only keys grow the table, not versions.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = latest_path(target)
        rows = batch if last is None else batch.unionByName(spark.read.schema(batch.schema).parquet(last))
        path = os.path.join(target, f"batch-{number:09d}")
        newest(rows).repartition(partitions, "key").write.mode("overwrite").parquet(path)
        os.makedirs(target, exist_ok=True)
        with open(os.path.join(target, "LATEST.new"), "w") as f:
            f.write(path)
            f.flush()
            os.fsync(f.fileno())
        os.replace(os.path.join(target, "LATEST.new"), os.path.join(target, "LATEST"))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_path(target: str) -> str | None:
    """Where the table is now; None before the first batch."""
    try:
        with open(os.path.join(target, "LATEST")) as f:
            return f.read().strip()
    except FileNotFoundError:
        return None
