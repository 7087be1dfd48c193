"""A store's family as a Spark data source: ``spark.read.format("keystrata").option("family", name).load(path)``.

Gives the versions in files, one partition for each immutable file that may meet the optional bounds ``lower`` and
``upper`` (hexadecimal keys, both included). Executors read Parquet with Arrow; nothing passes through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keystrata.model import LOG_SCHEMA, NotFoundError
from keystrata.sources.manifest import Manifest


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.family = options["path"], options["family"]
        self.lower, self.upper = (bytes.fromhex(options[x]) if options.get(x) else None for x in ("lower", "upper"))

    def partitions(self) -> list[InputPartition]:
        families = Manifest.load(self.path).families
        if self.family not in families:
            raise NotFoundError(f"no family {self.family!r}")
        return [_File(m.path) for m in families[self.family].files if (self.lower is None or m.max_key >= self.lower) and (self.upper is None or m.min_key <= self.upper)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for name in sorted(os.listdir(partition.path)) if partition else ():
            if not name.endswith(".parquet"):
                continue
            for batch in pq.ParquetFile(os.path.join(partition.path, name)).iter_batches(columns=LOG_SCHEMA.names):
                keep = pa.array([True] * batch.num_rows)
                if self.lower is not None:
                    keep = pc.and_(keep, pc.greater_equal(batch.column("key"), pa.scalar(self.lower)))
                if self.upper is not None:
                    keep = pc.and_(keep, pc.less_equal(batch.column("key"), pa.scalar(self.upper)))
                yield batch.filter(keep).select(LOG_SCHEMA.names)


class StoreDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keystrata"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoreDataSource)
