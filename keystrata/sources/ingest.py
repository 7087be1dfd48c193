"""Bulk ingestion: sorted runs written in parallel, checked for order, invisible until they are installed."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.model import LOG_SCHEMA, InvalidArgsError
from keystrata.operators.keys import host_sort_key, is_descending

if TYPE_CHECKING:
    from keystrata.sources.store import Store

#: Bytes of keys and values that a file of an ingestion has at least before the next one is begun.
LEAST_ROLL = 1 << 20
#: Bytes of rows that one task sorts, about, and what a row counts besides its key and value.
TASK_BYTES, ROW_BYTES = 128 << 20, 128


def task_count(rows: int, size: int) -> int:
    """Tasks for so many rows with so many bytes of keys and values."""
    return max(1, -(-(size + rows * ROW_BYTES) // TASK_BYTES))


def out_of_order(rows: DataFrame, key: str, order: tuple[str, ...], runs: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose key isn't above the one written before them; ``runs`` are streams checked apart, in parallel."""
    w = Window.partitionBy(*runs).orderBy(*order)
    return rows.withColumn("_before", F.lag(key).over(w)).filter(F.col("_before") >= F.col(key)).drop("_before")


def sorted_run(rows: DataFrame, seq: int, partitions: int, tasks: int) -> DataFrame:
    """Rows (key, value, tombstone, expires_at_ns) as a run of one shared sequence, range-partitioned and sorted by key.

    Duplicate keys raise: within one ingestion keys ascend strictly. They are looked for in ``tasks``, each of which sorts
    its keys; counting them in hash maps would hold all keys of a task that reads.
    """
    times = F.count("*").over(Window.partitionBy("key"))
    if rows.select("key").repartition(tasks, "key").withColumn("n", times).filter("n > 1").limit(1).count():
        raise InvalidArgsError("ingested keys must ascend strictly")
    run = rows.withColumn("seq", F.lit(seq).cast("long")).withColumn("single_delete", F.lit(False))
    return run.repartitionByRange(partitions, "key").sortWithinPartitions("key")


class Ingestion:
    """Writes rows in strictly ascending key order into files that nothing shows before ``finish``; left unfinished, it leaves nothing.

    All rows have one sequence. A file is closed once it holds the family's write buffer, a MiB at least.
    """

    def __init__(self, store: Store, name: str):
        self.store, self.name, self.config = store, name, store.config(name)
        self.rows: list[tuple] = []
        self.size, self.count, self.last, self.files, self.done = 0, 0, None, [], False
        store.flush(name)
        self.seq = store.visible + 1

    def __enter__(self) -> Ingestion:
        return self

    def __exit__(self, *_) -> None:
        self.abort()

    def _add(self, key: bytes, value: bytes, expires_at_ns: int, tombstone: bool) -> None:
        if self.done:
            raise InvalidArgsError("this ingestion is over")
        if key is None or value is None:
            raise InvalidArgsError("keys and values aren't null")
        place = host_sort_key(key, self.config.comparator)
        if self.last is not None and not (place < self.last if is_descending(self.config.comparator) else place > self.last):
            raise InvalidArgsError("ingested keys must ascend strictly")
        self.last = place
        self.rows.append((key, self.seq, value, expires_at_ns, tombstone, False))
        self.size += len(key) + len(value)
        if self.size >= max(self.config.write_buffer_size, LEAST_ROLL):
            self._roll()

    def write(self, key: bytes, value: bytes, expires_at_ns: int = 0) -> None:
        self._add(key, value, expires_at_ns, False)

    def write_tombstone(self, key: bytes) -> None:
        self._add(key, b"", 0, True)

    def _roll(self) -> None:
        if self.rows:
            self.files += self.store._write(self.name, self.store.spark.createDataFrame(self.rows, LOG_SCHEMA).coalesce(1), 0)
            self.count += len(self.rows)
            self.rows, self.size = [], 0

    def finish(self) -> int:
        """Shows all rows at once; how many there are."""
        if self.done:
            raise InvalidArgsError("this ingestion is over")
        self._roll()
        if self.files and self.store.visible + 1 != self.seq:  # commits came between: its rows are newer than theirs
            rows = [self.store.spark.read.schema(LOG_SCHEMA).parquet(m.path) for m in self.files]
            self.seq = self.store.visible + 1
            again = [m for d in rows for m in self.store._write(self.name, d.withColumn("seq", F.lit(self.seq).cast("long")), 0)]
            self.store._discard(self.files)
            self.files = again
        self.done = True
        if self.files:
            self.store._installed(self.name, self.files, self.seq)
        return self.count

    def abort(self) -> None:
        """Takes back what was written, unless it is finished."""
        if not self.done:
            self.done = True
            self.store._discard(self.files)
