"""The relational side of transactions: batch order, sequences, publication, conflicts and savepoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_batch(ops: DataFrame, keys: tuple[str, ...] = ("cf", "key"), op: str = "op_idx") -> DataFrame:
    """The last write of each key of a batch, with ``slot`` (from 0): the rank of the key's *first* write."""
    last = Window.partitionBy("batch", *keys).orderBy(F.col(op).desc())
    whole = Window.partitionBy("batch", *keys)
    d = ops.withColumn("_first", F.min(op).over(whole)).withColumn("_place", F.row_number().over(last)).filter("_place = 1")
    slot = F.row_number().over(Window.partitionBy("batch").orderBy("_first")) - 1
    return d.withColumn("slot", slot.cast("long")).drop("_place", "_first")


def assign_sequences(deduped: DataFrame, start: int) -> DataFrame:
    """Contiguous blocks in batch order: ``seq`` of each write, ``commit_seq`` of its batch (its block's last)."""
    sizes = deduped.groupBy("batch").agg(F.count("*").alias("_n")).withColumn("_range", F.floor(F.col("batch") / (1 << 16)))
    # Prefix sums in two steps: within ranges of batches, and over the ranges' totals.
    totals = sizes.groupBy("_range").agg(F.sum("_n").alias("_total"))
    chain = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(chain), F.lit(0)).alias("_carried"))
    own = Window.partitionBy("_range").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(totals, "_range")
    sizes = sizes.select("batch", "_n", (F.lit(start) + F.col("_before") + F.col("_carried")).alias("_start"))
    d = deduped.join(sizes, "batch")
    return d.withColumn("seq", F.col("_start") + F.col("slot")).withColumn("commit_seq", F.col("_start") + F.col("_n") - 1).drop("_n", "_start")


def gap_free_watermark(ranges: DataFrame, base: int = 0) -> DataFrame:
    """One row, ``visible``: the highest s such that the completed ranges [start, end] cover everything above ``base`` up to s.

    Ranges are cut into runs by blocks of start; a block only passes on its own cover, so no task sorts all ranges.
    """
    block = 1 << 16
    r = ranges.select(F.col("start").cast("long"), F.col("end").cast("long"), F.floor(F.col("start") / block).alias("_block"))
    inner = Window.partitionBy("_block").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    chain = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = r.groupBy("_block").agg(F.max("end").alias("_end"))
    ends = ends.select("_block", F.coalesce(F.max("_end").over(chain), F.lit(base)).alias("_carried"))
    r = r.join(ends, "_block").withColumn("_reached", F.greatest("_carried", F.coalesce(F.max("end").over(inner), F.lit(base))))
    gap = F.min(F.when(F.col("start") > F.col("_reached") + 1, F.col("start")))
    first = r.agg(gap.alias("gap"), F.max("end").alias("top"))
    # Nothing before the first gap starts at or after it, so the cover up to there is the largest end that starts earlier.
    below = r.join(F.broadcast(first), F.col("gap").isNull() | (F.col("start") < F.col("gap")))
    return below.agg(F.coalesce(F.greatest(F.max("end"), F.lit(base)), F.lit(base)).cast("long").alias("visible"))


def conflicts(log: DataFrame, touched: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The touched keys (key, read_seq) whose newest committed version is above their transaction's read_seq.

    Used for the write set (Snapshot, Serializable) and for the point reads of all families (Serializable). The log side
    is cut to touched keys, then reduced to one maximum a key by a hash aggregate with partial sums.
    """
    newest = log.join(touched.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(F.max("seq").alias("newest_seq"))
    return touched.join(newest, list(keys)).filter(F.col("newest_seq") > F.col("read_seq"))


def replay_savepoints(ops: DataFrame) -> DataFrame:
    """The writes that a transaction commits, from its operations in order (op_idx; action put, delete, savepoint, rollback_to, release; name).

    A write is undone by a later rollback_to whose savepoint was set before it. A rollback_to takes the last savepoint of
    its name that is still on the stack and keeps it; release and rollback drop later ones. An unknown name raises. One
    transaction's list is sequential by nature, so each one is replayed as a group; many run in parallel.
    """
    import pandas as pd

    schema = ops.schema

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("op_idx").reset_index(drop=True)
        writes: list[int] = []
        stack: list[tuple[str, int]] = []
        for i, (action, name) in enumerate(zip(part["action"], part["name"])):
            if action in ("put", "delete"):
                writes.append(i)
            elif action == "savepoint":
                stack.append((name, len(writes)))
            elif action in ("rollback_to", "release"):
                at = max((j for j, (x, _) in enumerate(stack) if x == name), default=None)
                if at is None:
                    raise ValueError(f"unknown savepoint {name!r}")
                if action == "rollback_to":
                    del writes[stack[at][1] :]
                    del stack[at + 1 :]
                else:
                    del stack[at:]
        return part.iloc[writes]

    return ops.groupBy("txn").applyInPandas(replay, schema)
