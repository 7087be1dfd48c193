"""Named queries that drive a persistent ``Store`` through its life: loads, commits, compaction, parts, copies.

Each makes a store of its own in a folder that goes when the process ends, and returns a DataFrame over its files. The folder
lies in ``spark.checkpoint.dir`` where that is a plain path, so that executors share it.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.model import ColumnFamilyConfig, ConflictError, Isolation, PartitionRule, StoreOptions
from keystrata.sources.store import Store
from keystrata.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_NS = 1_705_708_800 * 10**9
#: Orders by key: a first load, then one that rewrites status P and deletes status F. Every seventh customer's rows have expired.
BOTH = """o AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k, o_orderpriority AS p, o_orderstatus AS st, o_custkey % 7 = 0 AS old FROM orders),
loaded AS (SELECT k, p AS v FROM o WHERE NOT old),
newest AS (SELECT k, CASE WHEN st = 'P' THEN 2 ELSE 1 END AS seq, CASE WHEN st = 'P' THEN 'again' ELSE p END AS v
    FROM o WHERE st <> 'F' AND (NOT old OR st = 'P'))"""
PARTS = (PartitionRule(b"1-", "urgent"), PartitionRule(b"2-", "high"))


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _folder(spark: SparkSession) -> str:
    shared = urlsplit(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "")
    base = shared.path if shared.path and shared.scheme in ("", "file") else None
    if base:
        os.makedirs(base, exist_ok=True)
    root = tempfile.mkdtemp(prefix="store-", dir=base)
    atexit.register(shutil.rmtree, root, True)
    return root


def _open(spark: SparkSession, root: str, **options) -> Store:
    return Store(spark, os.path.join(root, "db"), StoreOptions(**options), clock=lambda: NOW_NS)


def _orders(spark: SparkSession, sf_dir: str, key=None) -> DataFrame:
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0") if key is None else key
    return table(spark, sf_dir, "orders").select(
        F.encode(key, "UTF-8").alias("key"),
        F.encode("o_orderpriority", "UTF-8").alias("value"),
        F.when(F.col("o_custkey") % 7 == 0, NOW_NS - 1).otherwise(0).cast("long").alias("expires_at_ns"),
        "o_orderstatus",
    )


def _load(store: Store, name: str, rows: DataFrame) -> None:
    """The first load."""
    store.ingest(name, rows.drop("o_orderstatus"))


def _reload(store: Store, name: str, rows: DataFrame) -> None:
    """Status P again, status F deleted."""
    again = rows.filter("o_orderstatus in ('P', 'F')").select(
        "key", F.when(F.col("o_orderstatus") == "P", F.encode(F.lit("again"), "UTF-8")).alias("value"), (F.col("o_orderstatus") == "F").alias("tombstone")
    )
    store.ingest(name, again)


def _pairs(view: DataFrame, *more) -> DataFrame:
    return view.select(*more, F.decode("key", "UTF-8").alias("k"), F.decode("value", "UTF-8").alias("v"))


@query(f"WITH {BOTH} SELECT k, seq, v FROM newest")
def store_ingest_reopen(spark, sf_dir):
    """Two bulk loads, seen after the store was closed and opened again."""
    root, rows = _folder(spark), _orders(spark, sf_dir)
    with _open(spark, root) as s:
        s.create_column_family("orders")
        _load(s, "orders", rows)
        _reload(s, "orders", rows)
    with _open(spark, root, read_only=True) as s:
        return _pairs(s.scan("orders"), "seq")


@query(f"WITH {BOTH} SELECT k, seq, v, false AS tombstone FROM newest")
def store_compact(spark, sf_dir):
    """All versions that a full compaction leaves: the newest live one of each key."""
    root, rows = _folder(spark), _orders(spark, sf_dir)
    with _open(spark, root) as s:
        s.create_column_family("orders", ColumnFamilyConfig(write_buffer_size=256 << 10))
        _load(s, "orders", rows)
        _reload(s, "orders", rows)
        s.compact("orders")
        return _pairs(s.log("orders"), "seq", "tombstone")


@query(f"WITH {BOTH} SELECT 'before' AS at, k, v FROM loaded UNION ALL SELECT 'now', k, v FROM newest")
def store_snapshot_over_compaction(spark, sf_dir):
    """A pinned snapshot and the newest state, both read after a compaction."""
    root, rows = _folder(spark), _orders(spark, sf_dir)
    with _open(spark, root) as s:
        s.create_column_family("orders")
        _load(s, "orders", rows)
        before = s.pin()
        _reload(s, "orders", rows)
        s.compact("orders")
        out = _pairs(s.scan("orders", before), F.lit("before").alias("at")).unionByName(_pairs(s.scan("orders"), F.lit("now").alias("at")))
        s.unpin(before)
        return out


@query(f"WITH {BOTH} SELECT 'copy' AS cf, k, v FROM loaded UNION ALL SELECT 'orders', k, v FROM newest WHERE v = 'again'")
def store_clone_clear_drop(spark, sf_dir):
    """A family is cloned and cleared, takes the second load alone; a third family is dropped."""
    root, rows = _folder(spark), _orders(spark, sf_dir)
    with _open(spark, root) as s:
        s.create_column_families([("orders", ColumnFamilyConfig()), ("gone", ColumnFamilyConfig())])
        _load(s, "orders", rows)
        s.clone_column_family("orders", "copy")
        s.clear_column_family("orders")
        _reload(s, "orders", rows)
        s.drop_column_family("gone")
        first, *rest = [_pairs(s.scan(name), F.lit(name).alias("cf")) for name in s.list_column_families()]
        for d in rest:
            first = first.unionByName(d)
        return first


@query(f"WITH {BOTH} SELECT 'backup' AS place, k, v FROM newest UNION ALL SELECT 'checkpoint', k, v FROM loaded")
def store_checkpoint_backup(spark, sf_dir):
    """A checkpoint taken between the loads and a backup after them, each opened for reading as a store."""
    root, rows = _folder(spark), _orders(spark, sf_dir)
    with _open(spark, root) as s:
        s.create_column_family("orders")
        _load(s, "orders", rows)
        s.checkpoint(os.path.join(root, "checkpoint"))
        _reload(s, "orders", rows)
        s.backup(os.path.join(root, "backup"))
    out = []
    for place in ("backup", "checkpoint"):
        with Store(spark, os.path.join(root, place), StoreOptions(read_only=True), clock=lambda: NOW_NS) as s:
            out.append(_pairs(s.scan("orders"), F.lit(place).alias("place")))
    return out[0].unionByName(out[1])


_BY_PRIORITY = "o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k, o_orderpriority AS v FROM orders WHERE o_custkey % 7 <> 0"


def _in_parts(spark: SparkSession, sf_dir: str, root: str, **options) -> Store:
    """A store whose orders are keyed by priority and compacted into parts."""
    key = F.concat("o_orderpriority", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    s = _open(spark, root, **options)
    s.create_column_family("orders", ColumnFamilyConfig(partition_rules=PARTS))
    _load(s, "orders", _orders(spark, sf_dir, key))
    s.compact("orders")
    return s


@query(f"""SELECT CASE WHEN v = '1-URGENT' THEN 'other' ELSE 'orders' END AS cf, k, v FROM (SELECT {_BY_PRIORITY})
UNION ALL SELECT 'frozen', k, v FROM (SELECT {_BY_PRIORITY}) WHERE v = '2-HIGH'""")
def store_parts_detach_attach(spark, sf_dir):
    """One part leaves its family and joins another; a second one is frozen and attached to a third."""
    root = _folder(spark)
    with _in_parts(spark, sf_dir, root) as s:
        for name in ("other", "frozen"):
            s.create_column_family(name, ColumnFamilyConfig(partition_rules=PARTS))
        s.attach_part("other", s.detach_part("orders", "urgent"))
        s.freeze_part("orders", "high", os.path.join(root, "frozen"))
        s.attach_part("frozen", os.path.join(root, "frozen"))
        out = [_pairs(s.scan(name), F.lit(name).alias("cf")) for name in ("orders", "other", "frozen")]
        return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""SELECT CASE v WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' END AS partition, v = '1-URGENT' AS moved,
CAST(count(*) AS BIGINT) AS n, min(k) AS low, max(k) AS high FROM (SELECT {_BY_PRIORITY}) WHERE v IN ('1-URGENT', '2-HIGH') GROUP BY v""")
def store_move_part(spark, sf_dir):
    """The catalogue of two parts after one of them moved to another tier."""
    root = _folder(spark)
    with _in_parts(spark, sf_dir, root, tiers={"cold": os.path.join(root, "cold")}) as s:
        s.move_part("orders", "urgent", "cold")
        files = s.catalog("orders").filter("partition in ('urgent', 'high')")
        moved = (F.coalesce("tier", F.lit("")) == "cold").alias("moved")
        return files.groupBy("partition", moved).agg(
            F.sum("num_entries").cast("long").alias("n"), F.decode(F.min("min_key"), "UTF-8").alias("low"), F.decode(F.max("max_key"), "UTF-8").alias("high")
        )


@query(f"WITH {BOTH} SELECT k, v FROM newest WHERE v <> '5-LOW'")
def store_compaction_filter(spark, sf_dir):
    """What a compaction leaves that a caller's filter takes rows from."""
    root, rows = _folder(spark), _orders(spark, sf_dir)
    with _open(spark, root) as s:
        s.create_column_family("orders")
        _load(s, "orders", rows)
        _reload(s, "orders", rows)
        s.set_compaction_filter("orders", F.col("value") == F.lit(b"5-LOW"))
        s.compact("orders")
        return _pairs(s.scan("orders"))


@query("""SELECT n_name AS k, CASE WHEN n_regionkey = 2 THEN 'kept' ELSE 'first' END AS v, CAST(1 AS BIGINT) AS conflicts
FROM nation WHERE n_regionkey NOT IN (0, 1, 3)""")
def store_transactions(spark, sf_dir):
    """Puts, deletes, a put that has expired, savepoints, a rollback, and a commit that loses to an earlier one, replayed from the journal."""
    root = _folder(spark)
    nations = table(spark, sf_dir, "nation").collect()
    of = lambda region: [r["n_name"].encode() for r in nations if r["n_regionkey"] == region]
    lost = 0
    with _open(spark, root) as s:
        s.create_column_family("nations")
        with s.begin() as t:
            for r in nations:
                t.put("nations", r["n_name"].encode(), b"first")
            t.set_savepoint("all")
            for k in of(4):
                t.delete("nations", k)
            t.rollback_to_savepoint("all")
        with s.begin() as t:
            for k in of(0):
                t.delete("nations", k)
            for k in of(1):
                t.single_delete("nations", k)
            for k in of(3):
                t.put("nations", k, b"brief", ttl_ns=-1)
        one, two = s.begin(Isolation.SNAPSHOT), s.begin(Isolation.SNAPSHOT)
        for k in of(2):
            one.put("nations", k, b"kept")
            two.put("nations", k, b"lost")
        one.commit()
        try:
            two.commit()
        except ConflictError:
            lost += 1
        undone = s.begin()
        undone.put("nations", b"nowhere", b"undone")
        undone.rollback()
    with _open(spark, root, read_only=True) as s:
        return _pairs(s.scan("nations"), F.lit(lost).cast("long").alias("conflicts"))
