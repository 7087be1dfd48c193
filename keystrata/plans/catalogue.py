"""Named queries over the engine's operators, and the equivalent DuckDB SQL of each.

Every query runs over its whole tables. Order is emitted as a column, binary keys as text or hexadecimal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import formats
from keystrata.model import PartitionRule, TierRule
from keystrata.operators import compaction, partitions, scan, statistics, transactions
from keystrata.operators.keys import excluded, included, sort_key
from keystrata.operators.resolve import newest, positions, resolve, resolve_with_overlay
from keystrata.plans import storing
from keystrata.sources.tables import DAY_NS, big_endian, event_files, event_log, item_log, micros, order_files, table, text_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

READ_SEQ, OLD_SEQ, NEW_SEQ = 5000, 3000, 8000
NOW_NS = 1_705_708_800 * 10**9  # 2024-01-20 00:00:00

#: The event log, and what a reader at READ_SEQ sees of it, in SQL.
VL = """vl AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id + 1 AS seq, event_type = 'error' AS tomb,
    CASE WHEN event_type = 'view' THEN epoch_us(ts) * 1000 + 604800000000000 ELSE 0 END AS exp, event_id, value FROM events)"""


def _seen(name: str, seq: int | None, where: str = "true") -> str:
    at = "true" if seq is None else f"seq <= {seq}"
    return f"""{name} AS (SELECT k, seq, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM vl
    WHERE {at} AND {where}) WHERE rn = 1 AND NOT tomb AND (exp = 0 OR exp > {NOW_NS}))"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _text(column: str = "key", name: str = "k") -> Column:
    return F.decode(F.col(column), "UTF-8").alias(name)


def _view(spark, sf_dir, seq: int | None = READ_SEQ) -> DataFrame:
    return resolve(event_log(spark, sf_dir), seq, NOW_NS)


def _columns(view: DataFrame, *more: str) -> DataFrame:
    return view.select(_text(), "seq", "value", *more)


# Reads


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, seq, value FROM v")
def snapshot_scan(spark, sf_dir):
    return _columns(_view(spark, sf_dir))


@query(f"WITH {VL}, {_seen('v', READ_SEQ, "k = '12'")} SELECT k, seq, value FROM v")
def point_get(spark, sf_dir):
    return _columns(scan.get(event_log(spark, sf_dir), b"12", READ_SEQ, NOW_NS))


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, seq, value FROM v WHERE k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
def multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(text_key(F.col("c_custkey")).alias("key"))
    return _columns(scan.multi_get(event_log(spark, sf_dir), keys, READ_SEQ, NOW_NS))


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, seq, value, row_number() OVER (ORDER BY k) AS pos FROM v")
def scan_forward(spark, sf_dir):
    return _columns(scan.ordered(_view(spark, sf_dir), column="key"), "pos")


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, seq, value, row_number() OVER (ORDER BY k DESC) AS pos FROM v")
def scan_backward(spark, sf_dir):
    return _columns(scan.ordered(_view(spark, sf_dir), backward=True, column="key"), "pos")


@query(f"WITH {VL}, {_seen('v', READ_SEQ, "k >= '13x'")} SELECT k, seq, value FROM v ORDER BY k LIMIT 1")
def seek_ge(spark, sf_dir):
    log = scan.ranged(event_log(spark, sf_dir), included(b"13x"))
    return _columns(scan.seek(resolve(log, READ_SEQ, NOW_NS), b"13x", "key"))


@query(f"WITH {VL}, {_seen('v', READ_SEQ, "k <= '13x'")} SELECT k, seq, value FROM v ORDER BY k DESC LIMIT 1")
def seek_le(spark, sf_dir):
    log = scan.ranged(event_log(spark, sf_dir), upper=included(b"13x"))
    return _columns(scan.seek_for_prev(resolve(log, READ_SEQ, NOW_NS), b"13x", "key"))


def _range_query(name: str, low, high, where: str):
    def run(spark, sf_dir):
        return _columns(resolve(scan.ranged(event_log(spark, sf_dir), low, high), READ_SEQ, NOW_NS))

    run.__name__ = name
    query(f"WITH {VL}, {_seen('v', READ_SEQ, where)} SELECT k, seq, value FROM v")(run)


_range_query("range_incl_incl", included(b"12"), included(b"30"), "k >= '12' AND k <= '30'")
_range_query("range_incl_excl", included(b"12"), excluded(b"30"), "k >= '12' AND k < '30'")
_range_query("range_excl_incl", excluded(b"12"), included(b"30"), "k > '12' AND k <= '30'")
_range_query("range_excl_excl", excluded(b"12"), excluded(b"30"), "k > '12' AND k < '30'")


@query("SELECT p_partkey, p_name FROM part WHERE p_name >= 'b' AND p_name < 'c'")
def prefix_scan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    keyed = p.withColumn("key", text_key(F.col("p_name"))).filter((F.col("p_name") >= "b") & (F.col("p_name") < "c"))
    return scan.prefixed(keyed, b"b").select("p_partkey", "p_name")


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, seq, value FROM v ORDER BY k LIMIT 1")
def queue_peek(spark, sf_dir):
    return _columns(scan.first(_view(spark, sf_dir), 1, "key"))


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, seq, value FROM v ORDER BY k DESC LIMIT 1")
def queue_tail(spark, sf_dir):
    return _columns(scan.first(_view(spark, sf_dir), 1, "key", backward=True))


@query(f"WITH {VL}, {_seen('v', None)} SELECT k, seq, value FROM v ORDER BY seq DESC LIMIT 256")
def event_log_newest(spark, sf_dir):
    return _columns(scan.first(_view(spark, sf_dir, None), 256, "seq", backward=True))


@query("""SELECT CAST(user_id AS VARCHAR) AS k, event_id + 1 AS seq, value, CAST(rank AS INTEGER) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 3""")
def feed_topn(spark, sf_dir):
    return _columns(scan.newest_of_each(event_log(spark, sf_dir), "key", 3), "rank")


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, lag(k) OVER (ORDER BY k) AS prev_k, lead(k) OVER (ORDER BY k) AS next_k FROM v")
def cursor_neighbors(spark, sf_dir):
    return scan.neighbours(_view(spark, sf_dir), "key").select(_text(), _text("prev_key", "prev_k"), _text("next_key", "next_k"))


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT count(*) AS n FROM v")
def live_count(spark, sf_dir):
    return _view(spark, sf_dir).agg(F.count("*").alias("n"))


_ASKED = "SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer"


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(text_key(F.col("c_custkey")).alias("key"))


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k FROM ({_ASKED}) WHERE k IN (SELECT k FROM v)")
def contains_semi(spark, sf_dir):
    return scan.contained(_asked(spark, sf_dir), _view(spark, sf_dir)).select(_text())


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k FROM ({_ASKED}) WHERE k NOT IN (SELECT k FROM v)")
def missing_anti(spark, sf_dir):
    return scan.missing(_asked(spark, sf_dir), _view(spark, sf_dir)).select(_text())


@query(f"WITH {VL}, {_seen('v', OLD_SEQ)} SELECT k, seq, value FROM v")
def as_of_scan(spark, sf_dir):
    return _columns(_view(spark, sf_dir, OLD_SEQ))


@query(f"""WITH {VL}, p AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderkey % 10000 AS read_seq FROM orders),
    j AS (SELECT p.k, p.read_seq, vl.seq, vl.value, vl.tomb, vl.exp FROM p ASOF LEFT JOIN vl ON p.k = vl.k AND p.read_seq >= vl.seq)
    SELECT k, read_seq, CASE WHEN NOT tomb AND (exp = 0 OR exp > {NOW_NS}) THEN seq END AS seq,
    CASE WHEN NOT tomb AND (exp = 0 OR exp > {NOW_NS}) THEN value END AS value FROM j""")
def asof_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    probes = o.select(text_key(F.col("o_custkey")).alias("key"), F.pmod("o_orderkey", F.lit(10000)).alias("read_seq"))
    return scan.as_of_lookup(event_log(spark, sf_dir), probes, NOW_NS, ["value"]).select(_text(), "read_seq", "seq", "value")


@query(f"""WITH {VL}, o AS (SELECT CAST(c_custkey AS VARCHAR) AS k, {READ_SEQ} AS seq, c_nationkey = 3 AS tomb, 0 AS exp, c_custkey AS event_id,
    c_acctbal AS value, 1 AS src FROM customer WHERE c_nationkey < 8),
    a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src DESC, seq DESC) AS rn FROM
        (SELECT k, seq, tomb, exp, event_id, value, 0 AS src FROM vl WHERE seq <= {READ_SEQ} UNION ALL SELECT k, seq, tomb, exp, event_id, value, src FROM o))
    SELECT k, seq, value FROM a WHERE rn = 1 AND NOT tomb AND (exp = 0 OR exp > {NOW_NS})""")
def overlay_scan(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_nationkey < 8")
    mine = c.select(text_key(F.col("c_custkey")).alias("key"), (F.col("c_nationkey") == 3).alias("tombstone"), F.lit(0).cast("long").alias("expires_at_ns"), F.col("c_custkey").alias("event_id"), F.col("c_acctbal").alias("value"), F.lit(0).alias("op_idx"))
    return _columns(resolve_with_overlay(event_log(spark, sf_dir), mine, READ_SEQ, NOW_NS))


@query(f"""WITH {VL}, {_seen('a', OLD_SEQ)}, {_seen('b', NEW_SEQ)}
    SELECT coalesce(a.k, b.k) AS k, a.value AS old, b.value AS new, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.value IS DISTINCT FROM b.value""")
def snapshot_diff(spark, sf_dir):
    return scan.difference(event_log(spark, sf_dir), OLD_SEQ, NEW_SEQ, NOW_NS).select(_text(), "old", "new", "change")


@query(f"WITH {VL} SELECT k, seq, CASE WHEN tomb THEN 'delete' ELSE 'put' END AS op FROM vl WHERE seq > {OLD_SEQ} AND seq <= {READ_SEQ}")
def change_feed(spark, sf_dir):
    return scan.change_feed(event_log(spark, sf_dir), OLD_SEQ, READ_SEQ).select(_text(), "seq", "op")


@query("SELECT user_id, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
def timeseries_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-06 00:00:00"))
    return e.filter((F.col("ts") >= low) & (F.col("ts") < high)).select("user_id", "event_id", "value")


# Transactions


_OPS = "SELECT o_orderkey // 64 AS batch, CAST(o_custkey % 50 AS VARCHAR) AS k, o_orderkey AS op_idx FROM orders"


def _ops(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 64).alias("batch"), F.lit("orders").alias("cf"), text_key(F.pmod("o_custkey", F.lit(50))).alias("key"), F.col("o_orderkey").alias("op_idx"))


_DEDUP = f"""ops AS ({_OPS}), d AS (SELECT batch, k, max(op_idx) AS op_idx, min(op_idx) AS first_op FROM ops GROUP BY batch, k),
    s AS (SELECT batch, k, op_idx, row_number() OVER (PARTITION BY batch ORDER BY first_op) - 1 AS slot FROM d)"""


@query(f"WITH {_DEDUP} SELECT batch, k, op_idx, slot FROM s")
def txn_dedup(spark, sf_dir):
    return transactions.dedup_batch(_ops(spark, sf_dir)).select("batch", _text(), "op_idx", "slot")


@query(f"""WITH {_DEDUP}, n AS (SELECT batch, count(*) AS n FROM s GROUP BY batch),
    b AS (SELECT batch, CAST(1001 + coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM n)
    SELECT s.batch, s.k, b.start + s.slot AS seq, b.start + b.n - 1 AS commit_seq FROM s JOIN b ON s.batch = b.batch""")
def assign_seq(spark, sf_dir):
    return transactions.assign_sequences(transactions.dedup_batch(_ops(spark, sf_dir)), 1001).select("batch", _text(), "seq", "commit_seq")


@query("""WITH r AS (SELECT event_id * 10 + 1 AS s, event_id * 10 + 10 AS e FROM events WHERE event_id <> 777),
    g AS (SELECT s, e, coalesce(max(e) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM r),
    f AS (SELECT min(s) AS gap FROM g WHERE s > reached + 1)
    SELECT CAST(coalesce(max(e), 0) AS BIGINT) AS visible FROM g, f WHERE gap IS NULL OR s < gap""")
def gapfree_watermark(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id <> 777")
    return transactions.gap_free_watermark(e.select((F.col("event_id") * 10 + 1).alias("start"), (F.col("event_id") * 10 + 10).alias("end")))


_WRITES = "SELECT CAST(c_custkey AS VARCHAR) AS k, 4000 + c_custkey % 5000 AS read_seq FROM customer"


def _writes(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(text_key(F.col("c_custkey")).alias("key"), (F.lit(4000) + F.pmod("c_custkey", F.lit(5000))).cast("long").alias("read_seq"))


@query(f"""WITH {VL}, w AS ({_WRITES}), m AS (SELECT k, max(seq) AS newest_seq FROM vl GROUP BY k)
    SELECT w.k, read_seq, newest_seq FROM w JOIN m ON w.k = m.k WHERE newest_seq > read_seq""")
def ww_conflict(spark, sf_dir):
    return transactions.conflicts(event_log(spark, sf_dir), _writes(spark, sf_dir)).select(_text(), "read_seq", "newest_seq")


_FAMILIES = """f AS (SELECT 'orders' AS cf, CAST(o_custkey AS VARCHAR) AS k, o_orderkey AS seq, o_totalprice AS value FROM orders
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_custkey, c_acctbal FROM customer)"""


def _families(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = o.select(F.lit("orders").alias("cf"), text_key(F.col("o_custkey")).alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return a.unionByName(c.select(F.lit("customer").alias("cf"), text_key(F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("value")))


@query(f"""WITH {_FAMILIES}, r AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'orders' ELSE 'customer' END AS cf, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey * 20 AS read_seq FROM supplier),
    m AS (SELECT cf, k, max(seq) AS newest_seq FROM f GROUP BY cf, k)
    SELECT r.cf, r.k, read_seq, newest_seq FROM r JOIN m ON r.cf = m.cf AND r.k = m.k WHERE newest_seq > read_seq""")
def serializable_conflict(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    reads = s.select(F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "orders").otherwise("customer").alias("cf"), text_key(F.col("s_suppkey")).alias("key"), (F.col("s_suppkey") * 20).alias("read_seq"))
    return transactions.conflicts(_families(spark, sf_dir), reads, ("cf", "key")).select("cf", _text(), "read_seq", "newest_seq")


@query("""WITH o AS (SELECT event_id // 50 AS txn, event_id % 50 AS op_idx, event_id FROM events),
    p AS (SELECT *, CASE WHEN op_idx % 10 = 3 THEN 'savepoint' WHEN op_idx % 20 = 18 THEN 'rollback_to' ELSE 'put' END AS action FROM o)
    SELECT txn, op_idx, event_id FROM p WHERE action = 'put' AND NOT (op_idx % 20 > 13 AND op_idx % 20 < 18
        AND EXISTS (SELECT 1 FROM p q WHERE q.txn = p.txn AND q.op_idx = p.op_idx - p.op_idx % 20 + 18)
        AND EXISTS (SELECT 1 FROM p q WHERE q.txn = p.txn AND q.op_idx = p.op_idx - p.op_idx % 20 + 13))""")
def savepoint_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.pmod("event_id", F.lit(50))
    action = F.when(op % 10 == 3, "savepoint").when(op % 20 == 18, "rollback_to").otherwise("put")
    ops = e.select(F.floor(F.col("event_id") / 50).alias("txn"), op.alias("op_idx"), action.alias("action"), F.lit("s").alias("name"), "event_id")
    return transactions.replay_savepoints(ops).select("txn", "op_idx", "event_id")


# Compaction and retention


OLDEST = 8000
_COLLAPSE = f"""c AS (SELECT *, seq <= {OLDEST} AS below, row_number() OVER (PARTITION BY k, seq <= {OLDEST} ORDER BY seq DESC) AS rn FROM vl),
    kept AS (SELECT *, exp > 0 AND exp <= {NOW_NS} AND NOT tomb AS expired FROM c WHERE NOT below OR rn = 1)"""


def _compacted(spark, sf_dir, bottom: bool, **more) -> DataFrame:
    return compaction.compact(event_log(spark, sf_dir), OLDEST, NOW_NS, bottom, **more).select(_text(), "seq", "tombstone", "value")


@query(f"WITH {VL}, {_COLLAPSE} SELECT k, seq, tomb AS tombstone, value FROM kept")
def compact_collapse(spark, sf_dir):
    return _compacted(spark, sf_dir, False)


@query(f"WITH {VL}, {_COLLAPSE} SELECT k, seq, tomb AS tombstone, value FROM kept WHERE NOT (below AND (tomb OR expired))")
def compact_bottom(spark, sf_dir):
    return _compacted(spark, sf_dir, True)


@query(f"WITH {VL}, {_COLLAPSE} SELECT k, seq, tomb AS tombstone, value FROM kept WHERE NOT (below AND tomb) AND NOT expired")
def compact_bottom_ref(spark, sf_dir):
    return _compacted(spark, sf_dir, True, literal_ttl=True)


@query(f"WITH {VL}, {_COLLAPSE} SELECT k, seq, tomb AS tombstone, value FROM kept WHERE NOT (below AND (tomb OR expired OR value > 50))")
def compact_filter(spark, sf_dir):
    return _compacted(spark, sf_dir, True, removes=F.col("value") > 50)


@query(f"WITH {VL}, {_COLLAPSE} SELECT k, seq, tomb OR (below AND NOT expired AND value > 50) AS tombstone, value FROM kept")
def compact_filter_upper(spark, sf_dir):
    return _compacted(spark, sf_dir, False, removes=F.col("value") > 50)


_FILES = """f AS (SELECT event_id // 500 AS id, count(*) AS num_entries, CAST(sum(CAST(event_type = 'error' AS INT)) AS BIGINT) AS num_tombstones,
    max(event_id + 1) AS max_seq, CAST(sum(length(props)) AS BIGINT) AS bytes, min(CAST(user_id AS VARCHAR)) AS min_k, max(CAST(user_id AS VARCHAR)) AS max_k, max(epoch_us(ts)) * 1000 AS t FROM events GROUP BY 1)"""
_ORDER_FILES = """o AS (SELECT CAST(o_orderkey % 4 AS INT) AS level, o_orderkey // (256 * CAST(pow(2, 4 - o_orderkey % 4) AS BIGINT)) AS place, * FROM orders),
    f AS (SELECT level, place * 4 + level AS id, place, count(*) AS num_entries, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS num_tombstones, max(o_orderkey) AS max_seq,
        CAST(sum(length(o_orderpriority)) AS BIGINT) AS bytes, min(o_orderkey) AS min_k, max(o_orderkey) AS max_k, max(epoch_us(o_orderdate)) * 1000 AS t,
        CASE WHEN place % 3 < 2 THEN 'p' || CAST(place // 2 % 5 AS VARCHAR) END AS part, CASE WHEN place % 7 = 3 THEN 'hdd' ELSE 'ssd' END AS tier FROM o GROUP BY level, place)"""


def _number(column: str, name: str) -> Column:
    return F.conv(F.hex(F.col(column)), 16, 10).cast("long").alias(name)


@query(f"""WITH {_ORDER_FILES}, s AS (SELECT level, count(*) AS files, sum(bytes) AS bytes FROM f GROUP BY level)
    SELECT min(level) AS level FROM s WHERE CASE WHEN level = 0 THEN files >= 10000 ELSE bytes > 1000 * pow(4, level - 1) END""")
def pick_level(spark, sf_dir):
    return compaction.pick_level(order_files(spark, sf_dir), trigger=10000, buffer_bytes=1000, ratio=4)


@query(f"""WITH {_ORDER_FILES}, u AS (SELECT min(min_k) AS lo, max(max_k) AS hi FROM f WHERE level = 1)
    SELECT level, id, num_entries FROM f, u WHERE level = 1 OR (level = 2 AND min_k <= hi AND max_k >= lo)""")
def overlap_inputs(spark, sf_dir):
    return compaction.overlapping(order_files(spark, sf_dir), 1).select("level", "id", "num_entries")


@query(f"WITH {_ORDER_FILES} SELECT u.id AS upper_id, l.id AS lower_id FROM f u JOIN f l ON u.level = 1 AND l.level = 2 AND u.min_k <= l.max_k AND l.min_k <= u.max_k")
def overlap_pairs(spark, sf_dir):
    files = order_files(spark, sf_dir)
    return compaction.overlap_pairs(files.filter("level = 1"), files.filter("level = 2"))


@query(f"WITH {_FILES} SELECT max(t) AS max_entry_time FROM f")
def age_carry(spark, sf_dir):
    return compaction.carried_age(event_files(spark, sf_dir))


@query(f"WITH {_FILES}, s AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM f) SELECT id, bytes, rest FROM s WHERE rest > 20000")
def fifo_size(spark, sf_dir):
    return compaction.fifo_by_size(event_files(spark, sf_dir), 20000).select("id", F.col("klog_size").alias("bytes"), F.col("bytes_from_here").alias("rest"))


@query(f"WITH {_FILES} SELECT id, t AS max_entry_time FROM f WHERE {NOW_NS} - t > {10 * DAY_NS}")
def fifo_ttl(spark, sf_dir):
    return compaction.fifo_by_age(event_files(spark, sf_dir), 10 * DAY_NS, NOW_NS).select("id", "max_entry_time")


# Partitions, parts, tiers


RULES = (PartitionRule(b"1", "ones"), PartitionRule(b"12", "twelves"), PartitionRule(b"3", "threes"))
_PART = "CASE WHEN starts_with(k, '12') THEN 'twelves' WHEN starts_with(k, '1') THEN 'ones' WHEN starts_with(k, '3') THEN 'threes' END"


@query(f"WITH {VL} SELECT {_PART} AS part, count(*) AS n, min(k) AS min_k FROM vl GROUP BY 1")
def partition_of(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("part", partitions.partition_of(F.col("key"), RULES))
    return log.groupBy("part").agg(F.count("*").alias("n"), F.min("key").alias("key")).select("part", "n", _text("key", "min_k"))


@query("SELECT CAST(user_id AS VARCHAR) || '-' || CAST(epoch_us(ts) // 86400000000 AS VARCHAR) AS part, count(*) AS n FROM events GROUP BY 1")
def derived_partition(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.floor(micros(F.col("ts")) / 86_400_000_000)
    key = F.concat(text_key(F.col("user_id")), F.unhex(F.lit("0000")), big_endian(day), big_endian(F.col("event_id")))
    return e.select(partitions.SCHEMES["tenant-bucket"](key).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query(f"WITH {VL} SELECT event_id // 500 AS file_id, count(DISTINCT coalesce({_PART}, '')) AS partitions FROM vl GROUP BY 1 HAVING count(DISTINCT coalesce({_PART}, '')) > 1")
def partition_cut_check(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("file_id", F.floor(F.col("event_id") / 500))
    return partitions.files_spanning_partitions(log, partitions.partition_of(F.col("key"), RULES))


@query(f"WITH {_ORDER_FILES} SELECT part AS partition, min(min_k) AS min_k, min(tier) AS tier, count(*) AS files FROM f WHERE level = 1 AND part IS NOT NULL GROUP BY part HAVING min(tier) = max(tier)")
def list_partitions(spark, sf_dir):
    return partitions.list_partitions(order_files(spark, sf_dir), 1).select("partition", _number("min_key", "min_k"), "tier", "files")


@query("SELECT p_brand AS prefix, count(*) AS rules FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_prefix_check(spark, sf_dir):
    return partitions.duplicate_prefixes(table(spark, sf_dir, "part").select(F.col("p_brand").alias("prefix")))


@query(f"WITH {VL}, {_seen('v', READ_SEQ)} SELECT k, seq, value FROM v WHERE ({_PART}) IS DISTINCT FROM 'ones'")
def detach_scan(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("partition", partitions.partition_of(F.col("key"), RULES)).withColumn("level", F.lit(4))
    return _columns(resolve(partitions.detach(log, 4, "ones"), READ_SEQ, NOW_NS))


@query(f"""WITH {_ORDER_FILES}, i AS (SELECT * FROM f WHERE level = 3), span AS (SELECT min(min_k) AS lo, max(max_k) AS hi, max(max_seq) AS top FROM i),
    clash AS (SELECT count(*) > 0 AS c FROM f, span WHERE level = 2 AND place % 2 = 0 AND min_k <= hi AND max_k >= lo)
    SELECT 9000 + row_number() OVER (ORDER BY id) - 1 AS id, CASE WHEN c THEN 0 ELSE 2 END AS level, min_k, max_k, top > 1000000000 AS rejected FROM i, span, clash""")
def attach_placement(spark, sf_dir):
    files = order_files(spark, sf_dir)
    own = files.filter("level = 2 and floor(id / 4) % 2 = 0")
    placed = partitions.attach_placement(own, files.filter("level = 3"), 2, 1_000_000_000, 9000, NOW_NS)
    return placed.select("id", "level", _number("min_key", "min_k"), _number("max_key", "max_k"), "rejected")


@query(f"""WITH {_ORDER_FILES}, p AS (SELECT part, min(min_k) AS min_k, min(tier) AS tier, max(tier) AS other, max(t) AS newest FROM f WHERE level = 1 AND part IS NOT NULL GROUP BY part),
    r AS (SELECT *, CASE WHEN min_k < 1024 THEN 'cold' WHEN min_k < 65536 THEN 'hdd' END AS target, CASE WHEN min_k < 1024 THEN 0 ELSE {30 * DAY_NS} END AS least FROM p)
    SELECT part AS partition, min_k, tier, target, newest FROM r WHERE target <> 'ssd' AND (target <> tier OR tier <> other) AND {NOW_NS} - newest > least""")
def mover_plan(spark, sf_dir):
    # 8-byte keys: six zero bytes hold 0..65535, a seventh of 0..3 the first 1024.
    rules = [TierRule(bytes(6), "hdd", 30 * DAY_NS), *(TierRule(bytes([0] * 6 + [b]), "cold", 0) for b in range(4))]
    plan = partitions.mover_plan(order_files(spark, sf_dir), 1, rules, NOW_NS)
    return plan.select("partition", _number("min_key", "min_k"), "tier", "target", "newest")


@query(f"WITH {_ORDER_FILES}, l AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'hdd' ELSE 'ssd' END AS tier FROM f) SELECT l.id, l.tier FROM l JOIN f ON l.id = f.id WHERE l.tier <> f.tier")
def orphan_files(spark, sf_dir):
    files = order_files(spark, sf_dir)
    listing = files.select("id", F.when(F.pmod("id", F.lit(5)) == 0, "hdd").otherwise("ssd").alias("tier"))
    return partitions.orphans(listing, files)


# Statistics


@query(f"WITH {_ORDER_FILES} SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(num_entries) AS BIGINT) AS entries, CAST(sum(num_tombstones) AS BIGINT) AS tombstones FROM f GROUP BY level")
def cf_stats(spark, sf_dir):
    return statistics.level_statistics(order_files(spark, sf_dir))


@query(f"""WITH {_ORDER_FILES}, e AS (SELECT event_id // 500 AS id, sum(length(props)) AS bytes FROM events GROUP BY 1),
    a AS (SELECT 'orders' AS cf, level, bytes FROM f UNION ALL SELECT 'events', 0, bytes FROM e)
    SELECT cf, level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM a GROUP BY ROLLUP (cf, level)""")
def db_stats(spark, sf_dir):
    columns = ("cf", "level", "klog_size", "vlog_size")
    a = order_files(spark, sf_dir).withColumn("cf", F.lit("orders")).select(*columns)
    return statistics.database_statistics(a.unionByName(event_files(spark, sf_dir).withColumn("cf", F.lit("events")).select(*columns)))


@query("""SELECT l_orderkey // 512 AS file_id, count(*) AS num_entries, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS num_tombstones,
    max(l_orderkey * 8 + l_linenumber) AS max_seq, min(l_orderkey) AS min_k, max(l_orderkey) AS max_k FROM lineitem GROUP BY 1""")
def file_meta(spark, sf_dir):
    log = item_log(spark, sf_dir).withColumn("file_id", F.floor(F.col("l_orderkey") / 512))
    return statistics.file_metadata(log).select("file_id", "num_entries", "num_tombstones", "max_seq", _number("min_key", "min_k"), _number("max_key", "max_k"))


@query("SELECT count(*) + 7 AS approx_len FROM orders")
def approx_len(spark, sf_dir):
    return statistics.approximate_length(order_files(spark, sf_dir), 7)


@query("SELECT strlen(text) >= 512 AS side_file, count(*) AS \"values\", CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def value_separation_stats(spark, sf_dir):
    return statistics.separated_values(table(spark, sf_dir, "documents").select(F.octet_length("text").alias("size")), "size")


# Comparators


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name DESC, p_partkey DESC) AS pos FROM part")
def comparator_reverse(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("sort_key", F.concat(sort_key(text_key(F.col("p_name")), "reverse"), F.unhex(F.lit("00")), big_endian(F.col("p_partkey"))))
    return scan.ordered(p, "reverse").select("p_partkey", "p_name", "pos")


@query("""SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded,
    row_number() OVER (ORDER BY translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p_partkey) AS pos FROM part""")
def comparator_case_insensitive(spark, sf_dir):
    mixed = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").withColumn("folded", sort_key(text_key(mixed), "case_insensitive"))
    p = p.withColumn("sort_key", F.concat("folded", F.unhex(F.lit("00")), big_endian(F.col("p_partkey"))))
    return positions(p).select("p_partkey", _text("folded", "folded"), "pos")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders")
def comparator_uint64(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("sort_key", sort_key(big_endian(F.col("o_orderkey")), "uint64"))
    return positions(o).select("o_orderkey", "pos")


@query("SELECT o_orderkey, (o_orderkey % 2 * 2 - 1) * o_orderkey AS n, row_number() OVER (ORDER BY (o_orderkey % 2 * 2 - 1) * o_orderkey) AS pos FROM orders")
def comparator_int64(spark, sf_dir):
    n = (F.pmod("o_orderkey", F.lit(2)) * 2 - 1) * F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("n", n).withColumn("sort_key", sort_key(big_endian(F.col("n")), "int64"))
    return positions(o).select("o_orderkey", "n", "pos")


# Set operations over families


_NEWEST = """a AS (SELECT k, max(seq) AS seq FROM f WHERE cf = 'orders' GROUP BY k), b AS (SELECT k, max(seq) AS seq FROM f WHERE cf = 'customer' GROUP BY k)"""


def _pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = _families(spark, sf_dir)
    return tuple(newest(f.filter(F.col("cf") == cf)) for cf in ("orders", "customer"))


@query(f"WITH {_FAMILIES}, {_NEWEST} SELECT k, seq FROM a UNION ALL SELECT k, seq FROM b WHERE k NOT IN (SELECT k FROM a)")
def cf_union(spark, sf_dir):
    return scan.union(*_pair(spark, sf_dir)).select(_text(), "seq")


@query(f"WITH {_FAMILIES}, {_NEWEST} SELECT k, seq FROM a WHERE k IN (SELECT k FROM b)")
def cf_intersect(spark, sf_dir):
    return scan.intersect(*_pair(spark, sf_dir)).select(_text(), "seq")


@query(f"WITH {_FAMILIES}, {_NEWEST} SELECT k, seq FROM b WHERE k NOT IN (SELECT k FROM a WHERE seq > 12000)")
def cf_except(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return scan.except_(b, a.filter("seq > 12000")).select(_text(), "seq")


@query(f"WITH {_FAMILIES} SELECT cf, k, max(seq) AS seq, count(*) AS versions FROM f GROUP BY cf, k")
def unified_split(spark, sf_dir):
    f = _families(spark, sf_dir)
    counts = f.groupBy("cf", "key").agg(F.max("seq").alias("seq"), F.count("*").alias("versions"))
    return counts.select("cf", _text(), "seq", "versions")


# Ingestion and formats


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM i WHERE before >= l_partkey""")
def bulk_ingest_order_check(spark, sf_dir):
    from keystrata.sources.ingest import out_of_order

    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", big_endian(F.col("l_partkey")).alias("key"))
    return out_of_order(i, "key", ("l_linenumber", "key"), ("l_orderkey",)).select("l_orderkey", "l_linenumber")


@query("""SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS cf, n_name AS k,
    row_number() OVER (ORDER BY n_nationkey) AS seq, CASE WHEN n_nationkey % 3 = 0 THEN 'again' ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation""")
def store_commit_order(spark, sf_dir):
    """One transaction over two families, whose writes alternate and partly come twice, as the store's log has it."""
    import tempfile

    from keystrata.sources.store import Store

    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    family = lambda r: "odd" if r["n_regionkey"] % 2 else "even"
    with tempfile.TemporaryDirectory() as root, Store(spark, root) as store:
        store.create_column_family("even")
        store.create_column_family("odd")
        with store.begin() as t:
            for r in rows:
                t.put(family(r), r["n_name"].encode(), str(r["n_regionkey"]).encode())
            for r in rows:
                if r["n_nationkey"] % 3 == 0:
                    t.put(family(r), r["n_name"].encode(), b"again")
        logs = [store.log(cf).select(F.lit(cf).alias("cf"), _text(), "seq", F.decode("value", "utf-8").alias("v")).collect() for cf in ("even", "odd")]
    return spark.createDataFrame([tuple(r) for log in logs for r in log], "cf string, k string, seq long, v string")


@query(f"WITH {VL} SELECT k, seq, hex(encode(k)) || lpad(hex(18446744073709551615 - seq), 16, 'F') AS internal FROM vl")
def internal_keys(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("internal", formats.internal_key(F.col("key"), F.col("seq")))
    return log.select(_text(), formats.internal_seq(F.col("internal")).alias("seq"), F.hex("internal").alias("internal"))


# Queries that drive a store

QUERIES |= storing.QUERIES
ORACLE_SQL |= storing.ORACLE_SQL
