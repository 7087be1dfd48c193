"""Operators on small inputs: a randomised comparison with a dictionary model, streams, formats and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions import formats
from keystrata.operators import scan, transactions
from keystrata.operators.compaction import compact
from keystrata.operators.keys import sort_key
from keystrata.operators.resolve import positions, resolve

NOW = 1000
SCHEMA = "key binary, seq long, value string, expires_at_ns long, tombstone boolean, single_delete boolean"


def random_log(r, n):
    keys = [bytes([r.randrange(3)]) * r.randrange(4) for _ in range(8)]
    return [(r.choice(keys), i + 1, str(r.randrange(5)), r.choice([0, 0, 500, 2000]), r.random() < 0.3, False) for i in range(n)]


def model(rows, seq):
    last = {}
    for k, s, v, e, t, _ in sorted(rows, key=lambda x: x[1]):
        if s <= seq:
            last[k] = None if t or 0 < e <= NOW else v
    return {k: v for k, v in last.items() if v is not None}


def view(df, seq):
    return {bytes(r["key"]): r["value"] for r in resolve(df, seq, NOW).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_resolve_and_compact_against_model(spark, seed):
    r = random.Random(seed)
    rows = random_log(r, 60)
    log = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for seq in (0, 10, 35, 60):
        assert view(log, seq) == model(rows, seq)
    oldest = 30
    done = compact(log, oldest, NOW, bottom=True).cache()
    for seq in (30, 31, 45, 60):
        assert view(done, seq) == model(rows, seq)
    assert done.count() < len(rows)


def test_as_of_lookup_across_buckets(spark):
    r = random.Random(5)
    rows = [(bytes([r.randrange(3)]), i + 1, str(i), 0, r.random() < 0.2, False) for i in range(200)]
    log = spark.createDataFrame(rows, SCHEMA)
    probes = [(bytes([k]), s) for k in range(4) for s in range(0, 220, 7)]
    got = scan.as_of_lookup(log, spark.createDataFrame(probes, "key binary, read_seq long"), NOW, ["value"], bucket=16)
    found = {(bytes(x["key"]), x["read_seq"]): x["value"] for x in got.collect()}
    assert found == {(k, s): model(rows, s).get(k) for k, s in probes}


def test_neighbours_and_positions(spark):
    keys = sorted({bytes([a, b, c]) for a in (0, 7) for b in (1, 255) for c in range(3)} | {b"", b"\0", b"\xff"})
    d = spark.createDataFrame([(k,) for k in keys], "sort_key binary")
    got = {bytes(r["sort_key"]): (r["prev_key"] and bytes(r["prev_key"]), r["next_key"] and bytes(r["next_key"])) for r in scan.neighbours(d).collect()}
    for i, k in enumerate(keys):
        before, after = (keys[i - 1] if i else None), (keys[i + 1] if i + 1 < len(keys) else None)
        assert (got[k][0] or b"") == (before or b"") and got[k][1] == after
    for down in (False, True):
        rows = positions(d, descending=down).collect()
        assert [bytes(r["sort_key"]) for r in sorted(rows, key=lambda r: r["pos"])] == sorted(keys, reverse=down)


def test_watermark(spark):
    def visible(ranges):
        return transactions.gap_free_watermark(spark.createDataFrame(ranges, "start long, end long"), 0).first()[0]

    assert visible([(1, 5), (6, 6), (7, 10)]) == 10
    assert visible([(1, 5), (7, 10)]) == 5
    assert visible([(2, 5)]) == 0
    assert visible([(200_001, 200_002), (1, 200_000)]) == 200_002


def test_unknown_savepoint_raises(spark):
    ops = spark.createDataFrame([(1, 0, "rollback_to", "x")], "txn long, op_idx long, action string, name string")
    with pytest.raises(Exception, match="unknown savepoint"):
        transactions.replay_savepoints(ops).collect()


def test_sort_keys(spark):
    d = spark.createDataFrame([(bytearray(range(256)),)], "key binary")
    folded = bytes(d.select(sort_key(F.col("key"), "case_insensitive")).first()[0])
    assert folded == bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    with pytest.raises(Exception, match="8 bytes"):
        d.select(sort_key(F.col("key"), "int64")).collect()


def test_formats(spark):
    for n in (0, 1, 127, 128, 300, 1 << 35, (1 << 64) - 1):
        assert formats.read_uvarint(formats.uvarint(n) + b"x") == (n, len(formats.uvarint(n)))
    for n in (0, -1, 1, -64, 64, 1 << 40, -(1 << 63), (1 << 63) - 1):
        assert formats.read_varint(formats.varint(n))[0] == n
    assert formats.read_uvarint(b"\x80") is None and formats.read_uvarint(b"\xff" * 11) is None
    for a, b in ((b"abc", b"abz"), (b"a", b"b"), (b"ab", b"abc"), (b"a\xff", b"c")):
        assert a <= formats.separator(a, b) < b
    d = spark.createDataFrame([(b"k", 5), (b"k", (1 << 62) + 7), (b"", 1)], "key binary, seq long")
    i = d.withColumn("i", formats.internal_key(F.col("key"), F.col("seq")))
    back = i.select("key", "seq", formats.internal_user_key(F.col("i")).alias("k"), formats.internal_seq(F.col("i")).alias("s")).collect()
    assert all(r["key"] == r["k"] and r["seq"] == r["s"] for r in back)
    assert bytes(i.filter("seq = 5").first()["i"]) == b"k" + ((1 << 64) - 1 - 5).to_bytes(8, "big")


def test_stream_keeps_latest(spark, tmp_path):
    from keystrata.streaming.feed import keep_latest, latest_path, operations, read_log

    source, target, cp = (str(tmp_path / x) for x in ("log", "table", "cp"))
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [[(b"a", 3, "new", 0, False, False), (b"b", 1, "x", 0, False, False)], [(b"a", 2, "late", 0, False, False), (b"b", 4, "", 0, True, False)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = keep_latest(read_log(spark, source, schema), target, cp, 2)
        q.awaitTermination()
    table = spark.read.parquet(latest_path(target))
    assert sorted((bytes(r["key"]), r["seq"]) for r in table.collect()) == [(b"a", 3), (b"b", 4)]
    q = operations(read_log(spark, source, schema)).writeStream.format("memory").queryName("ops").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["seq"], r["op"]) for r in spark.table("ops").collect()) == [(1, "put"), (2, "put"), (3, "put"), (4, "delete")]


def test_bloom_and_codecs(spark):
    from keystrata.functions import filters
    from keystrata.model import CorruptionError, InvalidArgsError

    keys = [b"k%d" % i for i in range(500)]
    bloom = filters.Bloom.of_column(spark.createDataFrame([(k,) for k in keys], "key binary"), "key", 500, 0.01)
    assert all(bloom.may_contain(k) for k in keys) and bloom.k == 7
    assert sum(bloom.may_contain(b"x%d" % i) for i in range(2000)) < 60
    with pytest.raises(InvalidArgsError):
        filters.Bloom(10, 1.5)
    data = b"some bytes " * 100
    for codec in ("none", "snappy", "lz4", "lz4fast", "zstd", "flate"):
        packed = filters.compress(codec, data)
        assert filters.decompress(codec, packed, len(data)) == data
        with pytest.raises(CorruptionError):
            filters.decompress(codec, packed[: len(packed) // 2], len(data))
    assert filters.xxhash32(b"", 0) == 0x02CC5D05


def test_sequences_over_ranges_of_batches(spark):
    rows = [(b, "cf", b"k%d" % i, 10 * b + i) for b in (3, 70_000, 200_000) for i in range(3)]
    d = transactions.dedup_batch(spark.createDataFrame(rows, "batch long, cf string, key binary, op_idx long"))
    got = transactions.assign_sequences(d, 11).orderBy("batch", "slot").collect()
    assert [r["seq"] for r in got] == list(range(11, 20)) and [r["commit_seq"] for r in got] == [13] * 3 + [16] * 3 + [19] * 3


def test_order_of_keys_with_a_common_prefix(spark):
    """Keys that start alike are dealt to several ranges, and their places are right."""
    from keystrata.operators.resolve import positions, ranges
    from keystrata.operators.scan import neighbours

    keys = [b"user:%012d" % (i * 7919 % 5000) for i in range(5000)]
    d = spark.createDataFrame([(k,) for k in keys], "sort_key binary").repartition(3)
    assert ranges(d, "sort_key").select("_range").distinct().count() > 1
    for descending in (False, True):
        found = {bytes(r["sort_key"]): r["pos"] for r in positions(d, descending=descending).collect()}
        assert found == {k: n + 1 for n, k in enumerate(sorted(keys, reverse=descending))}
    order = sorted(keys)
    near = {bytes(r["sort_key"]): (r["prev_key"], r["next_key"]) for r in neighbours(d).collect()}
    assert all(near[k] == (order[n - 1] if n else None, order[n + 1] if n + 1 < len(order) else None) for n, k in enumerate(order))
