"""The store: commits, isolation, compaction, parts, tiers and recovery."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keystrata.model import (
    ColumnFamilyConfig,
    ConflictError,
    ExistsError,
    InvalidArgsError,
    Isolation,
    LockedError,
    NotFoundError,
    PartitionRule,
    PoisonedError,
    ReadOnlyError,
    StoreOptions,
    TierRule,
)
from keystrata.operators.keys import UNBOUNDED, encode_int64, excluded, included, register_comparator, successor
from keystrata.sources.store import MOVE_PHASES, Store

S = 10**9


class Clock:
    def __init__(self):
        self.now = 1_000 * S

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    s = Store(spark, str(tmp_path / "db"), clock=clock)
    s.create_column_families([("a", ColumnFamilyConfig()), ("b", ColumnFamilyConfig())])
    yield s
    s.close()


def missing(f, *args):
    with pytest.raises(NotFoundError):
        f(*args)


def test_basic_and_reopen(spark, tmp_path, clock):
    path = str(tmp_path / "db")
    with Store(spark, path, clock=clock) as s:
        s.create_column_family("a")
        s.put("a", b"a", b"1")
        s.put("a", b"b", b"2")
        s.put("a", b"empty", b"")
        s.delete("a", b"a")
        missing(s.get, "a", b"a")
        missing(s.get, "a", b"nothing")
        assert s.get("a", b"b") == b"2" and s.get("a", b"empty") == b""
        with pytest.raises(LockedError):
            Store(spark, path)
    with Store(spark, path, StoreOptions(read_only=True)) as s:
        assert s.items("a") == [(b"b", b"2"), (b"empty", b"")]
        with pytest.raises(ReadOnlyError):
            s.put("a", b"x", b"y")


def test_recovery_without_close_and_torn_tail(spark, tmp_path, clock):
    path = str(tmp_path / "db")
    s = Store(spark, path, clock=clock)
    s.create_column_families([("a", ColumnFamilyConfig()), ("b", ColumnFamilyConfig())])
    for i in range(3):
        with s.begin() as t:
            t.put("a", b"k%d" % i, b"v")
            t.put("b", b"k%d" % i, b"v")
    s.lock.release()  # the process is gone without a close
    with open(s.journal.path, "r+b") as f:
        f.truncate(os.path.getsize(s.journal.path) - 5)
    with Store(spark, path, clock=clock) as s:
        assert [k for k, _ in s.items("a")] == [k for k, _ in s.items("b")] == [b"k0", b"k1"]
        assert s.visible == 4


def test_ttl(store, clock):
    store.put("a", b"k", b"v", ttl_ns=50 * S)
    assert store.get("a", b"k") == b"v"
    clock.now += 80 * S
    missing(store.get, "a", b"k")
    with store.begin() as t:
        t.put("a", b"own", b"v", ttl_ns=1)
        clock.now += 2
        missing(t.get, "a", b"own")
        t.rollback()


def test_binary_keys_in_byte_order(store):
    keys = [bytes.fromhex(x) for x in ("", "00", "0000", "00ff", "7f", "8081", "c328", "ff", "ff00", "ffffff")]
    with store.begin() as t:
        for k in reversed(keys):
            t.put("a", k, b"v" + k)
    store.flush("a")
    assert store.items("a") == [(k, b"v" + k) for k in keys]
    assert store.items("a", backward=True) == [(k, b"v" + k) for k in reversed(keys)]
    assert successor(b"a\xff\xff") == b"b" and successor(b"\xff\xff") is None and successor(b"") is None


def test_bounds_matrix(store):
    ts = [1777062639, 1777062640, 1777062641]
    keys = [t.to_bytes(8, "big") + b"s" for t in ts]
    with store.begin() as t:
        for i, k in enumerate(keys):
            t.put("a", k, b"%d" % (i + 1))
    lo, hi, past = ((ts[0] + d).to_bytes(8, "big") for d in (0, 2, 3))
    cases = [
        (included(lo), included(hi), "12"),
        (included(lo), included(past), "123"),
        (included(lo), excluded(past), "123"),
        (excluded(lo), UNBOUNDED, "123"),
        (included(keys[0]), included(keys[2]), "123"),
        (excluded(keys[0]), excluded(keys[2]), "2"),
        (excluded(keys[0]), included(keys[2]), "23"),
        (UNBOUNDED, excluded(keys[1]), "1"),
    ]
    for lower, upper, wanted in cases:
        got = "".join(v.decode() for _, v in store.items("a", lower=lower, upper=upper))
        assert got == wanted
        assert "".join(v.decode() for _, v in store.items("a", backward=True, lower=lower, upper=upper)) == wanted[::-1]


def test_comparators(spark, tmp_path, clock):
    with Store(spark, str(tmp_path / "db"), clock=clock) as s:
        for c in ("int64", "reverse", "case_insensitive"):
            s.create_column_family(c, ColumnFamilyConfig(comparator=c))
        for n in (3, -1, 0, 2, -3, 1, -2):
            s.put("int64", encode_int64(n), b"v")
        s.flush("int64")
        s.put("int64", encode_int64(4), b"v")
        assert [int.from_bytes(k, "big", signed=True) for k, _ in s.items("int64")] == [-3, -2, -1, 0, 1, 2, 3, 4]
        got = s.items("int64", lower=included(encode_int64(-1)), upper=excluded(encode_int64(2)))
        assert [int.from_bytes(k, "big", signed=True) for k, _ in got] == [-1, 0, 1]
        with pytest.raises(InvalidArgsError):
            s.put("int64", b"short", b"v")
        for k in (b"a", b"ab", b"b"):
            s.put("reverse", k, k)
        assert [k for k, _ in s.items("reverse")] == [b"b", b"ab", b"a"]
        assert [k for k, _ in s.items("reverse", lower=included(b"ab"))] == [b"ab", b"a"]
        s.put("case_insensitive", b"Hello", b"1")
        s.put("case_insensitive", b"hello", b"2")
        s.put("case_insensitive", b"abd", b"3")
        assert [v for _, v in s.items("case_insensitive")] == [b"3", b"2"]
        with pytest.raises(InvalidArgsError):
            s.create_column_family("x", ColumnFamilyConfig(comparator="nope"))


def test_isolation_levels(store):
    store.put("a", b"k", b"0")
    # First committer wins at Snapshot.
    t1 = store.begin()
    t1.put("a", b"k", b"1")
    store.put("a", b"k", b"2")
    with pytest.raises(ConflictError):
        t1.commit()
    with pytest.raises(InvalidArgsError):
        t1.put("a", b"k", b"3")
    t1.rollback()
    assert store.get("a", b"k") == b"2"
    # RepeatableRead allows the lost update, and reads its snapshot.
    t = store.begin(Isolation.REPEATABLE_READ)
    store.put("a", b"k", b"4")
    assert t.get("a", b"k") == b"2"
    t.put("a", b"k", b"5")
    t.commit()
    assert store.get("a", b"k") == b"5"
    # ReadCommitted floats.
    t = store.begin(Isolation.READ_COMMITTED)
    store.put("a", b"k", b"6")
    assert t.get("a", b"k") == b"6"
    t.rollback()
    # Write skew commits at Snapshot, not at Serializable.
    for level, fails in ((Isolation.SNAPSHOT, False), (Isolation.SERIALIZABLE, True)):
        store.put("a", b"x", b"35")
        store.put("a", b"y", b"35")
        t1, t2 = store.begin(level), store.begin(level)
        for t in (t1, t2):
            t.get("a", b"x"), t.get("a", b"y")
        t1.put("a", b"x", b"5")
        t2.put("a", b"y", b"5")
        t1.commit()
        if fails:
            with pytest.raises(ConflictError):
                t2.commit()
        else:
            t2.commit()
    # Serializable checks point reads of other families too.
    store.put("a", b"r", b"1")
    t = store.begin(Isolation.SERIALIZABLE)
    t.get("a", b"r")
    t.put("b", b"w", b"1")
    store.put("a", b"r", b"2")
    with pytest.raises(ConflictError):
        t.commit()


def test_savepoints_dedup_and_sequences(store):
    t = store.begin()
    t.put("a", b"a", b"1")
    t.set_savepoint("s")
    t.put("a", b"b", b"2")
    t.rollback_to_savepoint("s")
    t.put("a", b"c", b"3")
    t.rollback_to_savepoint("s")
    with pytest.raises(InvalidArgsError):
        t.rollback_to_savepoint("other")
    t.release_savepoint("s")
    with pytest.raises(InvalidArgsError):
        t.release_savepoint("s")
    t.put("a", b"a", b"abc")
    t.put("a", b"z", b"z")
    t.put("a", b"a", b"ghi")
    before = store.visible
    assert t.commit() == before + 2
    assert store.items("a") == [(b"a", b"ghi"), (b"z", b"z")]
    assert store.begin().commit() is None and store.visible == before + 2


def test_read_own_writes_overlay(store):
    store.put("a", b"k", b"committed")
    t = store.begin()
    assert t.items("a") == [(b"k", b"committed")]
    t.put("a", b"k", b"mine")
    assert t.items("a") == [(b"k", b"mine")]  # also where the committed version has the snapshot's own sequence
    t.delete("a", b"k")
    t.put("a", b"n", b"1")
    store.put("a", b"outside", b"x")
    assert t.items("a") == [(b"n", b"1")] and t.items("a", lower=excluded(b"n")) == []
    missing(t.get, "a", b"k")
    t.rollback()
    t.reset(Isolation.READ_COMMITTED)
    assert [k for k, _ in t.items("a")] == [b"k", b"outside"]
    t.rollback()


def test_compaction_keeps_what_snapshots_see(store, clock):
    store.put("a", b"K", b"v0")
    snap = store.pin()
    for i in range(1, 4):
        store.put("a", b"K", b"v%d" % i)
        store.compact("a")
        assert store.get("a", b"K", snap) == b"v0" and store.get("a", b"K") == b"v%d" % i
    store.unpin(snap)
    store.compact("a")
    assert store.stats("a")["entries"] == 1
    store.delete("a", b"K")
    store.compact("a")
    stats = store.stats("a")
    assert stats["entries"] == stats["tombstones"] == stats["approx_len"] == 0
    # An expired version above a live snapshot stays, lest the older value reappear.
    store.put("a", b"k", b"v1")
    snap = store.pin()
    store.put("a", b"k", b"v2", ttl_ns=1)
    clock.now += 10
    store.compact("a")
    missing(store.get, "a", b"k")
    assert store.get("a", b"k", snap) == b"v1"
    store.unpin(snap)


def test_compaction_filter(store):
    with store.begin() as t:
        for i in range(10):
            t.put("a", b"k%03d" % i, b"keep" if i % 2 else b"purge")
    snap = store.pin()
    store.put("a", b"k000", b"purge")
    store.set_compaction_filter("a", F.col("value") == F.lit(b"purge"))
    store.compact("a")
    missing(store.get, "a", b"k002")
    assert store.get("a", b"k001") == b"keep" and store.get("a", b"k000") == b"purge"
    store.unpin(snap)
    store.compact("a")
    missing(store.get, "a", b"k000")


def test_fifo(spark, tmp_path, clock):
    with Store(spark, str(tmp_path / "db"), clock=clock) as s:
        s.create_column_family("f", ColumnFamilyConfig(compaction_style="fifo", fifo_max_bytes=4096))
        s.create_column_family("t", ColumnFamilyConfig(compaction_style="fifo", fifo_ttl_ns=400))
        for g in range(4):
            with s.begin() as t:
                for i in range(20):
                    t.put("f", b"g%d-k%02d" % (g, i), b"x" * 60)
            s.flush("f")
        s.compact("f")
        assert not s.contains("f", b"g0-k00") and s.contains("f", b"g3-k00")
        s.put("t", b"old", b"1")
        s.flush("t")
        clock.now += 600
        s.put("t", b"new", b"1")
        s.compact("t")
        assert [k for k, _ in s.items("t")] == [b"new"]


def test_ingestion(spark, store):
    store.put("a", b"k00500", b"old")
    store.put("a", b"pre", b"kept")
    rows = spark.range(1000).select(F.encode(F.format_string("k%05d", "id"), "UTF-8").alias("key"), F.encode(F.lit("v"), "UTF-8").alias("value"))
    before = store.visible
    assert store.ingest("a", rows) == 1000 and store.visible == before + 1
    assert store.scan("a").count() == 1001 and store.get("a", b"k00500") == b"v"
    with pytest.raises(InvalidArgsError):
        store.ingest("a", rows.unionByName(rows.limit(1)))
    gone = spark.createDataFrame([(b"pre", None, True)], "key binary, value binary, tombstone boolean")
    store.ingest("a", gone)
    missing(store.get, "a", b"pre")


def test_parts(spark, tmp_path, clock):
    rules = (PartitionRule(b"img/", "img"), PartitionRule(b"log/", "log"))
    tiers = (TierRule(b"img/", "hdd", 0), TierRule(b"log/", "hdd", 3600 * S))
    with Store(spark, str(tmp_path / "db"), StoreOptions(tiers={"hdd": str(tmp_path / "hdd")}), clock=clock) as s:
        s.create_column_family("p", ColumnFamilyConfig(partition_rules=rules, tier_rules=tiers))
        with s.begin() as t:
            for p in ("img", "log", "etc"):
                for i in range(5):
                    t.put("p", f"{p}/{i:03}".encode(), p.upper().encode())
        s.compact("p")
        assert sorted(str(m.partition) for m in s.family("p").files) == ["None", "img", "log"]
        assert [r["partition"] for r in s.list_partitions("p").orderBy("partition").collect()] == ["img", "log"]
        snap = s.pin()
        before = s.scan("p")
        folder = s.detach_part("p", "img")
        assert not s.contains("p", b"img/001") and before.count() == 15  # built before the part went
        s.unpin(snap)
        missing(s.detach_part, "p", "img")
        s.attach_part("p", folder)
        assert s.get("p", b"img/001") == b"IMG" and s.scan("p").count() == 15
        clock.now += S
        assert s.run_part_mover() == 1 and s.run_part_mover() == 0
        assert s.get("p", b"img/001") == b"IMG"
        seen = []
        assert s.move_part("p", "img", "ssd", lambda phase, n: seen.append(phase)) == 1
        assert tuple(dict.fromkeys(seen)) == MOVE_PHASES

        def fail(phase, n):
            raise RuntimeError(phase)

        with pytest.raises(RuntimeError):
            s.move_part("p", "img", "hdd", fail)
        assert s.get("p", b"img/001") == b"IMG" and s.move_part("p", "img", "ssd") == 0
        with pytest.raises(InvalidArgsError):
            s.move_part("p", "img", "nope")
        s.freeze_part("p", "log", str(tmp_path / "frozen"))
        s.add_partition_rule("p", b"etc/", "etc")
        with pytest.raises(InvalidArgsError):
            s.add_partition_rule("p", b"etc/", "again")
        missing(s.remove_partition_rule, "p", b"none")
        s.compact("p")
        assert sorted(str(m.partition) for m in s.family("p").files) == ["etc", "img", "log"]
    with Store(spark, str(tmp_path / "frozen")) as s:
        assert [v for _, v in s.items("p")] == [b"LOG"] * 5
    with Store(spark, str(tmp_path / "fresh")) as s:
        s.create_column_family("p")
        with pytest.raises(InvalidArgsError):
            s.attach_part("p", str(tmp_path / "frozen"))
        assert not s.family("p").files


def test_derived_partitions(spark, tmp_path):
    def key(name, bucket, i):
        return name + b"\0\0" + bucket.to_bytes(8, "big") + b"%d" % i

    with Store(spark, str(tmp_path / "db")) as s:
        with pytest.raises(InvalidArgsError):
            s.create_column_family("x", ColumnFamilyConfig(partition_scheme="unknown"))
        s.create_column_family("d", ColumnFamilyConfig(partition_scheme="tenant-bucket"))
        with s.begin() as t:
            for n in (b"alpha", b"beta", b"gamma"):
                for bucket in (1, 2):
                    for i in range(4):
                        t.put("d", key(n, bucket, i), b"v")
        s.compact("d")
        assert sorted(m.partition for m in s.family("d").files) == ["alpha-1", "alpha-2", "beta-1", "beta-2", "gamma-1", "gamma-2"]
    from keystrata.operators import partitions

    scheme = partitions.SCHEMES.pop("tenant-bucket")
    try:
        with pytest.raises(InvalidArgsError):
            Store(spark, str(tmp_path / "db"))
    finally:
        partitions.register_scheme("tenant-bucket", scheme)


def test_families_clone_clear_checkpoint(spark, tmp_path, store):
    store.put("a", b"k", b"1")
    store.clone_column_family("a", "c")
    store.put("a", b"k", b"2")
    assert store.get("c", b"k") == b"1"
    with pytest.raises(ExistsError):
        store.create_column_families([("new", ColumnFamilyConfig()), ("a", ColumnFamilyConfig())])
    assert sorted(store.list_column_families()) == ["a", "b", "c"]
    store.checkpoint(str(tmp_path / "cp"))
    store.backup(str(tmp_path / "bk"))
    store.clear_column_family("a")
    assert store.items("a") == []
    store.drop_column_family("c")
    missing(store.get, "c", b"k")
    for copy in ("cp", "bk"):
        with Store(spark, str(tmp_path / copy)) as s:
            assert s.get("a", b"k") == b"2" and s.get("c", b"k") == b"1"
    with pytest.raises(InvalidArgsError):
        store.create_column_family("bad/name")


def test_hooks_and_poison(store):
    seen = []
    store.set_commit_hook("a", lambda seq, ops: seen.append((seq, [(o.key, o.tombstone) for o in ops])))
    with store.begin() as t:
        t.put("a", b"x", b"1")
        t.put("b", b"y", b"1")
        t.delete("a", b"z")
    assert seen == [(store.visible, [(b"x", False), (b"z", True)])]
    path, store.journal.path = store.journal.path, "/nonexistent/journal"
    with pytest.raises(Exception, match="journal"):
        store.put("a", b"q", b"1")
    store.journal.path = path
    with pytest.raises(PoisonedError):
        store.put("a", b"q", b"1")
    assert store.get("a", b"x") == b"1" and store.poisoned


def test_config_validation():
    with pytest.raises(InvalidArgsError):
        ColumnFamilyConfig(partition_rules=(PartitionRule(b"a", "x"), PartitionRule(b"a", "y"))).validate()
    with pytest.raises(InvalidArgsError):
        ColumnFamilyConfig(partition_rules=(PartitionRule(b"a", ".."),)).validate()
    with pytest.raises(InvalidArgsError):
        ColumnFamilyConfig(compression=("brotli",)).validate()
    c = ColumnFamilyConfig(compression=("lz4", "zstd"), prefix_compression=((b"a", "lz4"), (b"az", "zstd"))).validate()
    assert [c.codec_for(i) for i in range(3)] == ["lz4", "zstd", "zstd"]
    assert c.codec_for(0, b"azx") == "zstd" and c.codec_for(1, b"ab") == "lz4"


def test_cursor_switches_direction(store):
    for k in (b"a", b"b", b"c", b"d", b"e"):
        store.put("a", k, k * 2)
    store.flush("a")
    store.put("a", b"bb", b"x")
    for page in (256, 2):
        c = store.cursor("a", page=page).seek_to_first()
        seen = [c.key]
        for step in ("next", "next", "prev", "next", "next", "next", "next"):
            seen.append(getattr(c, step)().key)
        assert seen == [b"a", b"b", b"bb", b"b", b"bb", b"c", b"d", b"e"]
        assert not c.next().valid
        assert c.seek(b"c").key == b"c" and c.next().key == b"d" and c.prev().key == b"c" and c.value == b"cc"
        assert c.seek_for_prev(b"bz").key == b"bb" and c.seek_to_last().key == b"e" and not c.seek(b"zz").valid
    c = store.cursor("a", lower=excluded(b"a"), upper=included(b"c"))
    assert c.seek(b"a").key == b"b" and c.seek_for_prev(b"z").key == b"c" and not c.next().valid
    with pytest.raises(InvalidArgsError):
        c.key  # noqa: B018


def test_leveled_steps(spark, tmp_path, clock):
    with Store(spark, str(tmp_path / "db"), clock=clock) as s:
        s.create_column_family("l", ColumnFamilyConfig(num_levels=3, l1_file_count_trigger=2, write_buffer_size=40, level_size_ratio=2))
        s.put("l", b"a", b"1")
        s.flush("l")
        assert s.compact_once("l") is None
        s.delete("l", b"a")
        s.flush("l")
        assert s.compact_once("l") == 0
        assert [m.level for m in s.family("l").files] == [1] and s.stats("l")["tombstones"] == 1
        with s.begin() as t:
            for i in range(20):
                t.put("l", b"k%02d" % i, b"v" * 10)
        s.flush("l")
        s.put("l", b"z", b"1")
        s.flush("l")
        assert s.compact_once("l") == 0 and s.compact_once("l") == 1
        assert {m.level for m in s.family("l").files} == {2} and s.stats("l")["tombstones"] == 0
        assert s.scan("l").count() == 21


def test_data_source(spark, store):
    from keystrata.sources.datasource import register

    register(spark)
    for i in range(4):
        store.put("a", b"k%d" % i, b"v")
        store.flush("a")
    store.delete("a", b"k1")
    store.flush("a")
    d = spark.read.format("keystrata").option("family", "a").load(store.root)
    assert d.count() == 5 and d.filter("tombstone").count() == 1
    d = spark.read.format("keystrata").option("family", "a").option("lower", b"k2".hex()).load(store.root)
    assert sorted(bytes(r["key"]) for r in d.collect()) == [b"k2", b"k3"]


def test_keys_that_share_prefixes(store):
    """Keys of all lengths around eight bytes, with zero bytes and extensions, half of them in files; asked beside keys that aren't there."""
    stems = (b"\0", b"z", b"user:")
    keys = sorted({(stem * 9)[:n] + tail for stem in stems for n in range(0, 18, 3) for tail in (b"", b"\0", b"\0q")})
    kept, absent_ = keys[::2] + keys[1::4], keys[3::4]
    for files in (True, False):
        with store.begin() as t:
            for n, k in enumerate(kept):
                if (len(k) % 2 == 0) == files:
                    t.put("a", k, b"<%d>" % n)
        if files:
            store.flush("a")
    model = {k: b"<%d>" % n for n, k in enumerate(kept)}
    assert store.items("a") == sorted(model.items())
    asked = store.spark.createDataFrame([(k,) for k in keys], "key binary")
    from keystrata.operators.scan import missing as absent
    from keystrata.operators.scan import prefixed

    assert sorted(bytes(r[0]) for r in absent(asked, store.scan("a")).collect()) == sorted(absent_)
    for prefix in (b"zzz", b"user:user", b"\0\0"):
        assert sorted(bytes(r["key"]) for r in prefixed(store.scan("a"), prefix).collect()) == sorted(k for k in model if k.startswith(prefix))


def test_sequences_follow_the_order_of_writes_over_families(store):
    at = store.visible
    with store.begin() as t:
        for name, k in (("a", b"1"), ("b", b"2"), ("a", b"3"), ("b", b"2"), ("b", b"4"), ("a", b"1")):
            t.put(name, k, k + name.encode())
    seqs = {(n, bytes(r["key"])): r["seq"] - at for n in "ab" for r in store.log(n).collect()}
    assert seqs == {("a", b"1"): 1, ("b", b"2"): 2, ("a", b"3"): 3, ("b", b"4"): 4} and store.visible == at + 4


def test_ingestion_writer(store, monkeypatch):
    from keystrata.sources import ingest

    monkeypatch.setattr(ingest, "LEAST_ROLL", 600)
    store.put("a", b"k005", b"old")
    store.put("a", b"gone", b"old")
    with store.start_ingestion("a") as w:
        for i in range(50):
            w.write(b"x%03d" % i, b"never")
    assert dict(store.items("a")) == {b"k005": b"old", b"gone": b"old"}
    w = store.start_ingestion("a")
    w.write_tombstone(b"gone")
    for i in range(100):
        w.write(b"k%03d" % i, b"v%d" % i)
    for bad in (b"k050", b"k099", None):
        with pytest.raises(InvalidArgsError):
            w.write(bad, b"")
    store.put("b", b"between", b"1")
    assert w.finish() == 101
    assert dict(store.items("a")) == {b"k%03d" % i: b"v%d" % i for i in range(100)}
    with pytest.raises(InvalidArgsError):
        w.write(b"z", b"")
    with pytest.raises(InvalidArgsError):
        store.ingest("a", store.spark.createDataFrame([(None, b"v")], "key binary, value binary"))
    assert len({r["seq"] for r in store.log("a").filter("key >= 'k0' and seq > 2").collect()}) == 1


def test_large_values_and_tombstone_runs(store):
    values = {b"v%d" % n: bytes(range(256)) * (n // 256) + b"\xfe" * (n % 256) for n in (65535, 65536, 65537)}
    with store.begin() as t:
        for k, v in values.items():
            t.put("a", k, v)
        for i in range(200):
            t.put("b", b"k%05d" % i, b"v")
    store.flush("a")
    assert dict(store.items("a")) == values
    meta = store.family("a").files[0]
    assert meta.vlog_size == sum(map(len, values.values())) and meta.klog_size == sum(map(len, values))
    with store.begin() as t:
        for i in range(1, 199):
            t.delete("b", b"k%05d" % i)
    c = store.cursor("b").seek_to_last()
    assert c.key == b"k00199" and c.prev().key == b"k00000" and not c.prev().valid


def test_anomalies(store):
    for k, v in ((b"k1", b"10"), (b"k2", b"20")):
        store.put("a", k, v)
    # Dirty write cycle: one writer's values stand.
    t1, t2 = store.begin(), store.begin()
    for t, v in ((t1, b"11"), (t2, b"12")):
        t.put("a", b"k1", v)
        t.put("a", b"k2", v)
    t1.commit()
    with pytest.raises(ConflictError):
        t2.commit()
    assert [v for _, v in store.items("a")] == [b"11", b"11"]
    # Read skew: a snapshot sees neither of another's writes.
    reader = store.begin()
    assert reader.get("a", b"k1") == b"11"
    with store.begin() as w:
        w.put("a", b"k1", b"12")
        w.put("a", b"k2", b"18")
    assert reader.get("a", b"k2") == b"11"
    reader.rollback()
    # Lost update.
    t1, t2 = store.begin(), store.begin()
    for t in (t1, t2):
        t.get("a", b"k1")
        t.put("a", b"k1", b"13")
    t1.commit()
    with pytest.raises(ConflictError):
        t2.commit()
    with pytest.raises(InvalidArgsError):
        t2.get("a", b"k1")


def test_compaction_rolls_files(spark, tmp_path):
    config = ColumnFamilyConfig(write_buffer_size=20_000, partition_rules=(PartitionRule(b"k00003", "third"),))
    with Store(spark, str(tmp_path / "db")) as s:
        s.create_column_family("c", config)
        rows = spark.range(20_000).selectExpr("encode(concat('k', lpad(id, 9, '0')), 'UTF-8') AS key", "encode(string(id), 'UTF-8') AS value")
        assert s.ingest("c", rows) == 20_000
        s.compact("c")
        files = s.family("c").files
        total = sum(m.klog_size + m.vlog_size for m in files)
        assert len(files) >= total // 20_000 and sum(m.num_entries for m in files) == 20_000
        assert max(m.klog_size + m.vlog_size for m in files) < 3 * 20_000
        ordered = sorted(files, key=lambda m: m.min_key)
        assert all(a.max_key < b.min_key for a, b in zip(ordered, ordered[1:]))
        for m in files:
            assert (m.partition == "third") == m.min_key.startswith(b"k00003") == m.max_key.startswith(b"k00003")
        assert s.scan("c").count() == 20_000 and s.get("c", b"k000012345") == b"12345"
        assert len(s.log("c", included(b"k000012345"), included(b"k000012345")).inputFiles()) == 1
        assert not [n for n in os.listdir(tmp_path / "db" / "data") if n.endswith(".staging")]


def test_codecs_by_prefix(spark, tmp_path):
    """Files begin anew where the codec changes; the longest prefix wins; a rule of bytes 255 has no end."""
    rules = ((b"b", "none"), (b"bb", "snappy"), (b"\xff", "snappy"))
    keys = [b"a", b"az", b"b", b"ba", b"bb", b"bbz", b"bc", b"c", b"\xfe", b"\xff", b"\xff\xff"]
    wanted = {b"a": "ZSTD", b"b": "UNCOMPRESSED", b"bb": "SNAPPY", b"bc": "UNCOMPRESSED", b"c": "ZSTD", b"\xff": "SNAPPY"}
    with Store(spark, str(tmp_path / "db")) as s:
        s.create_column_family("c", ColumnFamilyConfig(prefix_compression=rules))
        for compacted in (False, True):
            with s.begin() as t:
                for k in keys:
                    t.put("c", k, b"v" * 100)
            s.flush("c")
            if compacted:
                s.compact("c")
            got = {}
            for m in s.family("c").files:
                (name,) = [n for n in os.listdir(m.path) if n.endswith(".parquet")]
                got[m.min_key] = pq.ParquetFile(os.path.join(m.path, name)).metadata.row_group(0).column(0).compression
            assert got == wanted
            assert [k for k, _ in s.items("c")] == keys


def test_unfinished_writes_go_on_open(spark, tmp_path):
    root = str(tmp_path / "db")
    Store(spark, root).close()
    os.makedirs(os.path.join(root, "data", "77.staging", "cut_part=none"))
    with Store(spark, root):
        assert "77.staging" not in os.listdir(os.path.join(root, "data"))


def test_custom_comparator(spark, tmp_path):
    """A caller's order: by length, then by bytes; blanks at the end don't count, so such keys are one key."""
    encode = lambda k: F.encode(F.concat(F.lpad(F.length(F.rtrim(F.decode(k, "UTF-8"))).cast("string"), 6, "0"), F.rtrim(F.decode(k, "UTF-8"))), "UTF-8")
    register_comparator("by_length", encode, lambda k: b"%06d" % len(k.rstrip(b" ")) + k.rstrip(b" "))
    with pytest.raises(InvalidArgsError):
        register_comparator("memcmp", encode, bytes)
    config = ColumnFamilyConfig(comparator="by_length", num_levels=3, l1_file_count_trigger=1, write_buffer_size=64)
    with Store(spark, str(tmp_path / "db")) as s:
        s.create_column_family("c", config)
        with s.begin() as t:
            for k in (b"zz", b"b", b"aaa", b"a", b"ab"):
                t.put("c", k, b"1")
        s.flush("c")
        while s.compact_once("c") is not None:
            pass
        assert [k for k, _ in s.items("c")] == [b"a", b"b", b"ab", b"zz", b"aaa"]
        s.delete("c", b"zz ")
        s.put("c", b"a  ", b"2")
        s.flush("c")
        while s.compact_once("c") is not None:
            pass
        assert [(k.rstrip(), v) for k, v in s.items("c")] == [(b"a", b"2"), (b"b", b"1"), (b"ab", b"1"), (b"aaa", b"1")]
        assert [k for k, _ in s.items("c", lower=included(b"b"), upper=excluded(b"aaa"))] == [b"b", b"ab"]
        assert s.get("c", b"a") == b"2"
    with Store(spark, str(tmp_path / "db")) as s:
        assert len(s.items("c")) == 4


def test_no_task_grows_with_the_rows(spark, tmp_path, monkeypatch):
    """What one task of a load or a compaction sorts is bounded: tasks follow the rows, and no aggregate sorts or hashes keys."""
    from keystrata.sources import ingest

    plans, rows = [], spark.range(4000).select(F.format_string("%05d", F.col("id") * 7919 % 4000).cast("binary").alias("key"), F.lit(b"v").alias("value"))
    kind = type(rows)
    for name in ("collect", "count"):
        run = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, run=run: (plans.append(self._jdf.queryExecution().executedPlan().toString()), run(self))[1])
    monkeypatch.setattr(ingest, "TASK_BYTES", 1 << 15)
    with Store(spark, str(tmp_path / "db")) as s:
        s.create_column_family("d")
        s.ingest("d", rows)
        made = list(s.family("d").files)
        assert len(made) > 4 and max(m.num_entries for m in made) < 1000
        s.ingest("d", rows.limit(10).withColumn("tombstone", F.lit(True)))
        assert s._dealt("d", s.family("d").files).rdd.getNumPartitions() > 4
        s.compact("d")
        left = s.family("d").files
        with pytest.raises(InvalidArgsError):
            s.ingest("d", rows.unionByName(rows.limit(1)))
        found = {bytes(r[0]) for r in s.log("d").select("key").collect()}
        for files in (made, left):
            assert all(a.max_key < b.min_key for a, b in zip(files, files[1:]))
        for m in left:
            own = [bytes(r[0]) for r in spark.read.parquet(m.path).select("key").collect()]
            assert (m.num_entries, m.min_key, m.max_key) == (len(own), min(own), max(own))
    assert sum(m.num_entries for m in left) == len(found) == 3990
    assert plans and not any("SortAggregate" in p or "keys=[key" in p for p in plans)
