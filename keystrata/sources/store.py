"""A persistent store of column families: commits, snapshots, files, compaction, parts and tiers.

The driver holds the manifest and the commits that are not in files yet; data files are Parquet, written and read by
executors. Every read is a DataFrame over the files whose key range may match, and the pending commits. A commit is one
journal line for all families, so it is atomic across them, also after a crash.
"""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.model import (
    CATALOG_SCHEMA,
    DEFAULT_TIER,
    LOG_SCHEMA,
    NAME,
    ColumnFamilyConfig,
    ExistsError,
    InvalidArgsError,
    IoError,
    Isolation,
    NotFoundError,
    PartitionRule,
    PoisonedError,
    ReadOnlyError,
    StoreOptions,
    with_rule,
    without_rule,
)
from keystrata.operators import compaction, partitions, scan, statistics
from keystrata.operators.keys import UNBOUNDED, Bound, host_sort_key, is_descending, merges_keys, sort_key, successor
from keystrata.operators.resolve import resolve
from keystrata.sources.ingest import Ingestion, sorted_run, task_count
from keystrata.sources.manifest import Family, FileMeta, Journal, Lock, Manifest, b64, unb64, sync_folder

#: Files that are being written stand in folders of this ending; what a crash leaves of them goes when the store opens.
STAGING = ".staging"
LOG_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA)
MOVE_PHASES = ("copy_complete", "destination_synced", "manifest_flipped", "source_delete_finished")


@dataclass(frozen=True)
class Op:
    """One committed write, as hooks see it."""

    key: bytes
    value: bytes
    tombstone: bool
    expires_at_ns: int = 0
    single_delete: bool = False


class Store:
    """Open with ``Store(spark, path)``; close it, or use it as a context manager."""

    def __init__(self, spark: SparkSession, root: str, options: StoreOptions | None = None, clock: Callable[[], int] = time.time_ns):
        self.spark, self.root, self.options, self.clock = spark, os.path.abspath(root), options or StoreOptions(), clock
        os.makedirs(self.root, exist_ok=True)
        self.lock = Lock(self.root, self.options.read_only)
        try:
            self.manifest = Manifest.load(self.root)
            for name, family in self.manifest.families.items():
                scheme = family.config.partition_scheme
                if scheme and scheme not in partitions.SCHEMES:
                    raise InvalidArgsError(f"family {name!r} needs the partition scheme {scheme!r}")
        except BaseException:
            self.lock.release()
            raise
        self.journal = Journal(self.root)
        self.pending: dict[str, list[tuple]] = {n: [] for n in self.manifest.families}
        self.visible = self.manifest.global_seq
        self.snapshots: dict[int, int] = {}
        self.hooks: dict[str, Callable[[int, list[Op]], None]] = {}
        self.filters: dict[str, object] = {}
        self.garbage: list[str] = []
        self.counters = {"flushes": 0, "compactions": 0, "manifest_saves": 0, "reads": 0}
        self._poison: str | None = None
        self.closed = False
        for record in self.journal.replay():
            for name, rows in record["ops"].items():
                family = self.manifest.families.get(name)
                if family and family.id == record["ids"][name]:
                    self.pending[name] += [(unb64(k), s, unb64(v), e, t, d) for k, s, v, e, t, d in rows]
            self.visible = max(self.visible, record["seq"])
        if not self.options.read_only:
            self._sweep()

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # State

    def _writable(self) -> None:
        if self.options.read_only:
            raise ReadOnlyError("the store is open for reading")
        if self._poison:
            raise PoisonedError(self._poison)
        if self.closed:
            raise InvalidArgsError("the store is closed")

    @property
    def poisoned(self) -> str | None:
        """Why later writes are refused: the first failure to make something durable."""
        return self._poison

    def _save(self) -> None:
        try:
            self.manifest.global_seq = max(self.manifest.global_seq, self.visible)
            self.manifest.save(self.root)
            self.counters["manifest_saves"] += 1
        except OSError as e:
            self._poison = f"the manifest could not be replaced: {e}"
            raise IoError(self._poison) from e

    def close(self) -> None:
        if self.closed:
            return
        if not self.options.read_only and not self._poison:
            for name in list(self.manifest.families):
                self.flush(name)
            self._save()
        self._collect_garbage(force=True)
        self.closed = True
        self.lock.release()

    def sync_wal(self) -> None:
        self._writable()
        self.journal.sync()

    @property
    def wal_sync_count(self) -> int:
        return self.journal.syncs

    # Families

    def create_column_family(self, name: str, config: ColumnFamilyConfig | None = None) -> None:
        self.create_column_families([(name, config or ColumnFamilyConfig())])

    def create_column_families(self, wanted: Iterable[tuple[str, ColumnFamilyConfig]]) -> None:
        """All or none, with one manifest replacement; an empty list does nothing."""
        self._writable()
        wanted = list(wanted)
        names = [n for n, _ in wanted]
        for name, config in wanted:
            if not NAME.match(name) or name in (".", ".."):
                raise InvalidArgsError(f"bad family name {name!r}")
            if name in self.manifest.families or names.count(name) > 1:
                raise ExistsError(f"family {name!r} exists")
            config.validate()
            if config.partition_scheme and config.partition_scheme not in partitions.SCHEMES:
                raise InvalidArgsError(f"unknown partition scheme {config.partition_scheme!r}")
        if not wanted:
            return
        for name, config in wanted:
            self.manifest.families[name] = Family(self.manifest.next_family_id, config)
            self.manifest.next_family_id += 1
            self.pending[name] = []
        self._save()

    def list_column_families(self) -> list[str]:
        return list(self.manifest.families)

    def family(self, name: str) -> Family:
        if name not in self.manifest.families:
            raise NotFoundError(f"no family {name!r}")
        return self.manifest.families[name]

    def config(self, name: str) -> ColumnFamilyConfig:
        return self.family(name).config

    def drop_column_family(self, name: str) -> None:
        self._writable()
        family = self.family(name)
        del self.manifest.families[name], self.pending[name]
        self._save()
        self._discard(family.files)
        self._trim_journal()

    def clear_column_family(self, name: str) -> None:
        """Empties a family in one manifest replacement, keeping its configuration."""
        self._writable()
        if self.options.unified:
            raise InvalidArgsError("a family of a shared log can't be cleared")
        old = self.family(name)
        self.manifest.families[name] = Family(self.manifest.next_family_id, old.config)
        self.manifest.next_family_id += 1
        self.pending[name] = []
        self._save()
        self._discard(old.files)
        self._trim_journal()

    def clone_column_family(self, source: str, target: str) -> None:
        """A family with the same immutable files under fresh ids; later writes are independent."""
        self._writable()
        old = self.family(source)
        if target in self.manifest.families:
            raise ExistsError(f"family {target!r} exists")
        if not NAME.match(target):
            raise InvalidArgsError(f"bad family name {target!r}")
        self.flush(source)
        files = [replace(m, id=self._new_id()) for m in old.files]
        self.manifest.families[target] = Family(self.manifest.next_family_id, old.config, files)
        self.manifest.next_family_id += 1
        self.pending[target] = []
        self._save()

    def add_partition_rule(self, name: str, prefix: bytes, partition: str) -> None:
        self._writable()
        family = self.family(name)
        family.config = with_rule(family.config, PartitionRule(prefix, partition))
        self._save()

    def remove_partition_rule(self, name: str, prefix: bytes) -> None:
        self._writable()
        family = self.family(name)
        family.config = without_rule(family.config, prefix)
        self._save()

    # Files

    def _new_id(self) -> int:
        self.manifest.next_file_id += 1
        return self.manifest.next_file_id - 1

    def _folder(self, tier: str | None = None) -> str:
        base = self.root if tier in (None, DEFAULT_TIER) else self.options.tiers.get(tier)
        if base is None:
            raise InvalidArgsError(f"unknown tier {tier!r}")
        return os.path.join(base, "data")

    def _discard(self, files: Iterable[FileMeta]) -> None:
        """Deletes files later, when no snapshot is live: DataFrames built before still read them."""
        self.garbage += [m.path for m in files]
        self._collect_garbage()

    def _collect_garbage(self, force: bool = False) -> None:
        if self.snapshots and not force:
            return
        used = {m.path for f in self.manifest.families.values() for m in f.files}
        for path in self.garbage:
            if path not in used:
                shutil.rmtree(path, ignore_errors=True)
        self.garbage = []

    def _sweep(self) -> None:
        """Deletes copies whose tier isn't their home (left by a move that broke off) and unfinished writes; unknown files stay."""
        homes = {m.id: (m.tier or DEFAULT_TIER, m.path) for f in self.manifest.families.values() for m in f.files}
        for tier in (DEFAULT_TIER, *self.options.tiers):
            folder = self._folder(tier)
            for name in os.listdir(folder) if os.path.isdir(folder) else ():
                stem = name.partition(".")[0]
                if stem.isdigit() and name == stem + STAGING:
                    shutil.rmtree(os.path.join(folder, name), ignore_errors=True)
                    continue
                if stem.isdigit() and int(stem) in homes:
                    home, path = homes[int(stem)]
                    if home != tier and os.path.join(folder, name) != path:
                        shutil.rmtree(os.path.join(folder, name), ignore_errors=True)

    def _write(self, name: str, rows: DataFrame, level: int, age: int | None = None) -> list[FileMeta]:
        """Writes rows as files (Parquet directories) sorted by key, in one job and two more for their statistics.

        Every partition of ``rows`` gives a file; a change of the column ``part``, where there is one, and of the codec that
        a key prefix has, begins another. Nothing names the files yet.
        """
        config = self.config(name)
        bounds = sorted({b for p, _ in config.prefix_compression if p for b in (p, successor(p)) if b is not None})
        codecs = [config.codec_for(level, b) for b in (b"", *bounds)]
        segment = sum(((F.col("key") >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
        part = F.concat(F.lit("p"), F.hex(F.encode("part", "UTF-8"))) if "part" in rows.columns else F.lit(None)
        cut = rows.select(*LOG_SCHEMA.names, F.coalesce(part, F.lit("none")).alias("cut_part"), segment.alias("cut_segment"))
        several = len(set(codecs)) > 1
        if several:
            cut = cut.persist()
        folder = os.path.join(self._folder(), f"{self._new_id()}{STAGING}")
        try:
            for codec in sorted(set(codecs)):
                own = cut.filter(F.col("cut_segment").isin([k for k, c in enumerate(codecs) if c == codec])) if several else cut
                writer = own.sortWithinPartitions("cut_part", "cut_segment", "key", F.desc("seq")).write.mode("append").option("compression", codec)
                if config.bloom_filter:
                    writer = writer.option("parquet.bloom.filter.enabled#key", "true")
                writer.partitionBy("cut_part", "cut_segment").parquet(folder)
            if not any(n.startswith("cut_part=") for n in os.listdir(folder)):
                return []
            long = F.length("value") >= config.klog_value_threshold
            size = F.length("key") + F.length("value")
            read = self.spark.read.schema(f"{LOG_DDL}, cut_part string, cut_segment int").parquet(folder).withColumns({"file": F.col("_metadata.file_path"), "place": F.col("_metadata.row_index")})
            made = read.groupBy("file", "cut_part").agg(
                F.count("*").alias("n"),
                F.sum(F.col("tombstone").cast("long")).alias("dead"),
                F.max("seq").alias("top"),
                F.sum(F.when(long, F.length("key")).otherwise(size)).alias("klog"),
                F.sum(F.when(long, F.length("value")).otherwise(0)).alias("vlog"),
            )
            found = made.collect()
            # A file is in key order, so its first and last rows have its bounds: an aggregate of keys would sort all rows.
            last = self.spark.createDataFrame([(r["file"], r["n"] - 1) for r in found], "file string, last long")
            ends = read.select("file", "place", "key").join(F.broadcast(last), "file").filter((F.col("place") == 0) | (F.col("place") == F.col("last")))
            bounds = {(r["file"], r["place"]): bytes(r["key"]) for r in ends.collect()}
            whole = [(*r, bounds[r["file"], 0], bounds[r["file"], r["n"] - 1]) for r in found]
            out = []
            for file, of, n, dead, top, klog, vlog, low, high in sorted(whole, key=lambda r: (r[1], r[-2])):
                source = unquote(urlsplit(file).path)
                file_id = self._new_id()
                path = os.path.join(self._folder(), f"{file_id}.parquet")
                os.makedirs(path)
                os.rename(source, os.path.join(path, os.path.basename(source)))
                named = None if of == "none" else bytes.fromhex(of[1:]).decode()
                out.append(FileMeta(file_id, level, path, n, dead, top, klog, vlog, low, high, named, None, age if age is not None else self.clock()))
            return out
        finally:
            if several:
                cut.unpersist()
            shutil.rmtree(folder, ignore_errors=True)

    def catalog(self, name: str) -> DataFrame:
        """The family's files as a DataFrame (see ``CATALOG_SCHEMA``)."""
        rows = [(m.id, m.level, m.num_entries, m.num_tombstones, m.max_seq, m.klog_size, m.vlog_size, m.min_key, m.max_key, m.partition, m.tier, m.max_entry_time) for m in self.family(name).files]
        return self.spark.createDataFrame(rows, CATALOG_SCHEMA)

    def log(self, name: str, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
        """All versions, of files whose key range may meet the bounds and of pending commits, with ``sort_key``."""
        family = self.family(name)
        plain = family.config.comparator in ("", "memcmp", "lexicographic", "uint64")
        paths = [m.path for m in family.files if not plain or ((lower.key is None or m.max_key >= lower.key) and (upper.key is None or m.min_key <= upper.key))]
        d = self.spark.createDataFrame(self.pending[name], LOG_SCHEMA) if self.pending[name] else None
        if paths:
            files = self.spark.read.schema(LOG_SCHEMA).parquet(*paths)
            d = files if d is None else d.unionByName(files)
        if d is None:
            d = self.spark.createDataFrame([], LOG_SCHEMA)
        d = d.withColumn("sort_key", sort_key(F.col("key"), family.config.comparator))
        if lower.key is not None or upper.key is not None:
            d = scan.ranged(d, lower, upper, family.config.comparator, "sort_key")
        return d

    def _keys(self, name: str) -> tuple[str, ...]:
        """Keys are equal as the comparator sees them."""
        return ("sort_key",) if merges_keys(self.config(name).comparator) else ("key",)

    # Reads

    def scan(self, name: str, read_seq: int | None = None, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, now_ns: int | None = None) -> DataFrame:
        """What is visible at ``read_seq`` (default: now) within bounds."""
        self.counters["reads"] += 1
        seq = self.visible if read_seq is None else read_seq
        return resolve(self.log(name, lower, upper), seq, self.clock() if now_ns is None else now_ns, self._keys(name))

    def items(self, name: str, backward: bool = False, **more) -> list[tuple[bytes, bytes]]:
        """A scan in comparator order, on the driver."""
        down = is_descending(self.config(name).comparator) != backward
        rows = self.scan(name, **more).orderBy(F.col("sort_key").desc() if down else F.col("sort_key").asc()).select("key", "value")
        return [(bytes(r[0]), bytes(r[1])) for r in rows.toLocalIterator()]

    def get(self, name: str, key: bytes, read_seq: int | None = None) -> bytes:
        bound = Bound(key)
        rows = self.scan(name, read_seq, bound, bound).select("value").collect()
        if not rows:
            raise NotFoundError("no such key")
        return bytes(rows[0][0])

    def cursor(self, name: str, read_seq: int | None = None, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, page: int = 256):
        """A cursor over what is visible at ``read_seq`` (default: now) within bounds."""
        from keystrata.sources.cursor import Cursor

        return Cursor(self.scan(name, read_seq, lower, upper), self.config(name).comparator, page)

    def contains(self, name: str, key: bytes) -> bool:
        try:
            self.get(name, key)
        except NotFoundError:
            return False
        return True

    def pin(self) -> int:
        """Registers a snapshot at the visible sequence; ``unpin`` it when done."""
        self.snapshots[self.visible] = self.snapshots.get(self.visible, 0) + 1
        return self.visible

    def unpin(self, seq: int) -> None:
        self.snapshots[seq] -= 1
        if not self.snapshots[seq]:
            del self.snapshots[seq]
        self._collect_garbage()

    @property
    def oldest_snapshot(self) -> int:
        return min(self.snapshots, default=self.visible)

    # Writes

    def begin(self, isolation: Isolation = Isolation.SNAPSHOT):
        from keystrata.sources.transaction import Transaction

        return Transaction(self, isolation)

    def put(self, name: str, key: bytes, value: bytes, ttl_ns: int = 0) -> None:
        with self.begin(Isolation.READ_COMMITTED) as t:
            t.put(name, key, value, ttl_ns)

    def delete(self, name: str, key: bytes) -> None:
        with self.begin(Isolation.READ_COMMITTED) as t:
            t.delete(name, key)

    def set_commit_hook(self, name: str, hook: Callable[[int, list[Op]], None] | None) -> None:
        self.family(name)
        if hook:
            self.hooks[name] = hook
        else:
            self.hooks.pop(name, None)

    def newest_seqs(self, name: str, keys: Iterable[bytes]) -> dict[bytes, int]:
        """The newest committed sequence of each key that has one."""
        comparator = self.config(name).comparator
        wanted = {host_sort_key(k, comparator): k for k in keys}
        out: dict[bytes, int] = {}
        for k, s, *_ in self.pending[name]:
            if (h := host_sort_key(k, comparator)) in wanted:
                out[wanted[h]] = max(out.get(wanted[h], 0), s)
        files = [m.path for m in self.family(name).files if merges_keys(comparator) or any(m.min_key <= k <= m.max_key for k in wanted.values())]
        if files and wanted:
            d = self.spark.read.schema(LOG_SCHEMA).parquet(*files).withColumn("sort_key", sort_key(F.col("key"), comparator))
            asked = self.spark.createDataFrame([(h,) for h in wanted], "sort_key binary")
            for r in d.join(F.broadcast(asked), "sort_key", "left_semi").groupBy("sort_key").agg(F.max("seq").alias("s")).collect():
                k = wanted[bytes(r[0])]
                out[k] = max(out.get(k, 0), r[1])
        return out

    def commit(self, ops: list[tuple[str, Op]]) -> int:
        """Installs one batch of (family, write), numbered in the order given over all families; returns its last sequence."""
        self._writable()
        seq, record, batch = self.visible, {"ops": {}, "ids": {}}, {}
        for name, op in ops:
            if self.family(name).config.comparator == "int64":
                host_sort_key(op.key, "int64")
            seq += 1
            batch.setdefault(name, []).append((op.key, seq, op.value, op.expires_at_ns, op.tombstone, op.single_delete))
        for name, rows in batch.items():
            record["ids"][name] = self.family(name).id
            record["ops"][name] = [(b64(k), s, b64(v), e, t, d) for k, s, v, e, t, d in rows]
        record["seq"] = seq
        try:
            self.journal.append(record, any(self.config(n).sync_mode == "full" for n in batch))
        except OSError as e:
            self._poison = f"the journal could not be written: {e}"
            raise IoError(self._poison) from e
        for name, rows in batch.items():
            self.pending[name] += rows
        self.visible = seq
        for name in batch:
            if hook := self.hooks.get(name):
                hook(seq, [op for n, op in ops if n == name])
        for name in batch:
            if sum(len(r[0]) + len(r[2]) for r in self.pending[name]) >= self.config(name).write_buffer_size:
                self.flush(name)
        return seq

    def _trim_journal(self) -> None:
        """The journal keeps what is still pending."""
        rows = {n: p for n, p in self.pending.items() if p}
        if not rows:
            self.journal.rewrite([])
            return
        ops = {n: [(b64(k), s, b64(v), e, t, d) for k, s, v, e, t, d in p] for n, p in rows.items()}
        self.journal.rewrite([{"seq": self.visible, "ids": {n: self.manifest.families[n].id for n in rows}, "ops": ops}])

    def flush(self, name: str) -> None:
        """Pending commits become a level-0 file with all versions (one for each run of keys of one codec)."""
        self._writable()
        family = self.family(name)
        if not self.pending[name]:
            return
        family.files += self._write(name, self.spark.createDataFrame(self.pending[name], LOG_SCHEMA).coalesce(1), 0)
        self.pending[name] = []
        self.counters["flushes"] += 1
        self._save()
        self._trim_journal()

    # Compaction

    def set_compaction_filter(self, name: str, removes) -> None:
        """A boolean Column over key and value, true where a live version goes; not persisted."""
        self.family(name)
        self.filters[name] = removes

    def _part_column(self, config: ColumnFamilyConfig):
        if config.partition_scheme:
            return partitions.SCHEMES[config.partition_scheme](F.col("key"))
        return partitions.partition_of(F.col("key"), config.partition_rules)

    def compact(self, name: str) -> None:
        """Rewrites all files of a family into its bottom level, cut by partition; FIFO families only evict."""
        self._writable()
        family = self.family(name)
        config = family.config
        self.flush(name)
        now = self.clock()
        self.counters["compactions"] += 1
        if config.compaction_style == "fifo":
            catalog = self.catalog(name)
            gone = {r[0] for r in compaction.fifo_by_age(catalog, config.fifo_ttl_ns, now).select("id").collect()}
            rest = catalog.filter(~F.col("id").isin(list(gone))) if gone else catalog
            gone |= {r[0] for r in compaction.fifo_by_size(rest, config.fifo_max_bytes).select("id").collect()}
            self._replace(family, [m for m in family.files if m.id in gone], [])
            return
        if not family.files:
            return
        old = list(family.files)
        bottom = config.num_levels - 1
        log = self._dealt(name, old)
        kept = compaction.compact(log, self.oldest_snapshot, now, True, removes=self.filters.get(name), keys=self._keys(name))
        kept = kept.withColumn("part", self._part_column(config))
        new = self._rolled(name, kept, bottom, old)
        self._replace(family, old, new)

    def _dealt(self, name: str, old: list[FileMeta]) -> DataFrame:
        """All versions in some files with ``sort_key``, dealt by key to as many tasks as they take: what one task sorts doesn't grow with the data."""
        log = self.spark.read.schema(LOG_SCHEMA).parquet(*(m.path for m in old)).withColumn("sort_key", sort_key(F.col("key"), self.config(name).comparator))
        return log.repartition(task_count(sum(m.num_entries for m in old), sum(m.klog_size + m.vlog_size for m in old)), *self._keys(name))

    def _rolled(self, name: str, kept: DataFrame, level: int, old: list[FileMeta]) -> list[FileMeta]:
        """Writes what a compaction of ``old`` keeps, in ranges of about the write buffer's size (less, if its rows are very short), cut where ``part`` changes."""
        ages = [m.max_entry_time for m in old if m.max_entry_time is not None]
        size = sum(m.klog_size + m.vlog_size for m in old)
        runs = max(1, size // self.config(name).write_buffer_size, task_count(sum(m.num_entries for m in old), size) // 4)
        return self._write(name, kept.repartitionByRange(runs, "part", "key"), level, max(ages, default=None))

    def _replace(self, family: Family, old: list[FileMeta], new: list[FileMeta]) -> None:
        gone = {m.id for m in old}
        family.files = [m for m in family.files if m.id not in gone] + new
        self._save()
        self._discard(old)

    def compact_once(self, name: str) -> int | None:
        """One leveled step, if any level is due: its files and the next level's overlapping ones go one level down.

        Returns the level, or None if none is due. Only the bottom drops deletes and expired versions, and only where
        nothing deeper holds data.
        """
        self._writable()
        family = self.family(name)
        config = family.config
        last = config.num_levels - 1
        catalog = self.catalog(name).cache()
        try:
            level = compaction.pick_level(catalog, config.l1_file_count_trigger, config.write_buffer_size, config.level_size_ratio).first()["level"]
            if level is None or level >= last:
                return None
            ids = {r[0] for r in compaction.overlapping(catalog, level).select("id").collect()}
        finally:
            catalog.unpersist()
        if merges_keys(config.comparator):  # byte ranges don't tell which files share a key
            ids |= {m.id for m in family.files if m.level in (level, level + 1)}
        old = [m for m in family.files if m.id in ids]
        bottom = not any(m.level > level + 1 or (m.level == level + 1 and m.id not in ids and level + 1 < last) for m in family.files)
        log = self._dealt(name, old)
        kept = compaction.compact(log, self.oldest_snapshot, self.clock(), bottom and level + 1 == last, removes=self.filters.get(name), keys=self._keys(name))
        part = self._part_column(config) if level + 1 == last else F.lit(None).cast("string")
        new = self._rolled(name, kept.withColumn("part", part), level + 1, old)
        self.counters["compactions"] += 1
        self._replace(family, old, new)
        return level

    # Ingestion

    def ingest(self, name: str, rows: DataFrame) -> int:
        """Bulk load of (key, value[, tombstone, expires_at_ns]) with one shared sequence; the number of rows.

        Nothing is visible before the manifest names the finished file.
        """
        self._writable()
        if "tombstone" not in rows.columns:
            rows = rows.withColumn("tombstone", F.lit(False))
        if "expires_at_ns" not in rows.columns:
            rows = rows.withColumn("expires_at_ns", F.lit(0).cast("long"))
        rows = rows.withColumn("value", F.coalesce("value", F.lit(b"")))
        nulls, n, size = rows.agg(F.count_if(F.col("key").isNull()), F.count("*"), F.sum(F.length("key") + F.length("value"))).first()
        if nulls:
            raise InvalidArgsError("an ingested key is null")
        self.flush(name)
        seq = self.visible + 1
        tasks = task_count(n, size or 0)
        run = sorted_run(rows, seq, max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions", "8"))), tasks)
        made = self._write(name, run, 0)
        if made:
            self._installed(name, made, seq)
        return sum(m.num_entries for m in made)

    def _installed(self, name: str, files: list[FileMeta], seq: int) -> None:
        """Names finished files of one sequence in the manifest."""
        self.family(name).files += files
        self.visible = seq
        self._save()

    def start_ingestion(self, name: str) -> Ingestion:
        """A writer of rows in strictly ascending key order; see ``Ingestion``."""
        self._writable()
        self.family(name)
        return Ingestion(self, name)

    # Parts and tiers

    def list_partitions(self, name: str) -> DataFrame:
        return partitions.list_partitions(self.catalog(name), self.config(name).num_levels - 1)

    def _part(self, name: str, partition: str) -> list[FileMeta]:
        bottom = self.config(name).num_levels - 1
        found = [m for m in self.family(name).files if m.level == bottom and m.partition == partition]
        if not found:
            raise NotFoundError(f"no part {partition!r}")
        return found

    def detach_part(self, name: str, partition: str) -> str:
        """Takes a part's bottom files out of the family; the folder that now holds them, with a manifest of its own."""
        self._writable()
        found = self._part(name, partition)
        target = os.path.join(self.root, "detached", f"{name}-{partition}-{self._new_id()}")
        self._export(name, found, target)
        self._replace(self.family(name), found, [])
        return target

    def freeze_part(self, name: str, partition: str, target: str) -> None:
        """Copies a part as a store of its own; the family keeps it."""
        self._export(name, self._part(name, partition), target)

    def _export(self, name: str, files: list[FileMeta], target: str) -> None:
        if os.path.exists(os.path.join(target, "MANIFEST.json")):
            raise ExistsError(f"{target} holds a store")
        os.makedirs(os.path.join(target, "data"), exist_ok=True)
        copies = []
        for m in files:
            if not os.path.isdir(m.path):
                raise IoError(f"file {m.id} is missing")
            path = os.path.join(target, "data", os.path.basename(m.path))
            shutil.copytree(m.path, path, dirs_exist_ok=True)
            copies.append(replace(m, path=path, tier=None))
        Manifest(max((m.id for m in copies), default=0) + 1, max((m.max_seq for m in copies), default=0), 2, {name: Family(1, self.config(name), copies)}).save(target)

    def attach_part(self, name: str, source: str) -> None:
        """Takes an exported part's files in, all or none: fresh ids, bottom level unless something overlaps there."""
        self._writable()
        incoming = [m for f in Manifest.load(source).families.values() for m in f.files]
        if not incoming:
            raise NotFoundError("nothing to attach")
        if any(m.max_seq > self.visible for m in incoming):
            raise InvalidArgsError("the part has versions this store hasn't seen")
        family = self.family(name)
        bottom = family.config.num_levels - 1
        low, high = min(m.min_key for m in incoming), max(m.max_key for m in incoming)
        clash = any(m.level == bottom and m.min_key <= high and m.max_key >= low for m in family.files)
        new = []
        for m in incoming:
            number = self._new_id()
            path = os.path.join(self._folder(), f"{number}.parquet")
            shutil.copytree(m.path, path)
            new.append(replace(m, id=number, path=path, level=0 if clash else bottom, tier=None, max_entry_time=self.clock()))
        self._replace(family, [], new)

    def move_part(self, name: str, partition: str, tier: str, observe: Callable[[str, int], None] | None = None) -> int:
        """Moves a part's files to a tier: copy, then manifest, then delete; the number of files moved.

        ``observe`` is told each phase; what it raises aborts the move only before the manifest names the copies.
        """
        self._writable()
        folder = self._folder(tier)
        found = [m for m in self._part(name, partition) if (m.tier or DEFAULT_TIER) != tier]
        if not found:
            return 0
        os.makedirs(folder, exist_ok=True)
        tell = observe or (lambda phase, n: None)
        moved = []
        try:
            for i, m in enumerate(found):
                path = os.path.join(folder, os.path.basename(m.path))
                shutil.copytree(m.path, path, dirs_exist_ok=True)
                moved.append(replace(m, path=path, tier=None if tier == DEFAULT_TIER else tier))
                sync_folder(path)
                tell(MOVE_PHASES[0], i + 1)
            sync_folder(folder)
            tell(MOVE_PHASES[1], len(moved))
        except BaseException:
            for m in moved:
                shutil.rmtree(m.path, ignore_errors=True)
            raise
        family = self.family(name)
        by_id = {m.id: m for m in moved}
        family.files = [by_id.get(m.id, m) for m in family.files]
        self._save()
        for phase, n in ((MOVE_PHASES[2], len(moved)), (MOVE_PHASES[3], len(moved))):
            try:
                tell(phase, n)
            except Exception:  # noqa: S110 - the move is done; an observer can't undo it
                pass
            if phase == MOVE_PHASES[2]:
                self._discard(found)
        return len(moved)

    def run_part_mover(self) -> int:
        """Moves every part whose tier rule says so; the number of parts moved."""
        n = 0
        for name, family in self.manifest.families.items():
            plan = partitions.mover_plan(self.catalog(name), family.config.num_levels - 1, family.config.tier_rules, self.clock())
            for row in plan.collect():
                n += bool(self.move_part(name, row["partition"], row["target"]))
        return n

    # Maintenance

    def checkpoint(self, target: str) -> None:
        """A store at ``target`` that shares this one's immutable files, by hard links."""
        self._copy(target, os.link)

    def backup(self, target: str) -> None:
        """A store at ``target`` with copies of all files."""
        self._copy(target, shutil.copy2)

    def _copy(self, target: str, copy) -> None:
        if not self.options.read_only:
            for name in self.manifest.families:
                self.flush(name)
        if os.path.exists(os.path.join(target, "MANIFEST.json")):
            raise ExistsError(f"{target} holds a store")
        os.makedirs(os.path.join(target, "data"), exist_ok=True)
        families = {}
        for name, family in self.manifest.families.items():
            files = []
            for m in family.files:
                if not os.path.isdir(m.path):
                    raise IoError(f"file {m.id} is missing")
                path = os.path.join(target, "data", os.path.basename(m.path))
                if not os.path.exists(path):
                    shutil.copytree(m.path, path, copy_function=lambda a, b: copy(a, b))
                files.append(replace(m, path=path, tier=None))
            families[name] = Family(family.id, family.config, files)
        Manifest(self.manifest.next_file_id, self.visible, self.manifest.next_family_id, families).save(target)

    def stats(self, name: str) -> dict:
        """Levels with files and bytes, entries, tombstones, pending entries, approximate length and counters."""
        rows = statistics.level_statistics(self.catalog(name)).orderBy("level").collect()
        pending = len(self.pending[name])
        return {
            "levels": {r["level"]: (r["files"], r["bytes"]) for r in rows},
            "entries": sum(r["entries"] for r in rows),
            "tombstones": sum(r["tombstones"] for r in rows),
            "pending": pending,
            "approx_len": sum(r["entries"] for r in rows) + pending,
            **self.counters,
        }

    def database_stats(self) -> DataFrame:
        d = None
        for name in self.manifest.families:
            own = self.catalog(name).withColumn("cf", F.lit(name))
            d = own if d is None else d.unionByName(own)
        return statistics.database_statistics(self.spark.createDataFrame([], CATALOG_SCHEMA + ", cf string") if d is None else d)


__all__ = ["MOVE_PHASES", "Op", "Store"]
