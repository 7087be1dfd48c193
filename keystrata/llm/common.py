"""Shared helpers: Arrow slices of bounded size, words of raw bytes and their hashes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds at once (a longer single text forms its own slice).
SLICE_BYTES = 1 << 20
#: For operators that need little more memory than the text, and gain from larger steps.
LARGE_SLICE = 2 << 20

#: Bytes of one Arrow batch between the JVM and a Python worker, about; and bytes of text between two releases of memory.
BATCH_BYTES = 4 << 20
RELEASE_BYTES = 8 << 20
#: Small rows of a file.
FILE_ROWS = 200_000
#: Bytes whose 64-bit intermediate values are held at once.
HASH_STEP = 1 << 17

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing by byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def splitmix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 2 + 1) * _BASE & (1 << 64) - 1)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE_VALUES = splitmix(np.arange(256, dtype=U64), 7)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**HASH_STEP modulo 2**64, and of its inverse."""
    out = []
    for base in (_BASE, _INVERSE):
        x = np.ones(1, U64)
        with np.errstate(over="ignore"):
            while len(x) <= HASH_STEP:
                x = np.concatenate([x, x * U64(pow(base, len(x), 1 << 64))])
        out.append(x[: HASH_STEP + 1].copy())
    return out[0], out[1]


@functools.cache
def _allocator():
    """The C library's release of freed memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that this process has freed back to the machine; workers are kept between tasks, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := _allocator():
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's texts have about ``limit`` bytes in each; no row is lost, no order changed."""
    since = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.concatenate([[0], np.cumsum(size)[:-1]]) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
            since += int(size[a:b].sum())
            if since > RELEASE_BYTES:
                release()
                since = 0
    release()


def raw(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts' UTF-8 bytes, one after another, and n+1 offsets; null counts as empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    buffers = column.buffers()
    if not len(column):
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = b"" if buffers[2] is None else buffers[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()
    return data, offsets - offsets[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many texts, with 64-bit hashes, without a Python object for any word.

    ``start``/``end``: byte positions in ``data``; ``first``: n+1 positions, the words of text i are first[i]:first[i+1].
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = raw(column)
        self.data = data.translate(LOWER) if lower else data
        del data
        self.bytes = np.frombuffer(self.data, np.uint8)
        word = np.zeros(len(self.bytes) + 2, bool)  # with a place before and one after
        np.take(~_WHITE, self.bytes, out=word[1:-1])
        cut = np.zeros(len(self.bytes) + 1, bool)
        cut[self.offsets[:-1]] = True
        self.start = np.flatnonzero(word[1:] & (cut | ~word[:-1]))
        self.end = np.flatnonzero(word[:-1] & (cut | ~word[1:]))
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One unsigned 64-bit hash for each word, from its bytes only: a polynomial in them, by prefix sums over steps of bytes."""
        up, down = _powers()
        value = np.zeros(len(self.start), U64)
        before = U64(0)
        with np.errstate(over="ignore"):
            for at in range(0, len(self.bytes), HASH_STEP):
                b = self.bytes[at : at + HASH_STEP]
                sums = np.zeros(len(b) + 1, U64)
                np.cumsum(_BYTE_VALUES[b] * up[: len(b)], out=sums[1:])
                sums *= U64(pow(_BASE, at, 1 << 64))
                sums += before
                s = slice(*np.searchsorted(self.start, [at, at + len(b)]))
                e = slice(*np.searchsorted(self.end, [at, at + len(b)], side="right"))
                value[s] -= sums[self.start[s] - at]
                value[e] += sums[self.end[e] - at]
                before = sums[-1]
            for k in range(0, len(value), HASH_STEP):
                v, at = value[k : k + HASH_STEP], self.start[k : k + HASH_STEP]
                # base**-at, from its quotient and remainder by the step.
                step, rest = np.divmod(at, HASH_STEP)
                high = np.array([pow(_INVERSE, q * HASH_STEP, 1 << 64) for q in range(int(step[0]), int(step[-1]) + 1)], U64)
                v *= down[rest] * high[step - step[0]]
                v += (self.end[k : k + HASH_STEP] - at).astype(U64)
        return splitmix(value)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k neighbours; result i covers i..i+k-1 (shorter by k-1)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for j in range(k):
            out = out * U64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return splitmix(out, 3)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, .. (counts[i] of them), for every i."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    ends = np.cumsum(counts)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array: entry i holds the bytes of values[bounds[i]:bounds[i+1]]."""
    step = values.dtype.itemsize
    offsets = (np.asarray(bounds, np.int64) * step).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def shared_folder(spark: SparkSession) -> None:
    """Lets checkpoint() work, in the folder that spark.checkpoint.dir names, and bounds Arrow batches.

    Where it is unset, a folder of this machine serves a local master (tests); executors elsewhere couldn't see one.
    """
    small_batches(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="keystrata-checkpoint-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(where)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch for the session, unless a smaller bound is set: by rows alone, long texts or sets make batches of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, "64m")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(text: str) -> int:
    text = text.lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(text[-1:])
    value = int(text[:-1]) << scale if scale else int(text)
    return value if value > 0 else 1 << 62


def cut(df: DataFrame, rows: int | None = None, by: str | None = None) -> DataFrame:
    """The rows, written once to the shared checkpoint folder; lineage ends there.

    ``rows``: about how many small ones there are at most, which are dealt to few files then. ``by``: a column by which small rows are
    dealt to as few files as adaptive execution makes of their size. (Hadoop's local file system starts two programs for each file, and
    for an instant, until the program has begun, the executor's JVM is there twice with all of its memory.) Spark deletes shuffle files once the plans that made them are garbage on the driver, which may be long after; so the
    driver's garbage is collected here.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if rows is not None:
        df = df.repartition(rows // FILE_ROWS + 1)
    if by is not None:
        df = df.repartition(by)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


class IdFilter:
    """A bit for each hash of some ids: holds back most rows of other ids, never one of theirs.

    It has 16 bits for each id (``many`` at most) up to 2 ** 28 bits, 32 MB, which bounds the broadcast; beyond, more rows pass.
    """

    def __init__(self, ids: DataFrame, many: int):
        """``ids``: a column ``id``, repeats allowed."""
        self.size = 1 << min(28, max(16, (16 * many).bit_length()))
        place = ids.select(self.place("id").alias("h"))
        bits = place.select(F.expr("shiftright(h, 6)").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        words = np.zeros(self.size // 64, np.int64)
        for batch in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
            words[np.asarray(batch.column("word"))] = np.asarray(batch.column("bits"))
        self._shared = ids.sparkSession.sparkContext.broadcast(words.view(U64))

    def place(self, column: str) -> Column:
        """The bit of an id."""
        return F.pmod(F.xxhash64(column), F.lit(self.size))

    def passes(self, place: pa.Array) -> np.ndarray:
        """Whether the bits at these places are set."""
        at = np.asarray(place)
        return (self._shared.value[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1


def estimated_parts(df: DataFrame, column: str, least: int, each: int) -> int:
    """Parts of ``each`` stored bytes of a text column, at least ``least``.

    The optimiser's size estimate of the scan serves; where it has none, the texts are measured (stored text is about
    half as large).
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 2
    return max(least, size // each)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, count: int, seed: int = 0):
    """A bucket 0..count-1 from a hash of the column's value."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(count)).cast("int")
