"""Removal of repeated passages, by sharded Aho-Corasick automata.

Which documents may share a window of ``WINDOW`` words is found first. A run of rows hashes its windows, keeps each
window once with its smallest doc_id (pre-aggregation: a window in a third of all rows moves once per run), and deals
40-bit hashes to shards by a minimiser of the window's words; a shard tells which (document, earlier document) pairs share
one. Minimisers that are frequent words' own (counted over all rows first) are split by the window's hash, so that no phrase,
however common, fills a shard. Hashes only propose: pairs are then confirmed. Each unit (an earlier document and a bounded number of later ones) goes to a shard of its own, which
compiles the windows that recur there into an Aho-Corasick automaton over whole words and streams every document of the
shard through it. All occurrences are located exactly; their covered words come back as bit maps.

Defined cases: a null text has no words; texts of fewer than 13 words lose nothing; repeats within one document are
kept; rows that repeat a doc_id do not remove each other; a null doc_id neither removes nor loses words; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import LARGE_SLICE, IdFilter, Words, cut, estimated_parts, ragged, rolling, shared_folder, slices, splitmix

WINDOW = 13
HASH_BITS = 40
#: Windows of a shard, about: what one task sorts at once.
SHARD_WINDOWS = 1 << 19
LEAST_SHARDS = 256
#: Later documents of one unit, and units' pairs of one automaton shard.
UNIT, SHARD_PAIRS = 128, 100
PATTERNS = 40_000
#: A run of three words counts as frequent from this share of a step's on.
FREQUENT_SHARE = 1 / (1 << 16)


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs, (2, n)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]])


def _triples(hashes: np.ndarray) -> np.ndarray:
    return rolling(hashes, 3)


def _minimisers(hashes: np.ndarray) -> np.ndarray:
    """For each window the smallest hash of three neighbouring words in it.

    Equal windows have equal ones, and neighbouring windows mostly share theirs, so that a passage meets in few shards.
    """
    m = _triples(hashes)
    for step in (1, 2, 4, WINDOW - 10):
        m = np.minimum(m[:-step], m[step:])
    return m


def _splits(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of frequent runs of three words, sorted, and among how many shards the windows they stand for are dealt.

    Every run counts in the steps in which it is frequent. Windows of those never frequent are no more than their share of a shard's.
    """

    def work(batches):
        for batch in slices(batches, limit=LARGE_SLICE):
            words = Words(batch.column("text"))
            n = np.maximum(words.counts - 2, 0)
            found = np.sort(_triples(words.hashes())[ragged(words.first[:-1], n)])
            if not len(found):
                continue
            new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            times = np.diff(np.append(new, len(found)))
            often = times >= max(2, len(found) * FREQUENT_SHARE)
            yield pa.RecordBatch.from_arrays([pa.array(found[new][often].view(np.int64)), pa.array(times[often])], ["triple", "n"])

    # One run of three words may stand for all windows around it.
    needed = F.ceil(F.sum("n") * (WINDOW - 2) / F.lit(SHARD_WINDOWS))
    found = docs.select("text").mapInArrow(work, "triple long, n long").groupBy("triple").agg(needed.alias("parts")).filter("parts > 1").toArrow()
    triple, parts = (np.asarray(found.column(c).combine_chunks()) for c in ("triple", "parts"))
    order = np.argsort(triple.view(np.uint64))
    return triple.view(np.uint64)[order], parts.astype(np.uint64)[order]


def _homes(hashes: np.ndarray, windows: np.ndarray, often: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """What a window's shard follows from: its minimiser, and of a frequent one a part by the window's hash."""
    m = _minimisers(hashes)
    if len(often):
        at = np.minimum(np.searchsorted(often, m), len(often) - 1)
        hot = np.flatnonzero(often[at] == m)
        m[hot] += splitmix((windows[hot] >> np.uint64(8)) % parts[at[hot]], 43)
    return splitmix(m, 41)


def _proposals(docs: DataFrame, count: int, splits: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A shard's hashes with their documents (runs of id, length); without hashes: pairs later/earlier found within a run of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(splits)

    def work(batches):
        often, parts = shared.value
        for batch in slices(batches, limit=LARGE_SLICE):
            words = Words(batch.column("text"))
            ids = np.asarray(batch.column("id"))
            n = np.maximum(words.counts - WINDOW + 1, 0)
            if not n.sum():
                continue
            hashes = words.hashes()
            at = ragged(words.first[:-1], n)
            windows = rolling(hashes, WINDOW)
            h, home = windows[at], _homes(hashes, windows, often, parts)[at]
            doc = np.repeat(np.arange(len(n)), n)
            owner = ids[doc]
            order = np.lexsort((owner, h))
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            later = owner[order] > owner[first]
            pairs = _distinct(owner[order][later], owner[first][later])
            if pairs.shape[1]:
                at = int(splitmix(ids[:1].view(np.uint64))[0] % np.uint64(count))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([None], pa.binary()), pa.array([pairs.tobytes()], pa.binary())], ["shard", "hashes", "owners"])
            keep = np.zeros(len(h), bool)
            keep[order[new]] = True
            h, owner = h[keep], owner[keep]
            shard = ((home[keep] >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[by], np.arange(count + 1))
            some = np.flatnonzero(np.diff(bounds))
            h, owner = h[by], owner[by]
            low = np.ascontiguousarray((h & np.uint64((1 << HASH_BITS) - 1)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].copy()
            # Documents stay in order within a shard: runs of an owner are (id, length).
            blobs, owners = [], []
            for k in some.tolist():
                a, b = bounds[k], bounds[k + 1]
                own = owner[a:b]
                edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                blobs.append(low[a:b].tobytes())
                owners.append(np.stack([own[edge], np.diff(np.append(edge, b - a))]).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(owners, pa.binary())], ["shard", "hashes", "owners"])

    return docs.mapInArrow(work, "shard int, hashes binary, owners binary")


def _shared(table: pa.Table) -> pa.Table:
    """The pairs (d, m), m earlier, that share a hash of one shard, and those already found."""
    bytes_, owner, known = [], [], []
    for h, o in zip(table.column("hashes").to_pylist(), table.column("owners").to_pylist()):
        o = np.frombuffer(o, np.int64).reshape(2, -1)
        if h is None:
            known.append(o)
            continue
        bytes_.append(np.frombuffer(h, np.uint8).reshape(-1, HASH_BITS // 8))
        owner.append(np.repeat(o[0], o[1]))
    if not bytes_:
        pairs = _distinct(*np.concatenate(known, axis=1))
        return pa.table({"d": pairs[0], "m": pairs[1]})
    width = np.zeros((sum(map(len, bytes_)), 8), np.uint8)
    width[:, : HASH_BITS // 8] = np.concatenate(bytes_)
    h, owner = width.view("<u8")[:, 0], np.concatenate(owner)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    first = np.repeat(np.minimum.reduceat(owner, start), np.diff(np.append(start, len(h))))
    later = owner > first
    pairs = _distinct(*np.concatenate([np.stack([owner[later], first[later]]), *known], axis=1))
    return pa.table({"d": pairs[0], "m": pairs[1]})


def _flags(docs: DataFrame, wanted: IdFilter) -> DataFrame:
    """The documents whose id passes the filter."""

    def work(batches):
        for whole in batches:
            yield from slices([whole.filter(pa.array(wanted.passes(whole.column("at")))).select(["id", "text"])])

    return docs.filter("id is not null").withColumn("at", wanted.place("id")).mapInArrow(work, "id long, text string")


def _letters(words: Words) -> str:
    """The words of all texts as a string of one letter for each distinct word."""
    _, letter = np.unique(words.hashes(), return_inverse=True)
    letter = letter + 1
    if len(letter) and int(letter.max()) > 0x10F000:
        raise ValueError("too many distinct words for one automaton shard")
    return (letter + np.where(letter >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")


def locate(texts: pa.Array, ids: np.ndarray, earlier: np.ndarray, patterns: int = PATTERNS) -> tuple[Words, np.ndarray]:
    """The texts' words, and the start positions of windows in later texts that also start in an earlier one of a smaller id.

    Windows that occur on both sides are compiled into automata of at most ``patterns`` patterns, whose letters are whole
    words; every later text is streamed through them.
    """
    import ahocorasick

    words = Words(texts)
    line = _letters(words)
    first = words.first
    n = np.maximum(np.diff(first) - WINDOW + 1, 0)
    start = ragged(first[:-1], n)
    doc = np.repeat(np.arange(len(n)), n)
    h = rolling(words.hashes(), WINDOW)[start]
    role = earlier[doc]
    source, target = np.flatnonzero(role), np.flatnonzero(~role)
    source = source[np.isin(h[source], h[target])]
    order = np.lexsort((ids[doc[source]], h[source]))
    source = source[order]
    source = source[np.concatenate([[True], h[source][1:] != h[source][:-1]])] if len(source) else source
    at, owner = start[source].tolist(), ids[doc[source]].tolist()
    hits: list[int] = []
    later = [(i, a, b) for i, a, b, e in zip(ids.tolist(), first.tolist(), first[1:].tolist(), earlier.tolist()) if not e and b - a >= WINDOW]
    for k in range(0, len(at), patterns):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for a, i in zip(at[k : k + patterns], owner[k : k + patterns]):
            automaton.add_word(line[a : a + WINDOW], i)
        automaton.make_automaton()
        for i, a, b in later:
            hits.extend([end - WINDOW + 1 for end, least in automaton.iter(line, a, b) if least < i])
    return words, np.array(hits, np.int64)


def _units(table: pa.Table) -> pa.Table:
    """One automaton shard: earlier documents' windows, located in the later ones; a bit map per later document."""
    table = table.combine_chunks()
    ids, keys = np.asarray(table.column("id").chunk(0)), np.asarray(table.column("key").chunk(0))
    earlier = np.asarray(table.column("role").chunk(0)) == 0
    words, hits = locate(table.column("text").chunk(0), ids, earlier)
    step = np.bincount(hits, minlength=len(words) + WINDOW + 1) - np.bincount(hits + WINDOW, minlength=len(words) + WINDOW + 1)
    covered = np.cumsum(step) > 0
    rows = [(i, k, np.packbits(covered[a:b]).tobytes()) for i, k, e, a, b in zip(ids.tolist(), keys.tolist(), earlier.tolist(), words.first.tolist(), words.first[1:].tolist()) if not e and covered[a:b].any()]
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["id", "key", "bits"])


def occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per later document: id, key, maps; the texts of documents that may share something: id, text, key)."""
    # Stored text is compressed to about half, and a word takes some six bytes.
    count = estimated_parts(docs, "text", LEAST_SHARDS, 3 * SHARD_WINDOWS)
    known = docs.filter("id is not null and text is not null")
    proposed = _proposals(known, count, _splits(known))
    pairs = cut(proposed.groupBy("shard").applyInArrow(_shared, "d long, m long").distinct())
    found = pairs.count()
    texts = cut(_flags(docs, IdFilter(pairs.select(F.explode(F.array("d", "m")).alias("id")), 2 * found)).withColumn("key", F.xxhash64("text")))
    per = pairs.groupBy("m").agg(F.count("*").alias("n")).select("m", F.ceil(F.col("n") / UNIT).cast("int").alias("salts"))
    many = max(1, found // SHARD_PAIRS)
    salted = pairs.join(per, "m").withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "d"), F.col("salts")).cast("int"))
    unit = F.pmod(F.xxhash64("m", "salt"), F.lit(many)).cast("int")
    later = salted.select(F.col("d").alias("id"), unit.alias("unit")).distinct().withColumn("role", F.lit(1))
    earlier = per.select("m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(F.col("m").alias("id"), unit.alias("unit")).distinct().withColumn("role", F.lit(0))
    rows = earlier.unionByName(later).join(texts, "id")
    maps = rows.groupBy("unit").applyInArrow(_units, "id long, key long, bits binary")
    return maps.groupBy("id", "key").agg(F.collect_list("bits").alias("maps")), texts


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _results(batch: pa.RecordBatch, removed) -> pa.RecordBatch:
    rows = []
    for i, text, maps in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), removed):
        words = (text or "").encode().split()
        n, gone = len(words), 0
        if maps:
            bits = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in maps], axis=0)
            drop = np.unpackbits(bits)[:n].astype(bool)
            gone = int(drop.sum())
            words = [w for w, x in zip(words, drop.tolist()) if not x]
        rows.append((i, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    shared_folder(docs.sparkSession)
    picked = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    maps, texts = occurrences(picked)
    maps = cut(maps)
    touched = IdFilter(maps.select("id"), maps.count())

    def untouched(batches):
        for whole in batches:
            for batch in slices([whole.filter(pa.array(~touched.passes(whole.column("at"))))]):
                yield _results(batch, [None] * batch.num_rows)

    def changed(batches):
        for batch in slices(batches):
            yield _results(batch, batch.column("maps").to_pylist())

    known = picked.filter("id is not null").withColumn("at", touched.place("id")).mapInArrow(untouched, _RESULT)
    nameless = picked.filter("id is null").withColumn("maps", F.lit(None).cast("array<binary>")).mapInArrow(changed, _RESULT)
    some = _flags(picked, touched).withColumn("key", F.xxhash64("text"))
    rest = some.join(maps, ["id", "key"], "left").select("id", "text", "maps").mapInArrow(changed, _RESULT)
    return known.unionByName(rest).unionByName(nameless)
