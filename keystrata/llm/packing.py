"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read; what is shuffled afterwards is one small row for each piece, never the ids.
Whole windows are cut off a document first and need no padding. What is left of it is cut into pieces and dealt to
groups of bounded size; in each group, largest differencing keeps a heap of partial partitions into k windows and merges
the two with the largest spread, the fullest windows of one onto the emptiest of the other, which leaves near-equal
windows. k starts at the least count that could hold all tokens and rises whenever a window exceeds the capacity.

Tokenising goes by words: the tokeniser drops white space and never joins across it, so a text's ids are those of its
words in order. Each word is encoded once per worker and found again by a 64-bit hash in a cache of bounded size.

Defined cases: a null text is empty and still has its end token; rows that repeat a doc_id are rows of their own; an
empty table gives no rows; very long texts give many whole windows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import LARGE_SLICE, Words, cut, ragged, slices

CAPACITY = 4096
END_ID = 2
PIECE = 512
GROUP = 4096
#: Words that a worker keeps, and words that are encoded at once (the tokeniser's own results are large).
CACHE_WORDS, ENCODE_WORDS = 1_500_000, 10_000


class WordTokens:
    """Ids of the words of many texts, with a cache of at most ``limit`` words."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and n+1 offsets of the texts."""
        unique, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(unique) + len(self.keys) > self.limit:
            self._reset()
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data, start, end = words.data, words.start[at[fresh]].tolist(), words.end[at[fresh]].tolist()
            lengths, flats = [], []
            for k in range(0, len(fresh), ENCODE_WORDS):
                some = [data[a:b].decode() for a, b in zip(start[k : k + ENCODE_WORDS], end[k : k + ENCODE_WORDS])]
                found = [x.ids for x in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                flats.append(np.fromiter((i for x in found for i in x), np.uint32, int(lengths[-1].sum())))
            length, flat = np.concatenate(lengths), np.concatenate(flats)
            where = len(self.pool) + np.cumsum(length) - length
            self.pool = np.concatenate([self.pool, flat])
            self.keys, self.where, self.length = (np.insert(a, place[fresh], b) for a, b in ((self.keys, unique[fresh]), (self.where, where), (self.length, length)))
            place = np.searchsorted(self.keys, unique)
        counts = self.length[place][back]
        ids = self.pool[ragged(self.where[place][back], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[words.first]


_open: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _open:
        _open[path] = WordTokens(path)
    return _open[path]


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window 0..k-1 of each item, and the windows' loads, by largest differencing."""
    heap = []
    for i, s in enumerate(sizes.tolist()):
        loads = np.zeros(k, np.int64)
        loads[0] = s
        heap.append((-s, i, loads, [[i], *[()] * (k - 1)]))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        loads = a + b[::-1]
        rank = np.argsort(-loads, kind="stable")
        both = [x if not y else y if not x else [*x, *y] for x, y in zip(of_a, reversed(of_b))]
        loads = loads[rank]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), order, loads, [both[r] for r in rank.tolist()]))
        order += 1
    window = np.zeros(len(sizes), np.int64)
    if not heap:
        return window, np.zeros(k, np.int64)
    for w, items in enumerate(heap[0][3]):
        window[list(items)] = w
    return window, heap[0][2]


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item; no window's sizes exceed the capacity (no item may)."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, loads = differencing(sizes, k)
        if loads.max(initial=0) <= capacity:
            return window
        k += max(1, k // 256)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens. Whole windows first, then pieces of at most ``piece``."""

    def work(batches):
        tokens = word_tokens(tokenizer_path)
        for batch in slices(batches, limit=LARGE_SLICE):
            ids, ends = tokens.encode(Words(batch.column("text")))
            n = np.diff(ends) + 1
            out = np.empty(len(ids) + len(n), "<u4")
            last = np.cumsum(n) - 1
            mask = np.ones(len(out), bool)
            mask[last] = False
            out[mask], out[last] = ids, end_id
            rest = n % capacity
            whole, small = n // capacity, -(-rest // piece)
            doc = np.repeat(np.arange(len(n)), whole + small)
            j = ragged(np.zeros(len(n), np.int64), whole + small)
            full = j < whole[doc]
            even = -(-rest // np.maximum(small, 1))  # pieces of one remainder differ by little
            start = np.where(full, j * capacity, whole[doc] * capacity + (j - whole[doc]) * even[doc])
            length = np.where(full, capacity, np.minimum(even[doc], n[doc] - start))
            view = memoryview(out.tobytes())
            begin = ((last - n + 1)[doc] + start) * 4
            crc = [zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc]))], [id_column, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column], docs[text_column].alias("text")).mapInArrow(work, f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset: every id in one piece, every sequence at most ``capacity`` and gapless."""
    found = cut(pieces(docs, tokenizer_path, capacity, end_id, id_column=id_column, text_column=text_column))
    groups = max(1, round(found.count() / group))

    def work(table: pa.Table) -> pa.Table:
        size = np.asarray(table.column("length").combine_chunks())
        order = np.lexsort((np.asarray(table.column("row").combine_chunks()), -size))
        table, size = table.take(pa.array(order)), size[order]
        whole = size == capacity
        sequence = np.cumsum(whole) - 1
        if not whole.all():
            sequence[~whole] = whole.sum() + windows(size[~whole], capacity)
        by = np.argsort(sequence, kind="stable")
        before = np.cumsum(size[by]) - size[by]
        first = np.concatenate([[True], np.diff(sequence[by]) > 0])
        offset = np.empty_like(before)
        offset[by] = before - np.maximum.accumulate(np.where(first, before, 0))
        number = table.column("group")[0].as_py() * (1 << 32) + sequence
        return pa.table([*(table.column(n) for n in (id_column, "start", "length", "ids_crc32", "doc_tokens")), pa.array(number), pa.array(offset)], [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_column].dataType.simpleString()
    dealt = found.withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(work, f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
