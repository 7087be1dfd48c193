"""Language-model scores by logistic context mixing, beside a smoothed unigram score.

The model reads a text as its lower-cased words, one space between them, and an end symbol. A byte is a path of bits in
the Huffman tree that the two bytes before it (where these are rare, the last) have in the training texts. For each bit, predictors with hashed contexts (the
last four and six bytes, and the word so far) give the log odds of the bit from counts; a logistic mixer adds
them up with weights gated by the amount of evidence: a gate is how often the slots of the predictors were seen.
A last stage maps the mixer's log odds to corrected ones. Weights and corrections are refined online: after each block of
a document, by the coding cost of all bits of that block. The cost of all bits is the text's probability.

Counts are of all training documents, whole: pairs of bytes, a count table for each predictor, and the counts of all
words. Tables grow with the training text (``slot_bits``), up to 2 ** ``MOST_SLOTS`` slots of two bytes, which bounds what is
broadcast; contexts beyond share slots, and the weights, fitted on the tables as they are, trust them as far as that goes.
What a document begins with (weights and corrections) is fitted on all bits of all training documents, whole. They fall in
two halves by a hash; while fitting, a document meets the counts of the other half, lest the weights trust counts of the
same texts. One pass over each half counts, by gate, how often ones and zeros come with the predictors' log odds, in
``LEVELS`` steps each; the fit is on these counts, so its size is bounded and no document is left out.
Tables are summed in parts by slot range, in steps of bounded size; their values and the words with the largest counts,
up to ``FREQUENT``, are broadcast. Other words' occurrences are joined with their counts, so no word is left out. A
document's result depends on its text and the training set only, not on how rows are dealt.

Defined cases: a null or blank text is the end token alone; rows that repeat a doc_id give a row each (and count as
often in training); a null doc_id counts as training; an empty table gives no rows; without training documents N and V
are 0 and predictions are even; other columns, whatever their names, are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import LARGE_SLICE, LOWER, SLICE_BYTES, Words, cut, estimated_parts, raw, release, slices, small_batches
from keystrata.llm.langid import held_out

#: How many bytes before a position each predictor's context has; ``WORD``: the word so far (its last eight bytes and its length).
WORD = 0
ORDERS = (4, 6, WORD)
PREDICTORS = len(ORDERS)
#: Slots of a predictor's table, as powers of two: at least ``LEAST_SLOTS``, and one for each ``SLOT_BYTES`` bytes of
#: training text, up to ``MOST_SLOTS`` (contexts of two and three bytes are few).
LEAST_SLOTS, MOST_SLOTS, SLOT_BYTES = 22, 24, 128
FEW_SLOTS = {2: 18, 3: 20}
#: Slots of one part of a table, as a power of two; bits of a count beside its place, and beside a pair.
PART = 16
COUNT_BITS, TIMES_BITS = 32, 16
#: Bits of a place in the trees: which tree, and the next byte.
OWN_BITS = 20
DEEPEST = 14
#: Trees for two bytes before at most, and how often each was seen at least; what else comes has the tree of the byte before.
MOST_TREES, LEAST_SEEN = 768, 200
#: Weights every document starts with, by predictor; and how fast they move.
START = (1 / 3, 1 / 3, 1 / 3)
RATE = 0.01
PULL = 20.0
#: Where the steps of a predictor's log odds begin, above 0, that the starting weights are fitted on; and what each stands for.
EDGES = (0.4, 1.2, 2.3, 3.7, 4.8, 6.5)
STANDS = (0.0, 0.8, 1.7, 3.0, 4.2, 5.6, 7.8)
LEVELS = 2 * len(EDGES) + 1
#: No bit's chance counts as less than one minus this.
MOST = np.float32(1 - 1e-6)
#: Classes of how often a slot was seen; the predictors' classes together choose a set of weights, two of the first one's as one.
CLASSES = 8
GATES = CLASSES * CLASSES * CLASSES // 2
#: The last stage maps the mixer's log odds, in so many buckets up to ``REACH`` to either side, to corrected ones.
BUCKETS, REACH = 32, 12.0
#: Counts that the fit starts from: a gate, a level for each predictor, and a bit.
CELLS = GATES * LEVELS**PREDICTORS * 2
MAP_PULL = 40.0
FIRST_BLOCK, LAST_BLOCK = 256, 8192
#: Positions whose bits are looked at together, about: what they take stays near the processor.
RUN = 1 << 14
SMOOTHING = 0.02
SCALE = 12.0
UNIT = 16 * SCALE
FREQUENT = 1_000_000
HELD_WORDS = 1_500_000
HELD_PAIRS = 1 << 22
#: Counted pairs or bits that are looked at together: what they take stays near the processor, and small.
STEP = 1 << 17
#: Portions of counts that one step adds up, about.
ADDED = 64
LN10 = math.log(10)

#: Bytes as the model reads them: lower-cased, and one kind of white space.
_READ = LOWER[:0x09] + b" " * 5 + LOWER[0x0E:]
#: Classes of the byte before the last: each letter, a space or the text's start, all others; times 256.
_CLASS = np.zeros(256, np.uint16)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27) << 8
_CLASS[32] = 27 << 8
WINDOWS = 28 << 8
#: By length: a mask of so many bytes before a position, the nearest in the top byte.
_LAST_BYTES = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(9)], np.uint64)
_NODE = np.uint32(0x9E3779B1)
#: Levels of a tree whose nodes share a line of a table's slots (64 bytes), as mostly do those of one position.
NEAR = 5


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as the model reads them (end symbol 0), one after another, and n+1 offsets."""
    closed = pc.binary_join_element_wise(pc.fill_null(column, ""), pa.scalar("\n", column.type), pa.scalar("", column.type))
    data, offsets = raw(closed)
    b = np.frombuffer(data.translate(_READ), np.uint8)
    if not len(b):
        return b, offsets
    white = b == 32
    starts, last = offsets[:-1], offsets[1:] - 1
    drop = white.copy()
    drop[1:] &= white[:-1]
    drop[starts] = white[starts]
    gone = np.flatnonzero(drop)
    before = np.searchsorted(gone, offsets)
    blank = np.diff(before) == np.diff(offsets)
    drop[last[blank]] = False
    ends = offsets - before + np.concatenate([[0], np.cumsum(blank)])
    out = b[~drop]
    out[ends[1:] - 1] = 0
    return out, ends


class Tree:
    """Huffman trees over the next byte, one for each byte before and for frequent windows: ``code`` (first bit lowest) and ``length`` at tree * 256 + next."""

    def __init__(self, counts: np.ndarray, which: np.ndarray | None = None):
        """``counts``: by tree, of the next byte; the first 256 are those of the byte before. ``which``: the tree of each window (see ``windows``)."""
        from keystrata.llm.webp_lossless import code_lengths, codes

        self.which = which
        counts = np.asarray(counts, float)
        overall = counts[:256].sum(axis=0) + 0.01
        overall /= overall.sum()
        self.length, self.code = np.zeros(counts.shape, np.uint8), np.zeros(counts.shape, np.uint32)
        made: dict[bool, tuple] = {}
        for before in range(len(counts)):
            seen = bool(counts[before].any())
            if seen or False not in made:
                lengths = code_lengths((counts[before] + overall).tolist(), DEEPEST)
                made[seen] = lengths, codes(lengths)
            self.length[before], self.code[before] = made[seen]
        self.length, self.code = self.length.ravel(), self.code.ravel()

    @staticmethod
    def of(follow: np.ndarray) -> Tree:
        """From counts of byte pairs, or of windows and the next byte. After a space there is one tree: the word so far is empty there, whatever came before."""
        follow = follow.reshape(-1, 256)
        if len(follow) == 256:
            return Tree(follow)
        seen = follow.sum(axis=1)
        seen.reshape(-1, 256)[:, 32] = 0
        seen[:256] = 0  # bytes of no class
        often = np.sort(np.argsort(-seen, kind="stable")[:MOST_TREES])
        often = often[seen[often] >= LEAST_SEEN]
        which = np.tile(np.arange(256, dtype=np.uint32), WINDOWS >> 8)
        which[often] = 256 + np.arange(len(often), dtype=np.uint32)
        return Tree(np.concatenate([follow.reshape(-1, 256, 256).sum(axis=0), follow[often]]), which)

    def places(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """tree * 256 + next at every position."""
        if self.which is None:
            return pairs_of(text, ends)
        out = np.take(self.which, windows(text, ends))
        out <<= np.uint32(8)
        out |= text
        return out

    @functools.cached_property
    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair's path begins; and of all paths, a step after another, the hash of the node, with the bit in the top bit, which no slot has."""
        first = np.cumsum(self.length, dtype=np.int64) - self.length
        node = np.zeros(int(self.length.sum()), np.uint32)
        for depth in range(DEEPEST):
            deep = np.flatnonzero(self.length > depth)
            code = self.code[deep]
            node[first[deep] + depth] = _path(code, depth) & np.uint32((1 << 31) - 1) | code >> np.uint32(depth) << np.uint32(31)
        return first, node


def pairs_of(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """before * 256 + next at every position; 0 comes before a text."""
    out = text.astype(np.uint16)
    out[1:] |= text[:-1].astype(np.uint16) << np.uint16(8)
    starts = ends[:-1][ends[:-1] < len(text)]
    out[starts] = text[starts]
    return out


def windows(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of the byte before the last, times 256, and the last byte, at every position; as if a space came before a text, but 0 at its first byte."""
    out = np.zeros(len(text), np.uint16)
    out[1:] = text[:-1]
    out[2:] |= np.take(_CLASS, text[:-2])
    starts = ends[:-1][ends[:-1] < len(text)]
    out[starts] = 0
    second = starts[starts + 1 < ends[1:][: len(starts)]] + 1
    out[second] = text[second - 1] | _CLASS[32]
    return out


def contexts(text: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A hash of 32 bits of each predictor's context at every position."""
    n = len(text)
    padded = np.concatenate([np.zeros(8, np.uint8), text])
    every = np.ndarray((n,), "<u8", padded, strides=(1,))
    starts = ends[:-1][ends[:-1] < n]
    out = [np.empty(n, np.uint32) for _ in ORDERS]
    near, began = np.arange(8), 0
    with np.errstate(over="ignore"):
        for a in range(0, n, RUN):  # what a run takes stays near the processor
            b = min(n, a + RUN)
            before = every[a:b].copy()
            first, last = np.searchsorted(starts, (a - 7, b))
            at = starts[first:last, None] + near  # at a document's start, the last k bytes are its own
            own = (at >= a) & (at < np.minimum(ends[1:][first:last], b)[:, None])
            before[at[own] - a] &= np.broadcast_to(_LAST_BYTES[:8], at.shape)[own]
            last_four = before.astype("<u8", copy=False).view("<u4")[1::2]
            for order, to in zip(ORDERS, out):
                if order == WORD:
                    begin = np.full(b - a, began - a, np.int64)
                    for x in (np.flatnonzero(padded[a + 7 : b + 7] == 32), starts[np.searchsorted(starts, a) : last] - a):
                        begin[x] = x
                    np.maximum.accumulate(begin, out=begin)
                    began = int(begin[-1]) + a
                    place = np.arange(b - a) - begin
                    x = before & np.take(_LAST_BYTES, place, mode="clip")
                    x += np.minimum(place, 255, out=place).view(np.uint64)
                    x += np.uint64(0x632BE59BD9B4E019)
                elif order > 4:
                    x = before >> np.uint64(64 - 8 * order)
                    x += np.uint64(1 + order)
                else:
                    y = last_four >> np.uint32(32 - 8 * order)
                    y += np.uint32(1 + order)
                    y *= _NODE
                if order == WORD or order > 4:
                    x *= np.uint64(0xBF58476D1CE4E5B9)
                    x >>= np.uint64(32)
                    y = x.astype(np.uint32)
                y ^= y >> np.uint32(16)
                y *= np.uint32(0x85EBCA6B)
                np.bitwise_xor(y, y >> np.uint32(13), out=to[a:b])
    return out


def slot_bits(training_bytes: int) -> list[int]:
    """Of each predictor's table for so much training text."""
    grown = max(1, training_bytes // SLOT_BYTES).bit_length()
    return [FEW_SLOTS.get(order, min(max(LEAST_SLOTS, grown), MOST_SLOTS)) for order in ORDERS]


def _path(code: np.ndarray, depth: int) -> np.ndarray:
    """What a code's node at a depth, its path so far, changes of a context's hash: of each ``NEAR`` levels only the lowest bits, so that they are neighbours."""
    above = depth - depth % NEAR
    x = code & np.uint32((1 << depth) - 1)
    low = x >> np.uint32(above)
    low |= np.uint32(1 << depth - above)
    if above:
        x &= np.uint32((1 << above) - 1)
        x |= np.uint32(1 << above)
        x *= _NODE
        x ^= x >> np.uint32(15)
        x <<= np.uint32(NEAR)
        low |= x
    return low


def count_pairs(bits: list[int], text: np.ndarray, ends: np.ndarray, tree: Tree | None = None) -> np.ndarray:
    """What the text's bits follow from, each with how often it comes in the low ``TIMES_BITS`` bits: predictor, context, tree (else the byte before) and next byte, which mostly come again within a text."""
    return np.concatenate(_pairs_by_predictor(bits, text, ends, tree))


def _pairs_by_predictor(bits: list[int], text: np.ndarray, ends: np.ndarray, tree: Tree | None = None) -> list[np.ndarray]:
    follow = pairs_of(text, ends) if tree is None else tree.places(text, ends)
    out = []
    for k, h in enumerate(contexts(text, ends)):
        h &= np.uint32((1 << bits[k]) - 1)
        pairs = h.astype(np.int64)
        pairs <<= OWN_BITS
        pairs |= follow
        pairs.sort()
        new = _first(pairs)
        pairs, times = pairs[new], np.diff(np.append(new, len(pairs)))
        pairs |= k << MOST_SLOTS + OWN_BITS
        out.append(_entries(pairs, times, TIMES_BITS))
    return out


def bits_of(tree: Tree, bits: list[int], found: np.ndarray) -> Iterator[np.ndarray]:
    """By predictor: the bits of counted pairs, in no order: places (predictor, slot, bit), each with a count in the low ``COUNT_BITS`` bits; a place may come again."""
    cuts = np.searchsorted(found, np.arange(PREDICTORS + 1) << MOST_SLOTS + OWN_BITS + TIMES_BITS)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        yield _bits_of(tree, bits[k], k, found[a:b])


def _bits_of(tree: Tree, bits: int, k: int, found: np.ndarray) -> np.ndarray:
    """One predictor's."""
    many = sum(int(np.take(tree.length, x >> TIMES_BITS & (1 << OWN_BITS) - 1).sum(dtype=np.int64)) for x in np.array_split(found, len(found) // STEP + 1))
    out, at = np.empty(many, np.int64), 0
    for a in range(0, len(found), STEP):
        times = found[a : a + STEP] & (1 << TIMES_BITS) - 1
        pairs = found[a : a + STEP] >> TIMES_BITS
        h, own = (pairs >> OWN_BITS).astype(np.uint32), pairs & (1 << OWN_BITS) - 1
        code, length = np.take(tree.code, own), np.take(tree.length, own)
        times += k << MOST_SLOTS + 1 + COUNT_BITS
        for depth in range(DEEPEST):
            if depth:
                deep = np.flatnonzero(length > depth)
                if not len(deep):
                    break
                h, code, length, times = (np.take(x, deep, mode="clip") for x in (h, code, length, times))
            slot = h ^ _path(code, depth)
            slot &= np.uint32((1 << bits) - 1)
            slot <<= 1
            slot += code >> depth & 1
            place = out[at : at + len(slot)]
            place[:] = slot
            place <<= COUNT_BITS
            place += times
            at += len(slot)
    return out


def count_bits(tree: Tree, bits: list[int], text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The text's bits, as ``bits_of`` has them."""
    return np.concatenate(list(bits_of(tree, bits, merged([count_pairs(bits, text, ends, tree)], TIMES_BITS))))


def _first(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before, and 0."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def merged(found: list[np.ndarray], low: int = COUNT_BITS) -> np.ndarray:
    """The distinct places, in order, each with its count in the ``low`` bits: a place's counts added up, in as many entries as that takes. A lone array is sorted where it is."""
    x = found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.int64)
    x.sort()
    out, a = [np.zeros(0, np.int64)], 0
    while a < len(x):
        b = min(len(x), a + STEP)
        if b < len(x):  # a place's counts stay together
            b = int(np.searchsorted(x, (x[b - 1] >> low) + 1 << low))
        place = x[a:b] >> low
        new = _first(place)
        out.append(_entries(place[new], np.add.reduceat(x[a:b] & (1 << low) - 1, new), low))
        a = b
    return np.concatenate(out)


def _entries(place: np.ndarray, total: np.ndarray, low: int = COUNT_BITS) -> np.ndarray:
    """Places with their counts in the low bits; a count too large for those takes more entries."""
    most = (1 << low) - 1
    if len(total) and int(total.max()) > most:
        times = -(-total // most)
        place, total = np.repeat(place, times), np.repeat(total, times)
        turn = np.arange(len(total)) - np.repeat(np.cumsum(times) - times, times)
        total = np.minimum(total - turn * most, most)
    return (place << low) + total


def slot_values(counts: np.ndarray) -> np.ndarray:
    """A signed 16-bit value a slot: 16 times the scaled log odds of a one, plus a class of how much the slot has seen."""
    c = counts.reshape(-1, 2).astype(np.float64)
    odds = np.clip(np.rint(np.log((c[:, 1] + SMOOTHING) / (c[:, 0] + SMOOTHING)) * SCALE), -2047, 2047)
    seen = np.minimum(CLASSES - 1, np.ceil(np.log2(c.sum(axis=1) + 1) * 0.75))
    return (odds * 16 + seen).astype(np.int16)


def tables_of(bits: list[int], found: np.ndarray) -> list[np.ndarray]:
    """Each predictor's slot values, from all counts at once."""
    place, count = found >> COUNT_BITS, found & ((1 << COUNT_BITS) - 1)
    out = []
    for k, b in enumerate(bits):
        own = place >> MOST_SLOTS + 1 == k
        out.append(slot_values(np.bincount(place[own] & ((2 << MOST_SLOTS) - 1), count[own], 2 << b)))
    return out


@dataclass
class Model:
    tree: Tree
    values: list[np.ndarray]
    #: (gates, predictors): what a document begins with.
    weights: np.ndarray
    #: (buckets,): what the last stage adds to the mixer's log odds.
    correction: np.ndarray

    @staticmethod
    def start(tree: Tree, values: list[np.ndarray]) -> Model:
        return Model(tree, values, np.tile(np.array(START), (GATES, 1)), np.zeros(BUCKETS))

    def bits(self, pairs: np.ndarray, hashed: list[np.ndarray], kind: type = np.float32) -> tuple:
        """All bits of the positions, one position's after another's: the position of each, the bits, each predictor's log odds times ``UNIT``, and the gates; bits and odds as ``kind``.

        A class adds less than one step of the log odds, so values serve as they are.
        """
        first, node = self.tree.paths
        length = np.take(self.tree.length, pairs)
        begin = np.cumsum(length, dtype=np.int64)
        n = int(begin[-1]) if len(begin) else 0
        begin -= length
        at = np.zeros(n, np.intp)
        at[begin[1:]] = 1
        np.cumsum(at, out=at)
        step = np.take(first, pairs)
        step -= begin
        step = np.take(step, at, mode="clip")
        step += np.arange(n)
        node = np.take(node, step, mode="clip")
        v = []
        for h, table in zip(hashed, self.values):
            slot = np.take(h, at, mode="clip")
            slot ^= node
            slot &= np.uint32(len(table) - 1)
            v.append(np.take(table, slot, mode="clip"))
        gate = ((v[-1] & 15) * np.int16(CLASSES) + (v[-2] & 15) + ((v[-3] & 15) >> 1) * np.int16(CLASSES * CLASSES)).astype(np.intp)
        node >>= np.uint32(31)
        return at, node.astype(kind), [x.astype(kind, copy=False) for x in v], gate

    def walk(self, text: np.ndarray, pairs: np.ndarray, hashed: list[np.ndarray], kind: type = np.float32) -> Iterator[tuple]:
        """``bits`` of the text's positions by depth: those of the trees' roots first."""
        at, bit, values, gate = self.bits(pairs, hashed, kind)
        depth = np.arange(len(at)) - np.searchsorted(at, at)
        for d in range(int(depth.max(initial=-1)) + 1):
            own = np.flatnonzero(depth == d)
            yield at[own], bit[own], [x[own] for x in values], gate[own]


#: How fast the chance moves with the log odds, in the middle of each bucket.
_CURVE = 1 / (2 + 2 * np.cosh((np.arange(BUCKETS) + 0.5) * (2 * REACH / BUCKETS) - REACH))


def bucket_of(odds: np.ndarray) -> np.ndarray:
    """The last stage's bucket of log odds."""
    x = odds + np.float32(REACH)
    x *= np.float32(BUCKETS / (2 * REACH))
    return np.clip(x, 0, BUCKETS - 1, out=x).astype(np.intp)


def _levels() -> np.ndarray:
    """The level of each slot value, at value + 2 ** 15."""
    odds = np.arange(-(1 << 15), 1 << 15) / UNIT
    return (np.sign(odds) * np.searchsorted(EDGES, np.abs(odds), side="right") + len(EDGES)).astype(np.intp)


_LEVEL = _levels()


def _by_level(values: np.ndarray) -> np.ndarray:
    """16 * level + class of slot values: a byte a slot."""
    return (np.take(_LEVEL, values.astype(np.intp) + (1 << 15)) * 16 + (values & 15)).astype(np.uint8)


def levelled(model: Model) -> Model:
    """The model with levels instead of log odds in its tables, where they aren't in them yet."""
    return Model(model.tree, [v if v.dtype == np.uint8 else _by_level(v) for v in model.values], model.weights, model.correction)


_STANDS = np.array([-x for x in STANDS[:0:-1]] + list(STANDS))
#: Positions that are looked at together, as a power of two.
TOGETHER = 21


def add_cells(model: Model, text: np.ndarray, ends: np.ndarray, cells: np.ndarray) -> None:
    """Adds all bits of the texts to the counts that the fit starts from; the model is ``levelled``."""
    every, hashed = model.tree.places(text, ends), contexts(text, ends)
    low = (1 << TOGETHER) - 1
    for a in range(0, len(text), 1 << TOGETHER):
        pairs, h = every[a : a + low + 1], [x[a : a + low + 1] for x in hashed]
        # The two longest contexts and the next byte mostly come again, so the tree is walked once for each; the sort brings equal ones together.
        key = h[-2].astype(np.int64)
        key <<= 32
        key |= h[-1]
        key *= 0x1E3779B97F4A7C15
        key ^= key >> 32
        key += pairs
        key *= 0x58476D1CE4E5B9
        key &= ~low
        key |= np.arange(len(key))
        key.sort()
        key &= low
        new = np.zeros(len(key), bool)
        new[0] = True
        for x in (pairs, *h[-2:]):  # the last six bytes have the shorter contexts in them
            x = np.take(x, key, mode="clip")
            new[1:] |= x[1:] != x[:-1]
        new = np.flatnonzero(new)
        times, key = np.diff(np.append(new, len(key))), key[new]
        for b in range(0, len(key), RUN):
            some = key[b : b + RUN]
            at, bit, x, cell = model.bits(np.take(pairs, some), [np.take(v, some) for v in h], np.uint8)
            for v in x:
                cell *= LEVELS
                cell += v >> 4
            cell *= 2
            cell += bit
            np.add.at(cells, cell, np.take(times[b : b + RUN], at, mode="clip"))


def fit(model: Model, cells: np.ndarray, rounds: int = 6) -> None:
    """Sets what documents begin with: for each gate a logistic regression of the bit, by Newton's steps with a pull to START; then the correction of each bucket."""
    counts = cells.reshape(-1, 2)
    at = np.flatnonzero(counts.any(axis=1))
    ones, many = counts[at, 1].astype(float), counts[at].sum(axis=1).astype(float)
    x = np.zeros((PREDICTORS, len(at)))
    for k in reversed(range(PREDICTORS)):
        at, level = np.divmod(at, LEVELS)
        x[k] = _STANDS[level]
    for turn in range(rounds + 1):
        odds = sum(x[k] * model.weights[at, k] for k in range(PREDICTORS))
        p = 1 / (1 + np.exp(-np.clip(odds, -20, 20)))
        error, curve = ones - many * p, many * p * (1 - p)
        if turn == rounds:
            b = bucket_of(odds.astype(np.float32))
            model.correction = np.bincount(b, error, BUCKETS) / (np.bincount(b, curve, BUCKETS) + MAP_PULL)
            return
        slope, bend = np.zeros((GATES, PREDICTORS)), np.zeros((GATES, PREDICTORS, PREDICTORS))
        for k in range(PREDICTORS):
            slope[:, k] = np.bincount(at, error * x[k], GATES)
            for m in range(k + 1):
                bend[:, k, m] = np.bincount(at, curve * x[k] * x[m], GATES)
        bend += np.tril(bend, -1).transpose(0, 2, 1) + PULL * np.eye(PREDICTORS)
        slope -= PULL * (model.weights - np.array(START))
        model.weights = model.weights + np.clip(np.linalg.solve(bend, slope[..., None])[..., 0], -1, 1)


def costs(model: Model, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each text's cost in nats. Weights and corrections are refined after each block of a document, by all of its bits."""
    docs = len(ends) - 1
    total = np.zeros(docs)
    base = [np.ascontiguousarray(model.weights[:, k] / UNIT, np.float32) for k in range(PREDICTORS)]
    own = [np.zeros(docs, np.float32) for _ in range(PREDICTORS)]
    correction = np.tile(model.correction.astype(np.float32), (docs, 1))
    surety = np.full((docs, BUCKETS), MAP_PULL)
    pairs, hashed = model.tree.places(text, ends), contexts(text, ends)
    at, block = ends[:-1].copy(), FIRST_BLOCK
    left = np.flatnonzero(at < ends[1:])
    while len(left):
        every = np.minimum(block, ends[1:][left] - at[left])
        cuts = _first((np.cumsum(every) - every) // RUN).tolist() + [len(left)]
        for a, b in zip(cuts, cuts[1:]):
            some, n = left[a:b], every[a:b]
            starts = np.cumsum(n) - n
            where = np.arange(int(n.sum())) + np.repeat(at[some] - starts, n)
            near = np.take(pairs, where, mode="clip")
            many = np.add.reduceat(np.take(model.tree.length, near), starts, dtype=np.int64)
            first = np.cumsum(many) - many
            doc = np.repeat(np.arange(len(some)), many)
            # A weight for each document and gate of this block, and a correction for each document and bucket.
            weight = [(base[k][None, :] + own[k][some][:, None]).ravel() for k in range(PREDICTORS)]
            add = correction[some].ravel()
            _, bit, x, gate = model.bits(near, [np.take(h, where, mode="clip") for h in hashed])
            gate += doc * GATES
            mixed = x[0] * np.take(weight[0], gate, mode="clip")
            for k in range(1, PREDICTORS):
                mixed += x[k] * np.take(weight[k], gate, mode="clip")
            bucket = bucket_of(mixed)
            doc *= BUCKETS
            bucket += doc
            mixed += np.take(add, bucket, mode="clip")
            # error = bit - p(1); cost = -ln p(bit)
            np.negative(mixed, out=mixed)
            p = np.exp(np.minimum(mixed, np.float32(80), out=mixed), out=mixed)
            p += 1
            np.reciprocal(p, out=p)
            error = bit - p
            total[some] -= np.add.reduceat(np.log(1 - np.minimum(np.abs(error), MOST)), first, dtype=np.float64)
            for k in range(PREDICTORS):
                x[k] *= error
                own[k][some] += RATE / UNIT**2 * np.add.reduceat(x[k], first, dtype=np.float64) / np.sqrt(many + 16)
            surety[some] += np.bincount(bucket, minlength=len(add)).reshape(-1, BUCKETS) * _CURVE
            correction[some] += (np.bincount(bucket, error, len(add)).reshape(-1, BUCKETS) / surety[some]).astype(np.float32)
            at[some] += n
        block = min(LAST_BLOCK, block * 2)
        left = left[at[left] < ends[1:][left]]
    return total


# The corpus


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0, by hash), of windows and the next byte as the model reads them (kind 1), of documents (kind 2)."""
    follow, docs, held, waiting = np.zeros(WINDOWS << 8, np.int64), 0, [], 0

    def rows(kind, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])

    def together():
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    for batch in slices(batches):
        words = Words(batch.column("text"), lower=True)
        text, ends = stream(batch.column("text"))
        window = windows(text, ends).astype(np.intp)
        window <<= 8
        window |= text
        np.add.at(follow, window, 1)
        docs += batch.num_rows
        held.append(np.unique(words.hashes(), return_counts=True))
        waiting += len(held[-1][0])
        if waiting > HELD_WORDS:
            held = [together()]
            waiting = len(held[0][0])
            if waiting > HELD_WORDS // 2:
                yield rows(0, held[0][0].view(np.int64), held[0][1])
                held, waiting = [], 0
    if docs:
        if held:
            keys, counts = together()
            yield rows(0, keys.view(np.int64), counts)
        some = np.flatnonzero(follow)
        yield rows(1, some, follow[some])
        yield rows(2, np.zeros(1, np.int64), np.array([docs]))


_PORTION = "predictor int, part int, tuning boolean, salt long, counts binary"


def _packed(codec: pa.Codec, found: np.ndarray) -> bytes:
    """One part's counts: the number, and of the steps between places and of the counts a width each; then both, compressed."""
    count = found & ((1 << COUNT_BITS) - 1)
    step = np.diff((found >> COUNT_BITS) & ((2 << PART) - 1), prepend=0)
    out = [len(found).to_bytes(4, "little")]
    data = []
    for x in (step, count):
        top = int(x.max())
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
        out.append(bytes([width]))
        data.append(x.astype(f"<u{width}").tobytes())
    return b"".join(out) + codec.compress(b"".join(data), asbytes=True)


def _unpacked(codec: pa.Codec, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, tall = int.from_bytes(data[:4], "little"), data[4], data[5]
    flat = codec.decompress(data[6:], n * (wide + tall), asbytes=True)
    step, count = np.frombuffer(flat, f"<u{wide}", n), np.frombuffer(flat, f"<u{tall}", n, n * wide)
    return np.cumsum(step, dtype=np.int64), count


def _portions(found: np.ndarray, tuning: bool, salt: int) -> Iterator[pa.RecordBatch]:
    """A row for each part of a table that the counts touch."""
    codec = pa.Codec("zstd", compression_level=1)
    part = found >> COUNT_BITS + PART + 1
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    per = MOST_SLOTS - PART
    which = part[cuts]
    for k in range(0, len(cuts), 256):
        own = cuts[k : k + 257].tolist() + ([len(part)] if k + 257 > len(cuts) else [])
        w, n = which[k : k + 256], len(own) - 1
        data = [_packed(codec, found[a:b]) for a, b in zip(own, own[1:])]
        columns = [pa.array((w >> per).astype(np.int32)), pa.array((w & ((1 << per) - 1)).astype(np.int32)), pa.array([tuning] * n), pa.array([salt] * n, pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["predictor", "part", "tuning", "salt", "counts"])


def _total(data: pa.ChunkedArray) -> np.ndarray:
    codec, total = pa.Codec("zstd"), np.zeros(2 << PART, np.int64)
    for x in data:
        place, count = _unpacked(codec, x.as_py())
        np.add.at(total, place, count.astype(np.int64))
    return total


def _added(table: pa.Table) -> pa.Table:
    """Portions of one part as one portion, or two: the tuning documents' counts stay apart."""
    first = [table.column(c)[0].as_py() for c in ("predictor", "part", "salt")]
    out = []
    for tuning in (False, True):
        own = table.filter(pc.equal(table.column("tuning"), tuning))
        if not own.num_rows:
            continue
        total = _total(own.column("counts"))
        place = np.flatnonzero(total)
        out.append((first[0], first[1], tuning, first[2], _packed(pa.Codec("zstd", compression_level=1), _entries(place, total[place]))))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()))], ["predictor", "part", "tuning", "salt", "counts"])


_HALVES = ("values", "rest", "own")


def _values(table: pa.Table) -> pa.Table:
    """The values of one part of a predictor's slots from all of its counts; from those of texts not marked ``tuning``; and from those of marked ones."""
    tuning = table.column("tuning")
    own, rest = _total(table.filter(tuning).column("counts")), _total(table.filter(pc.invert(tuning)).column("counts"))
    made = {name: pa.array([slot_values(x).tobytes()], pa.binary()) for name, x in zip(_HALVES, (own + rest, rest, own))}
    return pa.table({"predictor": table.column("predictor")[:1], "part": table.column("part")[:1], **made})


def _summed(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Portions from all texts, those of a part added up in steps of bounded size."""
    salts = estimated_parts(texts, "text", 1, 8 << 20) // ADDED
    while salts:
        rows = rows.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("predictor", "part", "salt").applyInArrow(_added, _PORTION)
        salts //= ADDED
    return rows


def bit_parts(training: DataFrame, tree: Tree, bits: list[int]) -> DataFrame:
    """The slot values of all texts and of both halves (``_HALVES``), by predictor and part."""

    def work(batches):
        salt = TaskContext.get().partitionId()
        held = {tuning: [[] for _ in ORDERS] for tuning in (False, True)}  # each predictor's pairs by themselves: what a step takes is a third

        def portions(tuning):
            for k, found in enumerate(held[tuning]):
                pairs = merged(found, TIMES_BITS)
                found.clear()
                places = _bits_of(tree, bits[k], k, pairs)
                del pairs
                yield from _portions(merged([places]), tuning, salt)

        def many(tuning):
            return sum(len(x) for found in held[tuning] for x in found)

        for batch in slices(batches, limit=LARGE_SLICE):
            for tuning in held:
                own = batch.filter(pc.equal(batch.column("tuning"), tuning))
                if own.num_rows:
                    for found, pairs in zip(held[tuning], _pairs_by_predictor(bits, *stream(own.column("text")), tree)):
                        found.append(pairs)
                if many(tuning) > HELD_PAIRS:
                    for found in held[tuning]:
                        found[:] = [merged(found, TIMES_BITS)]
                    if many(tuning) > HELD_PAIRS * 3 // 4:
                        yield from portions(tuning)
                        release()
        for tuning in held:
            yield from portions(tuning)
        release()

    rows = _summed(training.mapInArrow(work, _PORTION), training)
    rows = rows.groupBy("predictor", "part").applyInArrow(_values, "predictor int, part int, " + ", ".join(f"{x} binary" for x in _HALVES))
    return rows.repartition("predictor", "part")  # so all are made at once, and then read a few after another


def bit_tables(parts: DataFrame, bits: list[int], *columns: str, levels: tuple[str, ...] = ()) -> list[list[np.ndarray]]:
    """For each of the columns, each predictor's slot values, of all texts or of a half; ``levels``: those to be as ``levelled``. Read once, as it is made anew each time."""
    out = {c: [np.zeros(1 << b, np.uint8 if c in levels else np.int16) for b in bits] for c in columns}
    for row in parts.select("predictor", "part", *columns).toLocalIterator():  # a part after another comes to the driver
        at = row["part"] << PART
        for c in columns:
            x = np.frombuffer(row[c], np.int16)
            out[c][row["predictor"]][at : at + (1 << PART)] = _by_level(x) if c in levels else x
    return list(out.values())


def bit_values(training: DataFrame, tree: Tree, bits: list[int]) -> tuple[list[np.ndarray], list[tuple[slice, np.ndarray]]]:
    """Each predictor's slot values from all texts; and by predictor where to put which values for those without the texts marked ``tuning``."""
    values, rest = bit_tables(bit_parts(training, tree, bits), bits, "values", "rest")
    return values, [(slice(None), x) for x in rest]


def bit_cells(texts: DataFrame, model: Model) -> np.ndarray:
    """The counts that the fit starts from, of all bits of the texts."""
    shared = texts.sparkSession.sparkContext.broadcast(levelled(model))

    def work(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches, limit=LARGE_SLICE):
            add_cells(shared.value, *stream(batch.column("text")), cells)
        place = np.flatnonzero(cells)
        yield from _portions(_entries(place, cells[place]), False, TaskContext.get().partitionId())

    rows = _summed(texts.mapInArrow(work, _PORTION), texts)
    out = np.zeros(-(-CELLS // (2 << PART)) * (2 << PART), np.int64)
    for row in rows.groupBy("predictor", "part").applyInArrow(_added, _PORTION).toLocalIterator():
        place, count = _unpacked(pa.Codec("zstd"), row["counts"])
        np.add.at(out, (((row["predictor"] << MOST_SLOTS - PART) + row["part"]) << PART + 1) + place, count.astype(np.int64))
    shared.destroy()
    return out[:CELLS]


def trained(training: DataFrame, follow: np.ndarray) -> Model:
    """The model of texts (id, text), of which the byte pairs (or windows and next bytes) are counted already."""
    tree, bits = Tree.of(follow), slot_bits(int(follow.sum()))
    training = training.select("text", (F.pmod(F.xxhash64(F.lit(9), "id", "text"), F.lit(2)) == 1).alias("tuning"))
    values, rest, own = bit_tables(bit_parts(training, tree, bits), bits, *_HALVES, levels=_HALVES[1:])
    cells = sum(bit_cells(training.filter(half).select("text"), Model.start(tree, others)) for half, others in ((F.col("tuning"), rest), (~F.col("tuning"), own)))
    del rest, own
    model = Model.start(tree, values)
    fit(model, cells)
    return model


def score(docs: DataFrame, learn: Column, held: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where ``learn`` holds."""
    spark = docs.sparkSession
    training = docs.filter(learn).select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    small_batches(spark)
    counted = cut(training.select("text").mapInArrow(_word_rows, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), by="key")
    words = counted.filter("kind = 0").select("key", "n")
    few = {(r["kind"], r["key"]): r["n"] for r in counted.filter("kind > 0").toLocalIterator()}
    train_docs = few.get((2, 0), 0)
    level = F.floor(F.log2("n")).cast("int")
    levels = sorted(((r["level"], r["words"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).toLocalIterator()), reverse=True)
    distinct = sum(x[1] for x in levels) + (train_docs > 0)
    tokens = sum(x[2] for x in levels) + train_docs
    least, kept = 63, 0
    for lev, many, _ in levels:
        if kept + many > FREQUENT:
            break
        least, kept = lev, kept + many
    frequent = words.filter(level >= least).toArrow() if kept else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    keys = np.asarray(frequent.column("key").combine_chunks()).view(np.uint64)
    order = np.argsort(keys)
    known = (keys[order], np.asarray(frequent.column("n").combine_chunks())[order])
    follow = np.zeros(WINDOWS << 8, np.int64)
    for (kind, place), n in few.items():
        if kind == 1:
            follow[place] = n
    shared = spark.sparkContext.broadcast((trained(training, follow), known))
    scale = tokens + distinct + 1

    def work(batches):
        model, (keys, counts) = shared.value
        gain = np.log10(counts + 1.0)
        row = TaskContext.get().partitionId() << 33
        names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "key", "times"]
        for batch in slices(batches, limit=SLICE_BYTES):
            column = batch.column("text")
            text, ends = stream(column)
            nats = costs(model, text, ends)
            w = Words(column, lower=True)
            coded = pa.array(w.hashes()).dictionary_encode()
            unique, back = np.asarray(coded.dictionary), np.asarray(coded.indices)
            at = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
            found = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
            value = np.where(found, gain[at], 0.0) if len(keys) else np.zeros(len(unique))
            n = batch.num_rows
            doc = np.repeat(np.arange(n), w.counts)
            base = np.bincount(doc, value[back], n) + math.log10(train_docs + 1)
            sure = np.bincount(doc, found[back], n).astype(np.int64) + (train_docs > 0)
            length = w.counts + 1
            ids = np.arange(row, row + n)
            row += n
            empty = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("id"), batch.column("held_out"), pa.array(length.astype(np.int64)), pa.array(sure), pa.array(base), pa.array(-nats / LN10), empty(pa.int64()), empty(pa.int64())], names)
            # Occurrences of other words: one row for each word of a document.
            rare = ~found[back]
            pair, times = np.unique(doc[rare] * len(unique) + back[rare], return_counts=True)
            if m := len(pair):
                empty = lambda kind: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pair // len(unique)]), empty(batch.column("id").type), empty(pa.bool_()), *(empty(pa.int64()) for _ in range(2)), *(empty(pa.float64()) for _ in range(2)), pa.array(unique[pair % len(unique)].view(np.int64)), pa.array(times)], names)

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(docs[id_column].alias("id"), held.alias("held_out"), docs[text_column].alias("text"))
    rows = cut(picked.mapInArrow(work, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, key long, times long"), by="row")
    rest = rows.filter("key is not null").select("row", "key", "times").join(words, "key")
    rest = rest.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    out = rows.filter("key is null").join(rest, "row", "left")
    base = F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(scale))
    return out.select(F.col("id").alias(id_column), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    out = held_out("doc_id", modulus, remainder)
    return score(docs, ~out, out)
