"""Lossless WebP media columns: a decoder for whole columns of images, and a writer for byte payloads.

The decoder reads prefix codes (simple and normal, with meta codes), back-references and the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms. Many images are decoded in step: each turn reads one
token of every unfinished image with array operations, so the cost for each pixel does not depend on one image's length.

The writer stores bytes as 48 RGBA pixels a row (192 bytes), in tiles of at most ``TILE_ROWS`` rows, each tile a file of
its own; the stored form is the tiles one after another. A tile takes the smallest of three forms: the fixed prefix codes
for its bytes, those with a colour cache, or a palette with codes of its own. Repeated pixels become back-references. A
tile's form depends on its bytes alone, so equal payloads give equal bytes.

Defined cases: a null or empty text is stored as one row of spaces; very long texts give many tiles; rows that repeat a
doc_id give a row each; an empty table gives no rows; other columns, whatever their names, are ignored; a damaged file
raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.common import LARGE_SLICE, raw, slices

# Fixed values of the format.
LENGTH_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
OPAQUE_BLACK = 0xFF000000
#: Short distance codes 1..120: offsets (x back, y up), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))

PIXELS = 48
ROW_BYTES = 4 * PIXELS
TILE_ROWS = 64


# Reading


class _Bits:
    """Bits of one file, least significant first, from a position."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        a = self.at >> 3
        out = int.from_bytes(self.data[a : a + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("image data ends early")
        return out

    def peek(self) -> int:
        """The next 15 bits, zeros beyond the end."""
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 8], "little") >> (self.at & 7) & 0x7FFF


@lru_cache(maxsize=4096)
def _table(lengths: bytes) -> np.ndarray:
    """symbol << 4 | length for every value of the next bits; lengths[s] is symbol s's code length."""
    n = np.frombuffer(lengths, np.uint8).astype(np.int64)
    used = np.flatnonzero(n)
    if len(used) == 0:
        return np.zeros(1, np.int64)
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.int64)
    most = int(n.max())
    used = used[np.lexsort((used, n[used]))]
    if int((1 << (most - n[used])).sum()) != 1 << most:
        raise ValueError("prefix code isn't complete")
    out = np.zeros(1 << most, np.int64)
    code, size = 0, int(n[used[0]])
    for s in used.tolist():
        code <<= int(n[s]) - size
        size = int(n[s])
        back = int(f"{code:0{size}b}"[::-1], 2)
        out[back :: 1 << size] = s << 4 | size
        code += 1
    return out


def _read_lengths(bits: _Bits, size: int) -> bytes:
    out = bytearray(size)
    if bits.read(1):
        count, wide = bits.read(1) + 1, bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if count == 2 else [])]
        if max(symbols) >= size:
            raise ValueError("symbol beyond the alphabet")
        for s in symbols:
            out[s] = 1
        return bytes(out)
    count = bits.read(4) + 4
    own = bytearray(19)
    for s in LENGTH_CODE_ORDER[:count]:
        own[s] = bits.read(3)
    table = _table(bytes(own)).tolist()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    mask, at, last = len(table) - 1, 0, 8
    while at < size and left:
        left -= 1
        entry = table[bits.peek() & mask]
        bits.read(entry & 15)
        s = entry >> 4
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
            continue
        run, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + run > size:
            raise ValueError("code lengths beyond the alphabet")
        out[at : at + run] = bytes([value]) * run
        at += run
    return bytes(out)


class _Job:
    """One entropy-coded image: where its tokens start, its size, cache and prefix codes."""

    def __init__(self, at: int, width: int, height: int, cache: int, groups: list, meta=None, meta_bits: int = 0):
        self.at, self.width, self.height, self.cache, self.groups, self.meta, self.meta_bits = at, width, height, cache, groups, meta, meta_bits
        self.end = at


#: Equal header bits parse equally: (header as a number, its bits) -> its tables, by the first bytes.
_headers: dict[tuple, list[tuple[int, int, list]]] = {}


def _groups(bits: _Bits, count: int, cache: int) -> list:
    sizes = (LITERALS + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)
    a, shift = bits.at >> 3, bits.at & 7
    key = (count, cache, shift, bits.data[a + 1 : a + 9])
    for value, n, groups in _headers.get(key, ()):
        if int.from_bytes(bits.data[a : a + (n + shift + 7) // 8], "little") >> shift & ((1 << n) - 1) == value:
            bits.at += n
            return groups
    begin = bits.at
    groups = [[_table(_read_lengths(bits, s)) for s in sizes] for _ in range(count)]
    n = bits.at - begin
    if len(_headers) < 256:
        _headers.setdefault(key, []).append((int.from_bytes(bits.data[a : a + (n + shift + 7) // 8], "little") >> shift & ((1 << n) - 1), n, groups))
    return groups


def _image(bits: _Bits, width: int, height: int, main: bool) -> _Job:
    """Reads an entropy-coded image up to its tokens; meta images and transform data are decoded on the way."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("colour cache too large")
    meta, meta_bits, count = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = _whole(bits, -(-width >> meta_bits), -(-height >> meta_bits)) >> 8 & 0xFFFF
        count = int(meta.max()) + 1
    groups = _groups(bits, count, cache)
    return _Job(bits.at, width, height, cache, groups, meta, meta_bits)


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from every byte on, as signed 64-bit numbers."""
    padded = np.frombuffer(data + bytes(16), np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + 8]).view("<i8")[:, 0]


def _whole(bits: _Bits, width: int, height: int) -> np.ndarray:
    """An entropy-coded image that stands inside another's header, (height, width)."""
    job = _image(bits, width, height, False)
    out = _tokens(_words(bits.data), [job])[0]
    bits.at = job.end
    return out


def _value(words: np.ndarray, prefix: int, at: int) -> tuple[int, int]:
    """The value of a length or distance prefix symbol, and the bits it takes."""
    if prefix < 4:
        return prefix + 1, 0
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + (int(words[at >> 3]) >> (at & 7) & ((1 << n) - 1)) + 1, n


def _tokens(words: np.ndarray, jobs: list[_Job]) -> list[np.ndarray]:
    """The pixels (alpha, red, green, blue from the top byte) of each job's image, all jobs in step."""
    total = np.array([j.width * j.height for j in jobs], np.int64)
    base = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.int64)
    bit = np.array([j.at for j in jobs], np.int64)
    pos = np.zeros(len(jobs), np.int64)
    tables: dict[int, int] = {}
    kept, filled = [], 0
    at_rows, mask_rows, first = [], [], []
    for j in jobs:
        first.append(len(at_rows))
        for group in j.groups:
            for t in group:
                if id(t) not in tables:
                    tables[id(t)] = filled
                    kept.append(t)
                    filled += len(t)
            at_rows.append([tables[id(t)] for t in group])
            mask_rows.append([len(t) - 1 for t in group])
    table, code_at, code_mask, first = np.concatenate(kept), np.array(at_rows), np.array(mask_rows), np.array(first)
    wide = int((np.log2(code_mask[:, :4] + 1)).sum(axis=1).max()) > 56
    cache_bits = np.array([j.cache for j in jobs], np.int64)
    cache_at = np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 0)) - np.where(cache_bits > 0, 1 << cache_bits, 0)
    cache = np.zeros(int(np.where(cache_bits > 0, 1 << cache_bits, 0).sum()), np.int64)
    has_meta = np.array([j.meta is not None for j in jobs])
    limit = 8 * len(words)

    def row_of(k: int) -> int:
        j = jobs[k]
        if j.meta is None:
            return int(first[k])
        y, x = divmod(int(pos[k]), j.width)
        return int(first[k]) + int(j.meta[y >> j.meta_bits, x >> j.meta_bits])

    def remember(k: int, pixels: np.ndarray) -> None:
        if cache_bits[k]:
            at = (pixels * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - int(cache_bits[k]))
            for i, p in zip(at.tolist(), pixels.tolist()):
                cache[int(cache_at[k]) + i] = p

    def special(k: int, symbol: int, at: int, row: int) -> None:
        """A back-reference of image k; ``at``: the bit after the symbol."""
        p = int(pos[k])
        length, n = _value(words, symbol - LITERALS, at)
        at += n
        entry = int(table[code_at[row, 4] + (int(words[at >> 3]) >> (at & 7) & int(code_mask[row, 4]))])
        at += entry & 15
        code, n = _value(words, entry >> 4, at)
        at += n
        if code > len(NEAR):
            back = code - len(NEAR)
        else:
            x, y = NEAR[code - 1]
            back = max(1, x + y * jobs[k].width)
        if back > p or p + length > total[k]:
            raise ValueError("back-reference beyond the image")
        a = int(base[k]) + p
        if back >= length:
            out[a : a + length] = out[a - back : a - back + length]
        else:
            out[a : a + length] = np.resize(out[a - back : a], length)
        remember(k, out[a : a + length])
        pos[k], bit[k] = p + length, at

    active = np.flatnonzero(total > 0)
    while len(active):
        meta, cached = bool(has_meta[active].any()), bool(cache_bits[active].any())
        row = first[active]
        a0, a1, a2, a3 = code_at[row, :4].T.copy()
        m0, m1, m2, m3 = code_mask[row, :4].T.copy()
        b, to = bit[active], base[active] + pos[active]
        keepers = np.flatnonzero(cache_bits[active])
        slots_at, slot_shift = cache_at[active[keepers]], 32 - cache_bits[active[keepers]]
        turns, mixed = int((total[active] - pos[active]).min()), False
        done = 0
        while done < turns and not mixed:
            if meta:
                bit[active], pos[active] = b, to - base[active]
                row = np.array([row_of(k) for k in active.tolist()])
                a0, a1, a2, a3 = code_at[row, :4].T
                m0, m1, m2, m3 = code_mask[row, :4].T
            w = words[b >> 3] >> (b & 7)
            e0 = table[a0 + (w & m0)]
            n = e0 & 15
            used = n
            w = w >> n
            e1 = table[a1 + (w & m1)]
            n = e1 & 15
            used = used + n
            if wide:
                c = b + used
                w = words[np.minimum(c >> 3, len(words) - 1)] >> (c & 7)
            else:
                w = w >> n
            e2 = table[a2 + (w & m2)]
            n = e2 & 15
            used = used + n
            w = w >> n
            e3 = table[a3 + (w & m3)]
            used = used + (e3 & 15)
            s = e0 >> 4
            pixel = (e3 >> 4) << 24 | (e1 >> 4) << 16 | s << 8 | e2 >> 4
            if cached and int(s.max()) >= LITERALS + LENGTHS:
                hit = np.flatnonzero(s >= LITERALS + LENGTHS)
                pixel[hit] = cache[cache_at[active[hit]] + s[hit] - LITERALS - LENGTHS]
                used[hit] = e0[hit] & 15
                s[hit] = 0
            if int(s.max()) < LITERALS:
                out[to] = pixel
                if cached:
                    p = pixel[keepers]
                    cache[slots_at + ((p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> slot_shift)] = p
                b = b + used
                to = to + 1
                done += 1
                if int(b.max()) >= limit:
                    raise ValueError("image data ends early")
            else:
                plain = s < LITERALS
                bit[active], pos[active] = np.where(plain, b + used, b), to - base[active] + plain
                out[to[plain]] = pixel[plain]
                if cached:
                    own = plain[keepers]
                    p = pixel[keepers[own]]
                    cache[slots_at[own] + ((p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> slot_shift[own])] = p
                for i in np.flatnonzero(~plain).tolist():
                    special(int(active[i]), int(s[i]), int(b[i] + (e0[i] & 15)), int(row[i]))
                mixed = True
        if not mixed:
            bit[active], pos[active] = b, to - base[active]
        if int(bit.max()) >= limit:
            raise ValueError("image data ends early")
        active = active[pos[active] < total[active]]
    for j, e in zip(jobs, bit.tolist()):
        j.end = e
    return [out[a : a + n].reshape(j.height, j.width) for j, a, n in zip(jobs, base.tolist(), total.tolist())]


# Transforms


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) bytes as wide integers: alpha, red, green, blue."""
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def _joined(channels: np.ndarray) -> np.ndarray:
    c = channels & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left, top, corner, right):
    """One pixel's prediction from its neighbours' channels: left, top, top-left, top-right."""
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        return left if int(np.abs(top - corner).sum()) < int(np.abs(left - corner).sum()) else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        difference = mean - corner
        return np.clip(mean + (difference + (difference < 0) >> 1), 0, 255)
    return np.array([255, 0, 0, 0])


def _unpredict(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    d = _channels(pixels)
    h, w = pixels.shape
    d[0, 0] = (d[0, 0] + [255, 0, 0, 0]) & 255
    d[0] = np.cumsum(d[0], axis=0) & 255
    for y in range(1, h):
        above = d[y - 1]
        d[y, 0] = (d[y, 0] + above[0]) & 255
        kinds = (modes[y >> bits] >> 8 & 15)[np.arange(w) >> bits]
        if w > 1 and len(set(kinds[1:].tolist())) == 1 and kinds[1] in (0, 2, 3, 4, 8, 9):  # nothing of this row is needed
            right = np.concatenate([above[2:], d[y, :1]])
            d[y, 1:] = (d[y, 1:] + _predicted(int(kinds[1]), None, above[1:], above[:-1], right)) & 255
            continue
        for x in range(1, w):
            right = above[x + 1] if x + 1 < w else d[y, 0]
            d[y, x] = (d[y, x] + _predicted(int(kinds[x]), d[y, x - 1], above[x], above[x - 1], right)) & 255
    return _joined(d)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255) - ((x & 128) << 1)


def _uncross(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    h, w = pixels.shape
    f = factors[(np.arange(h) >> bits)[:, None], (np.arange(w) >> bits)[None, :]]
    c = _channels(pixels)
    green = _signed(c[..., 2])
    c[..., 1] = (c[..., 1] + (_signed(f) * green >> 5)) & 255
    c[..., 3] = c[..., 3] + (_signed(f >> 8) * green >> 5) + (_signed(f >> 16) * _signed(c[..., 1]) >> 5)
    return _joined(c)


def _add_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _joined(c)


def _unindex(pixels: np.ndarray, palette: np.ndarray, width: int, shift: int) -> np.ndarray:
    each, bits = 1 << shift, 8 >> shift
    index = pixels >> 8 & 255
    if shift:
        index = (index[:, :, None] >> (np.arange(each) * bits) & ((1 << bits) - 1)).reshape(len(index), -1)[:, :width]
    return np.concatenate([palette, np.zeros(256 - len(palette), np.int64)])[index]


def _open(data: bytes) -> bytes:
    """The image data of a file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image data")


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The images as (height, width, 4) arrays of 8-bit red, green, blue, alpha."""
    bodies, jobs, undo, start = [], [], [], 0
    for file in files:
        body = _open(file)
        bits = _Bits(body, 8)
        if body[:1] != b"\x2f":
            raise ValueError("bad signature")
        width, height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        steps, w, seen = [], width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise ValueError("a transform comes twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                size = bits.read(3) + 2
                steps.append((kind, _whole(bits, -(-w >> size), -(-height >> size)), size, w))
            elif kind == SUBTRACT_GREEN:
                steps.append((kind, None, 0, w))
            else:
                n = bits.read(8) + 1
                palette = _joined(np.cumsum(_channels(_whole(bits, n, 1)[0]), axis=0))
                shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                steps.append((kind, palette, shift, w))
                w = -(-w >> shift)
        job = _image(bits, w, height, True)
        job.at += 8 * start
        bodies.append(body)
        start += len(body)
        jobs.append(job)
        undo.append(steps)
    if not files:
        return []
    out = []
    for pixels, steps in zip(_tokens(_words(b"".join(bodies)), jobs), undo):
        for kind, data, size, w in reversed(steps):
            if kind == PREDICTOR:
                pixels = _unpredict(pixels, data, size)
            elif kind == CROSS_COLOUR:
                pixels = _uncross(pixels, data, size)
            elif kind == SUBTRACT_GREEN:
                pixels = _add_green(pixels)
            else:
                pixels = _unindex(pixels, data, w, size)
        flat = np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)
        out.append(flat[..., [2, 1, 0, 3]])
    return out


def decode(file: bytes) -> np.ndarray:
    return decode_many([file])[0]


# Writing


def code_lengths(weights: list[float], most: int) -> list[int]:
    """Huffman code lengths of at most ``most``; symbols of weight 0 get none."""
    used = [i for i, w in enumerate(weights) if w > 0]
    out = [0] * len(weights)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    floor = 0.0
    while True:
        heap = [(max(weights[i], floor), i, (i,)) for i in used]
        heapq.heapify(heap)
        for i in used:
            out[i] = 0
        n = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                out[i] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(out) <= most:
            return out
        floor = max(floor * 2, max(weights) / (1 << most))


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes, bits reversed for a stream that starts at the least significant bit."""
    out, code, size = [0] * len(lengths), 0, 0
    for s in sorted((s for s, n in enumerate(lengths) if n), key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - size
        size = lengths[s]
        out[s] = int(f"{code:0{size}b}"[::-1], 2)
        code += 1
    return out


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def prefix_code(self, lengths: list[int]) -> None:
        """Writes a code's lengths: the simple form where it can, else runs coded by a prefix code of their own."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 2 and all(s < 256 for s in used) and all(lengths[s] == 1 for s in used):
            used = used or [0]
            self.write(1, 1)
            self.write(len(used) - 1, 1)
            self.write(1, 1)
            for s in used:
                self.write(s, 8)
            return
        runs, at, last = [], 0, 8
        while at < len(lengths):
            n = 1
            while at + n < len(lengths) and lengths[at + n] == lengths[at]:
                n += 1
            value = lengths[at]
            if value == 0 and n >= 3:
                n = min(n, 138)
                runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            elif value and value == last and n >= 3:
                n = min(n, 6)
                runs.append((16, n - 3, 2))
            else:
                n = 1
                runs.append((value, 0, 0))
                last = value or last
            at += n
        count = [0] * 19
        for s, _, _ in runs:
            count[s] += 1
        own = code_lengths(count, 7)
        order = [own[s] for s in LENGTH_CODE_ORDER]
        while len(order) > 4 and not order[-1]:
            order.pop()
        self.write(0, 1)
        self.write(len(order) - 4, 4)
        for n in order:
            self.write(n, 3)
        self.write(0, 1)
        code = codes(own)
        single = sum(n > 0 for n in own) == 1
        for s, extra, n in runs:
            if not single:
                self.write(code[s], own[s])
            self.write(extra, n)


def container(body: bytes) -> bytes:
    body_ = body + bytes(len(body) & 1)
    return b"RIFF" + (12 + len(body_)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body_


#: Letters by falling frequency in Latin-script prose; weights halve about every four places.
FREQUENT = " etaoinsrhldcumpfgbvwykqxjz.,\n"


def _weights(top: int) -> list[float]:
    w = [0.0] * 256
    for b in range(top):
        w[b] = 2e-4
    for b in range(128, top):
        w[b] = 2e-3
    for b in (*range(0x41, 0x5B), *range(0x30, 0x3A)):
        w[b] = 1e-3
    for i, c in enumerate(FREQUENT):
        w[ord(c)] = 0.2 * 2.0 ** (-i / 4)
    return w


#: Colour cache: its slots' bits, and the share of tokens that its symbols are meant to be.
CACHE_BITS, CACHE_SHARE = 9, 0.3
#: Tiles of at most this many colours are also tried as palette images.
MOST_COLOURS = 16
_ONE_BACK = [0, 1, *[0] * (DISTANCES - 2)]  # the only distance symbol (code 2: one back) takes no bits


@lru_cache(maxsize=None)
def _profile(top: int, cached: bool):
    """A fixed code for bytes below ``top``, with a colour cache or without.

    Code and length of every byte (green, others), those of the run symbols and of the cache's slots, and the header's bits.
    """
    base = _weights(top)
    slots = 1 << CACHE_BITS if cached else 0
    cache = [sum(base) * CACHE_SHARE / (1 - CACHE_SHARE) / slots] * slots if cached else []
    green = code_lengths([*base, *[2e-3] * LENGTHS, *cache], 14)
    other = code_lengths(base, 12)
    head = BitWriter()
    head.write(0, 1)  # no transform
    head.write(int(cached), 1)
    if cached:
        head.write(CACHE_BITS, 4)
    head.write(0, 1)  # no meta codes
    for lengths in (green, other, other, other, _ONE_BACK):
        head.prefix_code(lengths)
    own = codes(green)
    code = np.array([own[:256], codes(other)], np.int64)
    size = np.array([green[:256], other], np.int64)
    runs, slot = slice(256, 256 + LENGTHS), slice(256 + LENGTHS, None)
    return code, size, own[runs], green[runs], np.array(own[slot], np.int64), np.array(green[slot], np.int64), head.value, head.n


def _run_token(length: int) -> tuple[int, int]:
    """Prefix symbol 0..23 and extra bits of a back-reference length."""
    if length <= 4:
        return length - 1, 0
    x = length - 1
    n = x.bit_length() - 1
    return 2 * n + (x >> (n - 1) & 1), n - 1


@lru_cache(maxsize=8192)
def _run_bits(top: int, cached: bool, length: int) -> tuple[int, int]:
    """A back-reference of ``length`` pixels to the pixel before: its bits and their count."""
    _, _, code, size, *_ = _profile(top, cached)
    symbol, n = _run_token(length)
    extra = (length - 1) & ((1 << n) - 1)
    return code[symbol] | extra << size[symbol], size[symbol] + n


def _cache_hits(argb: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cache slot of every pixel, and whether that slot holds the pixel when its turn comes.

    Every pixel enters the cache, so a slot holds the last pixel of the tile that fell into it.
    """
    slot = (argb * np.uint32(CACHE_MULTIPLIER) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    key = tile << CACHE_BITS | slot
    order = np.argsort(key, kind="stable")
    key, value = key[order], argb[order]
    hit = np.zeros(len(argb), bool)
    hit[order[1:]] = (key[1:] == key[:-1]) & (value[1:] == value[:-1])
    return slot, hit


def _palette_file(argb: np.ndarray, colours: np.ndarray) -> tuple[int, int]:
    """A tile of few colours as a palette image with codes of its own: the bits after the image's size, and their count."""
    k = len(colours)
    shift = 3 if k <= 2 else 2 if k <= 4 else 1
    index = np.searchsorted(colours, argb).reshape(-1, 1 << shift)
    packed = (index << (np.arange(1 << shift) * (8 >> shift))).sum(axis=1)
    tokens, edges = [], np.concatenate([[0], np.flatnonzero(np.diff(packed)) + 1, [len(packed)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        literal = int(packed[a])
        tokens.append((literal, 0, 0))
        rest = b - a - 1
        while rest >= 3:
            n = min(rest, 4096)
            symbol, extra = _run_token(n)
            tokens.append((256 + symbol, (n - 1) & ((1 << extra) - 1), extra))
            rest -= n
        tokens += [(literal, 0, 0)] * rest
    out = BitWriter()
    out.write(1 | PALETTE << 1 | (k - 1) << 3, 11)
    out.write(0, 1)  # the palette's image has no cache
    samples = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))[:, [1, 2, 0, 3]]
    channels = []
    for j in range(4):
        count = np.bincount(samples[:, j], minlength=256 + LENGTHS * (j == 0)).tolist()
        lengths = code_lengths(count, 15)
        out.prefix_code(lengths)
        channels.append((codes(lengths), lengths, sum(n > 0 for n in lengths) > 1))
    out.prefix_code(_ONE_BACK)
    for row in samples.tolist():
        for x, (code, size, several) in zip(row, channels):
            if several:
                out.write(code[x], size[x])
    out.write(0, 3)  # no further transform, no cache, no meta codes
    count = [0] * (256 + LENGTHS)
    for symbol, _, _ in tokens:
        count[symbol] += 1
    lengths = code_lengths(count, 15)
    out.prefix_code(lengths)
    for _ in range(3):
        out.prefix_code([1, *[0] * 255])
    out.prefix_code(_ONE_BACK)
    code, several = codes(lengths), sum(n > 0 for n in lengths) > 1
    for symbol, extra, n in tokens:
        if several:
            out.write(code[symbol], lengths[symbol])
        out.write(extra, n)
    return out.value, out.n


def encode_rows(payload: np.ndarray, tile_rows: np.ndarray) -> list[bytes]:
    """Files of consecutive tiles; tile i has the next tile_rows[i] rows of 192 bytes (red, green, blue, alpha by turns).

    Each tile takes the smallest of its forms: the fixed code of its bytes, that code with a colour cache, a palette.
    """
    pixels = payload.reshape(-1, 4)
    count = tile_rows * PIXELS
    first = np.cumsum(count) - count
    tile = np.repeat(np.arange(len(count)), count)
    wide = np.maximum.reduceat(pixels.max(axis=1), first) >= 128
    of = wide.astype(np.int64)[tile]
    argb = np.ascontiguousarray(pixels[:, [2, 1, 0, 3]]).view("<u4").ravel()
    slot, hit = _cache_hits(argb, tile)
    # Pixels equal to the one before, in runs of at least 3, become back-references.
    same = np.zeros(len(argb), bool)
    same[1:] = argb[1:] == argb[:-1]
    same[first] = False
    edge = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= 3
    runs = list(zip(begin[long].tolist(), end[long].tolist()))
    forms = []
    for cached in (False, True):
        both = [_profile(top, cached) for top in (128, 256)]
        code, size = (np.stack([x[k] for x in both]) for k in (0, 1))
        c, n = code[of, 0, pixels[:, 1]], size[of, 0, pixels[:, 1]]
        for channel in (0, 2, 3):
            c |= code[of, 1, pixels[:, channel]] << n
            n += size[of, 1, pixels[:, channel]]
        if cached:
            c[hit] = np.stack([x[4] for x in both])[of[hit], slot[hit]]
            n[hit] = np.stack([x[5] for x in both])[of[hit], slot[hit]]
        for a, b in runs:
            n[a:b] = c[a:b] = 0
            top = 256 if of[a] else 128
            for k in range(a, b, 4096):
                c[k], n[k] = _run_bits(top, cached, min(4096, b - k))
        heads = [x[6] for x in both]
        head_bits = np.array([x[7] for x in both])[wide.astype(int)] + 40
        forms.append((c, n, heads, head_bits, head_bits + np.add.reduceat(n, first)))
    with_cache = forms[1][4] < forms[0][4]
    c, n = (np.where(with_cache[tile], forms[1][k], forms[0][k]) for k in (0, 1))
    head_bits, tile_bits = (np.where(with_cache, forms[1][k], forms[0][k]) for k in (3, 4))
    palettes = {}
    for k in np.flatnonzero(np.add.reduceat((~hit).astype(np.int64), first) <= 2 * MOST_COLOURS).tolist():
        own = argb[first[k] : first[k] + count[k]]
        colours = np.unique(own)
        if len(colours) <= MOST_COLOURS:
            bits, size = _palette_file(own, colours)
            if size + 40 < tile_bits[k]:
                palettes[k] = bits, size + 40
    # Bits of a tile: the header, its pixels, zeros up to whole 8 bytes.
    words = -(-tile_bits // 64) + 1
    word_at = np.cumsum(words) - words
    at = np.cumsum(n) - n
    at = at - np.repeat(at[first], count) + np.repeat(word_at * 64 + head_bits, count)
    keep = n > 0
    at, c = at[keep], c[keep].view(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[new]] |= np.bitwise_or.reduceat(c << shift, new)
    over = np.flatnonzero(shift > 0)
    spill = c[over] >> (np.uint64(64) - shift[over])
    some = np.flatnonzero(spill)
    out[word[over[some]] + 1] |= spill[some]
    data = memoryview(out.tobytes())
    files = []
    for k, (rows, w, cached, bits, head, a) in enumerate(zip(tile_rows.tolist(), wide.tolist(), with_cache.tolist(), tile_bits.tolist(), head_bits.tolist(), word_at.tolist())):
        begin = 0x2F | (PIXELS - 1) << 8 | (rows - 1) << 22 | 1 << 36
        if k in palettes:
            rest, bits = palettes[k]
            body = bytearray((begin | rest << 40).to_bytes(-(-bits // 8), "little"))
        else:
            begin |= forms[cached][2][w] << 40
            whole = head // 8 + 1
            body = bytearray(data[8 * a : 8 * a + -(-bits // 8)])
            body[:whole] = (begin | int.from_bytes(body[:whole], "little")).to_bytes(whole, "little")
        files.append(container(bytes(body)))
    return files


def form(file: bytes) -> str:
    """The first transform of a file, else ``cache`` or ``plain``."""
    bits = _open(file)[5]
    return ("predictor", "cross_colour", "subtract_green", "palette")[bits >> 1 & 3] if bits & 1 else "cache" if bits & 2 else "plain"


def padded(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text followed by bytes 32 up to a positive multiple of 192, and each one's rows."""
    n = np.diff(offsets)
    rows = np.maximum(1, -(-n // ROW_BYTES))
    start = (np.cumsum(rows) - rows) * ROW_BYTES
    out = np.full(int(rows.sum()) * ROW_BYTES, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(start - offsets[:-1], n)] = np.frombuffer(data, np.uint8)
    return out, rows


def tiles(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every tile, and n+1 offsets of the texts' tiles."""
    many = -(-rows // TILE_ROWS)
    ends = np.concatenate([[0], np.cumsum(many)])
    out = np.full(int(ends[-1]), TILE_ROWS, np.int64)
    out[ends[1:] - 1] = rows - (many - 1) * TILE_ROWS
    return out, ends


def split_files(media: bytes) -> list[bytes]:
    """The files of a stored form."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + n])
        at += n
    return out


def encode(texts: pa.Array) -> list[bytes]:
    """The stored form of every text."""
    payload, rows = padded(*raw(texts))
    tile_rows, ends = tiles(rows)
    files = encode_rows(payload, tile_rows)
    return [b"".join(files[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]


def feature(pixels: np.ndarray) -> str:
    """Rows and columns of the image, the mean sample of each channel and the mean absolute step between rows."""
    mean = pixels.reshape(-1, 4).mean(axis=0)
    step = float(np.abs(np.diff(pixels.astype(np.int16), axis=0)).mean()) if len(pixels) > 1 else 0.0
    return f"{pixels.shape[0]}x{pixels.shape[1]};" + ",".join(f"{x:.3f}" for x in mean) + f";{step:.3f}"


def store_and_read(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_media: bool = False) -> DataFrame:
    """Stores every text as lossless WebP, reads the stored bytes back and describes both; ``with_media`` adds the bytes. Map only.

    ``forms`` counts the files of each form, such as ``cache:3,plain:1``.
    """
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "forms", *["media"] * with_media]

    def work(batches):
        for batch in slices(batches, limit=LARGE_SLICE):
            column = batch.column("text")
            n_bytes = np.diff(raw(column)[1])
            media = encode(column)
            files = [split_files(m) for m in media]
            images = iter(decode_many([f for x in files for f in x]))
            rows = []
            for n, m, x in zip(n_bytes.tolist(), media, files):
                parts = [next(images) for _ in x]
                pixels = parts[0] if len(parts) == 1 else np.concatenate(parts)
                payload = pixels.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels), ",".join(f"{k}:{v}" for k, v in sorted(Counter(map(form, x)).items()))))
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds)), *([pa.array(media, pa.binary())] if with_media else [])], names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, forms string"
    return docs.select(docs[id_column], docs[text_column].alias("text")).mapInArrow(work, schema + (", media binary" if with_media else ""))
