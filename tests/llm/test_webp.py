"""The WebP decoder on files of every feature, made by a plain writer that follows the format bit by bit."""

import random

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import webp_lossless as W


def argb(pixels):
    """(h, w, 4) red, green, blue, alpha to numbers."""
    p = pixels.astype(np.int64)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def lz_prefix(value):
    if value <= 4:
        return value - 1, 0, 0
    x = value - 1
    n = x.bit_length() - 1
    return 2 * n + (x >> (n - 1) & 1), n - 1, x & ((1 << (n - 1)) - 1)


def entropy_image(bits, image, main, cache=0, meta=None, meta_bits=2, copies=True):
    """Writes an image's tokens: literals, cache hits, and copies of earlier runs."""
    h, w = image.shape
    flat = image.ravel().tolist()
    bits.write(1 if cache else 0, 1)
    if cache:
        bits.write(cache, 4)
    if main:
        bits.write(0 if meta is None else 1, 1)
        if meta is not None:
            bits.write(meta_bits - 2, 3)
            entropy_image(bits, meta.astype(np.int64) << 8, False)
    tokens, table, at = [], {}, 0
    while at < len(flat):
        best = (0, 0)
        if copies:
            for back in range(1, min(at, 300) + 1):
                n = 0
                while at + n < len(flat) and n < 4096 and flat[at + n] == flat[at + n - back]:
                    n += 1
                best = max(best, (n, -back))
        if best[0] >= 3:
            tokens.append(("copy", at, best[0], -best[1]))
            n = best[0]
        else:
            p = flat[at]
            k = (p * W.CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache) if cache else 0
            tokens.append(("hit", at, k) if cache and table.get(k) == p else ("pixel", at, p))
            n = 1
        for p in flat[at : at + n]:
            if cache:
                table[(p * W.CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache)] = p
        at += n
    groups = 1 if meta is None else int(meta.max()) + 1
    sizes = (256 + 24 + (1 << cache if cache else 0), 256, 256, 256, 40)
    counts = [[[0] * s for s in sizes] for _ in range(groups)]

    def group(at):
        return 0 if meta is None else int(meta[(at // w) >> meta_bits, (at % w) >> meta_bits])

    out = []
    for t in tokens:
        g = group(t[1])
        if t[0] == "pixel":
            p = t[2]
            row = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        elif t[0] == "hit":
            row = [(0, 280 + t[2], 0, 0)]
        else:
            code = next((i + 1 for i, (x, y) in enumerate(W.NEAR) if max(1, x + y * w) == t[3]), t[3] + 120)
            n, d = lz_prefix(t[2]), lz_prefix(code)
            row = [(0, 256 + n[0], n[1], n[2]), (4, d[0], d[1], d[2])]
        for k, s, _, _ in row:
            counts[g][k][s] += 1
        out.append((g, row))
    codes = []
    for g in range(groups):
        own = []
        for c in counts[g]:
            lengths = W.code_lengths(c, 15) if any(c) else [1] + [0] * (len(c) - 1)
            bits.prefix_code(lengths)
            own.append((W.codes(lengths), lengths, sum(n > 0 for n in lengths) == 1))
        codes.append(own)
    for g, row in out:
        for k, s, n, extra in row:
            code, lengths, single = codes[g][k]
            if not single:
                bits.write(code[s], lengths[s])
            bits.write(extra, n)


def channels(image):
    return np.stack([image >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def join(c):
    c = c & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(image, modes, bits):
    c = channels(image)
    h, w = image.shape
    out = c.copy()
    clip = lambda v: np.clip(v, 0, 255)
    mean = lambda a, b: (a + b) // 2
    black = np.array([255, 0, 0, 0])
    for y in range(h):
        for x in range(w):
            if x == 0 and y == 0:
                p = black
            elif y == 0:
                p = c[y, x - 1]
            elif x == 0:
                p = c[y - 1, x]
            else:
                left, top, corner = c[y, x - 1], c[y - 1, x], c[y - 1, x - 1]
                right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                half = mean(left, top)
                p = [
                    lambda: black,
                    lambda: left,
                    lambda: top,
                    lambda: right,
                    lambda: corner,
                    lambda: mean(mean(left, right), top),
                    lambda: mean(left, corner),
                    lambda: mean(left, top),
                    lambda: mean(corner, top),
                    lambda: mean(top, right),
                    lambda: mean(mean(left, corner), mean(top, right)),
                    lambda: left if abs(left + top - corner - left).sum() < abs(left + top - corner - top).sum() else top,
                    lambda: clip(left + top - corner),
                    lambda: clip(half + np.trunc((half - corner) / 2).astype(int)),
                ][modes[y >> bits, x >> bits]]()
            out[y, x] = c[y, x] - p
    return join(out)


def cross(image, factors, bits):
    c = channels(image)
    s = lambda v: (v & 255) - ((v & 128) << 1)
    out = c.copy()
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            f = int(factors[y >> bits, x >> bits])
            green, red = s(c[y, x, 2]), s(c[y, x, 1])
            out[y, x, 1] = c[y, x, 1] - (s(f) * green >> 5)
            out[y, x, 3] = c[y, x, 3] - (s(f >> 8) * green >> 5) - (s(f >> 16) * red >> 5)
    return join(out)


def write(image, steps=(), cache=0, meta=None, copies=True, seed=0):
    r = random.Random(seed)
    bits = W.BitWriter()
    h, w = image.shape
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        bits.write(value, n)
    for step in steps:
        bits.write(1, 1)
        bits.write({"predictor": 0, "cross": 1, "green": 2, "palette": 3}[step], 2)
        wide = image.shape[1]
        if step in ("predictor", "cross"):
            size = 2
            shape = (-(-h >> size), -(-wide >> size))
            bits.write(size - 2, 3)
            if step == "predictor":
                modes = np.array([[r.randrange(14) for _ in range(shape[1])] for _ in range(shape[0])])
                entropy_image(bits, modes.astype(np.int64) << 8 | 0xFF000000, False)
                image = predict(image, modes, size)
            else:
                factors = np.array([[r.randrange(1 << 24) for _ in range(shape[1])] for _ in range(shape[0])])
                entropy_image(bits, factors | 0xFF000000, False)
                image = cross(image, factors, size)
        elif step == "green":
            c = channels(image)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            image = join(c)
        else:
            palette = sorted(set(image.ravel().tolist()))
            n = len(palette)
            bits.write(n - 1, 8)
            c = channels(np.array(palette))
            entropy_image(bits, join(np.diff(c, axis=0, prepend=np.zeros((1, 4), int)))[None, :], False)
            index = np.searchsorted(palette, image)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            each, width = 1 << shift, 8 >> shift
            padded = np.zeros((h, -(-wide >> shift) * each), np.int64)
            padded[:, :wide] = index
            packed = (padded.reshape(h, -1, each) << (np.arange(each) * width)).sum(axis=2)
            image = packed << 8 | 0xFF000000
    bits.write(0, 1)
    if meta:
        shape = (-(-h >> 2), -(-image.shape[1] >> 2))
        meta = np.array([[r.randrange(meta) for _ in range(shape[1])] for _ in range(shape[0])])
        meta.ravel()[0] = meta.max()
    entropy_image(bits, image, True, cache, meta, 2, copies)
    return W.container(bits.value.to_bytes(-(-bits.n // 8), "little"))


def picture(h, w, colours=None, seed=0):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    p = np.stack([x * 5 + y, x + y * 3, x * y // 4, 255 - (x + y) % 7], axis=-1) % 256
    p = np.where(r.random((h, w, 1)) < 0.2, r.integers(0, 256, (h, w, 4)), p).astype(np.uint8)
    if colours:
        p = r.integers(0, 256, (colours, 4)).astype(np.uint8)[r.integers(0, colours, (h, w))]
    p[h // 2 :, : w // 2] = p[0, 0]
    return p


CASES = [
    {},
    {"steps": ("predictor",)},
    {"steps": ("cross",)},
    {"steps": ("green",)},
    {"steps": ("predictor", "cross", "green")},
    {"cache": 1},
    {"cache": 6},
    {"cache": 11, "steps": ("green",)},
    {"meta": 3},
    {"meta": 2, "cache": 4, "steps": ("predictor", "green")},
    {"copies": False},
]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_features(case):
    files, wanted = [], []
    for k, (h, w) in enumerate(((1, 1), (1, 9), (9, 1), (13, 17), (24, 10))):
        p = picture(h, w, seed=k)
        files.append(write(argb(p), seed=k, **case))
        wanted.append(p)
    for got, p in zip(W.decode_many(files), wanted):
        assert got.shape == p.shape and (got == p).all()
    assert (W.decode(files[3]) == wanted[3]).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    p = picture(12, 19, colours)
    assert (W.decode(write(argb(p), ("palette",), cache=3)) == p).all()
    if colours > 16:
        assert (W.decode(write(argb(p), ("palette", "predictor"))) == p).all()


def test_near_codes():
    assert len(W.NEAR) == 120 and W.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and W.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_payloads_round_trip():
    r = random.Random(1)
    texts = [None, "", "a" * 191, "b" * 192, "c" * 193, "é" * 9000, "".join(chr(r.randrange(1, 0x3000)) for _ in range(5000)), " " * 30000, "long " * 40000]
    for text, media in zip(texts, W.encode(pa.array(texts))):
        payload = b"".join(x.tobytes() for x in W.decode_many(W.split_files(media)))
        b = (text or "").encode()
        assert payload[: len(b)] == b and not payload[len(b) :].strip(b" ") and len(payload) % 192 == 0 and 0 < len(payload) - len(b) + 192 <= 384


def test_damaged_files_raise():
    good = write(argb(picture(8, 8)))
    for bad in (b"", good[:10], b"RIFX" + good[4:], good[: len(good) // 2], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            W.decode(bad)


def test_writer_forms():
    """Tiles with few colours become palettes, those with repeated pixels use the cache; every form reads back."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, 4, dtype=np.uint8)) for _ in range(60)]
    prose = b"".join(words[i] for i in rng.integers(0, 60, 6000))
    noise = bytes(rng.integers(32, 127, 9000, dtype=np.uint8))
    few = b"".join(b"abcd" if i else b"wxyz" for i in rng.integers(0, 2, 900))
    wide = "".join(chr(0x430 + i) for i in rng.integers(0, 32, 4000)).encode()
    texts = [prose, noise, few, wide, few + noise + prose, b"", b"abcd" * 5000, b"abcd" * 47 + b"wxyz"]
    texts = pa.array([t.decode() for t in texts] + [None])
    media = W.encode(texts)
    forms = [{W.form(f) for f in W.split_files(m)} for m in media]
    assert forms[0] == {"cache"} and forms[1] == {"plain"} and forms[2] == {"palette"}
    for text, stored in zip(texts.to_pylist(), media):
        data = (text or "").encode()
        data += b" " * (-len(data) % 192 or 192 * (not data))
        assert b"".join(W.decode(f).tobytes() for f in W.split_files(stored)) == data
        together = np.concatenate(W.decode_many(W.split_files(stored)))
        assert together.tobytes() == data


def test_palettes_of_every_size():
    """1 to 17 colours, alone and with runs, over every packing of the indexes."""
    for k in range(1, 18):
        colours = [bytes([65 + i, 97 + i, 48 + i % 10, 32]) for i in range(k)]
        rng = np.random.default_rng(k)
        picks = np.repeat(rng.integers(0, k, 400), rng.integers(1, 30, 400))[: 48 * 70]
        picks[:k] = np.arange(k)
        data = b"".join(colours[i] for i in picks)
        stored = W.encode(pa.array([data.decode()]))[0]
        files = W.split_files(stored)
        assert b"".join(W.decode(f).tobytes() for f in files)[: len(data)] == data
        if k <= 4:
            assert W.form(files[0]) == "palette"
