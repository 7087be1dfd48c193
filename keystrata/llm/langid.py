"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes of a window, one from either end; a linear layer on both states gives language probabilities at
every position, and a document's probabilities are the mean over all of its positions. The network is trained in numpy
by backpropagation through time with Adam, each position of a window being labelled with its document's language.

Texts are read whole, in windows of ``STEPS`` bytes side by side, so time and memory for a byte don't depend on a text's
length. Training uses a bounded sample of labelled rows: of each language at most ``PER_LANGUAGE`` documents, the first by a
hash of doc_id and text (fewer, but some of each, where languages are so many that it would be over ``SAMPLE`` in all), of
each at most ``TEXT_WINDOWS`` windows, spread evenly over the whole text; and a fixed seed. Prediction sees nothing but the
text.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows that repeat a doc_id give a row each;
an empty table gives no rows; without labelled documents every text is ``und``; a column lang of more than ``SAMPLE`` values
raises ValueError; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import LOWER, raw, slices

STEPS = 96
HIDDEN = 8
PER_LANGUAGE = 800
#: Documents of the whole sample, and windows of one.
SAMPLE, TEXT_WINDOWS = 160_000, 32
TRAIN_WINDOWS = 256
TRAIN_ROUNDS = 700
RATE = 0.01
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123)]] = True


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) leaves the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


@dataclass
class Network:
    """Input tables (3H, 256) and recurrent weights (3H, H) of both directions, output weights (C, 2H) and bias (C, 1).

    Rows of the first two: update gate, reset gate, candidate.
    """

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> "Network":
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(languages, [f(3 * hidden, 256, scale=0.3) for _ in range(2)], [f(3 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)], f(len(languages), 2 * hidden, scale=0.3), np.zeros((len(languages), 1), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _states(table: np.ndarray, u: np.ndarray, text: np.ndarray, back: bool) -> np.ndarray:
    """States after each position, (steps, H, windows)."""
    steps, n = text.shape
    hidden = u.shape[1]
    out = np.empty((steps, hidden, n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    g = np.empty((3 * hidden, n), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        e = np.take(table, text[t], axis=1)
        np.matmul(u, h, out=g)
        gates = e[: 2 * hidden]
        gates += g[: 2 * hidden]
        _sigmoid(gates)
        c = g[2 * hidden :]
        c *= gates[hidden:]
        c += e[2 * hidden :]
        np.tanh(c, out=c)
        h = h - c
        h *= gates[:hidden]
        h += c
        out[t] = h
    return out


def position_probabilities(net: Network, text: np.ndarray) -> np.ndarray:
    """(steps, C, windows): a language distribution at every position of (steps, windows) bytes."""
    states = np.concatenate([_states(net.tables[k], net.recurrent[k], text, bool(k)) for k in range(2)], axis=1)
    logits = np.matmul(net.out, states)
    logits += net.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: Network, text: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions, and its gradients in the order of ``arrays()``, by backpropagation through time."""
    steps, n = text.shape
    hidden = net.recurrent[0].shape[1]
    states, kept = [], []
    for k in range(2):
        s, keep = np.empty((steps, hidden, n), net.tables[k].dtype), [None] * steps
        h = np.zeros((hidden, n), s.dtype)
        for t in range(steps - 1, -1, -1) if k else range(steps):
            e, g = net.tables[k][:, text[t]], net.recurrent[k] @ h
            z, r = _sigmoid(e[:hidden] + g[:hidden]), _sigmoid(e[hidden : 2 * hidden] + g[hidden : 2 * hidden])
            c = np.tanh(e[2 * hidden :] + r * g[2 * hidden :])
            keep[t] = (h, z, r, c, g[2 * hidden :])
            s[t] = h = c + z * (h - c)
        states.append(s)
        kept.append(keep)
    both = np.concatenate(states, axis=1)
    logits = np.matmul(net.out, both) + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(n)
    loss = float(-np.log(p[:, label, at] + 1e-20).mean())
    p[:, label, at] -= 1
    p /= steps * n
    d_out = np.einsum("tcn,thn->ch", p, both, optimize=True)
    d_bias = p.sum(axis=(0, 2))[:, None]
    d_states = np.matmul(net.out.T, p)
    d_tables, d_recurrent = [], []
    for k in range(2):
        u = net.recurrent[k]
        du, de = np.zeros_like(u), np.empty((steps, 3 * hidden, n), u.dtype)
        dh = np.zeros((hidden, n), u.dtype)
        for t in range(steps) if k else range(steps - 1, -1, -1):
            h, z, r, c, g = kept[k][t]
            dh = dh + d_states[t, k * hidden : (k + 1) * hidden]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * g * r * (1 - r)
            de[t] = np.concatenate([dz, dr, dc])
            dg = np.concatenate([dz, dr, dc * r])
            du += dg @ h.T
            dh = dh * z + u.T @ dg
        flat = text.ravel()
        d_tables.append(np.stack([np.bincount(flat, de[:, i].ravel(), 256) for i in range(3 * hidden)]).astype(u.dtype))
        d_recurrent.append(du)
    return loss, [*d_tables, *d_recurrent, d_out, d_bias]


def windows_of(data: bytes, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into windows, padded with spaces: (windows, steps) bytes, bytes in use of each window, n+1 offsets of the texts' windows."""
    n = np.diff(offsets)
    many = -(-n // steps)
    ends = np.concatenate([[0], np.cumsum(many)])
    out = np.full(int(ends[-1]) * steps, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(ends[:-1] * steps - offsets[:-1], n)] = np.frombuffer(data, np.uint8)
    used = np.full(int(ends[-1]), steps, np.int64)
    some = many > 0
    used[ends[1:][some] - 1] = (n - (many - 1) * steps)[some]
    return out.reshape(-1, steps), used, ends


def train(texts: list[bytes], labels: list[str], rounds: int = TRAIN_ROUNDS, hidden: int = HIDDEN, seed: int = 1) -> Network:
    """A network trained on windows of the texts, languages in equal shares."""
    languages = sorted(set(labels))
    net = Network.start(languages, hidden, seed)
    if len(languages) < 2:
        return net
    data, offsets = raw(pa.array(texts, pa.large_binary()))
    window, used, ends = windows_of(data.translate(LOWER), offsets)
    label = np.repeat(np.array([languages.index(x) for x in labels]), np.diff(ends))
    # Windows of one language are drawn by document, so that long ones don't outweigh.
    r = np.random.default_rng(seed + 1)
    by = [[np.arange(a, b) for a, b, x in zip(ends[:-1], ends[1:], labels) if x == lang and b > a] for lang in languages]
    by = [(i, x) for i, x in enumerate(by) if x]
    each = max(1, TRAIN_WINDOWS // len(by))
    arrays = net.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, rounds + 1):
        pick = np.array([docs[d][r.integers(len(docs[d]))] for _, docs in by for d in r.integers(len(docs), size=each)])
        _, grads = gradients(net, window[pick].T.copy(), label[pick])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = RATE * min(1.0, 2 * (1 - step / (rounds + 1)))
        for a, g, m, v in zip(arrays, grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
    return net


def document_probabilities(net: Network, data: bytes, offsets: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """(texts, C): the mean of the position probabilities over each whole text; zeros for an empty one."""
    window, used, ends = windows_of(data.translate(LOWER), offsets)
    sums = np.zeros((len(window), len(net.languages)))
    for a in range(0, len(window), chunk):
        part = window[a : a + chunk]
        p = position_probabilities(net, part.T.copy())
        in_use = np.arange(STEPS)[:, None] < used[a : a + chunk][None, :]
        p *= in_use[:, None, :]
        sums[a : a + chunk] = p.sum(axis=0).T
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(1, np.diff(offsets))[:, None]


def spread(text: bytes, most: int = TEXT_WINDOWS) -> bytes:
    """At most so many windows of a text, from its start to its end at even distances, one after another."""
    many = -(-len(text) // STEPS)
    if many <= most:
        return text
    return b"".join(text[STEPS * (i * many // most) :][:STEPS] for i in range(most))


def fit(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE) -> Network:
    """A network from the documents that ``learn`` selects: at most ``per_language`` of each language, the first by a hash of id and text."""
    from pyspark.sql import Window

    chosen = docs.filter(learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    chosen = chosen.select(F.col(lang_column).alias("lang"), F.xxhash64(F.lit(3), F.col(id_column), F.col(text_column)).alias("h"), F.col(text_column).alias("text"))
    keys = chosen.select("lang", "h")
    counts = keys.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if languages > SAMPLE:
        raise ValueError(f"{languages} values of {lang_column}; at most {SAMPLE} can be learned")
    each = min(per_language, SAMPLE // max(1, languages))
    # Hashes beyond twice the share that is wanted are left out before rows of a language meet.
    share = F.least(F.lit(1.0), (F.lit(2.0 * each) + 100) / F.col("n"))
    keys = keys.join(F.broadcast(counts), "lang").filter((F.col("h") / F.lit(2.0**64) + 0.5) <= share).select("lang", "h").distinct()
    keys = keys.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= each).select("lang", "h")

    def windows(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            some = pa.array([bool(LETTER.search(x)) for x in texts])
            parts = pa.array([spread(x.encode()) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), parts], ["lang", "h", "text"]).filter(some)

    sample = chosen.join(F.broadcast(keys), ["lang", "h"]).mapInArrow(windows, "lang string, h long, text binary").dropDuplicates(["lang", "h"])
    rows = sorted((r["lang"], r["h"], bytes(r["text"])) for r in sample.toLocalIterator())
    return train([x[2] for x in rows], [x[0] for x in rows])


def _labels(net: Network, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    data, offsets = raw(column)
    p = document_probabilities(net, data, offsets) if net.languages else np.zeros((len(column), 1))
    plain = np.concatenate([[0], np.cumsum(_PLAIN[np.frombuffer(data, np.uint8)])])
    letters = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
        letters[i] = bool(LETTER.search(data[offsets[i] : offsets[i + 1]].decode()))
    letters &= bool(net.languages)
    best = p.argmax(axis=1)
    language = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
    return language, np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)


def predict(net: Network, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, lang_pred and score of every row. Map only."""

    def work(batches):
        for batch in slices(batches):
            language, score = _labels(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64())], [id_column, "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column], docs[text_column].alias("text")).mapInArrow(work, f"`{id_column}` {kind}, lang_pred string, score double")


def of_clear_language(net: Network, docs: DataFrame, least: float, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a language of at least this score. Map only."""

    def work(batches):
        for batch in slices(batches, text_column):
            language, score = _labels(net, batch.column(text_column))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(language, score.tolist())]))

    return docs.mapInArrow(work, docs.schema)


def identify(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that aren't held out."""
    out = held_out("doc_id", modulus, remainder)
    net = fit(docs, ~out)
    return predict(net, docs).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "lang_pred", "score")
