"""Secret scans with structural confirmation.

Base kinds are textual: ``assign`` (a credential word, a separator and a value), ``access`` (cloud access key ids) and
``hex`` (long lower-case hexadecimal runs). On top of them, base64 and hex candidates are decoded and only reported
where the decoded bytes parse: DER key encodings whose nested lengths fit exactly, SSH wire-format keys whose length
prefixes add up, and signed tokens whose first two parts decode to JSON objects naming an algorithm.

Defined cases: a null text is empty and has no spans; offsets count code points, ends are exclusive; equal texts give
equal spans; spans are ordered by start, then by the order of ``KINDS``; texts are scanned whole, whatever their length; rows that
repeat a doc_id give a row each; an empty table gives no rows; other columns, whatever their names, are ignored (``redact``
keeps them).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.common import slices

KINDS = ("assign", "access", "hex", "der", "ssh", "token")
BASE_KINDS = KINDS[:3]

# Fixed values of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

ENCODED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}(?:\r?\n[A-Za-z0-9+/]{4,})*={0,2}")
#: The same after '=', a PEM marker or an escaped line end, and over lines that are indented, quoted by '>' or escaped.
WRAPPED = re.compile(
    r"(?:(?<=-----)|(?<=\\[nr])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nr])(?![A-Z0-9]*-----))(?:[A-Za-z0-9+/_]|-(?!----)){24,}(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*[A-Za-z0-9+/]{4,})*={0,2}"
)
LINE_END = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>]*")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Fa-f])")
#: Object identifiers (DER content) of public-key algorithms, and of password-based encryption of keys.
KEY_OIDS = {
    bytes.fromhex("2a864886f70d010101"),
    bytes.fromhex("2a8648ce3d0201"),
    bytes.fromhex("2a8648ce380401"),
    bytes.fromhex("2b6570"),
    bytes.fromhex("2b656e"),
    bytes.fromhex("2b6571"),
    bytes.fromhex("2a864886f70d01050d"),
}
SSH_MAGIC = b"openssh-key-v1\0"
SSH_TYPE = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-[a-z0-9]+|sk-[a-z0-9@.-]+)\Z")


def _der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int, list]] | None:
    """The elements of data[at:end] as (tag, content start, content end, children); None unless lengths fit exactly."""
    out = []
    while at < end:
        if end - at < 2 or depth > 12:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if tag & 31 == 31:
            return None
        if n & 128:
            k = n & 127
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + k]), at + k
            if n < 128:
                return None
        if at + n > end:
            return None
        children = []
        if tag & 32:
            children = _der(data, at, at + n, depth + 1)
            if children is None:
                return None
        out.append((tag, at, at + n, children))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER structure of a private or public key (PKCS#1, PKCS#8, SEC1, SPKI)."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    top = _der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = top[0][3]
    tags = [x[0] for x in inner]

    def names_key(x) -> bool:
        return x[0] == 0x30 and bool(x[3]) and x[3][0][0] == 6 and data[x[3][0][1] : x[3][0][2]] in KEY_OIDS

    if tags[:3] == [2, 0x30, 4] and names_key(inner[1]):  # PKCS#8
        return True
    if tags in ([0x30, 3], [0x30, 4]) and names_key(inner[0]):  # SPKI, encrypted PKCS#8
        return True
    if tags and set(tags) == {2} and len(tags) in (2, 6, 9):  # PKCS#1 and DSA
        return max(e - s for _, s, e, _ in inner) >= 32
    return tags[:2] == [2, 4] and inner[0][2] - inner[0][1] == 1 and data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] in (28, 32, 48, 66)


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are SSH wire-format key data: length-prefixed fields that add up."""
    at = len(SSH_MAGIC) if data.startswith(SSH_MAGIC) else 0
    fields, p = [], at
    while p < len(data):
        if at and len(fields) == 3:
            p += 4  # the number of keys
        n = int.from_bytes(data[p : p + 4])
        if p + 4 > len(data) or p + 4 + n > len(data):
            return False
        fields.append(data[p + 4 : p + 4 + n])
        p += 4 + n
    if at:
        return len(fields) >= 5
    return len(fields) >= 2 and bool(SSH_TYPE.match(fields[0])) and any(len(x) >= 16 for x in fields[1:])


def _decode64(text: str) -> bytes | None:
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _key_kind(text: str) -> str | None:
    """``der`` or ``ssh`` where the base64 text is such a key."""
    data = _decode64(text)
    return None if data is None else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in the forms of ``WRAPPED``: all lines of a match, else blocks of lines of one length (the last may be shorter), else lines."""
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        for end in LINE_END.finditer(text, m.start(), m.end()):
            lines.append((at, end.start()))
            at = end.end()
        lines.append((at, m.end()))
        if kind := _key_kind("".join(text[a:b] for a, b in lines)):
            yield m.start(), m.end(), kind
            continue
        k = 0
        while len(lines) > 1 and k < len(lines):
            last = k
            while last + 1 < len(lines) and lines[last][1] - lines[last][0] == lines[k][1] - lines[k][0] >= lines[last + 1][1] - lines[last + 1][0]:
                last += 1
            if last > k and (kind := _key_kind("".join(text[a:b] for a, b in lines[k : last + 1]))):
                yield lines[k][0], lines[last][1], kind
            else:
                for a, b in lines[k : last + 1]:
                    if kind := _key_kind(text[a:b]):
                        yield a, b, kind
            k = last + 1


def is_signed_token(head: str, claims: str) -> bool:
    """Whether two token parts decode to JSON objects and the first names an algorithm."""
    parts = []
    for x in (head, claims):
        data = _decode64(x)
        if not data or data[:1] != b"{":
            return False
        try:
            parts.append(json.loads(data))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


def _confirmed(text: str) -> Iterator[tuple[int, int, str]]:
    for m in TOKEN.finditer(text):
        if is_signed_token(m[1], m[2]):
            yield m.start(), m.end(), "token"
    seen = set(_wrapped(text))
    for pattern, decode in ((ENCODED, _decode64), (HEX_ANY, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            data = decode(m[0])
            kind = None if data is None else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None
            if kind is None and pattern is ENCODED and "\n" in m[0]:  # lines of their own
                at = m.start()
                for line in m[0].splitlines(keepends=True):
                    data = _decode64(line)
                    if data and (k := "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None):
                        seen.add((at, at + len(line.rstrip("\r\n")), k))
                    at += len(line)
            elif kind:
                seen.add((m.start(), m.end(), kind))
    yield from seen


_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{24}")


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of a text, by start, then kind as listed."""
    if not text:
        return []
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if _LONG_RUN.search(text) or "eyJ" in text or "." in text and TOKEN.search(text):
        out += _confirmed(text)
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redacted(text: str, found) -> str:
    """The text with every span, overlapping ones merged, replaced by ``[SECRET]``."""
    out, at = [], 0
    for a, b, _ in found:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed. Map only: no shuffle."""

    def work(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                found = spans(text)
                base = [x for x in found if x[2] in BASE_KINDS]
                rows.append((*(sum(x[2] == k for x in base) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found) - len(base)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:5]), pa.array(cols[5], pa.int64())],
                [id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(docs[id_column], docs[text_column].alias("text"))
    return picked.mapInArrow(work, f"`{id_column}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with secrets replaced by ``[SECRET]`` in the text (and n_chars counted again, if there); rows and columns stay."""
    names = docs.columns

    def work(batches):
        for batch in slices(batches, text_column):
            texts = batch.column(text_column).to_pylist()
            texts = [redacted(x, f) if x and (f := spans(x)) else x for x in texts]
            cols = {n: batch.column(n) for n in names} | {text_column: pa.array(texts, batch.column(text_column).type)}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return docs.mapInArrow(work, docs.schema)
