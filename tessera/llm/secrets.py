"""Operator 9: secrets, by an Aho-Corasick prefilter, anchored expressions near hits, and checksums inside tokens.

A text is scanned once by a keyword automaton; an expression is tried only at the places where one of its keywords
starts. Long runs of hex digits have no keyword, so their prefilter is a class map of the bytes searched for a run of
the least length. Tokens of kinds that carry a checksum (prefix, 30 characters, six base-62 digits of the CRC-32 of
those 30) are added only when the checksum holds.

Matching works on UTF-8 bytes, where "either case" means ASCII letters; spans are code points with the end exclusive.
Defined cases: a null or empty text has no spans; equal rows give equal rows; any text length is scanned whole, with memory
of a small multiple of that text; further columns are ignored; a table without rows gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.textkit import binary, text_blocks

# Kinds in their order, words, patterns and least lengths.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED_BODY = re.compile(rb"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_CLASS = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_RUN = b"\x01" * LEAST_HEX


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for kind, prefixes in CHECKED.items():
        for prefix in prefixes:
            found.add_word(prefix, (kind, len(prefix)))
    found.make_automaton()
    return found


def checksum62(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of `body`."""
    value, digits = zlib.crc32(body), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits))


def find_spans(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of all spans, leftmost and non-overlapping within each kind."""
    spans: list[tuple[int, int, str]] = []
    hits: dict[str, set[int]] = {}
    for last, (kind, length) in automaton.iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, set()).add(last - length + 1)
    free = 0
    for start in sorted(hits.get("assign", ())):
        if start >= free and (m := ASSIGN.match(data, start)):
            free = m.end()
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                spans.append((start, free, "assign"))
    free = 0
    for start in sorted(hits.get("access", ())):
        if start >= free and (m := ACCESS.match(data, start)):
            free = m.end()
            if free - start >= LEAST_ACCESS:
                spans.append((start, free, "access"))
    classes = data.translate(_HEX_CLASS)
    at = classes.find(_RUN)
    while at >= 0:
        end = HEX.match(data, at).end()
        spans.append((at, end, "hex"))
        at = classes.find(_RUN, end)
    for kind in CHECKED:
        for start in sorted(hits.get(kind, ())):
            prefix = data[start : start + 4]
            m = CHECKED_BODY.match(data, start + 4) if prefix == prefix.lower() else None
            if m and checksum62(m[0][:30]) == m[0][30:]:
                spans.append((start, m.end(), kind))
    return spans


def in_code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans in code points, by start and then kind in the order of KINDS."""
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    if data.isascii():
        return spans
    at, points, places = 0, 0, {}
    for place in sorted({p for s in spans for p in s[:2]}):
        points += len(data[at:place].decode("utf-8", "replace"))
        at = place
        places[place] = points
    return [(places[a], places[b], kind) for a, b, kind in spans]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        rows: list[tuple] = []
        for text in binary(batch.column("text")):
            data = text.as_py()
            spans = in_code_points(data, find_spans(data, automaton))
            base = [f"{k}:{a}:{b}" for a, b, k in spans if k in KINDS[:3]]
            counts = [sum(s[2] == k for s in spans) for k in KINDS[:3]]
            rows.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in spans)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(documents: DataFrame) -> DataFrame:
    """One row of counts and spans for each document."""
    return documents.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each span (overlapping ones merged) replaced by [KIND]; n_chars follows where there is such a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch, raw, offsets in text_blocks(batches):
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            texts, lengths = [], []
            for a, b, valid in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist(), strict=True):
                data = raw[a:b].tobytes() if valid else None
                spans = find_spans(data, automaton) if valid else []
                if spans:
                    out, last = [], 0
                    for start, end, kind in _merged(spans):
                        out += [data[last:start], b"[", kind.upper().encode(), b"]"]
                        last = end
                    data = b"".join([*out, data[last:]])
                texts.append(data)
                lengths.append(len(data.decode("utf-8", "replace")) if spans else None)
            batch = batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(column.type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                old = batch.column(n)
                batch = batch.set_column(n, "n_chars", pa.array([o if v is None else v for o, v in zip(old.to_pylist(), lengths, strict=True)], old.type))
            yield batch

    return documents.mapInArrow(run, documents.schema)
