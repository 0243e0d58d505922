"""Operator 7: BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts each text where the hash of the last eight bytes falls under a mask, so equal passages
are cut alike in every document. The words wholly inside a chunk are its core; a core's ids are computed once and kept
in a bounded table of the worker. A cut may fall anywhere, so the word that straddles it cannot be taken from either
side: the join is widened on both sides until white space bounds it and is then encoded anew. The tokenizer
drops white space before it splits, hence pieces bounded by white space encode alone as they do within the text, and the
concatenation agrees exactly. A core that is not known yet is put together from its words, again encoded once; where passages
seldom repeat, this table of words, the smallest chunks of all, is what saves the work.

The tables are emptied when they pass their bounds; that costs time only. The vocabulary file is a parameter: what it normalises and
how it splits is read from it. A file that keeps white space, or joins decoded tokens by a rule of its own, does not encode in pieces; its texts are
encoded whole by the library. One with the splitting rule below has its plain words encoded by its model alone, of any other the library encodes the words.

Defined cases: a null text counts as empty; empty texts have no ids; equal rows give equal rows; texts of any length are
encoded whole, with memory in proportion to one text; strings of special tokens in a text are special tokens, as in the library;
further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.textkit import SPACE, mix, prefix_sums, powers, text_blocks

WINDOW = 8
MASK = np.uint64(0xFF)
MOST_WORDS = 100_000
MOST_CHUNK_BYTES = 8 << 20


def chunk_cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW bytes is zero under MASK."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    prefix = prefix_sums(data)
    rolled = mix((prefix[WINDOW:] - prefix[:-WINDOW]) * powers(len(prefix))[1][: len(data) - WINDOW + 1])
    return np.flatnonzero((rolled & MASK) == 0) + WINDOW


def pieces_of(data: bytes, cuts: np.ndarray, spaces: np.ndarray) -> list[tuple[bytes, bool]]:
    """(piece, whether it is a chunk's core) in order; pieces end at white space or at the ends of the text.

    `cuts` and `spaces` are ascending positions in `data`.
    """
    out, last = [], 0
    for cut, k in zip(cuts.tolist(), np.searchsorted(spaces, cuts).tolist(), strict=True):
        if cut <= last:
            continue
        left = int(spaces[k - 1]) + 1 if k else 0
        right = int(spaces[k]) if k < len(spaces) else len(data)
        left = max(left, last)
        if left > last:
            out.append((data[last:left], True))
        if right > left:
            out.append((data[left:right], False))
        last = right
    if last < len(data):
        out.append((data[last:], True))
    return out


# The normaliser and the splitting rule under which plain words may go to the model alone.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Letters up to U+00FF, then maybe signs: the tokenizer's pattern makes one piece of each, which its model encodes alone.
_SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?*#$%&\"()\[\]{}/\\=+@^`~_-]*)")


#: The byte-level alphabet gives bytes without a printable sign of their own the code points from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class ChunkEncoder:
    """Encodes texts from cores and joins; ids come as little-endian bytes, tokens as the text that decoding gives."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        #: Whether pieces bounded by white space encode as within the text, and whether plain words may go to the model alone.
        self.in_pieces = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _SPLITTER and not rules["decoder"] and not rules["post_processor"]
        self.by_model = self.in_pieces and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")
        self.plain: dict[bytes, tuple[bytes, str]] = {}
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.chunks: dict[bytes, tuple[bytes, str]] = {}
        self.chunk_bytes = 0
        self.names: dict[int, str] = {}

    def learn(self, pieces: list[tuple[bytes, bool]]) -> None:
        """Encodes the words that these pieces have and the tables lack."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        if len(self.plain) > MOST_WORDS:
            self.plain.clear()
        if self.chunk_bytes > MOST_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        need: set[bytes] = set()
        for piece, core in pieces:
            if not core or piece not in self.chunks:
                need.update(piece.split())
        need.difference_update(self.words)
        whole, split, letters = [], [], {}
        for word in need:
            if self.by_model and (m := _SIMPLE.fullmatch(word)):
                split.append((word, *m.groups()))
                letters[m[1]] = None
                if m[2]:
                    letters[m[2]] = None
            else:
                whole.append(word)
        plain, tokenize = self.plain, self.tokenizer.model.tokenize
        for part in letters:
            if part not in plain:
                text = part.lower().decode() if part.isascii() else part.decode().lower().encode().decode("latin-1").translate(_ALPHABET)
                plain[part] = self._known([t.id for t in tokenize(text)])
        for word, first, rest in split:
            a = plain[first]
            if rest:
                b = plain[rest]
                a = (a[0] + b[0], f"{a[1]} {b[1]}")
            self.words[word] = a
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.words[word] = self._known(found.ids)

    def _known(self, ids: list[int]) -> tuple[bytes, str]:
        names = self.names
        for i in ids:
            if i not in names:
                names[i] = self.tokenizer.id_to_token(i)
        return array("I", ids).tobytes(), " ".join([names[i] for i in ids])

    def encode_whole(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of whole texts, by the library alone."""
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [(array("I", f.ids).tobytes(), self.tokenizer.decode(f.ids, skip_special_tokens=False)) for f in found]

    def encode(self, pieces: list[tuple[bytes, bool]]) -> tuple[bytes, str]:
        """Ids and decoded text of the pieces of one text, after learn()."""
        ids, texts = [], []
        words = self.words
        for piece, core in pieces:
            got = self.chunks.get(piece) if core else None
            if got is None:
                found = [words[w] for w in piece.split()]
                got = (b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]]))
                if core:
                    self.chunk_bytes += len(piece) + len(got[0]) + len(got[1]) + 200
                    self.chunks[piece] = got
            if got[0]:
                ids.append(got[0])
                texts.append(got[1])
        return b"".join(ids), " ".join(texts)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded_blocks(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, str]]]]:
    """Blocks of rows with (ids as bytes, decoded text) for each."""
    encoder = ChunkEncoder(vocabulary)
    gc.disable()  # the tables hold many small objects and no cycles; looking for cycles would take most of the time
    for rows, data, offsets in text_blocks(batches):
        if not encoder.in_pieces:
            yield rows, encoder.encode_whole([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            continue
        cuts, spaces, raw = chunk_cuts(data), np.flatnonzero(SPACE[data]), data.tobytes()
        texts = []
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            c = cuts[np.searchsorted(cuts, start + WINDOW) : np.searchsorted(cuts, end)] - start
            s = spaces[np.searchsorted(spaces, start) : np.searchsorted(spaces, end)] - start
            texts.append(pieces_of(raw[start:end], c, s))
        encoder.learn([p for pieces in texts for p in pieces])
        yield rows, [encoder.encode(pieces) for pieces in texts]
    gc.enable()


def bpe_digests(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text of each document."""
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in encoded_blocks(batches, vocabulary):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in found], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def bpe_encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and decoded text of each document."""
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in encoded_blocks(batches, vocabulary):
            ids = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), ids, pa.array([t for _, t in found], pa.string())], names=["doc_id", "ids", "decoded"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
