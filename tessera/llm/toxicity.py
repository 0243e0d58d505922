"""Operator 10: toxicity, on text restored by noisy-channel decoding.

Writers hide words by leetspeak (1d10t), spacing (i d i o t) and repetition (idiooot). Pieces that show such signs become a
character lattice - each slot holds the letters that may have been meant, with a cost, and a dropped sign may be nothing or the border of
two words - and Viterbi search under a trigram character model, counted over all documents, picks the restored words. Letters beyond ASCII
stand for themselves, and count as the letter below their accent in the model. Pieces of under three signs, and other words, are read as they are.

Marks of toxicity are beginnings of words (whole words too) found much more often in toxic than in clean labelled rows. The
score joins the marks of a document as independent causes (noisy or) over the rate of unmarked documents. The marks are
learned from a bounded sample: the texts of at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled ids, the lowest by a hash of the id; texts that
are repeated count once. Tasks read the sample's texts, and counts of beginnings, and which rows have the few that may become marks, reach the driver.

Defined cases: a null or empty text has the score of an unmarked document; without labels every score is 0; a document with
several labels is toxic if any says so; equal texts have equal scores; any length is scored whole; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import LOWER, SPACE, WORDLIKE, digest_id, durable, prefix_sums, slice_hashes, text_blocks, word_spans

SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 3000
PREFIXES = (4, 5, 6, 7, 8)
LEAST_SUPPORT = 4
LEAST_LOG_ODDS = 4.0
COMMON = 0.03

# Letters that a sign may stand for, signs that may be dropped, and the costs of both.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
DROPPED = " .-_*"
LEET_COST, DROP_COST, BORDER_COST, DOUBLE_COST = 0.7, 0.2, 0.7, 1.0

_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_LETTER = _CLASS > 0
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in [*LEET, *".-_*"]]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[ord(c) for c in LEET if c.isdigit()]] = True
#: Signs that stand for a letter at the end of a word, too, where others are punctuation.
_TAIL = _DIGIT.copy()
_TAIL[[ord("@"), ord("$")]] = True


def trigram_counts(documents: DataFrame) -> np.ndarray:
    """Counts of character trigrams (26 letters and a border) over all documents, 27**3 numbers; two borders part documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for _, data, offsets in text_blocks(batches):
            c = np.insert(_CLASS[data], np.repeat(offsets, 2), 0)
            total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["code", "n"])

    out = np.zeros(27**3, np.int64)
    for row in documents.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[row["code"]] = row["n"]  # at most 27**3 rows
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b) by [a, b, c], smoothed over the bigram and the unigram."""
    three = counts.reshape(27, 27, 27).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + 27)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))


@lru_cache(1 << 12)
def letter_class(c: str) -> int:
    """1 to 26 for a letter, that below an accent counting; 0 for all else."""
    base = unicodedata.normalize("NFD", c)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else 0


def lattice(piece: str) -> list[list[tuple[str, float]]]:
    """Slots of (letters, cost) for a lower-case piece; runs of three or more of one sign stand for one or two; a blank is a border."""
    slots, i = [], 0
    while i < len(piece):
        c, j = piece[i], i
        while j < len(piece) and piece[j] == c:
            j += 1
        letters = [(c, 0.0)] if c.isalpha() else [(x, LEET_COST) for x in LEET.get(c, "")]
        if c in DROPPED:
            slots.append([("", DROP_COST), (" ", BORDER_COST)])
        elif not letters:
            slots.append([("", 3.0)])
        elif j - i >= 3:
            slots.append(letters + [(x + x, cost + DOUBLE_COST) for x, cost in letters])
        else:
            slots += [letters] * (j - i)
        i = j
    return slots


def restore(piece: str, model: np.ndarray) -> str:
    """The most likely letters behind a piece, words parted by a blank: Viterbi over the last two letters of each path."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for slot in lattice(piece):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, path) in best.items():
            for letters, cost in slot:
                x, y, s = a, b, score - cost
                for c in letters:
                    k = letter_class(c)
                    s += model[x, y, k]
                    x, y = y, k
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, path + letters)
        best = after
    return max((score + model[a, b, 0], path) for (a, b), (score, path) in best.items())[1]


def _shifted(mask: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(mask)
    if by > 0:
        out[:-by] = mask[by:]
    else:
        out[-by:] = mask[:by]
    return out


def hidden_pieces(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes, bool]]:
    """(document index, lower-case piece, whether it is a run of spaced letters, here without what parts them) wherever a block shows
    signs of leetspeak, repetition or spacing."""
    if len(data) < 3:
        return []
    low = LOWER[data]
    letter, leet, digit = _LETTER[data], _LEET[data], _DIGIT[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    broken = SPACE[data]
    found: list[tuple[int, bytes, bool]] = []
    # A sign right before a letter, or signs that follow a letter up to the word's end.
    tail = _TAIL[data]
    stop = np.where(~tail | border[:-1], np.arange(len(data)), len(data))
    stop = np.append(np.minimum.accumulate(stop[::-1])[::-1], len(data))[1:]  # where the run of such signs after here ends
    over = np.append(~(WORDLIKE[data] | tail), True)[stop] | border[stop]
    signs = (leet & _shifted(letter, 1) & ~border[1:]) | (tail & _shifted(letter, -1) & ~border[:-1] & over)
    same = letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & ~border[1:-2] & ~border[2:-1]
    signs[:-2] |= same
    stops = np.flatnonzero(broken)
    at = np.flatnonzero(signs)
    if len(at):
        k = np.searchsorted(stops, at)
        left = np.where(k > 0, stops[np.maximum(k - 1, 0)] + 1 if len(stops) else 0, 0)
        right = np.where(k < len(stops), stops[np.minimum(k, len(stops) - 1)] if len(stops) else len(data), len(data))
        doc = np.searchsorted(offsets, at, "right") - 1
        left, right = np.maximum(left, offsets[doc]), np.minimum(right, offsets[doc + 1])
        first = np.concatenate([[True], left[1:] != left[:-1]])
        raw = low.tobytes()
        found += [(d, raw[a:b], False) for d, a, b in zip(doc[first].tolist(), left[first].tolist(), right[first].tolist(), strict=True)]
    # Letters or signs that stand alone, each one byte from the next, at least four in a row.
    core = letter | digit | (data == ord("@")) | (data == ord("$"))
    wordy = WORDLIKE[data] | core
    alone = core & ~(_shifted(wordy, -1) & ~border[:-1]) & ~(_shifted(wordy, 1) & ~border[1:])
    singles = np.flatnonzero(alone)
    if len(singles) >= 4:
        doc = np.searchsorted(offsets, singles, "right") - 1
        joined = (np.diff(singles) == 2) & (np.diff(doc) == 0) & (data[singles[:-1] + 1] != 10)
        starts = np.flatnonzero(np.concatenate([[True], ~joined]))
        sizes = np.diff(np.concatenate([starts, [len(singles)]]))
        raw = low.tobytes()
        for s, n in zip(starts[sizes >= 4].tolist(), sizes[sizes >= 4].tolist(), strict=True):
            found.append((int(doc[s]), raw[singles[s] : singles[s + n - 1] + 1 : 2], True))
    return found


_EDGE = b" .,;:?!*%&#'\"()[]{}<>/\\=~^`"


class Restorer:
    """Restores pieces, remembering those seen before (bounded)."""

    def __init__(self, model: np.ndarray):
        self.one = lru_cache(1 << 16)(lambda piece: restore(piece, model))

    def words(self, piece: bytes, spaced: bool = False) -> list[bytes]:
        """The restored words of a piece; signs that cannot be part of a word split it. Among spaced letters nothing tells where
        a word begins, so one may begin at each, and is given as far as beginnings reach."""
        if spaced:
            joined = self.one(piece.decode()).encode().replace(b" ", b"")
            return [joined[i : i + PREFIXES[-1] + 1] for i in range(max(1, len(joined) - PREFIXES[0] + 1))]
        out = []
        for part in piece.strip(_EDGE).replace(b",", b"\n").replace(b"%", b"\n").replace(b"#", b"\n").replace(b"&", b"\n").split(b"\n"):
            part = part.strip(_EDGE)
            if len(part) >= 3:
                out += self.one(part.decode("utf-8", "replace")).encode().split()
        return out


def piece_hashes(words: list[bytes], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the beginnings (0: the whole) of words, with the index of each one's word."""
    joined = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    return _hashes(prefix_sums(joined), ends - sizes, ends, lengths)


def _hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    hashes, places = [], []
    for length in lengths:
        pick = np.flatnonzero(ends - starts > length) if length else np.arange(len(starts))
        stop = starts[pick] + length if length else ends
        hashes.append(slice_hashes(prefix, starts[pick], stop) + np.uint64(length))
        places.append(pick)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def block_features(data: np.ndarray, offsets: np.ndarray, restorer: Restorer, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of the beginnings of all plain and restored words of a block."""
    low = LOWER[data]
    starts, ends, doc = word_spans(WORDLIKE[data], offsets)
    hashes, places = _hashes(prefix_sums(low), starts, ends, lengths)
    doc = doc[places]
    more, owner = [], []
    for d, piece, spaced in hidden_pieces(data, offsets):
        for word in restorer.words(piece, spaced):
            more.append(word)
            owner.append(d)
    if more:
        h, at = piece_hashes(more, lengths)
        hashes, doc = np.concatenate([hashes, h]), np.concatenate([doc, np.array(owner)[at]])
    return hashes, doc


class Marks:
    """Learned beginnings of words, each with the chance that a document that has it is toxic."""

    def __init__(self, lengths: tuple[int, ...], hashes: np.ndarray, chances: np.ndarray, base: float):
        order = np.argsort(hashes)
        self.lengths, self.hashes, self.chances, self.base = lengths, hashes[order], chances[order], base

    def scores(self, data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> np.ndarray:
        """Noisy or over the marks of each document of a block."""
        clean = np.full(len(offsets) - 1, 1 - self.base)
        if len(self.hashes):
            hashes, doc = block_features(data, offsets, restorer, self.lengths)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(np.stack([doc[hit], at[hit]]), axis=1)
            np.multiply.at(clean, pairs[0], 1 - self.chances[pairs[1]])
        return np.clip(1 - clean, 0.0, 1.0)


def likely_marks(toxic: np.ndarray, clean: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Where counts of toxic and clean rows allow a mark."""
    odds = np.log((toxic + 0.5) / (size[1] + 1)) - np.log((clean + 0.5) / (size[0] + 1))
    return (toxic >= LEAST_SUPPORT) & (odds >= LEAST_LOG_ODDS)


def learn_marks(rows: list[tuple[int, np.ndarray]], hashes: np.ndarray, size: tuple[int, int], prior: float) -> Marks:
    """Marks from rows (toxic, which of the candidates `hashes` it has); `size` counts clean and toxic rows, also those that have
    none, and `prior` is the share of toxic rows among all that are labelled."""
    toxic_rows = [has for toxic, has in rows if toxic]
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(has for t, has in rows if t == toxic)]), minlength=len(hashes)) for toxic in (0, 1)]
    has: list[list[int]] = [[] for _ in hashes]
    for d, found in enumerate(toxic_rows):
        for h in found.tolist():
            has[h].append(d)
    # A mark counts by itself when it is common among toxic rows; else only if rows have it that no mark before explains.
    open_rows, kept = np.ones(len(toxic_rows), bool), []
    for h in np.lexsort((hashes, -counts[1])).tolist():
        if len(has[h]) >= max(2 * LEAST_SUPPORT, COMMON * size[1]) or open_rows[has[h]].sum() >= max(LEAST_SUPPORT, 0.01 * size[1]):
            kept.append(h)
            open_rows[has[h]] = False

    def likely(h: int) -> float:
        toxic, clean = prior * counts[1][h] / size[1], (1 - prior) * (counts[0][h] + 0.5) / size[0]
        return toxic / (toxic + clean)

    # A mark that clean rows have too goes when surer marks find all its toxic rows (a short beginning beside the whole word).
    surest = np.zeros(len(toxic_rows))
    for h in kept:
        surest[has[h]] = np.maximum(surest[has[h]], likely(h))
    kept = [h for h in kept if not counts[0][h] or (surest[has[h]] <= likely(h)).any()]
    marked = [sum(bool(np.isin(found, kept).any()) for t, found in rows if t == toxic) for toxic in (0, 1)]
    toxic, clean = prior * (size[1] - marked[1]) / size[1], (1 - prior) * (size[0] - marked[0]) / size[0]
    base = min(toxic / (toxic + clean), 0.45) if clean else 0.45
    return Marks((*PREFIXES, 0), hashes[kept], np.array([likely(h) for h in kept]), base)


def held_out_column():
    """Rows that labels are never learned from: CRC-32 of the id's text divides by 5."""
    return digest_id() % 5 == 0


def sample_features(documents: DataFrame, labels: DataFrame, model: np.ndarray) -> DataFrame:
    """(tie, toxic, features) of the sample: each text once, with the hashes of the beginnings of its words."""
    place = F.xxhash64("doc_id")
    picked = labels.where("toxic = 1").orderBy(place, "doc_id").limit(SAMPLE_TOXIC).union(labels.where("toxic = 0").orderBy(place, "doc_id").limit(SAMPLE_CLEAN))
    sample = durable(picked)  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows, so it may be sent to every task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(model), set()
        for block, data, offsets in text_blocks(batches):
            rows = list(zip(block.column("tie").to_pylist(), block.column("toxic").to_pylist(), strict=True))
            fresh = [k for k, row in enumerate(rows) if row not in seen and not seen.add(row)]  # copies are read once a task
            parts = [data[offsets[k] : offsets[k + 1]] for k in fresh]
            found = [np.unique(block_features(part, np.array([0, len(part)]), restorer, (*PREFIXES, 0))[0]).view(np.int64) for part in parts]
            columns = [pa.array([rows[k][i] for k in fresh], kind) for i, kind in enumerate((pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], names=["tie", "toxic", "features"])

    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull())
    read = rows.select(F.xxhash64("text").alias("tie"), "toxic", "text").mapInArrow(run, "tie long, toxic int, features array<long>")
    return read.groupBy("tie").agg(F.max("toxic").alias("toxic"), F.first("features").alias("features"))  # one text has one list


def fit(documents: DataFrame, labels: DataFrame, model: np.ndarray) -> Marks:
    """Marks learned from a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out_column()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    rows = durable(sample_features(documents, known, model))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    size = (sizes.get(0, 0), sizes.get(1, 0))
    if not all(size):
        return Marks((), np.zeros(0, np.uint64), np.zeros(0), prior)
    counted = rows.select("toxic", F.explode("features").alias("hash")).groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    often = counted.where(F.col("toxic") >= LEAST_SUPPORT).toArrow()
    toxic, clean = (often.column(c).to_numpy() for c in ("toxic", "clean"))
    hashes = np.sort(often.column("hash").to_numpy()[likely_marks(toxic, clean, size)].view(np.uint64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.flatnonzero(np.isin(hashes, f.values.to_numpy().view(np.uint64))) for f in b.column("features")]
            yield pa.RecordBatch.from_arrays([b.column("tie"), b.column("toxic"), pa.array(found, pa.list_(pa.int64()))], names=["tie", "toxic", "found"])

    placed = rows.mapInArrow(place, "tie long, toxic int, found array<long>").where(F.size("found") > 0).collect()
    return learn_marks([(r["toxic"], np.array(r["found"], np.int64)) for r in sorted(placed, key=lambda r: r["tie"])], hashes, size, prior)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document."""
    model = character_model(trigram_counts(documents))
    marks = fit(documents, labels, model)
    sent = documents.sparkSession.sparkContext.broadcast((model, marks))  # 27**3 numbers and the marks of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, marks = sent.value
        restorer = Restorer(model)
        for rows, data, offsets in text_blocks(batches):
            score = marks.scores(data, offsets, restorer)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), rows.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return documents.select("doc_id", "text", held_out_column().alias("held_out")).mapInArrow(run, SCHEMA)
