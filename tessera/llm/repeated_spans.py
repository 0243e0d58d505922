"""Operator 5: removal of repeated 100-byte strings by a depth-limited, sparse suffix sort.

Suffixes are ordered only as far as the threshold, digit by digit, and a suffix leaves as soon as nothing shares its
digits so far. The passes go from the most significant digit down:

1. The first digit is a 32-byte gram. Of the 69 grams of a window only that with the least hash is used (the leftmost of
   equals): a choice by content, so equal windows choose alike, and about one place in 35 is sorted instead of all.
2. The second digit is the segment around the gram that covers all windows which chose it. Equal segments settle all their
   windows at once: the first stays, the others go. A gram with a single segment is done: its windows are found nowhere else.
3. Windows of segments that differ around a shared gram go through 1 and 2 again with grams of 84 bytes. Nearly all windows
   are done then; what stays lies within a few bytes of the place where two texts part.
4. The rest is refined to single windows; equal windows are the repeated ones.

Before each shuffle a task folds what it has read: only the first of equal rows travels for others, later ones are already
decided; grams with many segments in one task skip the sort of their segments and are refined under salted keys. So no
passage, however frequent, meets in one task. Digits are compared as hashes (gram and segment, or both hashes of a window, are 128 bits).

A document is (doc_id, text): rows equal in both are one document and get equal results; a null doc_id comes before all others;
rows with one id and different texts are ordered by a hash of the text. Null texts count as empty; texts of under 100 bytes
lose nothing; memory grows with the longest single text; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import BLOCK_BYTES, durable, mix, packed, powers, prefix_sums, shuffles_freed, slice_hashes, text_blocks, whole_groups

SPAN = 100
GRAM = 32
LONG_GRAM = 84
MANY_SEGMENTS = 64
FOLD_ROWS = 1 << 20

FULL, PARTIAL, PLAIN, WITNESS = 0, 1, 2, 3


def _least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each run of `width` values."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later = best[step:] < best[:-step]
        best = np.where(later, best[step:], best[:-step])
        at = np.where(later, at[step:], at[:-step])
        span += step
    return at


def all_windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the block) and document index of all windows of a block."""
    windows = np.maximum(np.diff(offsets) - SPAN + 1, 0)
    doc = np.repeat(np.arange(len(windows)), windows)
    return np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][doc], doc


def anchors(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Gram hash, segment hash, document index, first and last window start of each gram of `width` bytes that the windows at `starts` choose."""
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    prefix = prefix_sums(data)
    places = np.arange(len(data) - width + 1)
    grams = slice_hashes(prefix, places, places + width)
    at = _least_positions(grams, SPAN - width + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    low, high, at, doc = starts[first], starts[last], at[first], doc[first]
    segment = slice_hashes(prefix, low, high + SPAN) + mix((at - low).astype(np.uint64))
    return grams[at], segment, doc, low - offsets[doc], high - offsets[doc]


#: place holds low << 33 | high << 2 | kind, so that a row is short on its way through a shuffle.
ROW = "key long, digit long, doc long, tie int, place long"
NAMES = ["key", "digit", "doc", "tie", "place"]


def _emit(key, digit, doc, tie, low, high, kind) -> pa.RecordBatch:
    place = (np.asarray(low).astype(np.uint64) << np.uint64(33)) | (np.asarray(high).astype(np.uint64) << np.uint64(2)) | np.asarray(kind).astype(np.uint64)
    columns = [pa.array(np.asarray(c).view(np.int64), pa.int64()) for c in (key, digit, doc)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.asarray(tie).astype(np.int32)), pa.array(place.view(np.int64))], names=NAMES)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """key, digit, doc, tie, low, high and kind of the rows of a task, which are sorted by key, in lots of whole keys."""
    for key, digit, doc, tie, place in whole_groups(batches, NAMES, FOLD_ROWS):
        yield key.view(np.uint64), digit.view(np.uint64), doc, tie, *_unpacked_place(place), (place.view(np.uint64) & np.uint64(3)).astype(np.int64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _sorted_once(*columns: np.ndarray, keys: int) -> tuple[np.ndarray, ...]:
    """The rows in the order of the first `keys` columns, those equal in all of these once (rows of equal documents)."""
    order = np.lexsort(columns[:keys][::-1])
    columns = tuple(c[order] for c in columns)
    once = _runs(*columns[:keys])
    return tuple(c[once] for c in columns)


def _distinct_per_gram(new_gram: np.ndarray, new_digit: np.ndarray) -> np.ndarray:
    """For each row, how many digits its gram has."""
    group = np.cumsum(new_gram) - 1
    return np.bincount(group, weights=new_digit)[group]


def _salt(doc: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64) * np.uint64(31) + low.astype(np.uint64))


def fold_anchors(gram, segment, doc, tie, low, high) -> Iterator[pa.RecordBatch]:
    """What one task sends of its anchors (see the module's text)."""
    gram, segment, doc, tie, low, high = _sorted_once(gram, segment, doc, tie, low, high, keys=5)
    new_gram, new_segment = _runs(gram), _runs(gram, segment)
    crowded = _distinct_per_gram(new_gram, new_segment) >= MANY_SEGMENTS
    kind = np.where(~new_segment, FULL, np.where(crowded, PARTIAL, PLAIN))
    salt = _salt(doc, low)
    sent = kind == PLAIN
    yield _emit(np.where(sent, gram, salt), np.where(sent, segment, 0), doc, tie, low, high, kind)
    if (one := crowded & new_gram).any():
        yield _emit(gram[one], salt[one], doc[one], tie[one], low[one], high[one], np.full(one.sum(), WITNESS))


def settle_anchors(gram, segment, doc, tie, low, high, kind) -> tuple[np.ndarray, ...]:
    """Sorts all rows of the grams of one task: (doc, tie, low, high, kind) of what goes or is refined."""
    open_rows = kind >= PLAIN
    done = tuple(c[~open_rows] for c in (doc, tie, low, high, kind))
    gram, segment, doc, tie, low, high, kind = _sorted_once(*(c[open_rows] for c in (gram, segment, doc, tie, low, high, kind)), keys=5)
    new_gram, new_segment = _runs(gram), _runs(gram, segment)
    several = _distinct_per_gram(new_gram, new_segment) > 1 if len(gram) else new_gram
    kind = np.where(kind == WITNESS, WITNESS, np.where(~new_segment, FULL, np.where(several, PARTIAL, PLAIN)))
    keep = kind <= PARTIAL
    return tuple(np.concatenate([a, b[keep]]) for a, b in zip(done, (doc, tie, low, high, kind), strict=True))


def _as_ranges(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tie, low, high) of runs of consecutive window starts."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order]
    first = _runs(doc, tie)
    first[1:] |= start[1:] > start[:-1] + 1
    at = np.flatnonzero(first)
    ends = start[np.concatenate([at[1:], [len(start)]]).astype(np.int64) - 1] if len(start) else start
    return doc[at], tie[at], start[at], ends


def fold_windows(first, second, doc, tie, start) -> Iterator[pa.RecordBatch]:
    """What one task sends of its windows: the first of equal ones, and ranges of the others, which go."""
    first, second, doc, tie, start = _sorted_once(first, second, doc, tie, start, keys=5)
    new = _runs(first, second)
    yield _emit(first[new], second[new], doc[new], tie[new], start[new], start[new], np.full(new.sum(), PLAIN))
    doc, tie, low, high = _as_ranges(doc[~new], tie[~new], start[~new])
    if len(doc):
        yield _emit(_salt(doc, low), np.zeros(len(doc), np.uint64), doc, tie, low, high, np.full(len(doc), FULL))


def settle_windows(first, second, doc, tie, low, high, kind) -> tuple[np.ndarray, ...]:
    """(doc, tie, low, high) of all ranges that go, from all rows of the windows of one task."""
    done = tuple(c[kind == FULL] for c in (doc, tie, low, high))
    first, second, doc, tie, low = _sorted_once(*(c[kind == PLAIN] for c in (first, second, doc, tie, low)), keys=5)
    later = ~_runs(first, second)
    return tuple(np.concatenate([a, b]) for a, b in zip(done, _as_ranges(doc[later], tie[later], low[later]), strict=True))


_SECOND_HIGH = np.random.default_rng(29).integers(0, 1 << 63, 256, np.uint64)


def window_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window at each start; the second reads bytes through a random table."""
    other = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SECOND_HIGH[data] * powers(len(data))[0], out=other[1:])
    return slice_hashes(prefix_sums(data), starts, starts + SPAN), slice_hashes(other, starts, starts + SPAN)


def _unpacked_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low and high of the place column."""
    place = place.view(np.uint64)
    return (place >> np.uint64(33)).astype(np.int64), ((place >> np.uint64(2)) & np.uint64(0x7FFFFFFF)).astype(np.int64)


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of packed texts with their open ranges: doc and tie by document, bytes, offsets, and starts and document index of the open windows."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids, texts, ranges, size = [], [], [], 0

    def block() -> tuple[np.ndarray, ...]:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        index = np.repeat(np.arange(len(ranges)), [len(r) for r in ranges])
        low, high = _unpacked_place(np.concatenate(ranges))
        order = np.lexsort((low, index))
        index, low, sizes = index[order], low[order], (high - low + 1)[order]
        starts = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low + offsets[index], sizes)
        doc, tie = (np.array(c, np.int64) for c in zip(*ids, strict=True))
        made = doc, tie, np.frombuffer(b"".join(texts), np.uint8), offsets, starts, np.repeat(index, sizes)
        for held in (ids, texts, ranges):
            held.clear()
        return made

    for batch in batches:
        for doc, tie, text, places in zip(*(batch.column(n) for n in ("doc", "tie", "text", "places")), strict=True):
            data = unpack(text.as_py())
            if texts and size + len(data) > BLOCK_BYTES:
                yield block()
                size = 0
            ids.append((doc.as_py(), tie.as_py()))
            texts.append(data)
            ranges.append(places.values.to_numpy())
            size += len(data)
    if texts:
        yield block()


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans (n, 2), ascending."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([new[1:], [True]])]], axis=1)


def _tied(documents: DataFrame) -> DataFrame:
    """doc (a null id as the least long), tie and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int").alias("tie"), text.alias("text")
    )


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """(doc, tie, low, high): ranges of window starts whose 100-byte string starts earlier elsewhere."""
    rows = _tied(documents).select("doc", "tie", "text")

    def folded(parts: Iterator[tuple[np.ndarray, ...]], fold) -> Iterator[pa.RecordBatch]:
        """Folds the rows of a task in lots of about FOLD_ROWS."""
        held: list[tuple[np.ndarray, ...]] = []
        for part in parts:
            held.append(part)
            if sum(len(h[0]) for h in held) >= FOLD_ROWS:
                yield from fold(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if held:
            yield from fold(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def of_block(doc, tie, data, offsets, starts, index, width) -> tuple[np.ndarray, ...]:
        gram, segment, d, low, high = anchors(data, offsets, starts, index, width)
        return gram, segment, doc[d], tie[d], low, high

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (of_block(b.column("doc").to_numpy(), b.column("tie").to_numpy(), data, offsets, *all_windows(offsets), GRAM) for b, data, offsets in text_blocks(batches))
        yield from folded(parts, fold_anchors)

    def spread_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded((of_block(*block, LONG_GRAM) for block in _open_blocks(batches)), fold_anchors)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for taken in _taken(batches):
            doc, tie, low, high, kind = settle_anchors(*taken)
            yield _emit(kind, np.zeros(len(doc), np.int64), doc, tie, low, high, kind)

    def spread_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((*window_hashes(data, starts), doc[index], tie[index], starts - offsets[index]) for doc, tie, data, offsets, starts, index in _open_blocks(batches))
        yield from folded(parts, fold_windows)

    def last_settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for taken in _taken(batches):
            doc, tie, low, high = settle_windows(*taken)
            yield _emit(np.full(len(doc), FULL), np.zeros(len(doc), np.int64), doc, tie, low, high, np.full(len(doc), FULL))

    def settled(sent: DataFrame, settle_with) -> DataFrame:
        with shuffles_freed(documents.sparkSession):
            return durable(sent.repartition("key").sortWithinPartitions("key").mapInArrow(settle_with, ROW).select(F.col("key").cast("int").alias("kind"), "doc", "tie", "place"))

    def still_open(marks: DataFrame) -> DataFrame:
        places = marks.where(F.col("kind") == PARTIAL).groupBy("doc", "tie").agg(F.collect_set("place").alias("places"))  # of one document
        return packed(rows).join(places, ["doc", "tie"]).select("doc", "tie", "text", "places")

    marks = settled(rows.mapInArrow(spread, ROW), settle)
    closer = settled(still_open(marks).mapInArrow(spread_open, ROW), settle)
    found = settled(still_open(closer).mapInArrow(spread_windows, ROW), last_settle)
    gone = [m.where(F.col("kind") == FULL).select("doc", "tie", "place") for m in (marks, closer, found)]
    return gone[0].unionByName(gone[1]).unionByName(gone[2])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(text: bytes, places: pa.Array | None) -> tuple[list[bytes], int, int]:
    if places is None or not len(places):
        return [text], 0, 0
    low, high = _unpacked_place(places.to_numpy())
    spans = merged(np.stack([low, high + SPAN], axis=1))
    kept, last = [], 0
    for a, b in spans.tolist():
        kept.append(text[last:a])
        last = b
    return [*kept, text[last:]], int((spans[:, 1] - spans[:, 0]).sum()), len(spans)


def _with_places(documents: DataFrame) -> DataFrame:
    found = repeated_ranges(documents).groupBy("doc", "tie").agg(F.collect_list("place").alias("places"))  # of one document
    return packed(_tied(documents)).join(found, ["doc", "tie"], "left").select("doc_id", "text", "places")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, pa.Array | None]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
        yield unpack(text.as_py()), places.values


def removal_digests(documents: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, places in _texts(batch):
                kept, removed, spans = _cut(data, places)
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                rows.append((len(data), removed, spans, digest.hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_places(documents).mapInArrow(run, SCHEMA)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and the text without its repeated bytes, as binary (a cut may fall within a character)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b"".join(_cut(data, places)[0]) for data, places in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return _with_places(documents).mapInArrow(run, "doc_id long, kept binary")
