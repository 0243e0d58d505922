"""Operator 4: benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words at every HALF words. Terms are hashed to DIMS, weighted by TF-IDF (document frequencies
over all passages of the corpus), and projected on the leading right singular vectors of the passage matrix, scaled by
their singular values. The vectors come from a randomised decomposition in one distributed pass (range finder with a Nystrom
step) over all passages (of HALF words) of all documents. All passages of all documents are then searched.

Items are cut into windows too; a passage is a candidate of an item when the cosine of two of their windows reaches
COSINE. Beside this, an exact route loses nothing: an item's rarest words are chosen so that at least `least`
of its matched words are among them wherever the longest common subsequence could suffice; every run of the text with so
many of them, at every HALF words, is a candidate too (and a passage with fewer of them around it is none). A candidate is verified by the longest common subsequence of words: LCS_SURE of the item's words,
or LCS_MAYBE of them together with the whole answer (the item's last sentence) in order, which finds paraphrases.

The items are a query set: they are held by every task in blocks of at most ITEMS, one pass over the documents a block.

Defined cases: null and empty texts hold nothing; items without words are ignored; items of under LEAST_WORDS words must be there
entirely, in one piece (looked up by hash in every text); repeated rows and items give repeated findings once for each (doc_id, item_id), of equal
finds the largest share; texts of any length are read whole, a block of them or one longer text at a time; empty tables give no rows; further
columns are ignored. Punctuation and ASCII case do not count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import LOWER, WORDLIKE, mix, prefix_sums, slice_hashes, text_blocks, text_tie, without_rows, word_spans

BITS = 12
DIMS = 1 << BITS
RANK, OVERSAMPLED = 48, 64
WINDOW, HALF = 32, 16
RUNS = 4096  # passages weighed at once, of a text of any length
ITEMS = 1000
COSINE = 0.35
LCS_SURE, LCS_MAYBE = 0.75, 0.5
LEAST_WORDS = 8
LCS_ITEMS = 256  # items whose word masks are held at once


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document index of the words of a block."""
    starts, ends, doc = word_spans(WORDLIKE[data], offsets)
    return slice_hashes(prefix_sums(LOWER[data]), starts, ends), doc


def halves(doc: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of each run of HALF words (the last run of a document may be shorter)."""
    counts = np.bincount(doc, minlength=documents)
    runs = -(-counts // HALF)
    owner = np.repeat(np.arange(documents), runs)
    firsts = np.cumsum(counts) - counts
    within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    return firsts[owner] + HALF * within, owner


def dims_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def passage_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages (of HALF words) each dimension occurs, and the number of passages, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)
        for _, data, offsets in text_blocks(batches):
            hashes, doc = words_of(data, offsets)
            firsts, _ = halves(doc, len(offsets) - 1)
            if len(firsts):
                run = np.repeat(np.arange(len(firsts)), np.diff(np.concatenate([firsts, [len(hashes)]])))
                pairs = np.sort(run * DIMS + dims_of(hashes))
                fresh = np.concatenate([[True], pairs[1:] != pairs[:-1]])
                seen[:DIMS] += np.bincount(pairs[fresh] % DIMS, minlength=DIMS)
                seen[DIMS] += len(firsts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(seen)], names=["dim", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for row in documents.select("text").mapInArrow(count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        out[row["dim"]] = row["n"]  # DIMS + 1 rows
    return out[:DIMS], int(out[DIMS])


def _probe() -> np.ndarray:
    return np.random.default_rng(11).normal(size=(DIMS, OVERSAMPLED)).astype(np.float32)


def latent_basis(documents: DataFrame, idf: np.ndarray) -> np.ndarray:
    """(DIMS, RANK): TF-IDF weights times singular vectors over singular values, of the passages of all documents."""

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, out = np.ascontiguousarray(_probe().T, float), np.zeros((OVERSAMPLED, DIMS))
        for _, data, offsets in text_blocks(batches):
            hashes, doc = words_of(data, offsets)
            firsts, _ = halves(doc, len(offsets) - 1)
            every, ends = dims_of(hashes), np.append(firsts, len(hashes))
            for low in range(0, len(firsts), RUNS):
                cut = ends[low : low + RUNS + 1]
                dims, first = every[cut[0] : cut[-1]], cut[:-1] - cut[0]
                value, run = idf[dims], np.repeat(np.arange(len(first)), np.diff(cut))
                value /= (np.sqrt(np.add.reduceat(value * value, first)) + 1e-9)[run]
                for column, total in zip(probe, out, strict=True):  # one column at a time: sums of whole rows take twice as long
                    seen = np.add.reduceat(column[dims] * value, first)
                    total += np.bincount(dims, seen[run] * value, DIMS)
        used = np.flatnonzero(np.abs(out).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(column[used]) for column in out)], names=["dim", *(f"c{k}" for k in range(OVERSAMPLED))])

    schema = "dim long, " + ", ".join(f"c{k} double" for k in range(OVERSAMPLED))
    sums = documents.select("text").mapInArrow(accumulate, schema).groupBy("dim").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(OVERSAMPLED)])
    ranged = np.zeros((DIMS, OVERSAMPLED))
    for row in sums.collect():  # at most DIMS rows
        ranged[row["dim"]] = row[1:]
    # Nystrom: with G = A'A and Y = G P, G is near Y (P'Y)^-1 Y', whose eigenvectors are A's right singular vectors.
    middle = _probe().astype(float).T @ ranged
    value, vector = np.linalg.eigh((middle + middle.T) / 2)
    good = value > 1e-8 * max(value.max(), 1e-30)
    if not good.any():
        return (_probe()[:, :RANK] * idf[:, None]).astype(np.float32)
    left, strength, _ = np.linalg.svd(ranged @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    rank = min(RANK, len(strength))
    return (idf[:, None] * left[:, :rank] / (strength[:rank] + 1e-6 * strength[0])).astype(np.float32)


def lcs_length(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        if m := places.get(w):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def in_order(answer: list[int], text: list[int]) -> bool:
    """Whether all words of the answer occur in the text, in order."""
    rest = iter(text)
    return all(any(w == x for x in rest) for w in answer)


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        out += mix(hashes[k : k + len(out)] + np.uint64(k))
    return out


class Items:
    """A block of benchmark items: words, answers, latent vectors of their windows, postings of their rarest words."""

    def __init__(self, rows: list[tuple[int, str]], basis: np.ndarray, frequencies: np.ndarray):
        self.short: dict[int, dict[int, list[int]]] = {}
        postings: list[tuple[int, int]] = []
        self.least = []
        self.ids, self.words, self.answers = [], [], []
        vectors, self.owner, self.at = [], [], []
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            hashes, _ = words_of(data, np.array([0, len(data)]))
            if not len(hashes):
                continue
            sentences = [s for s in re.split(r"[.?!\n]+", text) if s.strip()]
            last = np.frombuffer((sentences[-1] if sentences else text).encode(), np.uint8)
            self.answers.append(words_of(last, np.array([0, len(last)]))[0].tolist())
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(hashes.tolist())
            if len(hashes) < LEAST_WORDS:
                self.least.append(0)
                self.short.setdefault(len(hashes), {}).setdefault(int(runs_of(hashes, len(hashes))[0]), []).append(k)
                continue
            need = math.ceil(LCS_MAYBE * len(hashes))
            self.least.append(max(1, need // 4))
            word, times = np.unique(hashes, return_counts=True)
            order = np.argsort(frequencies[dims_of(word)], kind="stable")
            # Words beyond these can make up no more than need - least of the matched ones.
            rare = int(np.argmax(len(hashes) - np.cumsum(times[order]) <= need - self.least[k])) + 1
            postings += [(w, k) for w in word[order[:rare]].tolist()]
            starts = sorted({*range(0, max(1, len(hashes) - WINDOW + 1), HALF), max(0, len(hashes) - WINDOW)})
            for s in starts:
                part = hashes[s : s + WINDOW]
                vectors.append(basis[dims_of(part)].sum(axis=0))
                self.owner.append(k)
                self.at.append(s)
        self.vectors = np.array(vectors, np.float32).reshape(len(vectors), basis.shape[1])
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True) + 1e-9
        self.owner, self.at = np.array(self.owner, np.int64), np.array(self.at, np.int64)
        postings.sort()
        self.posted = np.array([k for _, k in postings], np.int64)
        self.rare, self.first = np.unique(np.array([w for w, _ in postings], np.uint64), return_index=True)
        self.first = np.append(self.first, len(postings))
        self.least, self.sizes = np.array(self.least, np.int64), np.array([len(w) for w in self.words], np.int64)
        self.margins = HALF + self.sizes // 4
        self._masks: tuple = (-1,)

    def masks(self, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary of LCS_ITEMS items from `low` on, and by item and word the places of the word (items of at most 64 words)."""
        if self._masks[0] != low:
            words = self.words[low : low + LCS_ITEMS]
            vocabulary = np.unique(np.array([w for item in words for w in item], np.uint64))
            masks = np.zeros((len(words), len(vocabulary) + 1), np.uint64)
            for k, item in enumerate(words):
                if len(item) <= 64:
                    np.bitwise_or.at(masks[k], np.searchsorted(vocabulary, np.array(item, np.uint64)), np.uint64(1) << np.arange(len(item), dtype=np.uint64))
            self._masks = low, vocabulary, masks
        return self._masks[1:]


def short_places(items: Items, hashes: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) of the short items that stand in a document."""
    found = set()
    for size, where in items.short.items():
        runs = runs_of(hashes, size)
        for at in np.flatnonzero(np.isin(runs, np.array(list(where), np.uint64)) & (doc[: len(runs)] == doc[size - 1 :][: len(runs)])).tolist():
            found.update((int(doc[at]), k) for k in where[int(runs[at])])
    return found


def rare_hits(items: Items, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, word) wherever one of an item's rarest words stands, by ascending word."""
    if not len(items.rare):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(items.rare, hashes), len(items.rare) - 1)
    places = np.flatnonzero(items.rare[at] == hashes)
    counts = np.diff(items.first)[at[places]]
    item = items.posted[np.repeat(items.first[at[places]] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    return item, np.repeat(places, counts)


def rare_places(items: Items, hashes: np.ndarray, doc: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray, hits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(item, first word) of every passage, at every HALF words, that holds enough of an item's rarest words."""
    item, place = hits
    step = len(hashes) + 1
    keys = np.sort(item * step + place)
    item, place = keys // step, keys % step
    size, margin = items.sizes[item], items.margins[item]
    d = doc[place]
    # A passage that suffices has a first rare word, after which enough of them follow within its length.
    enough = np.searchsorted(keys, item * step + np.minimum(place + size + 2 * margin, word_ends[d])) - np.arange(len(keys)) >= items.least[item]
    item, place, size, margin, d = item[enough], place[enough], size[enough], margin[enough], d[enough]
    begin, end = word_starts[d], word_ends[d]
    low = np.maximum(0, -(-(place - begin - size - margin + 1) // HALF))
    high = np.minimum((place - begin + margin) // HALF, (end - begin - 1) // HALF)
    n = np.maximum(high - low + 1, 0)
    start = np.repeat(begin + HALF * low, n) + HALF * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    both = np.unique(np.repeat(item, n) * step + start)
    item, start = both // step, both % step
    d, margin = doc[start], items.margins[item]
    left, right = np.maximum(word_starts[d], start - margin), np.minimum(word_ends[d], start + items.sizes[item] + margin)
    keep = np.searchsorted(keys, item * step + right) - np.searchsorted(keys, item * step + left) >= items.least[item]
    return item[keep], start[keep]


def cosine_places(items: Items, basis: np.ndarray, hashes: np.ndarray, firsts: np.ndarray, owner: np.ndarray, hits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, document) of every passage near an item's window; a first word may lie before its document's.

    Passages around which too few of the item's rarest words stand for any match are left out at once.
    """
    half = np.add.reduceat(basis[dims_of(hashes)], firsts, axis=0)
    joined = np.flatnonzero(owner[1:] == owner[:-1])
    window = half.copy()
    window[joined] += half[joined + 1]
    window /= np.linalg.norm(window, axis=1, keepdims=True) + 1e-9
    kinds, run = len(items.ids), np.searchsorted(firsts, hits[1], "right") - 1
    before = (items.at + items.margins[items.owner]) // HALF + 1
    after = (items.sizes[items.owner] + items.margins[items.owner] - items.at) // HALF + 2
    near = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(window), 2048):
        w, q = np.nonzero(window[at : at + 2048] @ items.vectors.T >= COSINE)
        if not len(w):
            continue
        low, high = max(0, at - int(before.max())), min(len(window), at + 2048 + int(after.max()))
        part = slice(*np.searchsorted(run, [low, high]).tolist())
        counts = np.zeros((high - low + 1, kinds), np.int32)
        counts[1:] = np.bincount((run[part] - low) * kinds + hits[0][part], minlength=(high - low) * kinds).reshape(high - low, kinds).cumsum(axis=0)
        w += at
        item = items.owner[q]
        keep = counts[np.minimum(w + after[q], high) - low, item] - counts[np.maximum(w - before[q], low) - low, item] >= items.least[item]
        near.append(np.stack([w[keep], q[keep]]))
    w, q = np.concatenate(near, axis=1)
    return items.owner[q], firsts[w] - items.at[q], owner[w]


def batched_lcs(masks: np.ndarray, words: np.ndarray, item: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common subsequences of items of at most 64 words with runs [left, right) of `words`, all runs side by side.

    masks[i, w] has a bit for every place of word w in item i; the last column, for words of no item, is empty.
    """
    out = np.zeros(len(item), np.int64)
    order = np.argsort(left - right, kind="stable")
    item, left, lengths = item[order], left[order], (right - left)[order]
    rows = np.full(len(item), np.iinfo(np.uint64).max, np.uint64)
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")  # runs longer than t, at t
    for t, n in enumerate(running.tolist()):
        row = rows[:n]
        hit = row & masks[item[:n], words[left[:n] + t]]
        rows[:n] = (row + hit) | (row - hit)
    full = np.iinfo(np.uint64).max >> (np.uint64(64) - sizes[item].astype(np.uint64))
    out[order] = sizes[item] - np.bitwise_count(rows & full)
    return out


def passage_shares(items: Items, hashes: np.ndarray, item: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The share of its item that each passage [left, right) holds in order."""
    shares = np.zeros(len(item))
    for low in range(0, len(items.ids), LCS_ITEMS):
        mine = np.flatnonzero((item >= low) & (item < low + LCS_ITEMS) & (items.sizes[item] <= 64))
        if not len(mine):
            continue
        vocabulary, masks = items.masks(low)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        words = np.where(vocabulary[at] == hashes, at, len(vocabulary))
        found = batched_lcs(masks, words, item[mine] - low, items.sizes[low : low + LCS_ITEMS], left[mine], right[mine])
        shares[mine] = found / items.sizes[item[mine]]
    for i in np.flatnonzero(items.sizes[item] > 64).tolist():
        shares[i] = lcs_length(items.words[item[i]], hashes[left[i] : right[i]].tolist()) / items.sizes[item[i]]
    return shares


def search_block(items: Items, basis: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], float]:
    """(document index, item index) -> share found, for the documents of a block."""
    hashes, doc = words_of(data, offsets)
    firsts, owner = halves(doc, len(offsets) - 1)
    if not len(firsts) or not items.ids:
        return {}
    found: dict[tuple[int, int], float] = dict.fromkeys(short_places(items, hashes, doc), 1.0)
    word_ends = np.searchsorted(doc, np.arange(len(offsets) - 1), "right")
    word_starts = np.searchsorted(doc, np.arange(len(offsets) - 1), "left")
    hits = rare_hits(items, hashes)
    item, start, d = cosine_places(items, basis, hashes, firsts, owner, hits)
    more, place = rare_places(items, hashes, doc, word_starts, word_ends, hits)
    item, start, d = np.concatenate([item, more]), np.concatenate([start, place]), np.concatenate([d, doc[place]])
    left = np.maximum(word_starts[d], start - items.margins[item])
    right = np.minimum(word_ends[d], start + items.sizes[item] + items.margins[item])
    order = np.flatnonzero(right > left)
    order = order[np.argsort((item * len(hashes) + left)[order], kind="stable")]
    item, left, right, d = item[order], left[order], right[order], d[order]
    if len(item):  # of passages with one beginning the longest holds all that the others hold
        once = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (left[1:] != left[:-1])]))
        item, left, right, d = item[once], left[once], np.maximum.reduceat(right, once), d[once]
    shares = passage_shares(items, hashes, item, left, right)
    likely = np.flatnonzero(shares >= LCS_MAYBE)
    for i, k, x, share in zip(likely.tolist(), item[likely].tolist(), d[likely].tolist(), shares[likely].tolist(), strict=True):
        if share > found.get((x, k), 0.0) and (share >= LCS_SURE or in_order(items.answers[k], hashes[left[i] : right[i]].tolist())):
            found[x, k] = share
    return found


def findings(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tie, item_id, share): every row with every benchmark item found in it; tie is the hash of its text."""
    spark = documents.sparkSession
    frequencies, passages = passage_frequencies(documents)
    idf = np.log((passages + 1.0) / (frequencies + 1.0)) + 0.05
    basis = latent_basis(documents, idf)
    blocks = max(1, -(-benchmark.count() // ITEMS))
    placed = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    out = None
    for block in range(blocks):
        rows = sorted(((r["item_id"], r["text"]) for r in placed.where(F.col("block") == block).collect()), key=str)
        sent = spark.sparkContext.broadcast((Items(rows, basis, frequencies), basis))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, basis = sent.value
            for block_rows, data, offsets in text_blocks(batches):
                found = search_block(items, basis, data, offsets)
                ids, ties = block_rows.column("doc_id").to_pylist(), block_rows.column("tie").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, _ in found], pa.int64()),
                        pa.array([ties[d] for d, _ in found], pa.int64()),
                        pa.array([items.ids[k] for _, k in found], pa.int64()),
                        pa.array(list(found.values()), pa.float64()),
                    ],
                    names=["doc_id", "tie", "item_id", "share"],
                )

        part = documents.select("doc_id", "text", text_tie().alias("tie")).mapInArrow(run, "doc_id long, tie long, item_id long, share double")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): every document with every benchmark item found in it."""
    return findings(documents, benchmark).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no benchmark item is found, with the columns that came.

    Rows are told apart by doc_id and text: others of the same, or of no, doc_id stay.
    """
    return without_rows(documents, findings(documents, benchmark).select("doc_id", "tie"))
