"""Operator 2: quality classifier from weak labels.

Overlapping heuristic labellers vote good, junk or nothing on every document. Documents with one pattern of votes are alike to the label
model, so expectation maximisation runs on the counts of patterns, of which there are at most 3**labellers whatever the
corpus. It estimates each labeller's rate of junk votes among good documents and among each kind of junk, and the shares of these classes, from
the votes alone; a labeller that does not vote says nothing. The posteriors of a
bounded sample (SAMPLE expected rows by a hash of id and text; a row that is repeated counts once) train a linear scorer over hashed 4-byte grams and the
coarse shape of the text (each labeller's measure, in steps), which scores all. Tasks make the sample's features, so no text reaches the driver.

Defined cases: a null or blank text is voted junk by length and has no grams, so its score is that of its shape, capped at the
posterior of its votes; texts of under four bytes likewise; equal texts have equal rows (scores are rounded to six places, for sums
depend on the block in the places after); repeated rows give repeated rows; an empty table gives no rows; further
columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import LOWER, SPACE, gram_buckets, prefix_sums, slice_hashes, sums_by_document, text_blocks, word_spans

LABELLERS = ("symbols", "capitals", "stutter", "exclaiming", "length", "word_length", "variety")
BITS = 16
STEPS = 16
SAMPLE = 3000
ROUNDS = 60
#: First rates of junk votes (of any labeller on good documents and other kinds of junk, and on the kind it is meant for) and first
#: share of good documents. The rates weigh as much as PRIOR documents a class, so the corpus decides.
START_OTHER, START_OWN, START_GOOD, PRIOR = 0.01, 0.9, 0.8, 2.0
#: Value of a shape feature beside gram shares, which add up to 1.
SHAPE = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, by document: shares of a word or a letter, and `words`, their number."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    starts, ends, doc = word_spans(~SPACE[data], offsets)
    words = np.bincount(doc, minlength=n)
    per_word = np.maximum(words, 1)
    count = lambda mask: sums_by_document(mask, lengths)
    hashes = slice_hashes(prefix_sums(LOWER[data]), starts, ends)
    again = np.zeros(n)
    if len(doc) > 1:
        repeat = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:][repeat], minlength=n)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return {
        "symbols": count(_SYMBOL[data]) / per_word,
        "capitals": count(_UPPER[data]) / np.maximum(count(_ALPHA[data]), 1),
        "stutter": again / per_word,
        "exclaiming": count(data == 33) / per_word,
        "words": words,
        "word_length": np.bincount(doc, weights=ends - starts, minlength=n) / per_word,
        "variety": np.bincount(doc[order][new], minlength=n) / per_word,
    }


def votes(seen: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, labellers) of 1 good, -1 junk, 0 nothing."""

    def vote(value: np.ndarray, good: float, junk: float) -> np.ndarray:
        return np.where(value <= good, 1, np.where(value >= junk, -1, 0))

    words, mean_length = seen["words"], seen["word_length"]
    out = np.stack(
        [
            vote(seen["symbols"], 0.05, 0.2),
            vote(seen["capitals"], 0.15, 0.5),
            vote(seen["stutter"], 0.05, 0.2),
            vote(seen["exclaiming"], 0.05, 0.2),
            np.where(words >= 20, 1, 0),
            np.where((mean_length >= 2.5) & (mean_length <= 9.5), 1, np.where((mean_length < 2) | (mean_length > 14), -1, 0)),
            np.where(words < 20, 0, vote(-seen["variety"], -0.3, -0.15)),
        ],
        axis=1,
    )
    out[words == 0] = 0
    out[words == 0, LABELLERS.index("length")] = -1
    return out


def shapes(seen: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, labellers) feature numbers from 2**BITS on: each measure in STEPS steps."""
    scaled = [20 * seen["symbols"], 16 * seen["capitals"], 20 * seen["stutter"], 20 * seen["exclaiming"], np.log2(1 + seen["words"]), seen["word_length"], 16 * seen["variety"]]
    return (1 << BITS) + STEPS * np.arange(len(scaled)) + np.minimum(np.stack(scaled, axis=1), STEPS - 1).astype(np.int64)


def pattern_codes(v: np.ndarray) -> np.ndarray:
    """Each row of votes as a number in base 3."""
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def pattern_votes(codes: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    """The votes of pattern codes."""
    return codes[:, None] // 3 ** np.arange(labellers)[None] % 3 - 1


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation: posterior of good for each pattern, P(junk vote | class, a vote) of each labeller, shares of the classes.

    Class 0 is good; class k + 1 is the junk that labeller k is meant for, since a rule that catches one kind of junk passes
    the other kinds.
    """
    v = pattern_votes(codes)
    junk, good = (v == -1).astype(float), (v == 1).astype(float)
    classes = len(LABELLERS) + 1
    start = np.full((classes, len(LABELLERS)), START_OTHER)
    start[range(1, classes), range(len(LABELLERS))] = START_OWN
    rates, shares = start.copy(), np.array([START_GOOD, *[(1 - START_GOOD) / len(LABELLERS)] * len(LABELLERS)])
    posterior = np.zeros((len(codes), classes))
    for _ in range(rounds):
        logs = junk @ np.log(rates).T + good @ np.log(1 - rates).T + np.log(shares)
        posterior = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        weight = counts[:, None] * posterior
        rates = (weight.T @ junk + PRIOR * start) / (weight.T @ (junk + good) + PRIOR)
        shares = counts @ posterior + 1
        shares /= shares.sum()
    return posterior[:, 0], rates, shares


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 5, rate: float = 0.3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on (features, values, soft target) rows, by gradient steps scaled by feature."""
    weights = np.zeros((1 << BITS) + STEPS * len(LABELLERS))
    past, bias, past_bias, rng = np.full(len(weights), 1e-8), 0.0, 1e-8, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            kinds, x, target = rows[i]
            z = bias + float(weights[kinds] @ x)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            step = error * x
            past[kinds] += step * step
            weights[kinds] -= rate * step / np.sqrt(past[kinds])
            past_bias += error * error
            bias -= rate * error / np.sqrt(past_bias)
    return weights, bias


def _sample(rows: DataFrame, share: float) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(code, pattern, features, values) of a share of the rows: at most 6 bytes for each of 2**BITS features of a row."""
    code = F.xxhash64("doc_id", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in text_blocks(batches):
            seen = measures(data, offsets)
            packed = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                kinds, n = np.unique(gram_buckets(data[a:b], np.array([0, b - a]), BITS)[0], return_counts=True)
                packed.append(kinds.astype("<u2").tobytes() + n.astype("<u4").tobytes())
            columns = [block.column("code"), pa.array(pattern_codes(votes(seen)), pa.int64()), pa.array(list(shapes(seen)), pa.list_(pa.int64())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "pattern", "shape", "grams"])

    place = F.pmod(code, F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(place < share).select(code.alias("code"), "text").mapInArrow(features, "code long, pattern long, shape array<long>, grams binary")
    out = []
    for r in sorted(picked.distinct().collect(), key=lambda r: (r["code"], bytes(r["grams"]))):
        k = len(r["grams"]) // 6
        kinds, n = np.frombuffer(r["grams"], "<u2", k).astype(np.int64), np.frombuffer(r["grams"], "<u4", k, 2 * k)
        shape = np.array(r["shape"], np.int64)
        out.append((r["code"], r["pattern"], np.concatenate([kinds, shape]), np.concatenate([n / max(1, n.sum()), np.full(len(shape), SHAPE)])))
    return out


def quality_scores(documents: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, the votes' pattern, its posterior, the scorer's score and whether the document is kept."""
    rows = documents.select("doc_id", "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for _, data, offsets in text_blocks(batches):
            total += np.bincount(pattern_codes(votes(measures(data, offsets))), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["pattern", "n"])

    patterns = rows.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes, counts = np.array([r["pattern"] for r in patterns], np.int64), np.array([r["n"] for r in patterns], np.float64)
    posterior = np.zeros(3 ** len(LABELLERS))
    weights, bias = np.zeros((1 << BITS) + STEPS * len(LABELLERS)), 0.0
    if len(codes):
        posterior[codes] = np.round(estimate(codes, counts)[0], 9)
        weights, bias = train_scorer([(kinds, x, posterior[pattern]) for _, pattern, kinds, x in _sample(rows, min(1.0, sample / counts.sum()))])
    sent = documents.sparkSession.sparkContext.broadcast((posterior, weights, bias))  # fixed sizes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights, bias = sent.value
        for block, data, offsets in text_blocks(batches):
            seen = measures(data, offsets)
            pattern = pattern_codes(votes(seen))
            grams, n = gram_buckets(data, offsets, BITS)
            z = bias + sums_by_document(weights[grams], n) / np.maximum(n, 1) + SHAPE * weights[shapes(seen)].sum(axis=1)
            value = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            value = np.round(np.where(n == 0, np.minimum(value, posterior[pattern]), value), 6)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), pa.array(pattern, pa.int64()), pa.array(posterior[pattern]), pa.array(value), pa.array(value >= least)],
                names=["doc_id", "pattern", "posterior", "score", "kept"],
            )

    return rows.mapInArrow(score, "doc_id long, pattern long, posterior double, score double, kept boolean")
