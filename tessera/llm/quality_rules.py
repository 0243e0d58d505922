"""Operator 6: quality rules, with a length-normalised log-likelihood ratio of hashed n-grams.

Two multinomials over hash buckets of 4-byte grams are counted over the whole corpus: one of trusted documents (labelled of
good quality), one of all documents. A document's verdict is the mean over its grams of log p(trusted) - log p(raw), and it
passes at THRESHOLD or more. Counts leave a task as one vector of fixed size, whatever it has read.

Defined cases: a null text has no words and fails the base rules; texts of under four bytes have score 0; without trusted
documents, or without labels, every score is 0; repeated labels of a document count once (trusted if any of them is);
equal rows give equal rows; lines and windows are those of the whole text; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import gram_buckets, packed, sums_by_document, text_blocks, unpacked

BITS = 16
THRESHOLD = -0.35
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: So many trusted ids are sent to every task; at 8 bytes each and as much again for the table they take 16 MB.
MOST_SENT = 1_000_000
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = data.split()
    n = len(words)
    solid = data.translate(None, WHITE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    repeated_lines = 0
    if b"\n" in data:
        lines = [line for line in data.split(b"\n") if line.strip(WHITE)]
        repeated_lines = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            often = {g for g, k in Counter(grams).items() if k > 1}
            upto = 0
            for i, g in enumerate(grams):
                if g in often:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, repeated_lines, repeated


def gram_counts(documents: DataFrame, labels: DataFrame, bits: int = BITS, most_sent: int = MOST_SENT) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over trusted documents and over all documents.

    Up to `most_sent` trusted ids are sent to every task, which flags its rows in the one pass over the texts. More of them meet
    the (compressed) texts in a merge join, beside a pass that needs no ids; the counts are the same.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("trusted", F.lit(True))
    rows = documents.select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for block, data, offsets in text_blocks(batches):
            codes, sizes = gram_buckets(data, offsets, bits)
            total += np.bincount(codes, minlength=1 << bits)
            flags = np.array(block.column("trusted").to_pylist(), bool)
            good += np.bincount(codes[np.repeat(flags, sizes)], minlength=1 << bits)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(good[seen], pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "good", "raw"])

    def count_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count(unpacked(batches))

    schema = "bucket long, good long, raw long"
    if trusted.count() <= most_sent:
        flagged = rows.join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        counted = flagged.mapInArrow(count, schema)
    else:
        every = rows.select("text", F.lit(False).alias("trusted")).mapInArrow(count, schema)
        known = packed(rows.where(F.col("doc_id").isNotNull())).join(trusted.hint("merge"), "doc_id").select("text", "trusted")
        counted = every.union(known.mapInArrow(count_packed, schema).withColumn("raw", F.lit(0).cast("long")))
    good, raw = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).collect():  # at most 2**bits rows
        good[row["bucket"]], raw[row["bucket"]] = row["good"], row["raw"]
    return good, raw


def ratio_weights(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Smoothed log p(trusted) - log p(raw) of each bucket; all zero without trusted grams."""
    if not good.sum():
        return np.zeros(len(raw))
    prior = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    trusted = (good + len(raw) * 0.05 * prior) / (good.sum() + len(raw) * 0.05)
    return np.log(trusted / prior)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def apply_rules(documents: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, the ratio and the verdict of each document."""
    bits = int(np.log2(len(weights)))
    sent = documents.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for rows, data, offsets in text_blocks(batches):
            codes, sizes = gram_buckets(data, offsets, bits)
            score = sums_by_document(w[codes], sizes) / np.maximum(sizes, 1)
            raw = data.tobytes()
            base = [base_counts(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            failed = np.array([b[0] < LEAST_WORDS or 100 * b[4] > MOST_REPEATED_PERCENT * b[0] for b in base])
            columns = [rows.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*base, strict=True))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], names=NAMES)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_verdicts(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts over all documents, then the verdict of every document."""
    return apply_rules(documents, ratio_weights(*gram_counts(documents, labels)), threshold)
