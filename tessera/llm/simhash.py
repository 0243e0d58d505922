"""Operator 3: near duplicates by 64-bit SimHash and meet-in-the-middle ball hashing.

Two fingerprints at distance d meet at a value within half of d of both. Within an odd radius one differing bit is left
over, so the bits are dealt into `radius` blocks and balls are taken once with each block set to zero: some block holds at
least one of the differing bits, the other bits then differ in at most radius - 1 places, and balls of half that radius
meet. (For an even radius there is one ball over all bits.) Equal fingerprints are brought together first; each distinct
fingerprint emits its variants, the variants are shuffled, and colliding fingerprints are verified.

Where a variant gathers many fingerprints, a search over that variant's own set links them by a forest instead of all
pairs, so the links of a variant never outnumber its members. Components are found by rounds over the links.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a document with fewer words than a
shingle has its whole sequence as one; a null doc_id gets its component's smallest id; equal rows give equal rows; an
empty table gives no rows; further columns are ignored; texts of any length are hashed whole, in slices.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.textkit import binary, durable, keep_firsts, text_tie, whole_groups

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
FEW = 32  # up to so many members a variant's pairs are compared directly
_SLICE = 1 << 14


def fingerprint(data: bytes, size: int = SHINGLE_WORDS) -> int:
    """SimHash of the shingles of a text, ASCII letters in lower case."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    ones, n, digest = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], ends[at : at + _SLICE], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes, from first[i] to first[i + 1]; zero for an empty run."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        size = np.diff(first)[some]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int32), first[some])
            out[some] |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(documents: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, tie (hash of the text) and fp, the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in binary(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("tie"), pa.array(found, pa.int64())], names=["doc_id", "tie", "fp"])

    return documents.select("doc_id", "text", text_tie().alias("tie")).mapInArrow(run, "doc_id long, tie long, fp long")


def ball_masks(radius: int) -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of every variant that a fingerprint emits, as signed longs."""
    blocks = radius if radius % 2 else 1
    out = []
    for block in range(blocks):
        dropped = [b for b in range(64) if radius % 2 and b % blocks == block]
        kept = [b for b in range(64) if b not in dropped]
        keep = sum(1 << b for b in kept)
        for k in range(radius // 2 + 1):
            out += [(keep, sum(1 << b for b in flips)) for flips in itertools.combinations(kept, k)]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    return [(sign(keep), sign(flip)) for keep, flip in out]


def link_members(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) between members of equal keys at most `radius` bits apart; a forest where a key has many members."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    us, vs = [], []
    shared = np.repeat(sizes > 1, sizes) & np.repeat(sizes <= FEW, sizes)
    k, x = keys[shared], values[shared].view(np.uint64)
    for gap in range(1, min(FEW, len(k))):
        same = np.flatnonzero(k[gap:] == k[:-gap])
        if not len(same):
            break
        near = same[np.bitwise_count(x[same] ^ x[same + gap]) <= radius]
        us.append(x[near])
        vs.append(x[near + gap])
    for at in np.flatnonzero(sizes > FEW):
        rest = np.unique(values[first[at] : first[at] + sizes[at]].view(np.uint64))
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                here = queue.pop()
                near = np.bitwise_count(rest ^ here) <= radius
                found, rest = rest[near], rest[~near]
                us.append(np.full(len(found), here))
                vs.append(found)
                queue += list(found)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1)[u != v], axis=0)
    return pairs[:, 0].view(np.int64) if len(pairs) else pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.uint64).view(np.int64)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between the distinct fingerprints `fp` within the radius, enough of them to connect all that are linked."""
    masks = F.array(*[F.struct(F.lit(keep).alias("keep"), F.lit(flip).alias("flip")) for keep, flip in ball_masks(radius)])
    # Each fingerprint becomes many rows, so they are spread over all partitions before, however few bytes they take.
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    variants = spread.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m["flip"]).bitwiseAND(m["keep"]))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in whole_groups(batches, ["key", "fp"]):
            u, v = link_members(keys, values, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_duplicates(documents: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every document."""
    marked = durable(fingerprints(documents, size).select("doc_id", "fp"))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = named.join(lowest, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def simhash_digests(documents: DataFrame) -> DataFrame:
    """doc_id, the fingerprint in hex and component_id."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first_copies(documents: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), then text hash. Columns as they came.

    Rows are told apart by doc_id and text, so null and repeated ids are no special case; of rows equal in both that with the least
    hash of all columns stays.
    """
    marked = durable(fingerprints(documents, size))
    groups = connected_components(fingerprint_links(marked.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    named = marked.join(groups, "fp", "left").select("doc_id", "tie", F.coalesce("component", "fp").alias("component"))
    return keep_firsts(documents, named)
