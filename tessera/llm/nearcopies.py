"""Near copies by Jaccard similarity of word shingles, for the pipeline: fingerprints and MinHash find candidates, sets decide.

Texts of the same words (ASCII case and spacing aside) are one node. Two nodes are candidates when their SimHash fingerprints
(operator 3, over five-word shingles) lie within its radius, found by its ball hashing, or when one of BANDS bands of BAND_ROWS
minima is equal. Fingerprints alone cannot do it: at a similarity of 0.8 about 10 of 64 bits differ, and balls of half that radius
have 8 million variants. At similarity s two nodes miss each other in all bands with probability (1 - s**BAND_ROWS)**BANDS, 3e-5 at 0.8.
A candidate counts only if the Jaccard similarity of the two whole shingle sets (32-bit hashes) reaches LEAST. Components of these
links are groups.

Where a band key gathers more than FEW nodes, they are linked by a forest within that key's own set instead of all pairs.

Defined cases: a null or blank text has no shingle, and all such texts are copies of each other; a text of fewer words than a
shingle has its whole sequence as one; rows are told apart by doc_id and text, so null and repeated ids are no special case; of rows equal
in both that with the least hash of all columns stays; texts of any length are read whole; an empty table gives no rows; all columns
come back as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.simhash import fingerprint_links, majority_bits
from tessera.llm.textkit import LOWER, SPACE, durable, keep_firsts, mix, powers, prefix_sums, slice_hashes, text_blocks, text_tie, whole_groups, word_spans

SHINGLE_WORDS = 5
LEAST = 0.8
BANDS, BAND_ROWS = 20, 4
FEW = 16  # up to so many nodes a band key's pairs are compared directly

_RNG = np.random.default_rng(17)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node of each document, shingles, first shingle of each document): shingles are distinct and sorted by document."""
    starts, ends, doc = word_spans(~SPACE[data], offsets)
    words = slice_hashes(prefix_sums(LOWER[data]), starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((words + np.uint64(1)) * up[: len(words)], out=total[1:])
    nodes = mix((total[first + counts] - total[first]) * down[first] + counts.astype(np.uint64))
    made = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        made += mix(words[k : k + len(made)] + np.uint64(k))
    whole = np.flatnonzero(doc[: len(made)] == doc[size - 1 :]) if len(made) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    owner = np.concatenate([doc[whole], short]).astype(np.uint64)
    hashes = np.concatenate([mix(made[whole]), nodes[short]])
    pairs = np.unique(owner << np.uint64(32) | hashes >> np.uint64(32))
    return nodes, (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(pairs, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def band_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of MinHash bands; rows of documents without shingles mean nothing."""
    n = len(first) - 1
    keys = np.zeros((n, BANDS), np.uint64)
    used = np.flatnonzero(np.diff(first))
    if not len(used):
        return keys
    wide = shingles.astype(np.uint64)
    for band in range(BANDS):
        key = np.full(len(used), band, np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = mix(key + np.minimum.reduceat(wide * _TIMES[k] + _PLUS[k], first[used]))
        keys[used, band] = key
    return keys


def marks(documents: DataFrame) -> DataFrame:
    """doc_id, tie, node, fingerprint, bands and shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            nodes, shingles, first = shingle_sets(data, offsets)
            keys = band_keys(shingles, first).view(np.int64)
            fps = majority_bits(mix(shingles.astype(np.uint64) + np.uint64(1)), first)
            bounds = first.tolist()
            some = np.diff(first) > 0
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), pa.array(keys[some].ravel(), pa.int64()))
            sets = pa.array([shingles[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            columns = [rows.column("doc_id").cast(pa.int64()), rows.column("tie"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), lists, sets]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "node", "fp", "bands", "shingles"])

    return documents.select("doc_id", "text", text_tie().alias("tie")).mapInArrow(run, "doc_id long, tie long, node long, fp long, bands array<long>, shingles binary")


def candidates(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, v) of the nodes of each key, and (key, node) of the keys with more than FEW nodes."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    many = np.repeat(sizes > FEW, sizes)
    k, x = keys[~many], nodes[~many]
    us, vs = [x[:0]], [x[:0]]
    for gap in range(1, min(FEW, len(k))):
        same = np.flatnonzero(k[gap:] == k[:-gap])
        us.append(x[same])
        vs.append(x[same + gap])
    u, v = np.concatenate(us), np.concatenate(vs)
    return np.minimum(u, v), np.maximum(u, v), keys[many], nodes[many]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return 0.0
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common) if len(both) else 1.0


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets that similar pairs connect."""
    links, rest = [], list(range(len(sets)))
    while rest:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest:
            here = queue.pop()
            mine = sets[here]
            sizes = np.array([len(sets[r]) for r in rest])
            every = np.concatenate([sets[r] for r in rest])
            at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
            common = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            near = common >= LEAST * (len(mine) + sizes - common)
            found = [r for r, yes in zip(rest, near.tolist(), strict=True) if yes]
            rest = [r for r, yes in zip(rest, near.tolist(), strict=True) if not yes]
            links += [(here, r) for r in found]
            queue += found
    return links


def _unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint32)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v) among `nodes` (node, fp): nodes of one fingerprint with its least, and the least ones of linked fingerprints."""
    low = nodes.groupBy("fp").agg(F.min("node").alias("low"))
    alike = nodes.join(low, "fp").where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    links = fingerprint_links(low.select("fp"))
    near = links.join(low.select(F.col("fp").alias("u"), F.col("low").alias("a")), "u").join(low.select(F.col("fp").alias("v"), F.col("low").alias("b")), "v")
    return alike.union(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def near_links(marked: DataFrame) -> DataFrame:
    """Links (u, v) between nodes, enough of them to connect all candidates of similarity LEAST or more."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node in whole_groups(batches, ["key", "node"]):
            u, v, keys, nodes = candidates(key, node)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["u", "v", "key"])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(keys)], names=["u", "v", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("u").to_pylist(), b.column("v").to_pylist(), b.column("a"), b.column("b"), strict=True)
            yield _links([(u, v) for u, v, a, c in rows if jaccard(_unpack(a.as_py()), _unpack(c.as_py())) >= LEAST])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        for b in batches:
            for key, node, value in zip(b.column("key").to_pylist(), b.column("u").to_pylist(), b.column("a"), strict=True):
                groups.setdefault(key, []).append((node, _unpack(value.as_py())))
        for members in groups.values():
            yield _links([(members[i][0], members[j][0]) for i, j in forest([s for _, s in members])])

    nodes = marked.select("node", "fp").distinct()
    keyed = marked.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    met = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long, key long"))
    pairs = durable(met.where("key IS NULL").select("u", "v").union(fingerprint_pairs(nodes)).distinct())
    crowds = met.where("key IS NOT NULL").select("key", "u")
    needed = pairs.select("u").union(pairs.select("v")).union(crowds.select("u")).distinct().withColumnRenamed("u", "node")
    sets = durable(marked.select("node", "shingles").join(needed, "node", "left_semi").dropDuplicates(["node"]))
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    near = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")
    return near.union(crowds.join(left, "u").select("key", "u", "a").repartition("key").mapInArrow(connect, "u long, v long"))


def keep_first_copies(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (null last), then text hash. Columns as they came."""
    marked = durable(marks(documents))
    groups = connected_components(near_links(marked))
    named = marked.select("doc_id", "tie", "node").join(groups, "node", "left")
    return keep_firsts(documents, named.select("doc_id", "tie", F.coalesce("component", "node").alias("component")))
