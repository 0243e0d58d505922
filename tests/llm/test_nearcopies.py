"""The pipeline's near-copy stage against brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import random
import re

import corpus_pipeline

from tessera.llm import nearcopies

SMALL = "/root/testdata/sf0.001"


def plain_shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_firsts(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Rows kept: the first of each component of pairs at Jaccard 0.8 or more, in the order of ids with null last."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return [r for i, r in enumerate(rows) if root(i) == i]


def stage(spark, rows: list[tuple]) -> list[tuple]:
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, corpus_pipeline.near_duplicate_stage(spark, made, SMALL).collect()), key=str)


def variants() -> list[tuple[int, str]]:
    rng = random.Random(9)
    base = [(r, [f"w{rng.randrange(5000)}" for _ in range(n)]) for r, n in enumerate([80, 120, 200, 300, 500, 900, 1500] * 8)]
    rows = [(i, " ".join(w)) for i, w in base]
    for i, words in base:
        for k in (1, 2, 4, 8):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, k * len(words) // 400)):
                changed[at] = f"x{rng.randrange(5000)}"
            rows.append((1000 + 10 * i + k, " ".join(changed)))
    return rows


def test_near_copies_are_found_down_to_the_threshold(spark):
    rows = variants() + [(5000, "One  two three"), (5001, "one two\nTHREE"), (5002, "one two four"), (5003, ""), (5004, None), (5005, " \n")]
    got = stage(spark, rows)
    want = plain_firsts([(i, t if t and t.strip() else "") for i, t in rows])
    assert [i for i, _ in got] == [i for i, _ in sorted(want, key=str)]


def test_a_crowd_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        changed = list(words)
        changed[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(changed)))
    assert stage(spark, rows) == [rows[0]]
    sets = [sorted(hash(s) & 0xFFFFFFFF for s in plain_shingles(t)) for _, t in rows[: nearcopies.FEW * 2]]
    assert len(nearcopies.forest([nearcopies.np.array(s, nearcopies.np.uint32) for s in sets])) == len(sets) - 1


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == {i for i, _ in plain_firsts(rows)}
