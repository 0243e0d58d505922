"""Decontamination against brute-force longest common subsequences over all passages, short items and paraphrases included."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontamination as dc
from tests.llm.test_operators_b import plain_words

SF = "/root/testdata/sf0.01"


def plain_found(texts: dict[int, str], items: dict[int, str]) -> set[tuple[int, int]]:
    out = set()
    for d, text in texts.items():
        words = plain_words(text)
        for i, item in items.items():
            want = plain_words(item)
            n = len(want)
            if n < dc.LEAST_WORDS:
                if any(words[a : a + n] == want for a in range(len(words) - n + 1)):
                    out.add((d, i))
                continue
            answer = plain_words([s for s in dc.re.split(r"[.?!\n]+", item) if s.strip()][-1])
            margin = dc.HALF + n // 4
            for start in range(0, len(words), dc.HALF):
                region = words[max(0, start - margin) : start + n + margin]
                share = dc.lcs_length(want, region) / n
                if share >= dc.LCS_SURE or share >= dc.LCS_MAYBE and dc.in_order(answer, region):
                    out.add((d, i))
                    break
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("length(text) between 600 and 4000").orderBy("doc_id").limit(240).collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    long = list(items)
    pool = [w for t in docs for w in plain_words(t)]
    for n, size in enumerate([2, 3, 3, 4, 5, 5, 6, 7, 7, 7]):
        items[1000 + n] = " ".join(rng.sample(pool, size))
    texts = {}
    for d, text in enumerate(docs):
        words = plain_words(text)
        if d % 6 < 2:
            part = plain_words(items[1000 + d % 10])
        else:
            item = items[long[d % len(long)]]
            part = plain_words(item)
            answer = len(plain_words([s for s in dc.re.split(r"[.?!\n]+", item) if s.strip()][-1]))
            count = {2: 0, 3: len(part) // 4, 4: len(part) // 2, 5: len(part) // 2}[d % 6]
            for at in rng.sample(range(len(part) - answer), min(count, len(part) - answer)):
                part[at] = rng.choice(pool)
        at = rng.randrange(len(words))
        texts[d] = " ".join([*words[:at], *part, *words[at:]])
    return texts, items


def test_nothing_is_missed(spark, planted):
    texts, items = planted
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    want = plain_found(texts, items)
    print(f"brute force {len(want)} (short {sum(i >= 1000 for _, i in want)}), of these found {len(want & got)} (short {sum(i >= 1000 for _, i in want & got)}), found beyond them {len(got - want)}")
    assert len(want) >= 150
    assert want <= got
    assert not {(d, i) for d, i in got - want if i >= 1000}


def passages_of_kinds() -> tuple[list[str], list[int]]:
    """Passages of 30 kinds and how often each comes: over 4,000 rows, more than a former sample held."""
    rng = random.Random(3)
    pool = [f"w{n}" for n in range(300)]
    kinds = [" ".join(rng.sample(pool, dc.HALF)) for _ in range(30)]
    counts = rng.choices(range(100, 300), k=30)
    assert sum(counts) > 4000
    return kinds, counts


def dense_basis(kinds: list[str], counts: list[int], idf: np.ndarray) -> np.ndarray:
    """The basis by a dense decomposition of all passages; exact where there are at most RANK kinds."""
    rows = np.zeros((len(kinds), dc.DIMS))
    for k, text in enumerate(kinds):
        data = np.frombuffer(text.encode(), np.uint8)
        dims = dc.dims_of(dc.words_of(data, np.array([0, len(data)]))[0])
        np.add.at(rows[k], dims, idf[dims])
        rows[k] *= np.sqrt(counts[k] / (idf[dims] ** 2).sum())
    _, strength, right = np.linalg.svd(rows, full_matrices=False)
    return idf[:, None] * right.T / strength


def same_space(got: np.ndarray, want: np.ndarray) -> bool:
    """Whether two bases give the same inner products."""
    got, want = got.astype(float) @ got.T.astype(float), want @ want.T
    return np.allclose(got, want, atol=1e-3 * np.abs(want).max())


def test_basis_is_of_all_passages(spark):
    kinds, counts = passages_of_kinds()
    docs = spark.createDataFrame([(kinds[k],) for k in range(30) for _ in range(counts[k])] + [(None,), ("",)], "text string").repartition(5)
    frequencies, passages = dc.passage_frequencies(docs)
    assert passages == sum(counts)
    idf = np.log((passages + 1.0) / (frequencies + 1.0)) + 0.05
    assert same_space(dc.latent_basis(docs, idf), dense_basis(kinds, counts, idf))


def test_pipeline_stage_learns_from_all_rows(spark, tmp_path, monkeypatch):
    """The stage holds its items against vectors of every row that reaches it, and takes every planted row out."""
    kinds, counts = passages_of_kinds()
    texts = [kinds[k] for k in range(30) for _ in range(counts[k])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    spark.createDataFrame([(1, kinds[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    used, basis_of = [], dc.latent_basis

    def noted(documents, idf):
        used.append((basis_of(documents, idf), idf))
        return used[-1][0]

    monkeypatch.setattr(dc, "latent_basis", noted)
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).groupBy("text").count().collect()
    assert {r["text"]: r["count"] for r in left} == {kinds[k]: counts[k] for k in range(30) if k != 7}
    ((basis, idf),) = used
    assert same_space(basis, dense_basis(kinds, counts, idf))


def test_basis_of_a_long_text(spark):
    """A text of more passages than are weighed at once counts as its passages in texts of their own do."""
    rng = random.Random(4)
    pool = [f"w{n}" for n in range(500)]
    passages = [" ".join(rng.choices(pool, k=dc.HALF)) for _ in range(40)]
    texts = [passages[n % 40] for n in range(dc.RUNS + 50)]
    idf = np.random.default_rng(5).random(dc.DIMS) + 1
    apart = dc.latent_basis(spark.createDataFrame([(t,) for t in texts], "text string"), idf).astype(float)
    one = dc.latent_basis(spark.createDataFrame([(" ".join(texts),)], "text string"), idf).astype(float)
    assert same_space(apart, one)
