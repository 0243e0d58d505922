"""Stages that drop rows decide per row, where ids are null or repeated too."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from tessera.llm import simhash

SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def kept(df) -> list[tuple]:
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_clean_rows_stay_beside_contaminated_ones(spark, parts):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = [(None, prose(1)), (None, prose(2)), (7, prose(3)), (8, prose(4)), (9, None), (None, None), (None, "")]
    bad = [(None, f"{prose(5)} {item}"), (7, f"{item} {prose(6)}"), (7, f"{item} {prose(6)}")]
    made = spark.createDataFrame(clean + bad, "doc_id long, text string").repartition(parts)
    assert kept(corpus_pipeline.decontamination_stage(spark, made, SF)) == sorted(clean, key=str)


@pytest.mark.parametrize("keep", [simhash.keep_first_copies, lambda docs: corpus_pipeline.near_duplicate_stage(docs.sparkSession, docs, SF)])
def test_one_row_of_each_group_stays(spark, keep):
    a, b, c, d = (prose(k) for k in (10, 11, 12, 13))
    near = lambda text: text + " "  # noqa: E731  another text of the same words
    rows = [(None, a), (None, near(a)), (None, b), (5, near(b)), (None, c), (3, d), (3, near(d)), (3, prose(14)), (1, prose(15)), (1, prose(15)), (4, near(prose(15))), (6, None), (6, ""), (None, None)]
    got = [(i, (t or "").strip()) for i, t in kept(keep(spark.createDataFrame(rows, "doc_id long, text string")))]
    assert sorted(got, key=str) == sorted([(None, a), (5, b), (None, c), (3, d), (3, prose(14)), (1, prose(15)), (6, "")], key=str)
