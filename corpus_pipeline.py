"""A cleaning pipeline over `documents` from five operators: language, near duplicates, leaks, secrets, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet in the shared folder and read again as
the next stage's documents. A stage's table is removed once the next one is written; the last one stays for the caller.

Defined cases: null and blank texts, and texts without a letter, go in the first stage; if there is no labelled row to learn a language from,
no other text goes there. Rows are told apart by doc_id and text, so null and repeated ids take no other rows along; of repeated rows and of
near copies one stays (the smallest doc_id, null last, then text hash; of rows equal in both that with the least hash of all columns). Nulls in lang and
source matter nowhere else. Texts of any length are read whole. Further columns, whatever their names, pass through all stages but
the last, which returns doc_id and digests. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontamination, langid, nearcopies, secrets
from tessera.llm.textkit import shared_folder
from tessera.sources.files import Files


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter, and doubtful ones, go."""
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash of five-word shingles, and MinHash for what lies beyond its radius; Jaccard 0.8 or more)."""
    return nearcopies.keep_first_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all that is left."""
    return bpe.bpe_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", token_stage),
]

#: SQL cannot express these stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    folder = Files(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder.root}/{name}")
        docs = spark.read.parquet(f"{folder.root}/{name}")
        if before:
            folder.remove(before)
        before = name
    return docs
