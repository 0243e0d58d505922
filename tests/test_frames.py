"""RANGE frames over whole numbers run in many tasks, with the results of Spark's plain windows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue, dialect, frames

SF = "/root/testdata/sf0.01"

# Each over t(k, p, v), whose keys are null, repeated, negative, on the borders of stretches and far apart.
TEXTS = [
    "SELECT k, p, v, sum(v) OVER (ORDER BY k RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY p ORDER BY k RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM t",
    "SELECT k, v, min(v) OVER (ORDER BY k DESC NULLS FIRST RANGE BETWEEN 3 PRECEDING AND 700 FOLLOWING) AS lo, max(v) OVER (ORDER BY k DESC NULLS FIRST RANGE BETWEEN 900 PRECEDING AND 400 PRECEDING) AS hi FROM t",
    "SELECT k, v, count(v) OVER (PARTITION BY p, k % 3 ORDER BY k RANGE BETWEEN 1 FOLLOWING AND 5000 FOLLOWING) AS n, sum(v) OVER (ORDER BY k) AS r, rank() OVER (PARTITION BY p ORDER BY k) AS place FROM t",
    "WITH c AS (SELECT k, sum(v) OVER (PARTITION BY p ORDER BY k RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS s FROM t) SELECT c.k, c.s, max(c.s) OVER (ORDER BY c.k RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS m FROM c JOIN (SELECT DISTINCT k FROM c) d ON c.k = d.k",
    "SELECT * FROM t QUALIFY count(*) OVER (ORDER BY k RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1",
    "SELECT p, count(*) AS n, sum(count(*)) OVER (ORDER BY max(v) RANGE BETWEEN CURRENT ROW AND 40 FOLLOWING) AS s FROM t GROUP BY p UNION ALL SELECT CAST(k AS STRING), v, count(*) OVER (ORDER BY CAST(v AS TINYINT) RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) FROM t",
]


@pytest.fixture(scope="module")
def t(spark):
    draw = random.Random(5)
    keys = [None] * 5 + [x + d for x in (-(1 << 62), -2048, -1024, 0, 1024, 1 << 13, 1 << 40) for d in (-6, -1, 0, 0, 1, 4, 5, 11)] + [draw.randint(-3000, 3000) for _ in range(1500)]
    rows = [(k, draw.choice("abc") if draw.random() < 0.9 else None, draw.randint(0, 99)) for k in keys]
    spark.createDataFrame(rows, "k bigint, p string, v int").createOrReplaceTempView("t")


@pytest.mark.parametrize("text", TEXTS)
def test_same_rows_as_plain_windows(spark, t, text):
    got, want = dialect.sql(spark, text), spark.sql(dialect.rewrite(text))
    assert got.schema == want.schema
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_spread_where_frames_are_bounded(spark, t):
    stretches = [dialect.sql(spark, text)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(sequence(") for text in TEXTS]
    assert stretches == [1, 1, 1, 3, 1, 2]  # the fourth reads its WITH twice


def test_no_task_takes_the_table(spark):
    """win_range_numbers: no window holds more than a stretch and its borders, and no exchange goes to a single task."""
    df = catalogue.queries()["win_range_numbers"](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    keys = 1 << frames._BITS
    window = df._jdf.queryExecution().analyzed()
    while window.nodeName() != "Window":
        window = window.children().head()
    largest = frames._Spreading(df).frame(window).groupBy("_stretch").count().agg(F.max("count"), F.count("*")).first()
    assert largest[0] <= keys + 20 and largest[1] >= 15000 // keys
