"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and joins over the edges; nothing but a count and a checksum reaches the driver. Minima are
added up before the shuffle, and the joins are plain equi-joins whose large keys adaptive execution splits. Each round is
written to the shared checkpoint folder, which keeps the lineage short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over distinct edges (u, v) with u != v."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(lowest, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v), both long; component is the smallest node reachable."""
    edges = durable(edges.where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        edges = durable(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
