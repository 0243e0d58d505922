"""Operator 1: shards by jump consistent hashing, in DataFrame expressions only.

The chain of jumps of a key does not depend on the shard count: its last member below n is the key's shard of n, so
one fold gives the shard for n and for n + 1, and a key moves only into the new shard. The generator of the chain is a
64-bit linear congruence; ANSI arithmetic raises on overflow, so the state is held as two 32-bit halves.

Placement is a projection of each row and shuffles nothing. Numbering within shards first adds up equal digests
(map-side), then counts within (shard, bucket), so no task holds a whole shard.

Defined cases: a null key counts as key 0; a null text has size 16 and CRC 0; equal rows take consecutive slots; an empty
table gives an empty result; texts of any length count in full, and only their digests are shuffled; further columns are ignored (place() keeps
them, and replaces columns of its own names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the generator (fixed by the published algorithm), as high and low 32 bits.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2**64 in halves, with every intermediate below 2**63."""
    low0, low1 = low.bitwiseAND(0xFFFF), F.shiftright(low, 16)
    p0, p1 = low0 * F.lit(_LOW), low1 * F.lit(_LOW)
    bottom = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    high0, high1 = high.bitwiseAND(0xFFFF), F.shiftright(high, 16)
    cross = high0 * F.lit(_LOW) + F.shiftleft((high1 * F.lit(_LOW)).bitwiseAND(0xFFFF), 16)
    top = F.shiftright(bottom, 32) + F.shiftright(p1, 16) + (low * F.lit(_HIGH)).bitwiseAND(_MASK) + cross.bitwiseAND(_MASK)
    return top.bitwiseAND(_MASK), bottom.bitwiseAND(_MASK)


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown_shard): the shard of a long key among `shards`, and among one more."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        jump = F.floor((state["at"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + F.lit(1)).cast("double")))
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            jump.cast("long").alias("at"),
            F.when(jump < shards, jump.cast("long")).otherwise(state["shard"]).alias("shard"),
            F.when(jump < shards + 1, jump.cast("long")).otherwise(state["grown"]).alias("grown"),
        )
        return F.when(state["at"] <= shards, moved).otherwise(state)

    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_MASK).alias("low"), zero.alias("at"), zero.alias("shard"), zero.alias("grown")
    )
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)
    return F.struct(chain["shard"].cast("int").alias("shard"), chain["grown"].cast("int").alias("grown_shard"))


def place(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Every row with its shard and grown_shard; keys that are not integers are hashed first. Shuffles nothing."""
    column = F.col(key)
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        column = F.xxhash64(column)
    return df.withColumn("_jump", jump_shards(column, shards)).withColumns({"shard": F.col("_jump.shard"), "grown_shard": F.col("_jump.grown_shard")}).drop("_jump")


def number_slots(digests: DataFrame, buckets: int = 64) -> DataFrame:
    """Gapless slots within each shard, in the order (bucket, doc_id, text_crc32, size).

    `digests` has doc_id, size, text_crc32, shard and columns that follow from these. Equal digests are added up before
    the shuffle; counts within (shard, bucket) give each bucket's first slot.
    """
    known = [c for c in digests.columns]
    copies = digests.groupBy(*known).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    bucket = F.pmod(F.pmod(F.coalesce("doc_id", zero), F.lit(buckets)) + F.col("text_crc32"), F.lit(buckets)).cast("int")
    copies = copies.withColumn("_bucket", bucket)
    totals = copies.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_total"))
    by_bucket = Window.partitionBy("shard").orderBy("_bucket")
    firsts = totals.select(F.col("shard").alias("_shard"), F.col("_bucket").alias("_of"), (F.sum("_total").over(by_bucket) - F.col("_total")).alias("_first"))
    order = Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = copies.withColumn("_before", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    # At most shards * buckets rows, so a broadcast; no NULL meets, but a null-safe join adds no filter, so both sides share one exchange.
    ranked = ranked.join(F.broadcast(firsts), F.col("shard").eqNullSafe(F.col("_shard")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    step = 1 << 16  # many copies are spread out in two steps, so that no array grows with their number
    parts = ranked.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 1) div {step})")))
    parts = parts.withColumn("_k", F.explode(F.expr(f"sequence(_part * {step}, least(_n - 1, _part * {step} + {step - 1}))")))
    return parts.select(*known, (F.col("_first") + F.col("_before") + F.col("_k")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int, buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.col("text").cast("string")
    digests = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
    )
    placed = place(digests, shards)
    return number_slots(placed, buckets).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", salt: int = 8) -> None:
    """Writes whole rows under path/shard=K; each shard is split over `salt` tasks by the hash of all its columns."""
    placed = place(df, shards, key).drop("grown_shard")
    mixed = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt))
    placed.withColumn("_salt", mixed).repartition(F.col("shard"), F.col("_salt")).drop("_salt").write.partitionBy("shard").parquet(path)
