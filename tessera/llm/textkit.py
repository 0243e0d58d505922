"""Shared pieces: whole-text blocks for numpy, word and n-gram hashing, durable tables.

Kernels see the texts of an Arrow batch as one byte buffer with offsets, cut into blocks of bounded bytes, so a
worker's memory depends on the block size (or on one document, if it is longer) and never on the batch.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20

#: An odd multiplier of the rolling polynomial modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names, or the checkpoint folder that has been set. Only a
    local session, whose driver and executors are one, may do without and gets a folder of its own."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes the shuffle files of each execution at its end; they are of no use once durable() has cut a table off.

    Versions that do not know the setting keep them until the driver collects its garbage.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def digest_id(column: str = "doc_id"):
    """CRC-32 of a column's decimal text, unsigned; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def text_tie():
    """Hash of the text (null is not empty); with doc_id it tells rows apart where ids are null or repeated."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


#: So many (doc_id, tie) keys are sent to every task; in a hash table they take about 60 bytes each, 12 MB.
MOST_SENT_KEYS = 200_000


def without_rows(rows: DataFrame, keys: DataFrame, most_sent: int = MOST_SENT_KEYS) -> DataFrame:
    """The rows whose doc_id and text hash are not among `keys` (doc_id, tie); columns as they came.

    Up to `most_sent` keys are sent to every task and no text is shuffled; more of them meet the rows in a merge join, to which
    texts travel compressed.
    """
    keys = durable(keys.select(F.col("doc_id").alias("__key_id"), F.col("tie").alias("__key_tie")).distinct())
    few = keys.count() <= most_sent
    tied = rows.withColumn("__tie", text_tie())
    left = tied if few else packed(tied)
    met = left["doc_id"].eqNullSafe(keys["__key_id"]) & (left["__tie"] == keys["__key_tie"])
    found = left.join(F.broadcast(keys) if few else keys.hint("merge"), met, "left_anti").drop("__tie")
    return found if few else restored(found, rows.schema)


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row of those with the same doc_id and text: that with the least hash of all its columns. Columns as they came.

    Rows are folded by each task first, so copies never gather, and texts travel compressed.
    """
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, T.MapType)]
    tied = packed(rows.withColumn("__tie", text_tie()).withColumn("__order", F.xxhash64(*[F.col(f"`{c}`") for c in plain])))
    one = tied.groupBy("doc_id", "__tie").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "__order").alias("__row"))
    return restored(one.select("__row.*"), rows.schema)


def keep_firsts(rows: DataFrame, named: DataFrame) -> DataFrame:
    """One row of each component of `named` (doc_id, tie, component): that with the smallest doc_id (null last), then text hash."""
    named = durable(named.groupBy("doc_id", "tie", "component").agg(F.count(F.lit(1)).alias("copies")))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"))
    others = named.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))))
    if not named.where("copies > 1").isEmpty():
        rows = one_of_each(rows)
    return without_rows(rows, others.select("doc_id", "tie"))


def binary(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column with nulls as empty values and 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches as (rows, bytes, offsets), each of about `limit` bytes or a single document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = binary(batch.column(batch.schema.get_field_index("text")))
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start), data[ends[start] : ends[end]], ends[start : end + 1] - ends[start]
            start = end


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches sorted by the first of them, in lots of about `rows` rows that part no group of equal values.

    Memory depends on `rows` and on the largest single group, never on the partition.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(n).to_numpy() for n in names))
            size += batch.num_rows
        if size >= rows and held[0][0][0] != held[-1][0][-1]:
            columns = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            yield tuple(c[:last] for c in columns)
            held, size = [tuple(c[last:] for c in columns)], size - last
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES + 2), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE**i; differences times BASE**-start hash any slice."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal slices wherever they lie."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the maximal runs of `inside`, which end at document borders."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    starts_at = inside & ~before[:-1]
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    starts_at |= inside & border[:-1]
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:] & ~border[1:-1]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def gram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all 4-byte windows that lie within a document, and the count of windows by document."""
    lengths = np.diff(offsets)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
    v = data.astype(np.uint32)
    code = v[:-3] | (v[1:-2] << np.uint32(8)) | (v[2:-1] << np.uint32(16)) | (v[3:] << np.uint32(24))
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    keep = np.ones(len(data), bool)
    for back in (1, 2, 3):
        at = offsets[1:] - back
        keep[at[at >= 0]] = False  # a window that starts this near a border would cross it
    return code[keep[: len(code)]], np.maximum(lengths - 3, 0)


def sums_by_document(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `counts` values."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _with_text(schema: T.StructType, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, kind if f.name == "text" else f.dataType, f.nullable) for f in schema])


def packed(rows: DataFrame) -> DataFrame:
    """The rows with the text compressed (null stays null), for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.large_binary())
            yield batch.set_column(at, "text", pa.array([pack(t.as_py()) if t.is_valid else None for t in texts], pa.binary()))

    return rows.mapInArrow(run, _with_text(rows.schema, T.BinaryType()))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of packed() rows with their texts as bytes again."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array([unpack(t.as_py()) if t.is_valid else None for t in batch.column(at)], pa.large_binary()))


def restored(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """packed() rows with their texts as before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", batch.column(at).cast(pa.large_string()).cast(pa.string()))

    return rows.mapInArrow(run, _with_text(schema, T.StringType()))
