"""Table profile, frequent values, histograms and plan trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 10
TOP = 10
#: Frequent values are listed for columns of at most so many distinct values.
MOST_DISTINCT = 1000


def _name(column: str) -> F.Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """One row (column_name, value) for each row and column."""
    pairs = [F.struct(F.lit(c).alias("column_name"), _name(c).cast(kind).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def frequencies(df: DataFrame) -> DataFrame:
    """(column_name, value as text, n) of all values that are not NULL; tasks add up equal values before the shuffle."""
    return _long(df, df.columns, "string").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame) -> DataFrame:
    """One row a column: rows, NULLs, extremes as text, and mean and deviation of numbers, in one aggregation."""
    numeric, parts, rows, none = _numeric(df), [F.count(F.lit(1)).alias("n")], [], F.lit(None).cast("double")
    for i, c in enumerate(df.columns):
        x = _name(c)
        parts += [F.count(x).alias(f"c{i}"), F.min(x).cast("string").alias(f"lo{i}"), F.max(x).cast("string").alias(f"hi{i}")]
        if c in numeric:
            parts += [F.round(F.avg(x), 6).alias(f"a{i}"), F.round(F.stddev_pop(x), 6).alias(f"s{i}")]
        nulls = F.col("n") - F.col(f"c{i}")
        share = F.when(F.col("n") > 0, F.round(nulls * 100.0 / F.col("n"), 4).cast("double"))
        mean, deviation = (F.col(f"a{i}"), F.col(f"s{i}")) if c in numeric else (none, none)
        named = {"column_name": F.lit(c), "n_rows": F.col("n"), "null_count": nulls, "null_pct": share, "min_value": F.col(f"lo{i}"), "max_value": F.col(f"hi{i}"), "mean": mean, "stddev": deviation}
        rows.append(F.struct(*[v.alias(k) for k, v in named.items()]))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def profile(df: DataFrame) -> DataFrame:
    """statistics() with the number of distinct values."""
    distinct = frequencies(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return statistics(df).join(F.broadcast(distinct), "column_name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("long")))  # one row a column


def top_values(df: DataFrame, k: int = TOP, most_distinct: int = MOST_DISTINCT) -> DataFrame:
    """(column_name, place, value, n): the k most frequent values of each column that has few; ties in the order of their text."""
    counted = frequencies(df)
    few = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= most_distinct).select("column_name")
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counted.join(F.broadcast(few), "column_name").withColumn("place", place).where(F.col("place") <= k).select("column_name", "place", "value", "n")


def histograms(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(column_name, bucket, lo, hi, n): counts of each numeric column in equal buckets between its extremes; the last has its end too."""
    numeric = _numeric(df)
    if not numeric:
        return df.sparkSession.createDataFrame([], "column_name string, bucket int, lo double, hi double, n long")
    ends = df.agg(*[f(_name(c)).cast("double").alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max))])
    ends = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("most")) for i, c in enumerate(numeric)])))
    width = (F.col("most") - F.col("least")) / buckets
    bucket = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("value") - F.col("least")) / F.when(width != 0, width)), F.lit(buckets - 1))).cast("int")
    rows = _long(df, numeric, "double").where("value IS NOT NULL").join(F.broadcast(ends), "column_name")  # one row a column
    counted = rows.select("column_name", bucket.alias("bucket"), "least", width.alias("width")).groupBy("column_name", "bucket", "least", "width").agg(F.count(F.lit(1)).alias("n"))
    low = lambda k: F.round(F.col("least") + F.col("width") * k, 6)
    return counted.select("column_name", "bucket", low(F.col("bucket")).alias("lo"), low(F.col("bucket") + 1).alias("hi"), "n")


def full_profile(df: DataFrame, k: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """profile() with each column's histogram and most frequent values as arrays."""
    bars = histograms(df, buckets).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("bucket", "lo", "hi", "n"))).alias("histogram"))  # `buckets` at most
    tops = top_values(df, k).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("top"))  # k at most
    return profile(df).join(F.broadcast(bars), "column_name", "left").join(F.broadcast(tops), "column_name", "left")


def plan_tree(df: DataFrame) -> dict:
    """The optimised plan as nested {op, detail, est_rows, est_bytes, children}."""

    def build(node) -> dict:
        stats, children = node.stats(), node.children()
        rows = stats.rowCount()
        return {
            "op": node.nodeName(),
            "detail": node.simpleString(100),
            "est_rows": int(str(rows.get())) if rows.isDefined() else None,
            "est_bytes": int(str(stats.sizeInBytes())),
            "children": [build(children.apply(i)) for i in range(children.size())],
        }

    return build(df._jdf.queryExecution().optimizedPlan())
