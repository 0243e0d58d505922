"""Queries over the write layer and the engine's commands: each builds a versioned table from a generated one, works on it and reads back."""

from __future__ import annotations

import io
import threading
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.ipc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from tessera.engine import Engine
from tessera.operators import profile
from tessera.session import table
from tessera.sources.exports import arrow_stream, export
from tessera.sources.store import ConstraintError, Store, scratch

Query = Callable[[SparkSession, str], DataFrame]


def _store(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    store.create("t", table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), primary_key=["s_suppkey"])
    return store


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.insert("t", store.read("t").selectExpr("s_suppkey + 100000 AS s_suppkey", "s_name", "s_acctbal * 2 AS s_acctbal").where("s_suppkey % 2 = 0"))
    return store.read("t")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.delete("t", "s_acctbal < 1000")
    return store.read("t")


def update_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.update("t", {"s_acctbal": "s_acctbal + 1", "s_name": "upper(s_name)"}, "s_suppkey % 3 = 0")
    return store.read("t")


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    source = store.read("t").selectExpr("s_suppkey * 2 AS k", "s_acctbal AS bal")
    store.merge("t", source, "t.s_suppkey = s.k", matched_update={"s_acctbal": "s.bal"}, not_matched_insert={"s_suppkey": "s.k", "s_name": "'new'", "s_acctbal": "s.bal"})
    return store.read("t")


def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.delete("t", "s_suppkey % 5 = 0")
    store.snapshot("before")
    store.update("t", {"s_acctbal": "0.0"}, None)
    store.restore("before")
    store.checkpoint()
    return store.read("t")


def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    with store.transaction() as txn:
        txn.delete("t", "s_suppkey % 2 = 1")
        txn.insert("t", txn.read("t").selectExpr("s_suppkey + 500000 AS s_suppkey", "s_name", "s_acctbal"))
    return store.read("t")


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    engine.store.create("t", table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), primary_key=["s_suppkey"], unique=[["s_name"]], not_null=["s_acctbal"])
    return engine


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.sql("INSERT INTO t VALUES (-1, 'it''s \\ new', 1.5), (-2, NULL, -2)")
    engine.sql("INSERT INTO t (s_acctbal, s_suppkey) VALUES ($1, $2)", [0.25, -3])
    return engine.sql("SELECT * FROM t")


def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.script("BEGIN; DELETE FROM t WHERE s_suppkey > 5; UPDATE t SET s_acctbal = 0; ROLLBACK; BEGIN; UPDATE t SET s_acctbal = s_acctbal + 1 WHERE s_suppkey <= 3; COMMIT")
    return engine.sql("SELECT * FROM t")


def merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.sql("MERGE INTO t USING (SELECT s_suppkey * 2 AS k FROM t) s ON t.s_suppkey = s.k WHEN MATCHED AND s_acctbal > 0 THEN DELETE WHEN NOT MATCHED THEN INSERT (s_suppkey, s_name, s_acctbal) VALUES (s.k, NULL, 7)")
    return engine.sql("SELECT * FROM t")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and that nothing of it stays."""
    engine, refused = _engine(spark, sf_dir), []
    cases = {
        "primary key": "INSERT INTO t VALUES (-1, 'a', 1), (1, 'b', 1)",
        "repeated key": "INSERT INTO t VALUES (-1, 'a', 1), (-1, 'b', 1)",
        "null key": "INSERT INTO t VALUES (NULL, 'a', 1)",
        "not null": "INSERT INTO t VALUES (-1, 'a', NULL)",
        "unique": "INSERT INTO t SELECT s_suppkey + 1000000, s_name, 1 FROM t",
        "unique update": "UPDATE t SET s_name = 'same'",
        "null unique": "INSERT INTO t VALUES (-1, NULL, 1), (-2, NULL, 1)",
    }
    for name, text in cases.items():
        try:
            engine.sql(text)
            refused.append((name, False))
        except ConstraintError:
            refused.append((name, True))
    n = engine.sql("SELECT count(*) AS n FROM t")
    return spark.createDataFrame(refused, "what string, refused boolean").crossJoin(n)  # one row


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new store over the same folder sees what was committed, and nothing of a commit that was cut short."""
    store = _store(spark, sf_dir)
    store.delete("t", "s_suppkey % 4 = 0")
    store.update("t", {"s_name": "lower(s_name)"}, "s_suppkey % 4 = 1")
    store.read("t").limit(5).write.parquet(f"{store.root}/data/{uuid.uuid4().hex}")  # written, never published
    store.files.write(f"log/{store.tip() + 1:020d}.json.draft", b"[{")
    return Store(spark, store.root).read("t")


def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores over one folder, each unaware of the other's commits until it commits."""
    one = _store(spark, sf_dir)
    two = Store(spark, one.root)
    one.delete("t", "s_suppkey % 3 = 0")
    two.insert("t", two.read("t").selectExpr("s_suppkey + 1000000 AS s_suppkey", "s_name", "s_acctbal"))
    one.insert("t", one.read("t").selectExpr("s_suppkey + 2000000 AS s_suppkey", "s_name", "s_acctbal").where("s_suppkey < 2000010"))
    return Store(spark, one.root).read("t")


def folded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    for k in range(3):
        engine.sql(f"INSERT INTO t SELECT -s_suppkey - {k} * 1000000, NULL, {k} FROM t WHERE s_suppkey > 0 AND s_suppkey <= 4")
    engine.sql("CHECKPOINT")
    engine.sql("DELETE FROM t WHERE s_suppkey = -1")
    return engine.sql("SELECT * FROM t")


def catalogue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE FROM, rename, constraints, defaults and drop, and what describe() says of the rest."""
    engine = _engine(spark, sf_dir)
    engine.sql(f"CREATE TABLE r FROM '{sf_dir}/region.parquet'")
    engine.sql(f"CREATE TABLE IF NOT EXISTS r FROM '{sf_dir}/nation.parquet'")
    engine.script("ALTER TABLE r RENAME TO regions; ALTER TABLE regions SET PRIMARY KEY (r_regionkey); ALTER TABLE regions ALTER r_name SET DEFAULT 'none'; DROP TABLE IF EXISTS nowhere")
    engine.sql("INSERT INTO regions (r_regionkey) VALUES (99)")
    engine.script("CREATE SNAPSHOT before; DELETE FROM regions; RESTORE TO SNAPSHOT before")
    rows = [(name, d["rows"], len(d["constraints"]["primary_key"])) for name in engine.store.tables() for d in [engine.store.describe(name)]]
    engine.sql("DROP TABLE t")
    listed = spark.createDataFrame([(n, k, key, n in engine.store.tables()) for n, k, key in rows], "table_name string, n_rows long, keys int, stays boolean")
    return listed.crossJoin(engine.sql("SELECT max(r_name) FILTER (WHERE r_regionkey = 99) AS by_default FROM regions"))  # one row


def upload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, sink = _engine(spark, sf_dir), io.BytesIO()
    pq.write_table(table(spark, sf_dir, "nation").toArrow(), sink)
    engine.upload("n", sink.getvalue(), primary_key=["n_nationkey"])
    return engine.sql("SELECT n_nationkey, n_name FROM n")


def _exported(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark)}/export-{uuid.uuid4().hex}"
        source = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
        if kind == "arrow":
            return spark.createDataFrame(pa.ipc.open_stream(arrow_stream(source)).read_all())
        export(source, path, kind)
        if kind == "parquet":
            return spark.read.parquet(path)
        reader = spark.read.schema(source.schema)
        return reader.json(path) if kind == "json" else reader.csv(path, header=True, sep="," if kind == "csv" else "\t", escape='"')

    run.__name__ = f"export_{kind}"
    return run


def table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    return spark.createDataFrame([(engine.sample("t", 7).join(engine.sql("SELECT * FROM t"), ["s_suppkey", "s_name", "s_acctbal"]).count(),)], "n long")


def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached table shows later writes, and clearing the caches changes nothing."""
    engine = _engine(spark, sf_dir)
    engine.cache("t")
    before = engine.sql("SELECT count(*) AS n FROM t").first()["n"]
    engine.sql("DELETE FROM t WHERE s_suppkey = 1")
    after = engine.sql("SELECT count(*) AS n FROM t").first()["n"]
    for what in ("scan", "code", "both"):
        engine.clear_cache(what)
    return spark.createDataFrame([(before, after, engine.sql("SELECT count(*) AS n FROM t").first()["n"])], "before long, after long, cleared long")


def history_and_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.sql("SELECT count(*) AS n FROM t WHERE s_suppkey >= $1 AND s_name <> $2", [2, "O'Neil \\d"])
    try:
        engine.sql("SELECT nothing FROM t")
    except Exception as e:
        assert "nothing" in str(e)
    return spark.createDataFrame([(k, h["text"], h["error"] is not None) for k, h in enumerate(engine.history)], "place int, statement string, failed boolean")


def cursor_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows passed by each FETCH or MOVE of a scrollable cursor over n_nationkey 0 to 24."""
    engine, out = _engine(spark, sf_dir), []
    engine.sql(f"CREATE TABLE n FROM '{sf_dir}/nation.parquet'")
    engine.sql("DECLARE c SCROLL CURSOR FOR SELECT n_nationkey FROM n ORDER BY n_nationkey")
    for k, step in enumerate(CURSOR_STEPS):
        got = engine.sql(f"{step} FROM c")
        out.append((k, step, f"moved {got}" if isinstance(got, int) else ",".join(str(r[0]) for r in got.collect())))
    engine.sql("CLOSE c")
    return spark.createDataFrame(out, "place int, step string, found string")


CURSOR_STEPS = ["FETCH NEXT", "FETCH 3", "FETCH PRIOR", "FETCH LAST", "FETCH NEXT", "FETCH PRIOR", "FETCH FIRST", "FETCH ABSOLUTE 10", "FETCH RELATIVE -2", "FETCH BACKWARD 2", "MOVE FORWARD 5", "FETCH FORWARD 0", "FETCH ABSOLUTE -3", "FETCH ALL", "FETCH BACKWARD ALL"]


def cancel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running query ends when it is cancelled from another thread, and the engine goes on."""
    engine, outcome = _engine(spark, sf_dir), []

    def work() -> None:
        try:
            engine.collect("SELECT count(*) AS n FROM range(400000) a JOIN range(400000) b ON a.id % 7 = b.id % 7", "slow")
            outcome.append("finished")
        except Exception:
            outcome.append("cancelled")

    thread = threading.Thread(target=work)
    thread.start()
    until = time.time() + 30
    while thread.is_alive() and time.time() < until:
        time.sleep(0.5)
        engine.cancel("slow")
    thread.join()
    return spark.createDataFrame([(outcome[0], engine.sql("SELECT count(*) AS n FROM t").first()["n"])], "outcome string, n long")


def explain_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of the optimised plan, from the tree that EXPLAIN (FORMAT JSON) gives as text, too."""
    engine = _engine(spark, sf_dir)
    tree, rows = engine.plan("SELECT s_name, count(*) AS n FROM t WHERE s_acctbal > 10 GROUP BY s_name"), []

    def walk(node: dict, depth: int) -> None:
        rows.append((depth, node["op"], node["est_bytes"] > 0))
        for child in node["children"]:
            walk(child, depth + 1)

    walk(tree, 0)
    return spark.createDataFrame([(d, op) for d, op, _ in rows if op in ("Aggregate", "Filter")], "depth int, op string").select("op")


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "part"))


def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size"))


def profile_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histograms(table(spark, sf_dir, "part").select("p_partkey", "p_size"))


CELLS = (
    "print('rows', len(sql('SELECT * FROM t')))",
    "int(frame('SELECT * FROM t WHERE s_suppkey > $1', [3]).selectExpr('sum(s_suppkey)').first()[0])",
    "n = sql('DELETE FROM t WHERE s_suppkey <= 3')\nfor k in range(2):\n    print(k, n)",
    "sql('SELECT nothing FROM t')",
    "n",
    "sql('SELECT count(*) AS n FROM t').n.tolist()",
)


def python_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cells print, their values and whether they fail; a cell sees the writes of those before, not their names."""
    engine = _engine(spark, sf_dir)
    found = [(k, *(r := engine.cell(code))[:2], r.error is not None) for k, code in enumerate(CELLS)]
    return spark.createDataFrame(found, "place int, printed string, value string, failed boolean")


_T = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"
ORACLES = {
    "insert_select": f"{_T} UNION ALL SELECT s_suppkey + 100000, s_name, s_acctbal * 2 FROM supplier WHERE s_suppkey % 2 = 0",
    "delete_where": f"{_T} WHERE NOT s_acctbal < 1000",
    "update_set": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "merge_upsert": """SELECT t.s_suppkey, t.s_name, coalesce(s.s_acctbal, t.s_acctbal) AS s_acctbal FROM supplier t LEFT JOIN supplier s ON t.s_suppkey = s.s_suppkey * 2
        UNION ALL SELECT s.s_suppkey * 2, 'new', s.s_acctbal FROM supplier s WHERE s.s_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)""",
    "snapshot_restore": f"{_T} WHERE s_suppkey % 5 <> 0",
    "transaction_commit": f"{_T} WHERE s_suppkey % 2 <> 1 UNION ALL SELECT s_suppkey + 500000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 <> 1",
    "insert_values": f"{_T} UNION ALL SELECT -1, 'it''s \\ new', 1.5 UNION ALL SELECT -2, NULL, -2 UNION ALL SELECT -3, NULL, 0.25",
    "rollback": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey <= 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "merge_delete": f"""{_T} WHERE NOT (s_acctbal > 0 AND s_suppkey IN (SELECT s_suppkey * 2 FROM supplier))
        UNION ALL SELECT s_suppkey * 2, NULL, 7 FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)""",
    "constraints": """SELECT what, refused, (SELECT count(*) + 2 FROM supplier) AS n FROM (VALUES ('primary key', true), ('repeated key', true), ('null key', true),
        ('not null', true), ('unique', true), ('unique update', true), ('null unique', false)) v(what, refused)""",
    "recovery": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN lower(s_name) ELSE s_name END AS s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0",
    "two_writers": f"""{_T} WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier
        UNION ALL SELECT s_suppkey + 2000000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey < 10""",
    "folded_log": f"""{_T} UNION ALL SELECT -s_suppkey - k * 1000000, NULL, k FROM supplier, (VALUES (0), (1), (2)) v(k)
        WHERE s_suppkey BETWEEN 1 AND 4 AND -s_suppkey - k * 1000000 <> -1""",
    "catalogue_changes": """SELECT 'regions' AS table_name, (SELECT count(*) + 1 FROM region) AS n_rows, 1 AS keys, true AS stays, 'none' AS by_default
        UNION ALL SELECT 't', (SELECT count(*) FROM supplier), 1, false, 'none'""",
    "upload_bytes": "SELECT n_nationkey, n_name FROM nation",
    **{f"export_{kind}": "SELECT p_partkey, p_name, p_retailprice FROM part" for kind in ("parquet", "csv", "tsv", "json", "arrow")},
    "table_sample": "SELECT least(7, count(*)) AS n FROM supplier",
    "cached_table": "SELECT count(*) AS before, count(*) - 1 AS after, count(*) - 1 AS cleared FROM supplier",
    "history_and_parameters": """SELECT * FROM (VALUES (0, 'SELECT count(*) AS n FROM t WHERE s_suppkey >= $1 AND s_name <> $2', false), (1, 'SELECT nothing FROM t', true)) v(place, statement, failed)""",
    "cursor_statements": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({k}, '{step}', '{found}')"
        for k, (step, found) in enumerate(
            zip(CURSOR_STEPS, ["0", "1,2,3", "2", "24", "", "24", "0", "9", "7", "6,5", "moved 5", "10", "22", "23,24", ",".join(map(str, range(24, -1, -1)))], strict=True)
        )
    )
    + ") v(place, step, found)",
    "cancel_query": "SELECT 'cancelled' AS outcome, count(*) AS n FROM supplier",
    "python_cell": """SELECT 0 AS place, 'rows ' || count(*) || chr(10) AS printed, NULL AS value, false AS failed FROM supplier
        UNION ALL SELECT 1, '', CAST(sum(s_suppkey) AS VARCHAR), false FROM supplier WHERE s_suppkey > 3
        UNION ALL SELECT 2, '0 ' || count(*) || chr(10) || '1 ' || count(*) || chr(10), NULL, false FROM supplier WHERE s_suppkey <= 3
        UNION ALL SELECT 3, '', NULL, true UNION ALL SELECT 4, '', NULL, true
        UNION ALL SELECT 5, '', '[' || count(*) || ']', false FROM supplier WHERE s_suppkey > 3""",
    "explain_tree": "SELECT * FROM (VALUES ('Aggregate'), ('Filter')) v(op)",
    "profile_table": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct, count(DISTINCT {c}) AS n_distinct,
            CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, {f'round(avg({c}), 6)' if number else 'CAST(NULL AS DOUBLE)'} AS mean,
            {f'round(stddev_pop({c}), 6)' if number else 'CAST(NULL AS DOUBLE)'} AS stddev FROM part"""
        for c, number in (("p_partkey", 1), ("p_name", 0), ("p_brand", 0), ("p_type", 0), ("p_size", 1), ("p_retailprice", 1))
    ),
    "profile_top_values": " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place, CAST({c} AS VARCHAR) AS value, count(*) AS n
            FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 10"""
        for c in ("p_brand", "p_type", "p_size")
    ),
    "profile_histograms": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, bucket, round(lo + w * bucket, 6) AS lo, round(lo + w * (bucket + 1), 6) AS hi, count(*) AS n FROM
            (SELECT lo, w, CAST(least(floor(({c} - lo) / w), 9) AS INTEGER) AS bucket FROM part, (SELECT CAST(min({c}) AS DOUBLE) AS lo, (max({c}) - min({c})) / 10.0::DOUBLE AS w FROM part) e)
            GROUP BY lo, w, bucket"""
        for c in ("p_partkey", "p_size")
    ),
}


QUERIES = (
    insert_select, delete_where, update_set, merge_upsert, snapshot_restore, transaction_commit, insert_values, rollback, merge_delete, constraints, recovery, two_writers, folded_log,
    catalogue_changes, upload_bytes, table_sample, cached_table, history_and_parameters, cursor_statements, cancel_query, python_cell, explain_tree, profile_table, profile_top_values, profile_histograms,
    *(_exported(kind) for kind in ("parquet", "csv", "tsv", "json", "arrow")),
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
