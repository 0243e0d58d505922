"""Versioned tables: an immutable Parquet base with inserts and tombstones in numbered commits.

A commit is Parquet written first and one manifest published last, so a crash leaves no half commit: folders without a manifest are
never read. Manifests are named by their first number and never replaced, so of two writers who saw the same state the second is told, reads
what the first has committed, checks its constraints again and takes the next number. The catalogue is published in numbered versions; the
highest counts. Row r with insert number i is visible when no delete of its key has a number >= i and no update one > i. Reads are
plain DataFrame plans over base and deltas, so filters and columns reach the scans: one scan of the base and of all inserts between two
deletes or updates, and after COMPACT_AFTER commits all are folded into a new base (where no snapshot needs them).
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.files import Files, Taken

COMPACT_AFTER = 64

def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session may do without and gets a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


class ConflictError(RuntimeError):
    """Another writer has changed the catalogue; the state has been read anew, so the caller may try again."""


class ConstraintError(ValueError):
    """A write that breaks NOT NULL, PRIMARY KEY or UNIQUE."""


@dataclass
class Constraints:
    """Declared constraints of a table; a primary key implies NOT NULL."""

    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)


@dataclass
class Change:
    """One numbered change: paths of inserted rows and of keys that are deleted or updated."""

    table: str
    number: int
    inserted: str | None = None
    keys: str | None = None
    kind: str = "delete"


class _Tables:
    """Reads and writes over a list of changes; subclasses say where new changes go."""

    spark: SparkSession
    root: str

    def _changes(self) -> list[Change]:
        raise NotImplementedError

    def _commit(self, changes: list[Change]) -> None:
        raise NotImplementedError

    def _next(self) -> int:
        raise NotImplementedError

    def _meta(self, name: str) -> dict:
        raise NotImplementedError

    def constraints(self, name: str) -> Constraints:
        return Constraints(**self._meta(name)["constraints"])

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self._meta(name)["schema"])

    def read(self, name: str, upto: int | None = None) -> DataFrame:
        """The visible rows, as of change `upto` where given."""
        meta, schema = self._meta(name), self.schema(name)
        base = self.spark.read.schema(schema).parquet(meta["base"])
        changes = [c for c in self._changes() if c.table == name and c.number > meta["base_number"] and (upto is None or c.number <= upto)]
        if not changes:
            return base
        groups = [(meta["base_number"], [meta["base"]])]
        for c in changes:
            if c.keys and c.kind == "update":
                groups.append((c.number, []))
            if c.inserted:
                groups[-1][1].append(c.inserted)
            if c.keys and c.kind == "delete":
                groups.append((c.number + 1, []))
        pk, gone = self.constraints(name).primary_key, None
        for c in changes:
            if c.keys:
                limit = F.lit(c.number if c.kind == "delete" else c.number - 1)
                part = self._keys(name, c.keys).withColumn("_limit", limit)
                gone = part if gone is None else gone.unionByName(part)
        if gone is None:
            return self.spark.read.schema(schema).parquet(*(path for _, paths in groups for path in paths))
        rows = None
        for at, paths in groups:
            if paths:
                part = self.spark.read.schema(schema).parquet(*paths).withColumn("_at", F.lit(at))
                rows = part if rows is None else rows.unionByName(part)
        last = gone.groupBy(*pk).agg(F.max("_limit").alias("_limit"))
        return rows.join(last, pk, "left").where(F.col("_limit").isNull() | (F.col("_limit") < F.col("_at"))).select(*schema.names)

    def _keys(self, name: str, path: str) -> DataFrame:
        """Primary keys in a file of keys, where they stand as _old_k."""
        schema, pk = self.schema(name), self._keyed(name)
        old = T.StructType([T.StructField(f"_old_{k}", schema[k].dataType) for k in pk])
        return self.spark.read.schema(old).parquet(path).toDF(*pk)

    def _write(self, df: DataFrame) -> str:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _check(self, name: str, rows: DataFrame, others: DataFrame) -> None:
        """`rows` are about to be added beside `others`."""
        self._check_declared(name, self.constraints(name), rows, others)

    def _check_declared(self, name: str, c: Constraints, rows: DataFrame, others: DataFrame) -> None:
        required = {*c.not_null, *c.primary_key}
        if required:
            broken = " OR ".join(f"`{k}` IS NULL" for k in sorted(required))
            if rows.where(broken).limit(1).count():
                raise ConstraintError(f"NULL in a NOT NULL column of {name}")
        for keys in [c.primary_key, *c.unique]:
            if keys:
                full = rows.dropna(subset=keys).select(*keys)
                if full.groupBy(*keys).count().where("count > 1").limit(1).count():
                    raise ConstraintError(f"rows of {name} repeat the key {keys}")
                if full.join(others.select(*keys), keys, "left_semi").limit(1).count():
                    raise ConstraintError(f"rows of {name} collide with the key {keys}")

    def _stored(self, name: str, rows: DataFrame) -> tuple[str, DataFrame]:
        path = self._write(rows)
        return path, self.spark.read.schema(self.schema(name)).parquet(path)

    def insert(self, name: str, rows: DataFrame) -> int:
        """Adds rows; missing columns take their defaults or NULL. Returns the number of rows."""
        schema, defaults = self.schema(name), self.constraints(name).defaults
        columns = [
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.expr(defaults.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in schema
        ]
        path, stored = self._stored(name, rows.select(*columns))
        self._check(name, stored, self.read(name))
        if n := stored.count():
            self._commit([Change(name, self._next(), inserted=path)])
        return n

    def _keyed(self, name: str) -> list[str]:
        if not (pk := self.constraints(name).primary_key):
            raise ConstraintError(f"{name} needs a primary key for this")
        return pk

    def delete(self, name: str, condition: str | None = None) -> int:
        """Deletes the rows for which the condition is true."""
        pk, rows = self._keyed(name), self.read(name).alias(name)
        path = self._write((rows.where(condition) if condition else rows).select(*[F.col(k).alias(f"_old_{k}") for k in pk]))
        if n := self._keys(name, path).count():
            self._commit([Change(name, self._next(), keys=path)])
        return n

    def update(self, name: str, values: dict[str, str], condition: str | None = None) -> int:
        """Sets columns to expressions over the old row."""
        pk, rows, schema = self._keyed(name), self.read(name).alias(name), self.schema(name)
        hit = rows.where(condition) if condition else rows
        new = [F.expr(values[f.name]).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in schema]
        path, stored = self._stored(name, hit.select(*[F.col(k).alias(f"_old_{k}") for k in pk], *new))  # keys and rows of one evaluation
        self._check(name, stored, rows.join(self._keys(name, path), pk, "left_anti"))
        if n := stored.count():
            self._commit([Change(name, self._next(), inserted=path, keys=path, kind="update")])
        return n

    def merge(
        self,
        name: str,
        source: DataFrame,
        on: str,
        matched_update: dict[str, str] | None = None,
        matched_delete: bool = False,
        matched_if: str = "true",
        not_matched_insert: dict[str, str] | None = None,
        not_matched_if: str = "true",
        target: str = "t",
        origin: str = "s",
    ) -> int:
        """MERGE with aliases for the target and the source; one matched and one unmatched arm. Returns the rows affected."""
        pk, rows, schema = self._keyed(name), self.read(name), self.schema(name)
        t, s = rows.alias(target), source.alias(origin)
        hit = t.join(s, F.expr(on), "inner").where(matched_if)
        old = [F.col(f"{target}.{k}").alias(f"_old_{k}") for k in pk]
        updated = [(F.expr(matched_update[f.name]) if matched_update and f.name in matched_update else F.col(f"{target}.{f.name}")).cast(f.dataType).alias(f.name) for f in schema]
        touched = hit.select(*old, *updated)
        keys = self._write(touched if matched_update or matched_delete else touched.limit(0))
        gone = self._keys(name, keys)
        if gone.groupBy(*pk).count().where("count > 1").limit(1).count():
            raise ConstraintError("a target row matches several source rows")
        new = None
        if matched_update:
            new = self.spark.read.schema(schema).parquet(keys)
        if not_matched_insert:
            fresh = s.join(t, F.expr(on), "left_anti").where(not_matched_if)
            fresh = fresh.select(*[F.expr(not_matched_insert.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in schema])
            new = fresh if new is None else new.unionByName(fresh)
        path, stored = self._stored(name, new if new is not None else rows.limit(0))
        self._check(name, stored, rows.join(gone, pk, "left_anti"))
        n, d = stored.count(), gone.count()
        if n or d:
            self._commit([Change(name, self._next(), inserted=path if n else None, keys=keys if d else None, kind="delete" if matched_delete else "update")])
        return n + (d if matched_delete else 0)


class Store(_Tables):
    """Tables, constraints, commits and snapshots under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)
        self._log: list[tuple[str, list[Change]]] = []
        self._catalogue: dict = {}
        self._version = 0
        self.reload()

    def reload(self) -> None:
        """Recovers the state from what has been published."""
        versions = self._versions()
        self._version = versions[-1] if versions else 0
        self._catalogue = json.loads(self.files.read(self._named(self._version))) if versions else {"tables": {}, "snapshots": {}}
        self._read_log()

    def _versions(self) -> list[int]:
        return [int(n.removesuffix(".json").removeprefix("catalogue-")) for n in self.files.names("") if n.startswith("catalogue-")]

    def _named(self, version: int) -> str:
        return f"catalogue-{version:012d}.json"

    def _read_log(self) -> None:
        """The manifests after the last fold, those known already without reading them again."""
        known, folded = dict(self._log), self._catalogue.get("folded", 0)
        names = [n for n in self.files.names("log") if int(n.removesuffix(".json")) > folded]
        self._log = [(n, known.get(n) or [Change(**c) for c in json.loads(self.files.read(f"log/{n}"))]) for n in names]

    def _save(self) -> None:
        """Publishes the next version of the catalogue; the one before stays for those who are reading it."""
        try:
            self.files.publish(self._named(self._version + 1), json.dumps(self._catalogue))
        except Taken as e:
            self.reload()
            raise ConflictError("another writer has changed the catalogue") from e
        self._version += 1
        for old in self._versions():
            if old < self._version - 1:
                self.files.remove(self._named(old))

    def _meta(self, name: str) -> dict:
        return self._catalogue["tables"][name]

    def _changes(self) -> list[Change]:
        return [c for _, changes in self._log for c in changes]

    def tip(self) -> int:
        """The number of the last change."""
        return max([self._catalogue.get("folded", 0), *(c.number for c in self._changes()), *(m["base_number"] for m in self._catalogue["tables"].values())])

    def _next(self) -> int:
        return self.tip() + 1

    def _commit(self, changes: list[Change]) -> None:
        if self._versions()[-1:] != [self._version]:  # tables may have been folded, altered or dropped
            self.reload()
            changes = self._renumbered(changes)
        while True:
            name = f"{changes[0].number:020d}.json"
            try:
                self.files.publish(f"log/{name}", json.dumps([asdict(c) for c in changes]))
                break
            except Taken:
                self._read_log()
                changes = self._renumbered(changes)
        self._log.append((name, changes))
        if len(self._log) >= COMPACT_AFTER and not self._catalogue["snapshots"]:
            self.checkpoint()

    def _renumbered(self, changes: list[Change]) -> list[Change]:
        """The changes after all that others have committed, if they still keep the constraints."""
        for c in changes:
            if c.table not in self._catalogue["tables"]:
                raise ConflictError(f"another writer has dropped {c.table}")
            if c.inserted:
                others = self.read(c.table)
                if c.keys:
                    others = others.join(self._keys(c.table, c.keys), self._keyed(c.table), "left_anti")
                self._check(c.table, self.spark.read.schema(self.schema(c.table)).parquet(c.inserted), others)
        first = self._next()
        return [replace(c, number=first + i) for i, c in enumerate(changes)]

    # Catalogue.

    def create(self, name: str, rows: DataFrame, primary_key: list[str] | None = None, not_null: list[str] | None = None, unique: list[list[str]] | None = None, defaults: dict[str, str] | None = None) -> None:
        """A new table with these rows as its base."""
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
        constraints = Constraints(primary_key or [], not_null or [], unique or [], defaults or {})
        path = self._write(rows)
        meta = {"base": path, "base_number": self.tip(), "schema": json.loads(schema.json()), "constraints": asdict(constraints)}
        try:
            self._check_declared(name, constraints, self.spark.read.schema(schema).parquet(path), rows.limit(0))
        except ConstraintError:
            self.files.remove(path.removeprefix(f"{self.root}/"))
            raise
        self._catalogue["tables"][name] = meta
        self._save()

    def register(self, name: str, path: str, **constraints) -> None:
        """A table over Parquet files that stay where they are."""
        schema = self.spark.read.parquet(path).schema
        self._catalogue["tables"][name] = {"base": path, "base_number": self.tip(), "schema": json.loads(schema.json()), "constraints": asdict(Constraints(**constraints))}
        self._save()

    def tables(self) -> list[str]:
        return sorted(self._catalogue["tables"])

    def describe(self, name: str) -> dict:
        """Columns with their types, constraints and the row count."""
        return {"columns": self.schema(name).simpleString(), "constraints": asdict(self.constraints(name)), "rows": self.read(name).count()}

    def drop(self, name: str) -> None:
        del self._catalogue["tables"][name]
        self._save()

    def rename(self, old: str, new: str) -> None:
        if new in self._catalogue["tables"]:
            raise ValueError(f"{new} exists")
        if any(c.table == old for c in self._changes()):
            self.checkpoint()
        self._catalogue["tables"][new] = self._catalogue["tables"].pop(old)
        self._save()

    def alter(self, name: str, **changed) -> None:
        """Replaces constraints (primary_key, not_null, unique, defaults) after checking the rows."""
        before = self._meta(name)["constraints"]
        self._meta(name)["constraints"] = {**before, **changed}
        try:
            self._check(name, self.read(name), self.read(name).limit(0))
        except ConstraintError:
            self._meta(name)["constraints"] = before
            raise
        self._save()

    def views(self) -> None:
        """Temp views over the visible rows of all tables."""
        for name in self.tables():
            self.read(name).createOrReplaceTempView(name)

    # Versions.

    def snapshot(self, name: str) -> int:
        self._catalogue["snapshots"][name] = self.tip()
        self._save()
        return self.tip()

    def restore(self, target: str | int) -> None:
        """Drops all changes after a snapshot or a change number."""
        number = self._catalogue["snapshots"][target] if isinstance(target, str) else target
        if any(m["base_number"] > number for m in self._catalogue["tables"].values()):
            raise ValueError("a checkpoint has folded later changes in")
        for name, changes in [x for x in self._log if x[1][-1].number > number]:
            self.files.remove(f"log/{name}")
            self._log.remove((name, changes))
        self._catalogue["snapshots"] = {k: v for k, v in self._catalogue["snapshots"].items() if v <= number}
        self._save()

    def checkpoint(self) -> None:
        """Folds the changes of every table into a new base, then forgets them and the snapshots before the tip."""
        tip = self.tip()
        fresh = {name: self._write(self.read(name)) for name in self.tables() if any(c.table == name and c.number > self._meta(name)["base_number"] for c in self._changes())}
        for name in self.tables():
            self._meta(name).update(base=fresh.get(name, self._meta(name)["base"]), base_number=tip)
        self._catalogue["snapshots"] = {k: v for k, v in self._catalogue["snapshots"].items() if v == tip}
        before, self._catalogue["folded"] = self._catalogue.get("folded", 0), tip
        self._save()
        for name in self.files.names("log"):  # what this fold took in stays until the next one, for writers who saw less
            if int(name.removesuffix(".json")) <= before:
                self.files.remove(f"log/{name}")
        self._log = []

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Writes that are seen inside at once and published together, or not at all on an error."""
        txn = self.begin()
        yield txn
        self.publish(txn)

    def begin(self) -> Transaction:
        """A transaction over what is visible now."""
        return Transaction(self)

    def publish(self, txn: Transaction) -> None:
        """Commits a transaction's changes as one; they come after all that was committed meanwhile. Keys are checked against the
        rows that the transaction saw, so of two writers of one key the last wins."""
        if txn.pending:
            first = self._next()
            self._commit([replace(c, number=first + i) for i, c in enumerate(txn.pending)])


class Transaction(_Tables):
    """A view of the store as it was at the start, with its own changes on top."""

    def __init__(self, store: Store):
        self.spark, self.root, self.store = store.spark, store.root, store
        self.seen, self.start = store._changes(), store.tip()
        self.pending: list[Change] = []

    def _meta(self, name: str) -> dict:
        return self.store._meta(name)

    def _changes(self) -> list[Change]:
        return [*self.seen, *self.pending]

    def _next(self) -> int:
        return self.start + len(self.pending) + 1

    def _commit(self, changes: list[Change]) -> None:
        self.pending += changes
