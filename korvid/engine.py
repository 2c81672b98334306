"""A session: SQL text in, results out."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvid.catalog import MEDIA, RID, Catalog, Field, Files, Index, Table, vector_column
from korvid.errors import DeadlockError, SQLError, SQLExecutionError, SQLIntegrityError, SQLSemanticError
from korvid.locks import DATABASE, LockTable
from korvid.operators import spatial, vectors
from korvid.operators import text as text_ops
from korvid.operators.numbering import numbered
from korvid.sources import csv as csv_source
from korvid.sources import media
from korvid.sql import ast as a
from korvid.sql.explain import render
from korvid.sql.lower import SIMILARITY, Bound, Expressions, Lowering, Node, Scope, Source, at, conjuncts, find, slot
from korvid.sql.parser import parse_script

#: Which index method goes with which column type.
INDEXABLE = {
    "HASH": ("INT", "FLOAT", "VARCHAR"),
    "BTREE": ("INT", "FLOAT", "VARCHAR"),
    "RTREE": ("POINT",),
    "SPIMI": ("TEXT", "VARCHAR"),
    "HNSW": ("IMAGE", "AUDIO", "VECTOR"),
    "IVF": ("IMAGE", "AUDIO", "VECTOR"),
}
#: Parts after which a sorted table is rewritten as one.
MOST_PARTS = 32
LANGUAGES = {"english": "english", "en": "english", "ingles": "english", "spanish": "spanish", "es": "spanish", "espanol": "spanish", "español": "spanish"}


@dataclass
class Result:
    columns: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    message: str = ""
    error: str | None = None
    affected: int | None = None
    plan: list[str] | None = None

    def rows(self) -> list[tuple]:
        """All rows on the driver; arithmetic errors of the query show here."""
        if self.df is None:
            return []
        try:
            return [tuple(r) for r in self.df.collect()]
        except PySparkException as e:
            raise SQLExecutionError(str(e).split("\n")[0]) from e

    def json_lines(self) -> DataFrame:
        """(value): each row as a JSON object; nulls are left out."""
        return self.df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.df.columns])).alias("value"))

    def to_dict(self) -> dict:
        """Rows for JSON, points as lat and lon."""
        plain = lambda v: {"lat": v["lat"], "lon": v["lon"]} if hasattr(v, "asDict") else v
        if self.error is not None:
            return {"error": self.error}
        return {"columns": self.columns, "rows": [[plain(v) for v in r] for r in self.rows()], "message": self.message, "plan": self.plan}


class Engine:
    """Statements run in autocommit unless BEGIN came before; each is atomic by itself.

    Sessions of one driver that are given the same LockTable wait for each other's tables until the
    end of a transaction; without one, a commit that finds another revision fails.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, locks: LockTable | None = None):
        self.spark, self.locks = spark, locks
        # Without a path the tables live in the warehouse, which every executor sees.
        self.catalog = Catalog(spark, path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/korvid-{uuid.uuid4().hex}")
        self.lowering = Lowering(self.catalog, self.text_index, self.vector_search)
        self._derived: dict[tuple, Any] = {}
        self._open: tuple[Any, int] | None = None
        #: Whether the open transaction has read the manifest since it got the whole database.
        self._defined = False

    def register(self, name: str, df: DataFrame, key: str | None = None, indexes: list[Index] = ()) -> None:
        """A read-only table over any DataFrame."""
        self.catalog.register(name, df, key)
        self.catalog.get(name).indexes += list(indexes)
        self._derived = {k: v for k, v in self._derived.items() if k[0] != name}

    @property
    def in_transaction(self) -> bool:
        return self._open is not None

    # -- statements --

    def execute(self, text: str) -> Result:
        """Runs a script; the last statement's result. The first error stops it and is raised."""
        result = Result()
        for statement in parse_script(text):
            result = self.run(statement)
        return result

    def try_execute(self, text: str) -> Result:
        """Like execute, with errors of the dialect in the result."""
        try:
            result = self.execute(text)
            if result.df is not None:
                result.df.schema  # noqa: B018
            return result
        except SQLError as e:
            return Result(error=str(e))

    def sql(self, text: str) -> DataFrame:
        return self.execute(text).df

    def run(self, statement: Any) -> Result:
        if isinstance(statement, a.Transaction):
            return self._transaction(statement.action)
        if self.locks is None:
            return self._run(statement)
        try:
            self._lock(statement.statement if isinstance(statement, a.Explain) else statement)
            return self._run(statement)
        except DeadlockError:
            if self._open is not None:
                self._transaction("ROLLBACK")
            raise
        finally:
            if self._open is None:
                self.locks.release(self)

    def _lock(self, s: Any) -> None:
        """Locks what the statement reads (S) and changes (X), and reads the manifest's state of it."""
        reads = isinstance(s, a.Select)
        defines = isinstance(s, (a.CreateTable, a.CreateIndex))
        self.locks.acquire(self, DATABASE, "X" if defines else "IS" if reads else "IX")
        self._refresh()
        wanted: dict[str, str] = {}
        if reads:
            wanted = {t.name: "S" for t in (s.table, *(j.table for j in s.joins))}
        elif isinstance(s, a.Delete):
            wanted, ahead = {}, [s.table.name]
            while ahead:  # and whatever refers to it
                name = ahead.pop()
                if name not in wanted:
                    wanted[name] = "X"
                    ahead += [t.name for t in self.catalog.tables.values() if any(f["table"] == name for f in t.foreign_keys)]
        elif not defines:
            table = self.catalog.tables.get(s.table)
            wanted = {f["table"]: "S" for f in (table.foreign_keys if table else ())} | {s.table: "X"}
        for name in sorted(wanted):
            self.locks.acquire(self, name, wanted[name])
        self._refresh()

    def _refresh(self) -> None:
        """What this session may have changed is its own; nobody else can have changed it."""
        held = self.locks.held(self)
        if held.get(DATABASE) == "X" and self._open is not None and self._defined:
            return
        with self.locks.latch:
            self.catalog.refresh({name for name, mode in held.items() if mode == "X"})
        self._defined = held.get(DATABASE) == "X"

    def _publish(self, base: int) -> None:
        if self.locks is None:
            return self.catalog.save(base)
        with self.locks.latch:
            held = self.locks.held(self)
            if held.get(DATABASE) != "X":
                self.catalog.refresh({name for name, mode in held.items() if mode == "X"})
            self.catalog.save()

    def _run(self, statement: Any) -> Result:
        if isinstance(statement, a.Select):
            bound = self.lowering.select(statement)
            return Result(bound.labels, bound.df)
        if isinstance(statement, a.Explain):
            return self._explain(statement)
        held = self.catalog.snapshot()
        try:
            result = self._change(statement)
            if self._open is None:
                self._publish(self.catalog.revision)
            return result
        except PySparkException as e:
            self.catalog.restore(held)
            raise SQLExecutionError(str(e).split("\n")[0]) from e
        except BaseException:
            self.catalog.restore(held)
            raise

    def _change(self, s: Any) -> Result:
        if isinstance(s, a.CreateTable):
            return self._create_table(s)
        if isinstance(s, a.CreateIndex):
            return self._create_index(s)
        if isinstance(s, a.Insert):
            return self._insert(s)
        if isinstance(s, a.Copy):
            return self._copy(s)
        if isinstance(s, a.Delete):
            return self._delete(s)
        raise SQLSemanticError(f"can't run {type(s).__name__}")

    def _transaction(self, action: str) -> Result:
        if action == "BEGIN":
            if self._open is not None:
                raise SQLExecutionError("a transaction is open already")
            self._defined = False
            self._open = self.catalog.snapshot(), self.catalog.revision
            return Result(message="BEGIN")
        if self._open is None:
            raise SQLExecutionError("no transaction is open")
        held, base = self._open
        if action == "COMMIT":
            self._publish(base)
        else:
            self.catalog.restore(held)
        self._open = None
        if self.locks is not None:
            self.locks.release(self)
        return Result(message=action)

    # -- definitions --

    def _own(self, name: str) -> Table:
        if name in self.catalog.external:
            raise SQLSemanticError(f"table {name} is read-only")
        return self.catalog.get(name)

    def _create_table(self, s: a.CreateTable) -> Result:
        if self.catalog.has(s.name):
            raise SQLSemanticError(f"table {s.name} exists already")
        types = {c.name: c.type for c in s.columns}
        if s.primary_key and types[s.primary_key] not in ("INT", "FLOAT", "VARCHAR"):
            raise SQLSemanticError(f"{types[s.primary_key]} can't be a primary key")
        if s.organisation != "HEAP" and not s.primary_key:
            raise SQLSemanticError(f"{s.organisation} needs a primary key")
        foreign = []
        for f in s.foreign_keys:
            if types[f.column] not in ("INT", "FLOAT", "VARCHAR"):
                raise SQLSemanticError(f"{types[f.column]} can't be a foreign key")
            own = f.table == s.name
            key = s.primary_key if own else self.catalog.get(f.table).primary_key
            if key is None or f.target not in (None, key):
                raise SQLSemanticError(f"a foreign key refers to the primary key of {f.table}")
            target = types[key] if own else self.catalog.get(f.table).field(key).type
            if target != types[f.column]:
                raise SQLSemanticError(f"foreign key {f.column} has another type than {f.table}.{key}")
            foreign.append({"column": f.column, "table": f.table, "target": key, "on_delete": f.on_delete})
        fields = [Field(c.name, c.type, c.size) for c in s.columns]
        self.catalog.tables[s.name] = Table(s.name, fields, s.primary_key, foreign, s.organisation)
        return Result(message="CREATE TABLE")

    def _create_index(self, s: a.CreateIndex) -> Result:
        table = self.catalog.get(s.table)
        f = table.field(s.column)
        if f is None:
            raise SQLSemanticError(f"column {s.column} does not exist")
        if any(i.name == s.name for t in self.catalog.tables.values() for i in t.indexes):
            raise SQLSemanticError(f"index {s.name} exists already")
        if f.type not in INDEXABLE[s.method]:
            raise SQLSemanticError(f"{s.method} doesn't fit {f.type}")
        options = dict(s.options)
        if "language" in options:
            if options["language"].lower() not in LANGUAGES:
                raise SQLSemanticError(f"unknown language {options['language']}")
            options["language"] = LANGUAGES[options["language"].lower()]
        if s.method in ("HNSW", "IVF"):
            options.setdefault("metric", "euclidean")
        table.indexes.append(Index(s.name, s.column, s.method, options))
        return Result(message="CREATE INDEX")

    # -- rows in --

    def _stored_value(self, f: Field, e: Any) -> Any:
        if isinstance(e, a.Point):
            if f.type == "POINT":
                return e.lat, e.lon
            raise SQLSemanticError(f"{f.name}: a point doesn't fit {f.type}")
        v = e.value if isinstance(e, a.Literal) else None
        if isinstance(v, bool) or v is None:
            raise SQLSemanticError(f"{f.name}: only numbers, texts and points are stored")
        if f.type == "INT" and isinstance(v, int) and -(2**63) <= v < 2**63:
            return v
        if f.type == "FLOAT" and isinstance(v, (int, float)) and math.isfinite(float(v)):
            return float(v)
        if isinstance(v, str) and f.kind == "STR":
            return v.encode()[: f.size].decode("utf-8", "ignore") if f.type == "VARCHAR" else v
        raise SQLSemanticError(f"{f.name}: {v!r} doesn't fit {f.type}")

    def _insert(self, s: a.Insert) -> Result:
        table = self._own(s.table)
        names = list(s.columns or [f.name for f in table.fields])
        if sorted(names) != sorted(f.name for f in table.fields):
            raise SQLSemanticError("INSERT gives every column once")
        rows = []
        for row in s.rows:
            if len(row) != len(names):
                raise SQLSemanticError("INSERT gives every column once")
            values = {n: self._stored_value(table.field(n), e) for n, e in zip(names, row)}
            out = [table.next_rid + len(rows)]
            for f in table.fields:
                out.append(values[f.name])
                if f.type in MEDIA:
                    out.append(media.extract(f.type, values[f.name]))
            rows.append(tuple(out))
        df = self.spark.createDataFrame(rows, table.schema())
        self._append(table, df, len(rows))
        return Result(message=f"INSERT {len(rows)}", affected=len(rows))

    def _copy(self, s: a.Copy) -> Result:
        table = self._own(s.table)
        names = list(s.columns or [f.name for f in table.fields])
        if sorted(names) != sorted(f.name for f in table.fields):
            raise SQLSemanticError("COPY gives every column once")
        df = csv_source.load(self.spark, s.path, names, table.fields, s.header, s.delimiter, s.encoding)
        for f in table.fields:
            if f.type in MEDIA:
                df = media.extract_column(df, f.type, f.name, vector_column(f.name))
        # Consecutive ids in file order, without one task for all rows: counts per partition first.
        df = df.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()).cache()
        sizes = {r["_part"]: r["count"] for r in df.groupBy("_part").count().collect()}
        first, starts = table.next_rid, {}
        for part in sorted(sizes):
            starts[part] = first
            first += sizes[part]
        n = sum(sizes.values())
        if n:
            base = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part"))
            order = F.row_number().over(Window.partitionBy("_part").orderBy("_nth")) - 1
            self._append(table, df.withColumn(RID, (base + order).cast("long")).select(*table.schema().names), n)
        df.unpersist()
        return Result(message=f"COPY {n}", affected=n)

    def _append(self, table: Table, df: DataFrame, n: int) -> None:
        self._check_keys(table, df)
        table.parts.append(self.catalog.write_part(table.name, df))
        table.next_rid += n
        table.version += 1
        if table.organisation != "HEAP" and len(table.parts) > MOST_PARTS:
            self.catalog.compact(table.name)

    def _check_keys(self, table: Table, df: DataFrame) -> None:
        if table.primary_key and (twice := self.repeated_keys(table.name, df).take(1)):
            raise SQLIntegrityError(f"key {twice[0][0]!r} of {table.name} exists already")
        for f in table.foreign_keys:
            if lost := self.missing_parents(table.name, f["column"], df).take(1):
                raise SQLIntegrityError(f"{f['table']} has no {f['target']} = {lost[0][0]!r}")

    def repeated_keys(self, name: str, df: DataFrame) -> DataFrame:
        """(key, n): the primary keys that would stand in the table n times if df's rows came in."""
        key, table = self.catalog.get(name).primary_key, self.catalog.get(name)
        fresh = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        if name in self.catalog.tables and table.parts:
            there = self.catalog.frame(name).select(key, F.lit(1).alias("_there")).join(fresh.select(key), key, "left_semi")
            fresh = fresh.join(there, key, "left").select(key, (F.col("n") + F.coalesce("_there", F.lit(0))).alias("n"))
        return fresh.where("n > 1")

    def missing_parents(self, name: str, column: str, df: DataFrame) -> DataFrame:
        """(key, n): the values of a foreign key in n rows of df for which there would be no parent if they came in."""
        f = next(f for f in self.catalog.get(name).foreign_keys if f["column"] == column)
        parent = self.catalog.frame(f["table"]).select(F.col(f["target"]).alias("_key"))
        if f["table"] == name:
            parent = parent.union(df.select(F.col(f["target"]).alias("_key")))
        lost = df.select(F.col(column).alias("_key")).join(parent, "_key", "left_anti")
        return lost.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))

    def load(self, name: str, df: DataFrame) -> Result:
        """INSERT of a DataFrame with the table's columns (media columns as paths), keys checked; all or nothing."""
        held = self.catalog.snapshot()
        try:
            table = self._own(name)
            for f in table.fields:
                if f.type in MEDIA:
                    df = media.extract_column(df, f.type, f.name, vector_column(f.name))
            n = df.count()
            given = numbered(df, [F.xxhash64(*[F.col(f"`{f.name}`") for f in table.fields if f.type not in MEDIA]), *[f.name for f in table.fields if f.type != "POINT"]], RID, first=table.next_rid)
            self._append(table, given.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema()]), n)
            if self._open is None:
                self.catalog.save(self.catalog.revision)
            return Result(message=f"INSERT {n}", affected=n)
        except PySparkException as e:
            self.catalog.restore(held)
            raise SQLExecutionError(str(e).split("\n")[0]) from e
        except BaseException:
            self.catalog.restore(held)
            raise

    def doomed_by(self, text: str) -> dict[str, DataFrame]:
        """The row ids by table that a DELETE statement would take with its cascades; raises if a key forbids it."""
        (s,) = parse_script(text)
        return self._cascade(self._own(s.table.name), self._doomed(s))

    # -- rows out --

    def _delete(self, s: a.Delete) -> Result:
        table = self._own(s.table.name)
        doomed = self._doomed(s).cache()
        n = doomed.count()
        if n:
            for name, rids in self._cascade(table, doomed).items():
                other = self.catalog.get(name)
                left = self.catalog.frame(name).join(rids, RID, "left_anti")
                other.parts = [self.catalog.write_part(name, left)]
                other.version += 1
        doomed.unpersist()
        return Result(message=f"DELETE {n}", affected=n)

    def _doomed(self, s: a.Delete) -> DataFrame:
        """The row ids that a DELETE names itself."""
        source, df, _ = self.lowering.source(s.table)
        scope = Scope([source])
        if s.where is not None:
            df = df.where(Expressions(scope).condition(scope.qualify(s.where)))
        return df.select(at(slot(source.alias, RID)).alias(RID))

    def _cascade(self, table: Table, rids: DataFrame) -> dict[str, DataFrame]:
        """Row ids to delete by table: the frontier is followed until it adds nothing, cycles included."""
        gone = {table.name: rids}
        frontier, restricted = [(table.name, rids)], []
        while frontier:
            name, fresh = frontier.pop()
            parent = self.catalog.frame(name).join(fresh, RID, "left_semi")
            for child in self.catalog.tables.values():
                for f in child.foreign_keys:
                    if f["table"] != name:
                        continue
                    keys = parent.select(F.col(f["target"]).alias(f["column"]))
                    hit = self.catalog.frame(child.name).join(keys, f["column"], "left_semi").select(RID)
                    if f["on_delete"] != "CASCADE":
                        restricted.append((child.name, name, hit))
                        continue
                    if child.name in gone:
                        hit = hit.join(gone[child.name], RID, "left_anti")
                    hit = hit.cache()
                    if not hit.isEmpty():
                        gone[child.name] = gone[child.name].union(hit).distinct() if child.name in gone else hit
                        frontier.append((child.name, hit))
        for child_name, name, hit in restricted:
            left = hit.join(gone[child_name], RID, "left_anti") if child_name in gone else hit
            if not left.isEmpty():
                raise SQLIntegrityError(f"rows of {child_name} refer to rows of {name}")
        return gone

    # -- derived structures, by table version --

    def text_index(self, table: Table, column: str) -> text_ops.StoredIndex:
        """The column's stored index: written at first use, then given the table's new parts only.

        It names the parts that it covers, so it is found again by a later session; where parts have
        gone (DELETE, ROLLBACK, compaction) it is written anew.
        """
        index = next((i for i in table.indexes if i.column == column and i.method == "SPIMI"), None)
        if index is None:
            raise SQLSemanticError(f"MATCH needs a SPIMI index on {table.name}.{column}")
        language, simple = index.options.get("language"), index.options.get("analysis") == "simple"
        build = lambda df: text_ops.build_index(df, RID, f"`{column}`", language, simple)
        key = (table.name, table.version, tuple(table.parts), column, "SPIMI", language)
        if key not in self._derived:
            self._forget(table)
            own = table.name in self.catalog.tables
            path = f"{self.catalog.root}/{table.name}/text-{index.name}" + ("" if own else f"-{uuid.uuid4().hex}")
            held = text_ops.open_index(self.spark, path) if own else None
            if held is None or not set(held.tag) <= set(table.parts):
                held = text_ops.write_index(build(self.catalog.frame(table.name)), path, table.parts)
            elif fresh := [p for p in table.parts if p not in held.tag]:
                held.add(build(self.spark.read.schema(table.schema()).parquet(*fresh)))
                held.tag = list(table.parts)
                held.save()
            if not own:
                Files(self.spark, path).go_with_the_session()
            self._derived[key] = held
        return self._derived[key]

    def vector_search(self, table: Table, s: a.SimilarTo) -> tuple[DataFrame, dict[str, str]]:
        """(the k nearest rows with _similarity, details for the plan)."""
        column = s.column.column if s.column is not None else None
        own = [i for i in table.indexes if i.method == s.method and column in (None, i.column)]
        if s.metric is not None:
            own = [i for i in own if i.options.get("metric", "euclidean") == s.metric]
        if not own:
            raise SQLSemanticError(f"SIMILAR_TO needs a {s.method} index" + (f" with metric {s.metric}" if s.metric else ""))
        if len(own) > 1 and (column is None or s.metric is None):
            raise SQLSemanticError("SIMILAR_TO is ambiguous: name the column and the metric")
        index = own[0]
        f = table.field(index.column)
        metric = index.options.get("metric", "euclidean")
        stored = index.column if f.type == "VECTOR" else vector_column(index.column)
        query = media.extract("IMAGE" if f.type == "VECTOR" else f.type, s.path)
        vectors.check_query(np.asarray(query), metric)
        frame = self.catalog.frame(table.name)
        width = next((len(r[0]) for r in frame.where(F.col(f"`{stored}`").isNotNull()).select(f"`{stored}`").take(1)), len(query))
        if width != len(query):
            raise SQLExecutionError(f"the query has {len(query)} dimensions, {table.name}.{index.column} has {width}")
        rows = frame.select(RID, F.col(f"`{stored}`").alias("v"))
        details = {"Vector Cond": f"similar_to({index.column}, '{s.path}', k={s.k})", "Index": index.name, "Metric": metric}
        if s.method == "IVF":
            key = (table.name, table.version, tuple(table.parts), index.column, "IVF", metric)
            if key not in self._derived:
                self._forget(table)
                self._derived[key] = self._lists(table, index, frame, rows, stored, metric)
            ivf = self._derived[key]
            details["Search"] = f"{len(ivf.probed(query, s.k))} of {ivf.lists} lists"
            found = ivf.search(query, s.k, tie=RID)
        else:
            details["Search"] = "exact (no graph is kept)"
            found = vectors.top_k(rows, "v", query, s.k, metric, RID)
        return found.withColumnRenamed("similarity", SIMILARITY), details

    def _lists(self, table: Table, index: Index, frame: DataFrame, rows: DataFrame, stored: str, metric: str) -> vectors.IvfIndex:
        """The column's inverted lists, written at first use; new parts go into the lists that are there."""
        own = table.name in self.catalog.tables
        path = f"{self.catalog.root}/{table.name}/lists-{index.name}" + ("" if own else f"-{uuid.uuid4().hex}")
        held = vectors.read_ivf(self.spark, path) if own else None
        if held is not None and held.tag == table.parts:
            return held
        if held is not None and set(held.tag) < set(table.parts) and len(table.parts) <= MOST_PARTS:
            fresh = self.spark.read.schema(table.schema()).parquet(*[p for p in table.parts if p not in held.tag])
            made = held.append(fresh.select(RID, F.col(f"`{stored}`").alias("v")))
        else:
            made = vectors.build_ivf(rows, "v", metric)
        made.tag = list(table.parts)
        if not own:
            Files(self.spark, path).go_with_the_session()
        return made.write(path)

    def _forget(self, table: Table) -> None:
        """Drops what was derived from older versions."""
        for key in [k for k in self._derived if k[0] == table.name and k[1] != table.version]:
            self._derived.pop(key)

    # -- maps --

    def map_payload(self, text: str, limit: int = 5000) -> dict:
        """What a map of a query over one table with points shows: the table's points (at most
        `limit`, by row id), the ids in the result, the shapes that the query names, and the view."""
        (q,) = parse_script(text)
        table = self.catalog.get(q.table.name)
        f = next((f for f in table.fields if f.type == "POINT"), None)
        if f is None or q.joins:
            raise SQLSemanticError("a map needs a query over one table with points")
        key = table.primary_key or RID
        p, frame = at(f.name), self.catalog.frame(q.table.name)
        points = frame.select(at(key).alias("id"), p["lat"].alias("lat"), p["lon"].alias("lon"))
        view = spatial.viewport(frame, p).first().asDict()
        shown = a.Select((a.SelectItem(a.Ref(key), "id"),), q.table, (), q.where, (), None, q.order_by, q.limit, q.offset) if key != RID else None
        ids = [r[0] for r in self.lowering.select(shown).df.limit(limit).collect()] if shown is not None else []
        shapes = []
        for e in conjuncts(q.where):
            for w in find(e, a.Within):
                shapes.append({"kind": "polygon", "rings": w.polygon.rings})
            if isinstance(e, a.Binary) and e.op in ("<", "<=") and isinstance(e.left, a.Distance) and isinstance(e.right, a.Literal):
                centre = next((x for x in (e.left.left, e.left.right) if isinstance(x, a.Point)), None)
                if centre is not None:
                    shapes.append({"kind": "circle", "lat": centre.lat, "lon": centre.lon, "radius": e.right.value})
        centres = [x for o in q.order_by for d in find(o.expr, a.Distance) for x in (d.left, d.right) if isinstance(x, a.Point)]
        shapes += [{"kind": "centre", "lat": c.lat, "lon": c.lon} for c in centres]
        shown_points = [tuple(r) for r in points.orderBy("id").limit(limit + 1).collect()]
        return {"points": shown_points[:limit], "more_points": len(shown_points) > limit, "ids": ids, "shapes": shapes, "view": view}

    # -- EXPLAIN --

    def _explain(self, s: a.Explain) -> Result:
        began = time.perf_counter()
        inner = s.statement
        actual = None
        if isinstance(inner, a.Select):
            bound = self.lowering.select(inner)
            planned = time.perf_counter()
            if s.analyze:
                actual = bound.df.count()
        else:
            name = inner.table if isinstance(inner, a.Insert) else inner.table.name
            self._own(name)
            verb = "Insert" if isinstance(inner, a.Insert) else "Delete"
            child = []
            df = self.catalog.frame(name)
            if isinstance(inner, a.Delete):
                df = self._doomed(inner)
                child = [Node(f"Seq Scan on {name}")]
            bound = Bound(df, [], Node(f"{verb} on {name}", {}, child), [])
            planned = time.perf_counter()
            if s.analyze:
                actual = self.run(inner).affected
        ended = time.perf_counter()
        lines = render(bound, actual, (planned - began) * 1000, (ended - planned) * 1000 if s.analyze else None)
        return Result(["QUERY PLAN"], self.spark.createDataFrame([(x,) for x in lines], "`QUERY PLAN` string").coalesce(1), plan=lines)

    def analyze(self, name: str, approximate: bool = False) -> DataFrame:
        """(column, rows, distinct, min, max) of a table in one pass."""
        table, df = self.catalog.get(name), self.catalog.frame(name)
        distinct = F.approx_count_distinct if approximate else F.count_distinct
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(table.fields):
            if f.type == "VECTOR":
                continue
            number = f.type in ("INT", "FLOAT")
            c = at(f.name)
            aggs += [distinct(c).alias(f"d{i}"), (F.min(c) if number else F.lit(None)).cast("double").alias(f"lo{i}"), (F.max(c) if number else F.lit(None)).cast("double").alias(f"hi{i}")]
        wide = df.agg(*aggs)
        items = [F.struct(F.lit(f.name).alias("column"), F.col("rows"), at(f"d{i}").alias("distinct"), at(f"lo{i}").alias("min"), at(f"hi{i}").alias("max")) for i, f in enumerate(table.fields) if f.type != "VECTOR"]
        return wide.select(F.inline(F.array(*items)))


def result_json(result: Result) -> str:
    return json.dumps(result.to_dict(), ensure_ascii=False)


__all__ = ["Engine", "Result", "Source", "result_json"]
