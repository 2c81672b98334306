"""Tables as immutable snapshots: a list of Parquet parts and a version, kept in one manifest."""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvid.errors import ConflictError, SQLSemanticError

RID = "_rid"
STORED = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "IMAGE": T.StringType(), "AUDIO": T.StringType()}
POINT_TYPE = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
MEDIA = ("IMAGE", "AUDIO")


def vector_column(name: str) -> str:
    return f"{name}__vector"


@dataclass
class Field:
    name: str
    type: str  # INT FLOAT VARCHAR TEXT POINT IMAGE AUDIO; BOOL TIME VECTOR in registered tables only
    size: int | None = None

    @property
    def kind(self) -> str:
        """The type in expressions."""
        return {"VARCHAR": "STR", "TEXT": "STR", "IMAGE": "STR", "AUDIO": "STR"}.get(self.type, self.type)


@dataclass
class Index:
    name: str
    column: str
    method: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Table:
    name: str
    fields: list[Field]
    primary_key: str | None = None
    foreign_keys: list[dict] = field(default_factory=list)
    organisation: str = "HEAP"
    indexes: list[Index] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    version: int = 0
    next_rid: int = 0

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def schema(self) -> T.StructType:
        out = [T.StructField(RID, T.LongType())]
        for f in self.fields:
            out.append(T.StructField(f.name, POINT_TYPE if f.type == "POINT" else STORED[f.type]))
            if f.type in MEDIA:
                out.append(T.StructField(vector_column(f.name), T.ArrayType(T.FloatType())))
        return T.StructType(out)


def fields_of(schema: T.StructType) -> list[Field]:
    """The dialect's types of a registered table; columns of other types are left out."""
    out = []
    for f in schema:
        kind = f.dataType
        if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            out.append(Field(f.name, "INT"))
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(Field(f.name, "FLOAT"))
        elif isinstance(kind, (T.StringType, T.VarcharType)):
            out.append(Field(f.name, "TEXT"))
        elif isinstance(kind, T.BooleanType):
            out.append(Field(f.name, "BOOL"))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(Field(f.name, "TIME"))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            out.append(Field(f.name, "VECTOR"))
        elif isinstance(kind, T.StructType) and kind.names == ["lat", "lon"]:
            out.append(Field(f.name, "POINT"))
    return out


class Files:
    """Small files on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root

    def _path(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.conf)

    def read(self, name: str) -> str | None:
        path, fs = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Written beside the old file, then renamed."""
        fresh, fs = self._path(f".{name}-{uuid.uuid4().hex}")
        path, _ = self._path(name)
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(fresh, path)

    def keep_only(self, names: set[str]) -> None:
        """Deletes all else below the root."""
        root, fs = self._path("")
        for status in fs.listStatus(root) if fs.exists(root) else ():
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)

    def go_with_the_session(self) -> None:
        """The root is deleted when the application ends."""
        path, fs = self._path("")
        fs.deleteOnExit(path)

    def make(self) -> None:
        path, fs = self._path("")
        fs.mkdirs(path)


class Catalog:
    MANIFEST = "catalog.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)
        self.tables: dict[str, Table] = {}
        self.external: dict[str, tuple[DataFrame, Table]] = {}
        self.revision = 0
        self._load()

    # -- manifest --

    def _load(self) -> None:
        text = self.files.read(self.MANIFEST)
        if text is None:
            return
        held = json.loads(text)
        self.revision = held["revision"]
        for t in held["tables"]:
            t["fields"] = [Field(**f) for f in t["fields"]]
            t["indexes"] = [Index(**i) for i in t["indexes"]]
            self.tables[t["name"]] = Table(**t)

    def refresh(self, keep: set[str]) -> None:
        """Reads the manifest again, but for the tables to keep as they are here."""
        own = {n: t for n, t in self.tables.items() if n in keep}
        self.tables = {}
        self._load()
        self.tables.update(own)

    def save(self, base: int | None = None) -> None:
        """Publishes the tables; base: the revision that they were changed from."""
        text = self.files.read(self.MANIFEST)
        there = json.loads(text)["revision"] if text else 0
        if base is not None and there != base:
            raise ConflictError("the catalog was changed by another session; roll back and try again")
        self.revision = there + 1
        self.files.make()
        self.files.replace(self.MANIFEST, json.dumps({"revision": self.revision, "tables": [asdict(t) for t in self.tables.values()]}))

    def snapshot(self) -> Any:
        return copy.deepcopy(self.tables)

    def restore(self, held: Any) -> None:
        self.tables = copy.deepcopy(held)

    # -- tables --

    def get(self, name: str) -> Table:
        if name in self.tables:
            return self.tables[name]
        if name in self.external:
            return self.external[name][1]
        raise SQLSemanticError(f"table {name} does not exist")

    def has(self, name: str) -> bool:
        return name in self.tables or name in self.external

    def frame(self, name: str) -> DataFrame:
        """The rows with their hidden row id."""
        if name in self.external:
            return self.external[name][0]
        table = self.get(name)
        if not table.parts:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*table.parts)

    def register(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A read-only table. key: the column that decides ties; without it there is no fixed order among them."""
        table = Table(name, fields_of(df.schema), primary_key=key)
        rid = F.col(f"`{key}`").cast("long") if key else F.xxhash64(*[F.col(f"`{f.name}`") for f in table.fields])
        self.external[name] = (df.select(rid.alias(RID), *[F.col(f"`{f.name}`") for f in table.fields]), table)

    def write_part(self, name: str, df: DataFrame) -> str:
        """Writes rows in the table's organisation; sorted ones can be pruned by their bounds."""
        table = self.get(name)
        path = f"{self.root}/{name}/part-{uuid.uuid4().hex}"
        if table.organisation != "HEAP" and table.primary_key:
            df = df.sortWithinPartitions(table.primary_key)
        writer = df.select(*table.schema().names).write
        for index in table.indexes:
            if index.method == "HASH":  # equality then skips row groups
                writer = writer.option(f"parquet.bloom.filter.enabled#{index.column}", "true")
        writer.parquet(path)
        return path

    def compact(self, name: str) -> None:
        """Rewrites a sorted table as one range-partitioned, sorted part."""
        table = self.get(name)
        df = self.frame(name)
        if table.organisation != "HEAP" and table.primary_key:
            df = df.repartitionByRange(table.primary_key)
        table.parts = [self.write_part(name, df)]
        table.version += 1
