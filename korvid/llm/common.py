"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import korvid.llm

# Python workers get the operators' functions inside the tasks, so they need no copy of the package.
cloudpickle.register_pickle_by_value(korvid.llm)


def set_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="korvid-checkpoint-")
    sc.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, which outlives any executor; the shuffles go at once, as nothing reads them again."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_checkpoint_dir(spark)
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)


def forget(df: DataFrame) -> None:
    """Deletes the files of a checkpoint() that nothing will read again."""
    plan = df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again; the files go when the application ends."""
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/korvid-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks can share caches.

    A worker goes from one operator to the next, so whoever asks first ends what another has kept.
    """
    holder = sys.modules.setdefault("_korvid_worker", types.ModuleType("_korvid_worker")).__dict__
    if holder.get("owner") != name:
        for key in [k for k in holder if k.startswith("state_")]:
            del holder[key]
        holder["owner"] = name
        give_back()
    return holder.setdefault(f"state_{name}", {})


def give_back() -> None:
    """Freed memory goes back to the system at once, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """run, a function for mapInArrow, after whose tasks the worker holds no freed memory: idle workers live on beside the JVM."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def small(batches, rows: int = 512):
    """The same rows in small batches, so that a worker never holds many texts twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def place_of(docs: DataFrame, name: str) -> int:
    """The number of the column: by its exact name, or else without regard to case."""
    names = docs.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def numbered_columns(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ...: whatever they were called, expressions can name them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def kept_places(docs: DataFrame, replaced) -> list[int]:
    """The numbers of the columns that none of the names replaces; Spark ignores case, so this does."""
    gone = {c.lower() for c in replaced}
    return [i for i, c in enumerate(docs.columns) if c.lower() not in gone]


def schema_of(docs: DataFrame, places: list[int], **more: T.DataType) -> T.StructType:
    """The schema of the numbered columns, and further ones."""
    fields = [T.StructField(f"c{i}", docs.schema[i].dataType) for i in places]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in more.items()])


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many lines before them as it takes to be none of docs' columns."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
