"""Feature extraction for media columns: a registry of extractors, run once per distinct path."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.errors import SQLExecutionError

Extractor = Callable[[str], list[float]]
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(kind: str, extractor: Extractor) -> None:
    """kind: IMAGE or AUDIO; extractor: path -> numbers."""
    _EXTRACTORS[kind.upper()] = extractor


def extract(kind: str, path: str) -> list[float]:
    if kind.upper() not in _EXTRACTORS:
        raise SQLExecutionError(f"no extractor for {kind}; see register_extractor")
    try:
        found = [float(x) for x in _EXTRACTORS[kind.upper()](path)]
    except SQLExecutionError:
        raise
    except Exception as e:
        raise SQLExecutionError(f"can't extract {kind} features of {path!r}: {e}") from e
    if not found or not all(map(math.isfinite, found)):
        raise SQLExecutionError(f"the features of {path!r} are not a row of finite numbers")
    return found


def vectors_file(path: str) -> list[float]:
    """An extractor for files, or plain texts, that hold a JSON array."""
    if os.path.exists(path):
        with open(path) as f:
            return json.load(f)
    return json.loads(path)


def extract_column(df: DataFrame, kind: str, path_col: str, into: str) -> DataFrame:
    """df with a vector column; each distinct path is extracted once, on the executors."""
    run = _EXTRACTORS[kind.upper()] if kind.upper() in _EXTRACTORS else None
    if run is None:
        raise SQLExecutionError(f"no extractor for {kind}; see register_extractor")

    def batches(parts):
        for pdf in parts:
            pdf[into] = [[float(x) for x in run(p)] for p in pdf["_path"]]
            yield pdf

    paths = df.select(F.col(path_col).alias("_path")).where("_path IS NOT NULL").distinct()
    made = paths.mapInPandas(batches, f"_path string, `{into}` array<float>")
    return df.drop(into).join(made, df[path_col] == made["_path"], "left").drop("_path")


def content_key(content) -> F.Column:
    """The cache key of a file's bytes."""
    return F.md5(content)


def extract_files(files: DataFrame, extractor: Callable[[bytes], list[float]], cache: DataFrame | None = None) -> DataFrame:
    """files(path, content) -> (path, key, vector); keys that cache(key, vector) has aren't extracted again."""
    keyed = files.select("path", content_key(F.col("content")).alias("key"), "content")
    todo = keyed.dropDuplicates(["key"])
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")

    def batches(parts):
        for pdf in parts:
            yield pdf.assign(vector=[list(map(float, extractor(bytes(c)))) for c in pdf["content"]])[["key", "vector"]]

    made = todo.select("key", "content").mapInPandas(batches, "key string, vector array<float>")
    every = made if cache is None else made.unionByName(cache.select("key", "vector"))
    return keyed.select("path", "key").join(every, "key")


def file_key(content: bytes) -> str:
    return hashlib.md5(content).hexdigest()
