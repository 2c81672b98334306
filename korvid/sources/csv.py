"""CSV: loading with all-or-nothing checks, and schema inference."""

from __future__ import annotations

import csv
import itertools
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.catalog import Field
from korvid.errors import SQLExecutionError

#: Names of encodings in the dialect, for Spark and for Python.
ENCODINGS = {"UTF8": "utf-8", "UTF-8": "utf-8", "LATIN1": "iso-8859-1", "ISO-8859-1": "iso-8859-1", "WIN1252": "windows-1252", "WINDOWS-1252": "windows-1252"}
POINT_TEXT = r"^\s*(?i:POINT)?\s*\(?\s*([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*,\s*([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*\)?\s*$"
MEDIA_ENDINGS = {"IMAGE": (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp"), "AUDIO": (".wav", ".mp3", ".flac", ".ogg", ".m4a")}


def truncated(text: Column, size: int) -> Column:
    """At most `size` UTF-8 bytes, cut after the last whole character; a cut character leaves no trace."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, size).cast("string"))
    return F.when(F.octet_length(text) > size, F.rtrim(cut, F.lit("�"))).otherwise(text)


def typed(column: Column, f: Field) -> Column:
    """The text as the field's type; null if it isn't one."""
    if f.type == "INT":
        return F.when(F.trim(column).rlike(r"^[+-]?[0-9]+$"), F.trim(column).try_cast("long"))
    if f.type == "FLOAT":
        number = F.trim(column).try_cast("double")
        return F.when(F.trim(column).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(number) < float("inf")), number)
    if f.type == "POINT":
        lat, lon = (F.regexp_extract(column, POINT_TEXT, k).try_cast("double") for k in (1, 2))
        return F.when(F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180), F.struct(lat.alias("lat"), lon.alias("lon")))
    return truncated(column, f.size) if f.type == "VARCHAR" and f.size else column


def load(spark: SparkSession, path: str, names: list[str], fields: list[Field], header: bool, delimiter: str, encoding: str) -> DataFrame:
    """names: the file's columns in order; fields: their types. Raises with a line number if a row is bad."""
    if encoding.upper() not in ENCODINGS:
        raise SQLExecutionError(f"unknown encoding {encoding}")
    charset = ENCODINGS[encoding.upper()]
    schema = ", ".join([*(f"`{n}` string" for n in names), "_bad string"])
    reader = spark.read.schema(schema).options(header=header, sep=delimiter, encoding=charset, mode="PERMISSIVE", multiLine=True, quote='"', escape='"', enforceSchema=True)
    raw = reader.options(columnNameOfCorruptRecord="_bad", nullValue="\u0001", emptyValue="").csv(path)
    by_name = {f.name: f for f in fields}
    first = F.regexp_replace(F.col(f"`{names[0]}`"), "^﻿", "")
    cols = [typed(first if n == names[0] else F.col(f"`{n}`"), by_name[n]).alias(n) for n in names]
    made = raw.select(*cols, "_bad")
    wrong = F.col("_bad").isNotNull()
    for n in names:
        wrong = wrong | F.col(f"`{n}`").isNull()
    if not made.where(wrong).isEmpty():
        raise SQLExecutionError(first_error(path, names, fields, header, delimiter, charset))
    return made.drop("_bad")


def first_error(path: str, names: list[str], fields: list[Field], header: bool, delimiter: str, charset: str) -> str:
    """The message for the first bad line; reads on the driver up to that line, only when there is one."""
    by_name = {f.name: f for f in fields}
    local = re.sub(r"^file:(//)?", "", path)
    if not os.path.exists(local):
        return f"{path}: a row doesn't fit the table"
    with open(local, encoding="utf-8-sig" if charset == "utf-8" else charset, newline="") as f:
        rows = csv.reader(f, delimiter=delimiter)
        if header:
            next(rows, None)
        for row in rows:
            if not row:
                continue
            if len(row) != len(names):
                return f"{path}, line {rows.line_num}: {len(row)} values for {len(names)} columns"
            for n, value in zip(names, row):
                kind = by_name[n].type
                if kind == "INT" and not re.fullmatch(r"\s*[+-]?[0-9]+\s*", value):
                    return f"{path}, line {rows.line_num}: {n}: {value!r} is no INT"
                if kind == "FLOAT" and not re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", value):
                    return f"{path}, line {rows.line_num}: {n}: {value!r} is no FLOAT"
                if kind == "POINT" and not re.match(POINT_TEXT, value):
                    return f"{path}, line {rows.line_num}: {n}: {value!r} is no POINT"
    return f"{path}: a row doesn't fit the table"


# -- inference --------------------------------------------------------------------------------------


def sniff(sample: str) -> str:
    """The delimiter that cuts the first lines into the most, and equally many, parts."""
    lines = [x for x in sample.splitlines() if x.strip()][:20]

    def score(d: str) -> tuple[bool, int]:
        widths = {len(r) for r in csv.reader(lines, delimiter=d)}
        return len(widths) == 1, max(widths, default=0)

    return max(",;\t|", key=score) if lines else ","


def _is_int(v: str) -> bool:
    return bool(re.fullmatch(r"[+-]?[0-9]+", v.strip())) and abs(int(v)) < 2**63


def _is_float(v: str) -> bool:
    return bool(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v.strip()))


def infer(path: str, taken: set[str] = frozenset(), sample_rows: int | None = None, encoding: str = "utf-8-sig") -> tuple[str, str]:
    """(CREATE TABLE, COPY) for a file, from all of its rows, or from the first sample_rows.

    Types by the first that fits all values: a media path, INT, FLOAT, TEXT above 255 bytes, else
    VARCHAR rounded up to tens. The first INT column is the key if its values differ.
    """
    with open(path, encoding=encoding, newline="") as f:
        delimiter = sniff(f.read(64 * 1024))
        f.seek(0)
        rows = [r for r in itertools.islice(csv.reader(f, delimiter=delimiter), None if sample_rows is None else sample_rows + 1) if r]
    if not rows:
        raise SQLExecutionError(f"{path} is empty")
    header = not any(_is_float(v) for v in rows[0]) and (len(rows) == 1 or len(set(rows[0])) == len(rows[0]))
    names = [re.sub(r"\W+", "_", n.strip().lower(), flags=re.A).strip("_") or f"c{i}" for i, n in enumerate(rows[0])] if header else [f"c{i}" for i in range(len(rows[0]))]
    for i, n in enumerate(names):
        n = f"c_{n}" if n[0].isdigit() else n
        while n in names[:i]:
            n += "_"
        names[i] = n
    body = rows[1:] if header else rows
    defs, key = [], None
    for i, name in enumerate(names):
        values = [r[i] if i < len(r) else "" for r in body]
        media = next((k for k, ends in MEDIA_ENDINGS.items() if values and all(v.lower().endswith(ends) for v in values)), None)
        longest = max((len(v.encode()) for v in values), default=0)
        if media:
            kind = media
        elif values and all(map(_is_int, values)):
            kind = "INT"
            if key is None and len({int(v) for v in values}) == len(values):
                key, kind = name, "INT PRIMARY KEY"
            elif key is None:
                key = ""
        elif values and all(map(_is_float, values)):
            kind = "FLOAT"
        elif longest > 255:
            kind = "TEXT"
        else:
            kind = f"VARCHAR({max(10, -(-longest // 10) * 10)})"
        defs.append(f'"{name}" {kind}')
    table = re.sub(r"\W+", "_", os.path.splitext(os.path.basename(path))[0].lower(), flags=re.A) or "t"
    table = f"t_{table}" if table[0].isdigit() else table
    base, n = table, 2
    while table in taken:
        table, n = f"{base}_{n}", n + 1
    place = path.replace("'", "''")
    return f'CREATE TABLE "{table}" ({", ".join(defs)})', f"COPY \"{table}\" FROM '{place}' WITH (FORMAT csv, HEADER {str(header).lower()}, DELIMITER '{delimiter}')"
