"""Sources outside the box: databases by JDBC, PDF pages."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A query's rows; with a numeric column the read is cut in parts that run side by side.

    Needs the database's driver on the class path.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column is None:
        return reader.option("query", query).load()
    bounds = {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return reader.options(dbtable=f"({query}) AS q", **bounds).load()


def pdf_pages(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, page, text); a page that can't be read is empty. Needs pypdf."""

    def run(batches):
        from pypdf import PdfReader

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    try:
                        rows.append((path, number, page.extract_text() or ""))
                    except Exception:  # one bad page doesn't spoil a document
                        rows.append((path, number, ""))
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")
