"""Distinct counts: exact, and a sketch of the k smallest hashes that merges across partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1024


def kmv_estimate(df: DataFrame, *columns: Column | str, k: int = K) -> DataFrame:
    """(estimate): exact below k distinct values, else (k - 1) over the k-th smallest hash as a share.

    Each task keeps its k smallest different hashes, so no more than k numbers of a task are shuffled.
    """

    def smallest(batches):
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.unique(np.r_[held, batch.column(0).to_numpy()])[:k]
        yield pa.record_batch([pa.array(held)], names=["h"])

    low = df.select(F.xxhash64(*columns).alias("h")).mapInArrow(smallest, "h long").distinct().orderBy("h").limit(k)
    row = low.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("last"))
    share = (F.col("last").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return row.select(F.when(F.col("n") < k, F.col("n").cast("double")).otherwise(F.lit(k - 1.0) / share).alias("estimate"))


def theta_estimate(df: DataFrame, column: str, log_k: int = 12) -> DataFrame:
    """The same with Spark's theta sketch, one aggregation with map-side merging."""
    return df.agg(F.theta_sketch_estimate(F.theta_sketch_agg(F.col(column), log_k)).alias("estimate"))


def column_statistics(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, rows, distinct, min, max) in one pass; min and max of numbers only."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("long", "integer", "double", "float", "short", "byte", "decimal")}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        number = F.col(c) if c in numeric else F.lit(None)
        aggs += [distinct(c).alias(f"d{i}"), F.min(number).cast("double").alias(f"lo{i}"), F.max(number).cast("double").alias(f"hi{i}")]
    items = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"d{i}").alias("distinct"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*items)))
