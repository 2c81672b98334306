"""Consecutive numbers over a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers, and the most ranges that the rows are cut into.
SPAN, RANGES = 500_000, 256


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """df with the numbers first, first + 1, ... by ascending order, as its first column.

    The rows are cut into ranges at keys from a hashed sample; the ranges' sizes say where each
    begins, and a window numbers the rows of a range. A row's range depends on nothing but its key,
    so a partition that is computed again gets the same numbers.
    """
    keyed = df.withColumn("_key", F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)]))
    n = df.count()
    ranges = min(RANGES, -(-n // SPAN))
    cuts = []
    if ranges > 1:
        every = max(1, n // (64 * ranges))
        sample = sorted((tuple(r["_key"]) for r in keyed.where(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).select("_key").collect()), key=lambda k: [(x is not None, x) for x in k])
        cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}, key=sample.index) if sample else []
    if not cuts:
        return keyed.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_key")) + (first - 1)).cast("long")).select(name, *df.columns)
    kind = keyed.schema["_key"].dataType
    bounds = F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(cut, kind)]) for cut in cuts])
    keyed = keyed.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col("_key"))))
    starts, at = {}, first - 1
    for r in sorted(keyed.groupBy("_range").count().collect()):
        starts[r["_range"]] = at
        at += r["count"]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_range"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return keyed.withColumn(name, (base + nth).cast("long")).select(name, *df.columns)
