"""Query registry: name -> (Spark query, DuckDB oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.engine import Engine
from korvid.operators import spatial
from korvid.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def place(key: str):
    """A point made from a key: always inside the domain, the same in any engine."""
    k = F.col(key)
    return spatial.point((k * 37 % 18001) / 100.0 - 90, (k * 91 % 36001) / 100.0 - 180)


def place_sql(key: str) -> str:
    return f"({key} * 37 % 18001) / 100.0 - 90 AS lat, ({key} * 91 % 36001) / 100.0 - 180 AS lon"


def session(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine with the named tables registered."""
    engine = Engine(spark)
    for name in names:
        df = table(spark, sf_dir, name)
        if name in ("customer", "supplier"):
            df = df.withColumn("place", place(KEYS[name]))
        engine.register(name, df, KEYS.get(name))
    return engine


def dialect(name: str, sql: str, tables: str, oracle: str | None, **rounded: int) -> None:
    """Registers a query in the dialect; rounded: digits of its inexact columns (the oracle rounds itself)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = session(spark, sf_dir, *tables.split()).sql(sql)
        return df.select(*[F.round(F.col(f"`{c}`"), rounded[c]).alias(c) if c in rounded else F.col(f"`{c}`") for c in df.columns])

    run.__name__ = name
    run.__doc__ = sql
    register(name, oracle)(run)


FLAGSHIP = (
    "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 "
    "GROUP BY l_returnflag HAVING COUNT(*) > 10 ORDER BY q DESC LIMIT 5"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "lineitem").sql(FLAGSHIP)


def _load() -> None:
    from korvid.plans import applications, fixed_queries, relational, spatial_queries, text_queries, vector_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
