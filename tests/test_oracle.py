"""Every registered query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from korvid.plans import registry
from korvid.session import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return df.astype(str).replace({"<NA>": "nan", "None": "nan"}).map(lambda x: x.removesuffix(".0")).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
