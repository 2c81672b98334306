"""The subpackage's queries against their SQL, and one name per operator."""

import re

import duckdb
import pandas as pd
import pytest

from korvid.llm import queries as q

SF = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = q.queries()[name](spark, SF).toPandas(), con.execute(q.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(canonical(got).replace({"nan": "None"}), canonical(want).replace({"nan": "None"}))


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in q.queries()]
    assert numbers == list(range(1, 11))
