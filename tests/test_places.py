"""Spatial queries on rows that the smallest tables don't have."""

import math
import random

import duckdb
import pytest

from korvid.engine import Engine
from korvid.operators import spatial
from korvid.plans import registry

#: Customers on the border of the hole, and one on the border of the polygon.
ON_HOLE, ON_POLYGON = (29380, 65382, 101384), (415590,)


@pytest.mark.parametrize("name, borders", [("geo_polygon_with_hole", ON_HOLE), ("geo_within_polygon", ON_POLYGON)])
def test_points_on_borders_follow_the_sql(spark, tmp_path, name, borders):
    keys = [(k,) for k in (*borders, *range(0, 18001, 97))]
    spark.createDataFrame(keys, "c_custkey long").selectExpr("c_custkey", "0 AS c_nationkey", "0D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = {k for k, in con.execute(registry.oracle_sql()[name]).fetchall()}
    assert {r.c_custkey for r in registry.queries()[name](spark, str(tmp_path)).collect()} == want and want


def metres(p, q, metric):
    (a, b), (c, d) = p, q
    if metric == "EUCLIDEAN":
        return math.hypot(c - a, d - b) * spatial.DEGREE
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * spatial.EARTH * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("metric", ["HAVERSINE", "EUCLIDEAN"])
@pytest.mark.parametrize("radius", [0, 60_000, 1_500_000, 6_000_000])
def test_joins_within_a_distance(spark, metric, radius):
    rng = random.Random(radius)
    near = [(0.0, 0.0), (89.9, 10.0), (-90.0, -100.0), (10.0, 179.9), (10.0, -179.9), (45.0, -180.0), (45.0, 180.0)]
    place = lambda: rng.choice(near) if rng.random() < 0.4 else tuple(max(-lim, min(lim, x + rng.gauss(0, 3))) for x, lim in zip(rng.choice(near), (90.0, 180.0)))
    sides = [[(i, *place()) for i in range(n)] + [(-1, None, None)] for n in (90, 60)]
    want = {(x[0], y[0]) for x in sides[0][:-1] for y in sides[1][:-1] if metres(x[1:], y[1:], metric) <= radius}
    for turn in (False, True):
        engine = Engine(spark)
        for name, rows in zip("uv", sides):
            df = spark.createDataFrame([(i, 1, None if a is None else (a, o)) for i, a, o in rows], "id int, k int, place struct<lat: double, lon: double>")
            engine.register(name, df, "id")
        on = "DISTANCIA(x.place, y.place) <= %d" if not turn else "%d >= DISTANCIA(y.place, x.place)"
        tables = ("u x", "v y") if not turn else ("v y", "u x")
        df = engine.sql(f"SELECT x.id AS i, y.id AS j FROM {tables[0]} JOIN {tables[1]} ON x.k = y.k AND {on % radius} USING {metric}")
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        bounded = metric == "EUCLIDEAN" or radius < 4_000_000
        assert ("_near0" in df._jdf.queryExecution().analyzed().toString()) == bounded
