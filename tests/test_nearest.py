"""Searches by a table of queries over several cells, and equal vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvid.operators import graph, vectors


@pytest.fixture
def spread(spark):
    """Keys stay in the partition that their hash gives, as they do on larger tables."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_several_cells_and_equal_vectors(spread, metric):
    v = np.random.default_rng(5).normal(size=(4500, 6)).round(3)
    v[[4400, 17, 2900, 800, 3100, 4000]] = v[40]  # more copies than k
    v[4499] = v[41]
    df = spread.createDataFrame(list(enumerate(v.tolist())), "id long, v array<double>")
    asked = df.where("id BETWEEN 39 AND 44").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {(r.query_id, r["rank"]): r.id for r in vectors.top_k_join(df, asked, "v", 4, metric).collect()}
    for i in range(39, 45):
        if metric == "euclidean":
            s = -((v - v[i]) ** 2).sum(axis=1)
        else:
            s = (v * v[i]).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) if metric == "cosine" else 1)
        assert [got[i, n] for n in range(1, 5)] == np.lexsort((np.arange(len(v)), -s))[:4].tolist()


def test_graphs_measure_the_width_they_need(spark):
    rng = np.random.default_rng(8)
    v, q = rng.normal(size=(2500, 48)), rng.normal(size=(40, 48))
    df = spark.createDataFrame(list(enumerate(v.tolist())), "id long, v array<double>")
    asked = spark.createDataFrame(list(enumerate(q.tolist())), "query_id long, q array<double>")
    found = graph.approximate_top_k(df, "v", asked, 10).collect()
    near = np.argsort(((q[:, None] - v[None]) ** 2).sum(-1), axis=1)[:, :10]
    want = {(i, j) for i, row in enumerate(near.tolist()) for j in row}
    assert len(want & {(r.query_id, r.id) for r in found}) >= 0.9 * len(want)
