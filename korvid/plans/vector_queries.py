"""Vector queries over embeddings."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.catalog import Index
from korvid.operators import graph, vectors
from korvid.plans.registry import register, session
from korvid.session import table
from korvid.sources import media

QUERY = [round(math.sin(3 * i + 1) / 8, 6) for i in range(64)]
Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
E = "embedding::DOUBLE[]"
SIMILARITY = {
    "cosine": f"list_cosine_similarity({E}, {Q})",
    "dot_product": f"list_inner_product({E}, {Q})",
    "euclidean": f"1 / (1 + list_distance({E}, {Q}))",
}


def _exact(name: str, metric: str) -> None:
    oracle = f"SELECT vec_id, round({SIMILARITY[metric]}, 9) AS similarity FROM embeddings ORDER BY {SIMILARITY[metric]} DESC, vec_id LIMIT 10"

    @register(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = vectors.top_k(table(spark, sf_dir, "embeddings"), "embedding", QUERY, 10, metric, "vec_id")
        return found.select("vec_id", F.round("similarity", 9).alias("similarity"))


for _metric in SIMILARITY:
    _exact(f"vec_topk_{_metric.split('_')[0]}", _metric)


def _dialect(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    media.register_extractor("IMAGE", media.vectors_file)
    engine = session(spark, sf_dir)
    own = [Index("h", "embedding", "HNSW", {"metric": "cosine"}), Index("i", "embedding", "IVF", {"metric": "cosine"})]
    engine.register("embeddings", table(spark, sf_dir, "embeddings"), "vec_id", own)
    return engine.sql(sql)


@register(
    "vec_topk_postfilter",
    f"""SELECT vec_id, label, round(s, 9) AS s FROM (SELECT vec_id, label, {SIMILARITY['cosine']} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40)
    WHERE label < 5 ORDER BY s DESC, vec_id""",
)
def vec_topk_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIMILAR_TO: the k nearest of all, then the other conditions."""
    found = _dialect(spark, sf_dir, f"SELECT vec_id, label, SIMILARITY_SCORE() AS s FROM embeddings WHERE SIMILAR_TO('{json.dumps(QUERY)}', k=40) USING HNSW AND label < 5")
    return found.withColumn("s", F.round("s", 9))


@register(
    "vec_batch_queries",
    f"""WITH q AS (SELECT vec_id AS query_id, {E} AS q FROM embeddings WHERE vec_id % 100 = 0),
    r AS (SELECT query_id, vec_id AS id, list_distance({E}, q) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance({E}, q), vec_id) AS rank FROM q, embeddings)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def vec_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return vectors.top_k_join(df, asked(df), "embedding", 5, "euclidean", "vec_id").select("query_id", "id", "rank")



@register("vec_ivf_all_lists", f"SELECT vec_id FROM embeddings ORDER BY list_distance({E}, {Q}), vec_id LIMIT 10")
def vec_ivf_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every list probed the answer is exact."""
    ivf = vectors.build_ivf(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "euclidean", 8)
    return ivf.search(QUERY, 10, probes=8, tie="vec_id").select("vec_id")


def asked(df: DataFrame) -> DataFrame:
    """The rows that serve as queries: ids divisible by 100."""
    return df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _recall(found: DataFrame, df: DataFrame) -> DataFrame:
    truth = vectors.top_k_join(df, asked(df), "embedding", 10, "euclidean", "vec_id")
    return vectors.recall_at_k(found, truth).agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("queries"))



@register(
    "precision_at_k",
    f"""WITH q AS (SELECT vec_id AS query_id, label AS own, {E} AS q FROM embeddings WHERE vec_id % 100 = 0),
    r AS (SELECT query_id, own, label, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity({E}, q) DESC, vec_id) AS rank FROM q, embeddings)
    SELECT query_id, count(*) FILTER (own = label) / 10.0 AS precision FROM r WHERE rank <= 10 GROUP BY 1""",
)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    found = vectors.top_k_join(df, asked(df), "embedding", 10, "cosine", "vec_id")
    relevant = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(df.select(F.col("vec_id").alias("id"), "label"), "label")
    return vectors.precision_at_k(found, relevant, 10)
