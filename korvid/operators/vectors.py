"""Vector search: metrics as column expressions, exact top-k, inverted lists, graphs, evaluation."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvid.catalog import Files
from korvid.errors import SQLExecutionError

METRICS = ("euclidean", "cosine", "dot_product")
SMALLEST_TRAINING = 16
#: Inverted lists are probed until this share of the sampled rows' true neighbours is found; what searches reach is measured
#: by a query of its own, against 0.9.
AIMED_RECALL, PROBE_SAMPLE = 0.96, 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def similarity(column: Column, query, metric: str) -> Column:
    """Larger is nearer: euclidean distances become 1 / (1 + d)."""
    q = np.asarray(query, float)
    check_query(q, metric)
    if metric == "euclidean":
        return 1 / (1 + euclidean(column, literal(q)))
    if metric == "cosine":
        size = norm(column)
        return F.when(size > 0, dot(column, literal(q / np.linalg.norm(q))) / size)
    return dot(column, literal(q))


def check_query(q: np.ndarray, metric: str) -> None:
    if metric not in METRICS:
        raise SQLExecutionError(f"unknown metric {metric}")
    if q.ndim != 1 or not len(q) or not np.isfinite(q).all():
        raise SQLExecutionError("a query vector is one row of finite numbers")
    if metric == "cosine" and not np.any(q):
        raise SQLExecutionError("cosine is undefined for a zero vector")


def top_k(df: DataFrame, column: str, query, k: int, metric: str = "euclidean", tie: str = "id", name: str = "similarity") -> DataFrame:
    """The k nearest rows with their similarity, exact. Zero vectors never come back under cosine."""
    q = np.asarray(query, float)
    scored = df.where(F.col(column).isNotNull() & (F.size(column) == len(q))).withColumn(name, similarity(F.col(column), q, metric))
    return scored.where(F.col(name).isNotNull()).orderBy(F.desc(name), tie).limit(k)


def top_k_batch(df: DataFrame, column: str, queries: dict[int, list[float]], k: int, metric: str = "euclidean", tie: str = "id") -> DataFrame:
    """(query_id, id, similarity, rank) for a bounded set of queries: one pass with matrix products.

    Each Arrow batch gives k rows per query at most, so the shuffle is small.
    """
    names = list(queries)
    q = np.array([queries[n] for n in names], float)
    for row in q:
        check_query(row, metric)

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["v"].map(lambda v: v is not None and len(v) == q.shape[1])]
            if not len(pdf):
                continue
            ids, v = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(float)
            s = _scores(q, v, metric)
            for name, row in zip(names, s):
                ok = np.flatnonzero(~np.isnan(row))
                best = ok[np.lexsort((ids[ok], -row[ok]))[:k]]
                yield pd.DataFrame({"query_id": name, "id": ids[best], "similarity": row[best]})

    found = df.select(F.col(tie).cast("long").alias("id"), F.col(column).alias("v")).mapInPandas(run, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Most rows and queries that one task of a search by a table of queries holds.
CELL, QUERIES = 65536, 8192


def top_k_join(df: DataFrame, queries: DataFrame, column: str, k: int, metric: str = "euclidean", tie: str = "id") -> DataFrame:
    """(query_id, id, similarity, rank) for queries(query_id, q), a table of any size.

    A grid: rows in cells, queries in blocks, one task for each pair of them with matrix products;
    a task gives k rows per query at most. Queries without a direction have no cosine neighbours.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(tie).cast("long").alias("id"), F.col(column).alias("v"), F.size(column).alias("dim"))
    asked = queries.where(F.col("q").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "q", F.size("q").alias("dim"))
    n, m = rows.count(), asked.count()
    cells, blocks = max(1, math.ceil(n / CELL), min(32, math.ceil(n / 2048))), max(1, math.ceil(m / QUERIES))
    left = asked.select("dim", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    right = rows.select("dim", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell"))

    return nearest_in_groups(left, right, ["dim", "cell", "block"], k, metric)


def nearest_in_groups(left: DataFrame, right: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """(query_id, id, similarity, rank): left's queries(query_id, q) against right's rows(id, v) with the same keys, whole numbers.

    Matrix products choose the rows that may be among the k nearest; those are scored one by one, so that equal vectors
    tie and their ids decide.
    """
    # Both sides' keys must be of one type: an int and an equal long are dealt to different tasks.
    left, right = (side.withColumns({c: F.col(c).cast("long") for c in keys}) for side in (left, right))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})]
        if len(a) and len(b):
            ids, v = b["id"].to_numpy(), np.stack(b["v"].to_numpy()).astype(float)
            names, q = a["query_id"].to_numpy(), np.stack(a["q"].to_numpy()).astype(float)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                if metric == "cosine":
                    part = np.where(np.any(part, axis=1, keepdims=True), part, np.nan)
                for name, one, row, off in zip(names[at : at + 256], part, *_nearness(part, v, metric)):
                    ok = np.flatnonzero(~np.isnan(row))
                    if len(ok) > k:  # ties with the k-th stay until the ids decide
                        ok = ok[row[ok] >= np.partition(row[ok], len(ok) - k)[len(ok) - k] - 2 * off]
                    score = _one_by_one(one, v[ok], metric)
                    best = np.lexsort((ids[ok], -score))[:k]
                    out.append(pd.DataFrame({"query_id": name, "id": ids[ok[best]], "similarity": score[best]}))
        return pd.concat(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearness(q: np.ndarray, v: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(larger is nearer, by how much it may be off in each query's row) by matrix products."""
    rounding = 4 * (v.shape[1] + 4) * np.finfo(float).eps
    if metric == "cosine":
        return _scores(q, v, metric), np.full(len(q), rounding)
    if metric == "dot_product":
        return q @ v.T, rounding * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
    a, b = (q * q).sum(1), (v * v).sum(1)
    return 2 * q @ v.T - a[:, None] - b, rounding * (a + b.max())


def _one_by_one(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """The similarity of each row, by the same steps wherever it stands."""
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(((v - q) ** 2).sum(axis=1)))
    dots = (v * q).sum(axis=1)
    return dots if metric == "dot_product" else dots / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot_product":
        return q @ v.T
    if metric == "cosine":
        size = np.linalg.norm(v, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(size > 0, (q / np.linalg.norm(q, axis=1, keepdims=True)) @ v.T / size, np.nan)
    d = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)))
    return 1 / (1 + d)


# -- k-means and inverted lists -------------------------------------------------------------------


def kmeans(df: DataFrame, column: str, k: int, metric: str = "euclidean", seed: int = 42, iterations: int = 100) -> np.ndarray:
    """Centroids (k, dim) by Spark's parallel k-means; unit vectors and centroids under cosine."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = df.where(F.col(column).isNotNull())
    if metric == "cosine":
        features = features.where(norm(F.col(column)) > 0)
    features = features.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(features)
    centres = np.array([c for c in model.clusterCenters()])
    if metric == "cosine":
        size = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(size > 0, size, 1)
    return centres


def assign(df: DataFrame, column: str, centres: np.ndarray, metric: str = "euclidean", name: str = "list_id") -> DataFrame:
    """df with the nearest centroid's number; ties go to the smaller one."""
    rest = [c for c in df.columns if c != name]
    at = rest.index(column)

    def run(batches):
        for pdf in batches:
            v = np.stack(pdf.iloc[:, at].to_numpy()).astype(float) if len(pdf) else np.zeros((0, centres.shape[1]))
            pdf[name] = (np.nan_to_num(_scores(centres, v, metric), nan=-np.inf).argmax(axis=0) if len(pdf) else np.zeros(0)).astype("int32")
            yield pdf

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema), f"`{name}` int"])
    return df.where(F.col(column).isNotNull()).select(*rest).mapInPandas(run, schema)


def probe_order(query, centres: np.ndarray, metric: str, sizes: list[int], k: int, probes: int) -> list[int]:
    """The nearest lists, at least `probes`, and more of them until they hold k rows: known from their sizes, no row is read."""
    order = np.argsort(-_scores(np.asarray(query, float)[None], centres, metric)[0], kind="stable").tolist()
    n = min(len(order), probes)
    while n < len(order) and sum(sizes[i] for i in order[:n]) < k:
        n += 1
    return order[:n]


@dataclass
class IvfIndex:
    """Inverted lists: the rows with their list, sorted by it when written; the centroids and the lists' sizes.

    probes: how many lists a search looks into, chosen at the build for a recall of AIMED_RECALL.
    """

    rows: DataFrame
    column: str
    centres: np.ndarray
    metric: str
    sizes: list[int]
    probes: int
    tag: list[str] = field(default_factory=list)

    @property
    def lists(self) -> int:
        return len(self.centres)

    def probed(self, query, k: int, probes: int | None = None) -> list[int]:
        return probe_order(query, self.centres, self.metric, self.sizes, k, probes or self.probes)

    def search(self, query, k: int, probes: int | None = None, tie: str = "id") -> DataFrame:
        near = self.rows.where(F.col("list_id").isin(*self.probed(query, k, probes))).drop("list_id")
        return top_k(near, self.column, query, k, self.metric, tie)

    def search_all(self, queries: DataFrame, k: int, tie: str = "id") -> DataFrame:
        """(query_id, id, similarity, rank) for queries(query_id, q), a table of any size: each query meets the rows of
        its nearest lists, one task for each list and block of queries."""
        size = max(1, math.ceil(queries.count() / QUERIES))
        centres, metric, sizes, probes = self.centres, self.metric, self.sizes, self.probes

        def nearest(batches):
            for pdf in batches:
                pdf["list_id"] = [probe_order(q, centres, metric, sizes, k, probes) for q in pdf["q"]]
                yield pdf.explode("list_id").astype({"list_id": "int32"})

        left = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
        left = left.mapInPandas(nearest, "query_id long, q array<double>, list_id int").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(size)))
        right = self.rows.select("list_id", F.col(tie).cast("long").alias("id"), F.col(self.column).alias("v"))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
        return nearest_in_groups(left, right, ["list_id", "block"], k, metric)

    def append(self, more: DataFrame) -> "IvfIndex":
        """With further rows, put into the lists as they are."""
        fresh = assign(more, self.column, self.centres, self.metric)
        sizes = list(self.sizes)
        for r in fresh.groupBy("list_id").count().collect():
            sizes[r["list_id"]] += r["count"]
        return IvfIndex(self.rows.unionByName(fresh), self.column, self.centres, self.metric, sizes, self.probes, self.tag)

    def write(self, path: str) -> "IvfIndex":
        """Rows sorted by list, so that a search reads the row groups of its lists; gives the index as it is read back."""
        spark, name = self.rows.sparkSession, uuid.uuid4().hex
        dealt = self.rows.repartitionByRange("list_id").sortWithinPartitions("list_id")
        dealt.write.option("parquet.block.size", 1 << 22).parquet(f"{path}/{name}/rows")
        lists = [(i, c.tolist(), int(n)) for i, (c, n) in enumerate(zip(self.centres, self.sizes))]
        spark.createDataFrame(lists, "list_id int, centre array<double>, size long").write.parquet(f"{path}/{name}/lists")
        files = Files(spark, path)
        files.make()
        files.replace("index.json", json.dumps({"name": name, "column": self.column, "metric": self.metric, "probes": self.probes, "tag": self.tag}))
        return read_ivf(spark, path)


def read_ivf(spark, path: str) -> IvfIndex | None:
    """The index at the path; None if there is none."""
    text = Files(spark, path).read("index.json")
    if text is None:
        return None
    held = json.loads(text)
    lists = spark.read.parquet(f"{path}/{held['name']}/lists").orderBy("list_id").collect()
    rows = spark.read.parquet(f"{path}/{held['name']}/rows")
    return IvfIndex(rows, held["column"], np.array([r["centre"] for r in lists]), held["metric"], [r["size"] for r in lists], held["probes"], held["tag"])


def build_ivf(df: DataFrame, column: str, metric: str = "euclidean", lists: int | None = None) -> IvfIndex:
    """Below SMALLEST_TRAINING rows there is one list, searched exactly.

    The probes are measured: for PROBE_SAMPLE rows (by hash), in which lists their true neighbours lie.
    """
    usable = df.where(F.col(column).isNotNull())
    if metric == "cosine":
        usable = usable.where(norm(F.col(column)) > 0)
    n = usable.count()
    if n < SMALLEST_TRAINING:
        dim = next((len(r[0]) for r in usable.select(column).take(1)), 1)
        centres = np.ones((1, dim))
    else:
        centres = kmeans(usable, column, lists or max(1, round(math.sqrt(n))), metric)
    rows = assign(usable, column, centres, metric)
    sizes = [0] * len(centres)
    for r in rows.groupBy("list_id").count().collect():
        sizes[r["list_id"]] = r["count"]
    found = IvfIndex(rows, column, centres, metric, sizes, len(centres))
    if len(centres) > 1:
        found.probes = measured_probes(found)
    return found


def measured_probes(ivf: IvfIndex, k: int = 10) -> int:
    """The least number of lists that hold AIMED_RECALL of the sampled rows' k true neighbours."""
    asked = ivf.rows.select(F.col(ivf.column).alias("q")).orderBy(F.xxhash64("q")).limit(PROBE_SAMPLE).collect()
    queries = {i: r["q"] for i, r in enumerate(asked)}
    near = top_k_batch(ivf.rows, ivf.column, queries, k, ivf.metric, "list_id").select("query_id", "id").collect()
    place = {i: {x: nth for nth, x in enumerate(ivf.probed(q, k, ivf.lists))} for i, q in queries.items()}
    nth = sorted(place[r["query_id"]][r["id"]] for r in near)
    return 1 + nth[max(0, math.ceil(AIMED_RECALL * len(nth)) - 1)] if nth else ivf.lists


# -- Bags of visual words -------------------------------------------------------------------------


def train_codebook(descriptors: DataFrame, column: str, words: int, sample: int = 100_000, seed: int = 42) -> np.ndarray:
    """k-means centroids of about `sample` descriptors, spread over all documents."""
    n = descriptors.count()
    part = descriptors.sample(fraction=min(1.0, sample / max(1, n)), seed=seed) if n > sample else descriptors
    return kmeans(part, column, words, "euclidean", seed)


def visual_words(descriptors: DataFrame, column: str, codebook: np.ndarray) -> DataFrame:
    """(doc_id, word) of every descriptor."""
    return assign(descriptors, column, codebook, "euclidean", "word").select("doc_id", "word")


# -- Evaluation -----------------------------------------------------------------------------------


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): both have (query_id, id); the share of the true neighbours found."""
    hits = truth.join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def precision_at_k(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision): hits / k, also if fewer than k came back."""
    hits = found.where(F.col("rank") <= k).join(relevant.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    every = found.select("query_id").distinct()
    return every.join(counts, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("precision"))
