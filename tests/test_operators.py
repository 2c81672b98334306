"""Spatial, text and vector operators against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korvid.functions import analysis, stemming
from korvid.operators import graph, sketches, spatial, vectors
from korvid.operators import text as text_ops
from korvid.sources import geojson

# -- spatial ---------------------------------------------------------------------------------


def metres(a, b, metric):
    if metric == "EUCLIDEAN":
        return math.hypot(a[0] - b[0], a[1] - b[1]) * 6371008.8 * math.pi / 180
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(23)
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)]
    rows += [(400, 90.0, 0.0), (401, -90.0, 0.0), (402, 0.0, 180.0), (403, 0.0, -180.0), (404, 10.0, 10.0), (405, 10.0, 10.0)]
    return rows, spark.createDataFrame(rows, "id long, lat double, lon double").withColumn("p", F.struct("lat", "lon")).cache()


@pytest.mark.parametrize("metric", ["HAVERSINE", "EUCLIDEAN"])
@pytest.mark.parametrize("centre", [(10.0, 10.0), (89.0, 0.0), (0.0, 179.5), (-45.0, -100.0)])
def test_radius_and_nearest(points, metric, centre):
    rows, df = points
    want = {i: metres((a, o), centre, metric) for i, a, o in rows}
    for radius in (0.0, 5e5, 4e6, 2.5e7):
        got = {r.id: r.distance for r in spatial.radius_query(df, F.col("p"), *centre, radius, metric).collect()}
        assert set(got) == {i for i, d in want.items() if d <= radius}
        assert all(got[i] == pytest.approx(want[i], abs=1e-3) for i in got)
    near = [r.id for r in spatial.nearest(df, F.col("p"), *centre, 12, "id", metric).collect()]
    assert [round(want[i], 3) for i in near] == sorted(round(d, 3) for d in want.values())[:12]
    assert near.index(404) < near.index(405) if 404 in near else True


@settings(max_examples=200, deadline=None)
@given(st.floats(-90, 90), st.floats(-180, 180), st.floats(0, 2.1e7), st.floats(-90, 90), st.floats(-180, 180), st.sampled_from(["HAVERSINE", "EUCLIDEAN"]))
def test_boxes_are_never_too_small(lat, lon, radius, plat, plon, metric):
    lat0, lon0, lat1, lon1 = spatial.bounding_box(lat, lon, radius, metric)
    if metres((lat, lon), (plat, plon), metric) <= radius:
        assert lat0 <= plat <= lat1 and lon0 <= plon <= lon1


def test_polygons_with_borders_and_holes(spark):
    rings = (((0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)), ((4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)))
    want = {(5.0, 5.0): False, (4.0, 5.0): True, (4.0, 4.0): True, (0.0, 0.0): True, (0.0, 5.0): True, (10.0, 3.0): True, (10.1, 3.0): False, (2.0, 2.0): True, (-1.0, 5.0): False}
    df = spark.createDataFrame([(a, b) for a, b in want], "lat double, lon double")
    got = {(r.lat, r.lon): r.inside for r in df.withColumn("inside", spatial.within(F.struct("lat", "lon"), rings)).collect()}
    assert got == want == {p: spatial.ring_contains(*p, rings) for p in want}


def test_random_polygons(points):
    rows, df = points
    rng = random.Random(4)
    for _ in range(3):
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))
        ring = tuple((rng.uniform(20, 80) * math.sin(t), rng.uniform(40, 170) * math.cos(t)) for t in angles)
        got = {r.id for r in df.where(spatial.within(F.col("p"), (ring,))).collect()}
        assert got == {i for i, a, o in rows if spatial.ring_contains(a, o, (ring,))}


def test_geojson(tmp_path):
    import json

    square = lambda x: [[[x, 0], [x + 2, 0], [x + 2, 2], [x, 2], [x, 0]], [[x + 0.5, 0.5], [x + 1, 0.5], [x + 1, 1], [x + 0.5, 0.5]]]
    f = tmp_path / "d.geojson"
    feature = {"type": "Feature", "properties": {"name": "n"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(0), square(10)]}}
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {**feature, "geometry": {"type": "Polygon", "coordinates": square(5)}}]}))
    found = geojson.districts(str(f), "name")
    assert [len(p) for p in found["n"]] == [2, 2, 2] and found["n"][0][0][1] == (0.0, 2.0)
    assert len(geojson.polygons(feature)) == 2
    with pytest.raises(ValueError):
        geojson.polygons({"type": "Point", "coordinates": [0, 0]})


# -- text ------------------------------------------------------------------------------------


def test_tokens():
    assert analysis.tokenize("O.N.U. don’t 3,14 Ñandú cafe\u0301") == ["onu", "don't", "3.14", "ñandú", "café"]
    assert analysis.tokenize("La U.E. y 1.000,5") == ["la", "ue", "y", "1.000.5"]
    assert analysis.tokenize("l'eau a_b") == ["l'eau", "a", "b"] and analysis.tokenize("") == []


#: Words and stems as published with the algorithms.
STEMS = {
    "english": "consist consist,consisted consist,consisting consist,consistency consist,knackeries knackeri,relational relat,hopping hop,hoping hope,agreed agre,happy happi,skies sky,dying die,generously generous,sensational sensat,databases databas,flies fli,vileness vile,controlling control,probate probat,early earli",
    "spanish": "chicas chic,chicharrones chicharron,torear tor,toreros torer,tormenta torment,torneado torn,rápidamente rapid,cheques chequ,torrencial torrencial,bases bas,búsqueda busqued,índices indic,distribuyendo distribu,fragmentación fragment",
}


@pytest.mark.parametrize("language", STEMS)
def test_stems(language):
    for pair in STEMS[language].split(","):
        word, stem = pair.split()
        assert stemming.STEMMERS[language](word) == stem, word


TEXTS = ["the quick brown fox", "The fox. The FOX!", "", None, "lazy dogs sleep; quick dogs don't", "fox " * 30, "brown bears"]


def naive(query, ranking):
    docs = [Counter(analysis.tokenize(t or "")) for t in TEXTS]
    n, mean = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(t for d in docs for t in d)
    terms = analysis.tokenize(query)
    out = {}
    for i, d in enumerate(docs):
        if ranking == "BM25":
            hit = [t for t in set(terms) if t in d]
            if hit:
                out[i] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for t in hit)
        else:
            w = {t: (1 + math.log10(terms.count(t))) * math.log10(n / df[t]) for t in set(terms) if df[t]}
            w = {t: x for t, x in w.items() if x > 0}
            dot = sum(x * (1 + math.log10(d[t])) for t, x in w.items() if d[t])
            if dot:
                out[i] = dot / (math.sqrt(sum(x * x for x in w.values())) * math.sqrt(sum((1 + math.log10(c)) ** 2 for c in d.values())))
    return out


@pytest.mark.parametrize("ranking", ["BM25", "TF_IDF"])
@pytest.mark.parametrize("query", ["fox", "quick quick dogs", "nothing here", "don't", ""])
def test_rankings(spark, ranking, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    index = text_ops.build_index(docs, "id", "t")
    got = {r.doc_id: r.score for r in text_ops.RANKINGS[ranking](index, query).collect()}
    assert got == pytest.approx(naive(query, ranking))
    want = {i for i, t in enumerate(TEXTS) if query and set(analysis.tokenize(query)) <= set(analysis.tokenize(t or ""))}
    assert {r.doc_id for r in text_ops.boolean_and(index, query).collect()} == want


def test_index_changes_equal_a_rebuild(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    index = text_ops.append(text_ops.build_index(docs.where("id < 4"), "id", "t"), docs.where("id >= 4"), "id", "t")
    assert {tuple(r) for r in index.postings.collect()} == {tuple(r) for r in text_ops.build_index(docs, "id", "t").postings.collect()}
    less = text_ops.remove(index, spark.createDataFrame([(1,), (5,)], "doc_id long"))
    assert {r.doc_id for r in text_ops.bm25(less, "fox").collect()} == {0}


@pytest.mark.parametrize("ranking", ["BM25", "TF_IDF"])
@pytest.mark.parametrize("query", ["fox", "quick quick dogs", "nothing here", ""])
def test_stored_rankings(spark, tmp_path, ranking, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    made = lambda df: text_ops.build_index(df, "id", "t")
    text_ops.write_index(made(docs.where("id < 3")), str(tmp_path / "i"))
    text_ops.open_index(spark, str(tmp_path / "i")).add(made(docs.where("id >= 3"))).save()
    held = text_ops.open_index(spark, str(tmp_path / "i"))
    assert len(held.segments) == 2
    for index in (held, text_ops.open_index(spark, str(tmp_path / "i")).consolidate()):
        got = {r.doc_id: r.score for r in text_ops.RANKINGS[ranking](index, query).collect()}
        assert got == pytest.approx(naive(query, ranking))
        want = {i for i, t in enumerate(TEXTS) if query and set(analysis.tokenize(query)) <= set(analysis.tokenize(t or ""))}
        assert {r.doc_id for r in text_ops.boolean_and(index, query).collect()} == want
        assert {tuple(r) for r in index.dictionary().collect()} == {tuple(r) for r in made(docs).dictionary().collect()}


def test_stored_index_reads_its_terms_and_forgets_documents(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    held = text_ops.write_index(text_ops.build_index(docs, "id", "t"), str(tmp_path / "i"))
    plan = text_ops.bm25(held, "fox dogs")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [dogs,fox])" in plan and "Join" not in plan
    held.remove(spark.createDataFrame([(1,), (5,)], "doc_id long")).save()
    less = text_ops.build_index(docs.where("id NOT IN (1, 5)"), "id", "t")
    for index in (text_ops.open_index(spark, str(tmp_path / "i")), held.consolidate().save()):
        assert {r.doc_id: r.score for r in text_ops.bm25(index, "fox dogs").collect()} == pytest.approx({r.doc_id: r.score for r in text_ops.bm25(less, "fox dogs").collect()})
        assert {tuple(r) for r in index.dictionary().collect()} == {tuple(r) for r in less.dictionary().collect()}
    held.vacuum()
    assert {x.name for x in (tmp_path / "i").iterdir() if not x.name.startswith(".")} == {"index.json", held.segments[0]["name"]}
    assert {tuple(r) for r in text_ops.open_index(spark, str(tmp_path / "i")).postings.collect()} == {tuple(r) for r in less.postings.collect()}


def test_streamed_postings(spark, tmp_path):
    from korvid.streaming.postings import follow

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow(stream, "id", "t", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    held = text_ops.open_index(spark, str(tmp_path / "out"))
    assert len(held.segments) == len(list((tmp_path / "in").glob("*.parquet")))
    got = {tuple(r) for r in held.postings.collect()}
    assert got == {tuple(r) for r in text_ops.build_index(docs, "id", "t", simple=True).postings.collect()}


# -- vectors ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    v[7] = 0
    v[50:60] = v[3]
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").cache()


def scores(v, q, metric):
    v = v.astype(float)
    if metric == "euclidean":
        return 1 / (1 + np.linalg.norm(v - q, axis=1))
    if metric == "dot_product":
        return v @ q
    with np.errstate(invalid="ignore"):
        return v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_exact_neighbours(cloud, metric):
    v, df = cloud
    q = v[3].astype(float)
    s = scores(v, q, metric)
    want = sorted((-round(x, 9), i) for i, x in enumerate(s) if not np.isnan(x))[:15]
    got = vectors.top_k(df.withColumn("v", F.col("v")), "v", q.tolist(), 15, metric).collect()
    assert sorted((-round(r.similarity, 9), r.id) for r in got) == want
    batch = vectors.top_k_batch(df, "v", {1: q.tolist(), 2: v[9].tolist()}, 15, metric).where("query_id = 1").collect()
    assert {r.id for r in batch} == {i for _, i in want}


def test_lists_and_graphs_find_most_neighbours(cloud):
    v, df = cloud
    queries = {i: v[i].tolist() for i in range(20)}
    asked = df.where("id < 20").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    truth = vectors.top_k_batch(df, "v", queries, 5, "euclidean")
    joined = vectors.top_k_join(df, asked, "v", 5, "euclidean")
    assert {tuple(r) for r in joined.select("query_id", "id", "rank").collect()} == {tuple(r) for r in truth.select("query_id", "id", "rank").collect()}
    found = graph.approximate_top_k(df, "v", asked, 5, "euclidean")
    assert vectors.recall_at_k(found, truth).agg(F.avg("recall")).first()[0] > 0.8
    ivf = vectors.build_ivf(df, "v", "euclidean")
    assert ivf.lists == 17
    whole = [r.id for r in ivf.search(queries[11], 5, probes=ivf.lists).collect()]
    assert whole == [r.id for r in truth.where("query_id = 11").orderBy("rank").collect()]
    assert len(ivf.search(queries[11], 5).collect()) == 5
    tiny = vectors.build_ivf(df.limit(9), "v", "cosine")
    assert tiny.lists == 1


def test_ivf_persists(spark, cloud, tmp_path):
    _, df = cloud
    ivf = vectors.build_ivf(df, "v", "dot_product")
    ivf.write(str(tmp_path))
    again = vectors.read_ivf(spark, str(tmp_path))
    q = [1.0] * 12
    assert [r.id for r in again.search(q, 7, 17).collect()] == [r.id for r in ivf.search(q, 7, 17).collect()]


def test_bag_of_words_weights(spark):
    words = [(0, "a"), (0, "a"), (0, "b"), (1, "b"), (2, "b"), (2, "c")]
    histogram = text_ops.bow_histogram(spark.createDataFrame(words, "doc_id long, word string"))
    got = {(r.doc_id, r.word): r.weight for r in text_ops.bow_tf_idf(histogram).collect()}
    assert got == pytest.approx({(0, "a"): 1.0, (0, "b"): 0.0, (1, "b"): 0.0, (2, "b"): 0.0, (2, "c"): 1.0})


# -- sketches --------------------------------------------------------------------------------


def test_distinct_sketch(spark):
    df = spark.range(40_000).select((F.col("id") % 20_000).alias("v"))
    assert sketches.kmv_estimate(df, "v").first()[0] == pytest.approx(20_000, rel=0.1)
    assert sketches.kmv_estimate(df.where("v < 500"), "v").first()[0] == 500
    assert sketches.theta_estimate(df, "v").first()[0] == pytest.approx(20_000, rel=0.1)

