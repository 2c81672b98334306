"""Recommendations, the passage assistant and the shop's sources."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvid.apps import passages, recommend
from korvid.engine import Engine
from korvid.catalog import Index
from korvid.operators import spatial
from korvid.operators import text as text_ops
from korvid.sources import media, shop


def test_fusion_by_reciprocal_ranks(spark):
    table = lambda d: spark.createDataFrame(list(d.items()), "id long, value double")
    signals = {"a": table({1: 5.0, 2: 3.0, 3: 3.0, 9: 0.0}), "b": table({3: 0.9, 2: 0.1}), "category": table({2: 1.0, 7: 1.0})}
    got = [(r.id, round(r.score, 9)) for r in recommend.fuse(7, signals, {"a": 1, "b": 0.5, "category": 0.5}).collect()]
    share = lambda place: 61 / (61 + place)
    want = {1: 0.5 * share(0), 2: 0.5 * share(1) + 0.25 * share(1) + 0.25, 3: 0.5 * share(2) + 0.25 * share(0)}
    assert got == sorted(((i, round(x, 9)) for i, x in want.items()), key=lambda p: (-p[1], p[0]))
    best = recommend.fuse(7, {"a": signals["a"]}, {"a": 1}, "max").first()
    assert (best.id, best.score) == (1, 1.0)


def test_also_bought(spark):
    day = 86400
    rows = [("u", 1, 0), ("u", 2, 30 * day), ("u", 3, 31 * day), ("v", 1, 50), ("v", 2, 10), ("v", 2, 20), ("w", 2, 0)]
    df = spark.createDataFrame(rows, "user string, product long, ts long")
    assert {(r.id, r.value) for r in recommend.also_bought(df, 1).collect()} == {(2, 3)}


def test_duplicates_are_dropped(spark):
    origin = {"id": 0, "title": "Red Case for Switch, new"}
    titles = ["red case FOR switch new!", "Blue mouse", "blue mouse (2024)", "", "", "Blue: mouse"]
    ranked = [{"id": i + 1, "title": t} for i, t in enumerate(titles)]
    assert [r["id"] for r in recommend.without_duplicates(origin, ranked)] == [2, 3, 4, 5]
    df = spark.createDataFrame([(r["id"], r["title"], 10.0 - r["id"]) for r in ranked], "id long, title string, score double")
    assert [r.id for r in recommend.first_per_title(df, origin["title"]).collect()] == [2, 3, 4, 5]
    image = {0: np.array([1.0, 0]), 2: np.array([1.0, 0.01]), 3: np.array([0, 1.0])}
    # A row that its image rejects leaves its title to others.
    assert [r["id"] for r in recommend.without_duplicates(origin, ranked, image.get, 3)] == [3, 4, 5]


def test_platforms_and_types(spark):
    rows = [("Mario for Nintendo Switch", "Video Games"), ("Optical Switch Keyboard", "Video Games > PC"), ("PS4 / PS5 headset", ""), ("Game", "Video Games > Wii U > Games"), (None, None)]
    df = spark.createDataFrame(rows, "t string, c string").select(recommend.platforms(F.col("t"), F.col("c")).alias("p"), recommend.product_type(F.col("t"), F.coalesce("c", F.lit(""))).alias("k"))
    assert [(r.p, r.k) for r in df.collect()] == [(["switch"], None), (["pc"], "teclado"), (["ps5", "ps4"], "audífonos"), (["wii u"], "juego"), ([], None)]


def test_query_expansion(spark):
    assert recommend.expand_query("mandos inalámbricos xbox") == "mandos inalámbricos xbox controller gamepad wireless"
    assert recommend.expand_query("auriculares") == "auriculares headset headphones" and recommend.expand_query("zzz") == "zzz" and recommend.expand_query(None) == ""


def test_stores_with_stock(spark):
    stores = spark.createDataFrame([(i, (float(i), 0.0)) for i in range(1, 30)], "id long, place struct<lat: double, lon: double>")
    stock = spark.createDataFrame([(3, 1, 2), (20, 1, 1), (25, 1, 0), (4, 2, 9)], "store long, product long, units int")
    assert [r.id for r in recommend.nearest_stores(stores, 0, 0, stock, 1).collect()] == [3, 20]
    assert [r.id for r in recommend.nearest_stores(stores, 0, 0, limit=2).collect()] == [1, 2]
    assert [r.id for r in recommend.nearest_stores(stores, 0, 0, stock, 1, radius=500_000).collect()] == [3]


def test_catalogue_through_the_dialect(spark):
    rows = [(1, "Video Games > PS4", "wireless controller", 10.0), (2, "Video Games > PS4 > Games", "racing game", 30.0), (3, "Video Games > PS41", "wireless mouse", 20.0)]
    engine = Engine(spark)
    engine.register("products", spark.createDataFrame(rows, "id long, category string, description string, price double"), "id", [Index("i", "description", "SPIMI", {"language": "english"})])
    ids = lambda **k: [r.id for r in recommend.catalogue(engine, **k).collect()]
    assert ids(category="Video Games > PS4") == [1, 2] and ids(query="mando inalámbrico") == [1, 3]
    assert ids(low=15, high=25) == [3] and ids(limit=1, offset=1) == [2]


# -- passages --------------------------------------------------------------------------------


def test_chunk_sizes():
    rng = random.Random(1)
    for n in (0, 1, 199, 350, 499, 500, 501, 650, 699, 700, 1200, 3333):
        words = [f"w{i}" + ("." if rng.random() < 0.07 else "") for i in range(n)]
        found = passages.chunk([(1, " ".join(words[: n // 2])), (2, " ".join(words[n // 2 :]))])
        assert " ".join(c["text"] for c in found) == " ".join(words)
        assert all(c["words"] <= 500 for c in found) and [c["nth"] for c in found] == list(range(1, len(found) + 1))
        assert all(c["words"] >= 200 for c in found) or len(found) == 1
        assert all(c["page"] <= c["last_page"] for c in found)
    with pytest.raises(ValueError):
        passages.chunk([], 300, 350, 500)


def test_cleaning():
    assert passages.clean("ﬁne frag-\n  mentation\r\na\x00b") == "fine fragmentation\na b"
    pages = [(1, "intro\nReferences\nx"), (2, "body"), (3, "end\n 7. REFERENCES \n[1] x"), (4, "more")]
    assert passages.without_references(pages) == [(1, "intro\nReferences\nx"), (2, "body"), (3, "end")]


def test_chunks_of_documents(spark):
    pages = spark.createDataFrame([(1, 2, "b " * 300), (1, 1, "a " * 300), (2, 1, None)], "doc_id long, page int, text string")
    got = [(r.doc_id, r.nth, r.page, r.last_page, r.words) for r in passages.chunk_documents(pages).orderBy("doc_id", "nth").collect()]
    assert got == [(1, 1, 1, 1, 300), (1, 2, 2, 2, 300)]


def test_retrieval_equals_a_greedy_pass(spark):
    rng = random.Random(3)
    scored = [(i, round(rng.uniform(1, 10), 3)) for i in range(60)]
    where = {i: rng.randrange(6) for i, _ in scored}
    got = passages.retrieve(spark.createDataFrame(scored, "doc_id long, score double"), spark.createDataFrame(list(where.items()), "id long, document long"), 6)
    best, used, want = sorted(scored, key=lambda p: (-p[1], p[0]))[:30], {}, []
    for i, s in best:
        if s >= 0.7 * best[0][1] and used.get(where[i], 0) < 2 and len(want) < 6:
            used[where[i]] = used.get(where[i], 0) + 1
            want.append(i)
    assert [r.id for r in got.orderBy("n").collect()] == want


def test_assistant(spark):
    texts = ["an inverted index maps terms", "a graph of neighbors", "the index of a database"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, document long, text string")
    index = text_ops.build_index(docs, "id", "text", "english")
    out = passages.ask("¿Qué es un índice invertido?", index, docs, 2, lambda system, message: "It maps terms [1], see [7].")
    assert out["keywords"] == "index inverted" and out["passages"][0]["id"] == 0 and out["citations"] == [1]
    assert passages.ask("¿que es?", index, docs)["passages"] == []
    df = spark.createDataFrame([("x [2] y [1, 3][9][2] [a]",), (None,)], "t string")
    assert [r[0] for r in df.select(passages.citations(F.col("t"), F.lit(5))).collect()] == [[2, 1, 3], []]
    returned = spark.createDataFrame([(1, 1, "B-tree"), (1, 2, "none")], "question long, n int, text string")
    assert tuple(passages.source_precision(returned, {1: ["b-?tree"]}).first()) == (1, 0.5, 1)


# -- sources ---------------------------------------------------------------------------------


def test_products_are_cleaned(spark, tmp_path):
    base = {
        "title": "A <b>pad</b> &amp; more", "description": ["one two three four five six seven eight nine ten", ""], "features": ["eleven twelve thirteen fourteen fifteen"], "price": "$1,299.996", "average_rating": 4.5,
        "images": [{"variant": "PT01", "large": "http://b"}, {"variant": "MAIN", "large": None, "hi_res": "http://a", "thumb": None}], "main_category": "Video Games",
        "categories": ["Video Games", "PC", "Accessories"], "store": "S", "details": {"x": "y"},
    }
    change = [
        {}, {"price": "free"}, {"images": []}, {"main_category": "Books"}, {"details": {"Type of item": "DVD"}}, {"details": {"ISBN-13": "1"}}, {"title": "Film [DVD]"},
        {"description": ["short"], "features": []}, {"title": "Case for PS5 only", "rating_number": 9}, {"categories": ["Video Games", "Deals"], "title": "thing", "store": None},
    ]
    f = tmp_path / "p.jsonl"
    f.write_text("".join(json.dumps({"parent_asin": f"A{i}", "rating_number": 1, **base, **c}) + "\n" for i, c in enumerate(change)) + json.dumps({"parent_asin": "A0", "rating_number": 0, **base}) + "\n")
    got = {r.asin: r for r in shop.products(shop.read_products(spark, str(f)), excluded=["A7"]).collect()}
    assert set(got) == {"A0", "A8", "A9"} and [got[a].id for a in ("A8", "A0", "A9")] == [1, 2, 3]
    assert (got["A0"].title, got["A0"].price, got["A0"].image_url, got["A0"].category) == ("A pad & more", 1300.0, "http://a", "Video Games > PC > Accessories")
    assert got["A8"].category == "Video Games > PlayStation 5 > Accessories" and (got["A9"].category, got["A9"].brand) == ("Video Games", "Desconocida")


def test_categories_follow_titles(spark):
    legacy = ["Video Games", "Legacy Systems", "PlayStation Systems", "PlayStation 2", "Accessories"]
    rows = [(legacy, "Headset for PS5 and Xbox One"), (legacy, "PS2 cable"), (["Video Games", "Legacy Systems", "Sega Systems", "Genesis", "Cables"], "PS4 stand"), ([], "nothing"), (["Video Games", "PlayStation 4", "Games"], "A game")]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<string>, t string").select(shop.category(F.col("c"), F.col("t"))).collect()]
    assert got == [
        "Video Games > PlayStation 5 > Accessories", "Video Games > Legacy Systems > PlayStation Systems > PlayStation 2 > Accessories",
        "Video Games > PlayStation 4 > Cables", "Video Games", "Video Games > PlayStation 4 > Games",
    ]


def test_purchases_are_cleaned(spark):
    rows = [("a", 1, 5, 1.0, True), ("a", 1, 3, 2.0, True), ("a", 2, 9, 3.0, True), ("b", 1, 1, 1.0, True), ("c", 1, 2, 1.0, True), ("c", 2, 2, 1.0, False), (None, 1, 1, 1.0, True)]
    got = shop.clean_purchases(spark.createDataFrame(rows, "user string, product long, ts long, rating double, verified boolean"))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a", 1, 3, 2.0), (2, "a", 2, 9, 3.0)]


def test_stores_from_map_elements(spark, tmp_path):
    f = tmp_path / "s.json"
    elements = [
        {"type": "way", "id": 1, "center": {"lat": 1.0, "lon": 1.0}, "tags": {"name": " B  b ", "shop": "x" * 30}},
        {"type": "node", "id": 9, "lat": 2.0, "lon": 2.0, "tags": {"name": "C", "addr:suburb": "sub", "addr:street": "st", "addr:housenumber": "5"}},
        {"type": "node", "id": 10, "lat": 2.0, "lon": 2.0, "tags": {"name": " "}},
        {"type": "node", "id": 3, "lat": 99.0, "lon": 2.0, "tags": {"name": "far"}},
        {"type": "node", "id": 4, "tags": {"name": "nowhere"}},
    ]
    f.write_text(json.dumps({"elements": elements}))
    got = [(r.id, r.osm_id, r.name, len(r.kind), r.district, r.address) for r in shop.read_stores(spark, str(f), (0, 0, 10, 10)).collect()]
    assert got == [(1, "node/9", "C", 0, "sub", "st 5"), (2, "way/1", "B b", 20, "", "")]


def test_feeds():
    feed = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2101.00001v3</id><title>A
    title</title><published>2021-01-02T00:00:00Z</published><summary> s </summary><author><name>A B</name></author><author><name>C</name></author><arxiv:primary_category term="cs.DB"/></entry></feed>"""
    (row,) = shop.parse_feed(feed, "t")
    assert row == {"arxiv_id": "2101.00001", "title": "A title", "authors": "A B, C", "year": 2021, "abstract": "s", "category": "cs.DB", "topic": "t"}
    assert shop.parse_license("<r xmlns='x'><license> http://l </license></r>") == "http://l" and shop.parse_license("<r/>", "d") == "d"


def test_files_are_extracted_once(spark, tmp_path):
    for name, content in (("a", b"xx"), ("b", b"xx"), ("c", b"y")):
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    first = media.extract_files(files, lambda content: [len(content)])
    assert sorted(r.vector[0] for r in first.collect()) == [1.0, 2.0, 2.0]
    cached = media.extract_files(files, lambda content: [0.0], first.select("key", "vector").distinct())
    assert sorted(r.vector[0] for r in cached.collect()) == [1.0, 2.0, 2.0]


def test_bootstrap_and_viewport(spark):
    mean, low, high = recommend.bootstrap([0.0, 1.0] * 50)
    assert mean == 0.5 and 0.35 < low < 0.5 < high < 0.65
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -4.0)], "lat double, lon double")
    assert tuple(spatial.viewport(df, F.struct("lat", "lon")).first()) == (1.0, -4.0, 3.0, 2.0, 2)
