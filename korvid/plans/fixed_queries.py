"""Queries whose results are known beforehand: rules on small given inputs, and properties of whole tables.

Where SQL has no such operator, the oracle is the table of the expected rows, or says of every row of
a table that a property holds.
"""

from __future__ import annotations

import io
import json
import os
import tempfile
import threading
import time
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.apps import passages, recommend
from korvid.catalog import Files, Index
from korvid.engine import Engine
from korvid.errors import ConflictError, SQLError
from korvid.functions import analysis, audio, descriptors, images, stemming
from korvid.locks import LockTable
from korvid.operators import sketches, spatial, vectors
from korvid.plans.registry import place, place_sql, register, session
from korvid.plans.vector_queries import E, Q, QUERY, asked
from korvid.session import table
from korvid.sources import csv as csv_source
from korvid.sources import geojson, media, shop
from korvid.sql import explain


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}::BIGINT"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return "'" + str(value).replace("'", "''") + "'"


KINDS = {bool: "boolean", int: "long", float: "double", str: "string"}


def expect(name: str, columns: str, rows: list[tuple]):
    """Registers a function (spark, sf_dir) -> rows, with the rows that it must give as its oracle."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    kinds = [next(KINDS[type(r[i])] for r in rows if r[i] is not None) for i in range(len(names))]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))

    def add(found):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = found(spark, sf_dir)
            return out if isinstance(out, DataFrame) else spark.createDataFrame([tuple(r) for r in out], schema)

        run.__name__, run.__doc__ = name, found.__doc__
        register(name, f"SELECT * FROM (VALUES {values}) AS t({', '.join(chr(34) + n + chr(34) for n in names)})")(run)
        return found

    return add


def fresh(spark: SparkSession, locks: LockTable | None = None) -> Engine:
    """An engine whose tables go with the session."""
    engine = Engine(spark, locks=locks)
    Files(spark, engine.catalog.root).go_with_the_session()
    return engine


# -- storage, keys and transactions ------------------------------------------------------------------

PART = "CREATE TABLE goods (id INT PRIMARY KEY, name VARCHAR(60), size INT, price FLOAT)"


def goods(spark: SparkSession, sf_dir: str, organisation: str, loads: int = 4, index: str = "") -> Engine:
    engine = fresh(spark)
    engine.execute(f"{PART} USING {organisation}; {index}" if index else f"{PART} USING {organisation}")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    for k in range(loads):
        engine.load("goods", part.where(F.col("id") % loads == k))
    return engine


GOODS = "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part"


@register("storage_sequential", f"{GOODS} WHERE p_partkey BETWEEN 100 AND 900")
def storage_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted table loaded in four parts and compacted; a range of keys."""
    engine = goods(spark, sf_dir, "SEQUENTIAL")
    engine.catalog.compact("goods")
    return engine.sql("SELECT * FROM goods WHERE id BETWEEN 100 AND 900")


@register("storage_btree", f"{GOODS} WHERE p_partkey >= 50 AND p_partkey < 77")
def storage_btree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goods(spark, sf_dir, "BTREE").sql("SELECT * FROM goods WHERE id >= 50 AND id < 77")


@register("storage_hash_index", f"{GOODS} WHERE p_size = 7")
def storage_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on a column with a HASH index, whose bloom filters skip row groups."""
    return goods(spark, sf_dir, "HEAP", 2, "CREATE INDEX h ON goods (size) USING HASH").sql("SELECT * FROM goods WHERE size = 7")


@register("copy_csv", GOODS)
def copy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read by COPY."""
    engine = fresh(spark)
    path = f"{engine.catalog.root}/in.csv"
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", True).csv(path)
    engine.execute(f"{PART}; COPY goods FROM '{path}' WITH (FORMAT csv, HEADER true)")
    return engine.sql("SELECT * FROM goods")


@expect("csv_inference", "what text", [("create", 'CREATE TABLE "shops_2" ("id" INT PRIMARY KEY, "name" TEXT, "price" FLOAT, "photo" IMAGE)'), ("copy", "COPY \"shops_2\" FROM 'shops.csv' WITH (FORMAT csv, HEADER true, DELIMITER ';')")])
def csv_inference(spark: SparkSession, sf_dir: str):
    """Types, key, delimiter and header of a file that the driver reads."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "shops.csv")
        with open(path, "w") as f:
            f.write("Id;Name;Price;Photo\n" + "".join(f"{i};{'b' * (300 if i == 12_000 else 3)};{i}.5;x{i}.png\n" for i in range(12_500)))
        create, copy = csv_source.infer(path, {"shops"})
    return [("create", create), ("copy", copy.replace(path, "shops.csv"))]


@register("tables_reopen", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey <> 3")
def tables_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another session at the same folder finds tables, keys and rows."""
    engine = fresh(spark)
    engine.execute("CREATE TABLE lands (id INT PRIMARY KEY, name VARCHAR(30)) USING BTREE")
    engine.load("lands", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    engine.execute("DELETE FROM lands WHERE id = 3")
    return Engine(spark, engine.catalog.root).sql("SELECT id, name FROM lands")


@register("result_json_lines", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""")
def result_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "region").execute("SELECT r_regionkey, r_name FROM region").json_lines().select(F.col("value").alias("line"))


SCHOOL = (
    "CREATE TABLE courses (cid INT PRIMARY KEY, name VARCHAR(10)); CREATE TABLE pupils (id INT PRIMARY KEY, course INT REFERENCES courses ON DELETE CASCADE);"
    "CREATE TABLE grants (pupil INT REFERENCES pupils ON DELETE RESTRICT, amount FLOAT); INSERT INTO courses VALUES (1, 'maths'), (2, 'music');"
    "INSERT INTO pupils VALUES (10, 1), (11, 1), (12, 2); INSERT INTO grants VALUES (12, 1.5)"
)


def outcome(run) -> str:
    try:
        run()
    except (SQLError, ConflictError) as e:
        return type(e).__name__
    return "done"


@expect("transaction_outcomes", "nth step result pupils", [
    (1, "own insert is seen", "done", 4), (2, "rollback", "done", 3), (3, "commit after another session's", "ConflictError", 4),
    (4, "rollback of it", "done", 3), (5, "repeated key", "SQLIntegrityError", 3), (6, "no parent", "SQLIntegrityError", 3),
    (7, "restricted delete", "SQLIntegrityError", 3), (8, "cascade", "done", 1), (9, "commit without begin", "SQLExecutionError", 1),
])
def transaction_outcomes(spark: SparkSession, sf_dir: str):
    """BEGIN, COMMIT and ROLLBACK, a conflict between two sessions, keys and cascades."""
    engine, nth, out = fresh(spark), 0, []
    engine.execute(SCHOOL)
    other = Engine(spark, engine.catalog.root)
    steps = (
        ("own insert is seen", lambda: engine.execute("BEGIN; INSERT INTO pupils VALUES (13, 2)")),
        ("rollback", lambda: engine.execute("ROLLBACK")),
        ("commit after another session's", lambda: (engine.execute("BEGIN; INSERT INTO pupils VALUES (14, 2)"), other.execute("INSERT INTO courses VALUES (5, 'dance')"), engine.execute("COMMIT"))),
        ("rollback of it", lambda: engine.execute("ROLLBACK")),
        ("repeated key", lambda: engine.execute("INSERT INTO pupils VALUES (10, 1)")),
        ("no parent", lambda: engine.execute("INSERT INTO pupils VALUES (20, 9)")),
        ("restricted delete", lambda: engine.execute("DELETE FROM courses WHERE cid = 2")),
        ("cascade", lambda: (engine.catalog._load(), engine.execute("DELETE FROM courses WHERE cid = 1"))),
        ("commit without begin", lambda: engine.execute("COMMIT")),
    )
    for name, run in steps:
        nth += 1
        result = outcome(run)
        out.append((nth, name, result, engine.execute("SELECT COUNT(*) AS n FROM pupils").rows()[0][0]))
    return out


@expect("lock_outcomes", "nth step result", [
    (1, "two sessions change two tables", "done"), (2, "read of a changed table", "LockTimeoutError"),
    (3, "child of a changed table", "LockTimeoutError"), (4, "read after the commit", "done"), (5, "definition beside a reader", "LockTimeoutError"),
    (6, "two readers", "done"), (7, "both readers want to change", "DeadlockError"), (8, "the other goes on", "done"),
])
def lock_outcomes(spark: SparkSession, sf_dir: str):
    """Sessions that share a lock table: shared and exclusive locks to a transaction's end, a time limit, a circle."""
    locks = LockTable(timeout=0.2)
    one = fresh(spark, locks)
    one.execute(SCHOOL)
    two, waits = Engine(spark, one.catalog.root, locks), Engine(spark, one.catalog.root, locks)

    later = threading.Thread(target=lambda: one.execute("INSERT INTO courses VALUES (9, 'art'); COMMIT"))

    def circle():
        locks.timeout = 120
        later.start()
        while later.is_alive() and not locks.waiting():
            time.sleep(0.01)
        two.execute("INSERT INTO courses VALUES (8, 'sport')")

    def goes_on():
        later.join()
        if [r[0] for r in two.execute("SELECT cid FROM courses WHERE cid > 7").rows()] != [9]:
            raise SQLError("the waiting session's row isn't there")

    steps = (
        ("two sessions change two tables", lambda: (one.execute("BEGIN; INSERT INTO courses VALUES (3, 'art')"), two.execute("DELETE FROM grants"))),
        ("read of a changed table", lambda: waits.execute("SELECT cid FROM courses")),
        ("child of a changed table", lambda: waits.execute("INSERT INTO pupils VALUES (30, 3)")),
        ("read after the commit", lambda: (one.execute("COMMIT"), waits.execute("INSERT INTO pupils VALUES (30, 3)"))),
        ("definition beside a reader", lambda: (one.execute("BEGIN; SELECT cid FROM courses"), two.execute("CREATE TABLE t (id INT)"))),
        ("two readers", lambda: two.execute("BEGIN; SELECT cid FROM courses")),
        ("both readers want to change", circle),
        ("the other goes on", goes_on),
    )
    return [(n, name, outcome(run)) for n, (name, run) in enumerate(steps, 1)]


WRONG = {
    "SELECT x FROM courses": "SQLSemanticError",
    "SELECT cid FROM nowhere": "SQLSemanticError",
    "SELECT cid, name FROM courses GROUP BY cid": "SQLSemanticError",
    "SELECT cid, COUNT(*) FROM courses": "SQLSemanticError",
    "SELECT cid FROM courses WHERE COUNT(*) > 1": "SQLSemanticError",
    "SELECT DISTINCT name FROM courses ORDER BY cid": "SQLSemanticError",
    "SELECT cid FROM courses WHERE MATCH(name, 'a') USING BM25": "SQLSemanticError",
    "SELECT id FROM notes WHERE MATCH(body, 'a') USING BM25 OR id = 1": "SQLSemanticError",
    "SELECT id FROM notes WHERE NOT MATCH(body, 'a') USING BM25": "SQLSemanticError",
    "SELECT id FROM notes WHERE MATCH(body, 'a') USING BM25 AND MATCH(body, 'b') USING BM25": "SQLSemanticError",
    "SELECT n.id FROM notes n JOIN courses c ON n.id = c.cid WHERE MATCH(n.body, 'a') USING BM25": "SQLSemanticError",
    "SELECT cid FROM courses WHERE": "SQLParseError",
    "SELEC cid FROM courses": "SQLParseError",
}


@expect("statement_errors", "statement error", list(WRONG.items()))
def statement_errors(spark: SparkSession, sf_dir: str):
    """What the parser and the binder refuse, before any row is read."""
    engine = fresh(spark)
    engine.execute("CREATE TABLE courses (cid INT PRIMARY KEY, name VARCHAR(10)); CREATE TABLE notes (id INT PRIMARY KEY, body TEXT); CREATE INDEX i ON notes (body) USING SPIMI")
    return [(sql, outcome(lambda s=sql: engine.execute(s))) for sql in WRONG]


@expect("index_follows_changes", "nth ids", [(1, "1,2"), (2, "1,2,4"), (3, "1,4"), (4, "1,4"), (5, "4")])
def index_follows_changes(spark: SparkSession, sf_dir: str):
    """A text index after inserts, a delete, a rolled-back insert, and in another session."""
    engine, out = fresh(spark), []
    ids = lambda e: ",".join(str(r[0]) for r in e.execute("SELECT id FROM d WHERE MATCH(t, 'indice') USING BM25 ORDER BY id").rows())
    engine.execute("CREATE TABLE d (id INT PRIMARY KEY, t TEXT); CREATE INDEX i ON d (t) USING SPIMI WITH (LANGUAGE = 'spanish')")
    engine.execute("INSERT INTO d VALUES (1, 'los índices invertidos'), (2, 'un índice'), (3, 'nada')")
    out.append((1, ids(engine)))
    engine.execute("INSERT INTO d VALUES (4, 'índice índice')")
    out.append((2, ids(engine)))
    engine.execute("DELETE FROM d WHERE id = 2")
    out.append((3, ids(engine)))
    engine.execute("BEGIN; INSERT INTO d VALUES (5, 'índices')")
    ids(engine)
    engine.execute("ROLLBACK")
    out.append((4, ids(engine)))
    other = Engine(spark, engine.catalog.root)
    other.execute("DELETE FROM d WHERE id = 1")
    out.append((5, ids(other)))
    return out


@expect("explain_plan", "nth depth label details", [
    (1, 0, "Limit", "Rows: 5"), (2, 1, "Sort", "Sort Key: sum(lineitem.l_quantity) DESC"), (3, 2, "Filter", "Filter: (count(*) > 10)"), (4, 3, "HashAggregate", "Group Key: lineitem.l_returnflag"),
    (5, 4, "Filter", "Filter: (lineitem.l_discount BETWEEN 0.05 AND 0.07)"), (6, 5, "Seq Scan on lineitem", ""),
])
def explain_plan(spark: SparkSession, sf_dir: str):
    """The logical steps of the flagship query."""
    from korvid.plans.registry import FLAGSHIP
    from korvid.sql.parser import parse_script

    engine = session(spark, sf_dir, "lineitem")
    found = explain.nodes(engine.lowering.select(parse_script(FLAGSHIP)[0]))
    return [(i, n["depth"], n["label"], "|".join(f"{k}: {v}" for k, v in n["details"].items())) for i, n in enumerate(found, 1)]


@expect("explain_text", "part shown", [(p, True) for p in ("cost=", "rows=", "actual", "Planning Time", "Execution Time", "Seq Scan on lineitem", "Physical Plan:", "PushedFilters", "output rows")])
def explain_text(spark: SparkSession, sf_dir: str):
    """EXPLAIN ANALYZE as text, and Spark's counters of the executed query."""
    from korvid.plans.registry import FLAGSHIP

    engine = session(spark, sf_dir, "lineitem")
    text = "\n".join(engine.execute(f"EXPLAIN ANALYZE {FLAGSHIP}").plan)
    df = engine.sql(FLAGSHIP)
    n = len(df.collect())
    parts = ("cost=", "rows=", "actual", "Planning Time", "Execution Time", "Seq Scan on lineitem", "Physical Plan:", "PushedFilters")
    return [*((p, p in text) for p in parts), ("output rows", explain.profile(df).get("numOutputRows", 0) >= n > 0)]


@register("pk_duplicates", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that the session's key check would refuse if all line items came into a table keyed by their order."""
    engine = fresh(spark)
    engine.execute("CREATE TABLE items (l_orderkey INT PRIMARY KEY, l_linenumber INT)")
    return engine.repeated_keys("items", table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


def shop_tables(spark: SparkSession, sf_dir: str) -> Engine:
    engine = fresh(spark)
    engine.execute(
        "CREATE TABLE customers (id INT PRIMARY KEY, nation INT, balance FLOAT);"
        "CREATE TABLE orders (id INT PRIMARY KEY, customer INT REFERENCES customers ON DELETE CASCADE);"
        "CREATE TABLE items (ord INT REFERENCES orders ON DELETE CASCADE, line INT)"
    )
    engine.load("customers", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    return engine


@register("fk_violations", "SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that the session's key check would miss if all orders came in, once some customers are deleted."""
    engine = shop_tables(spark, sf_dir)
    engine.execute("DELETE FROM customers WHERE balance < 0")
    return engine.missing_parents("orders", "customer", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")))


@register(
    "delete_cascade_plan",
    """SELECT 'customers' AS "table", count(*) AS n FROM customer WHERE c_nationkey = 3
    UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3
    UNION ALL SELECT 'items', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3""",
)
def delete_cascade_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each whole table the session's cascade takes."""
    engine = shop_tables(spark, sf_dir)
    engine.load("orders", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_semi")
    engine.load("items", items.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line")))
    found = engine.doomed_by("DELETE FROM customers WHERE nation = 3")
    return spark.createDataFrame([(name, rids.count()) for name, rids in found.items()], "`table` string, n long")


@register("kmv_distinct", "SELECT count(DISTINCT l_orderkey) AS n, true AS near FROM lineitem")
def kmv_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's estimate is within 15 % of the true number (about five standard errors)."""
    items = table(spark, sf_dir, "lineitem")
    estimate = sketches.kmv_estimate(items, "l_orderkey").first()["estimate"]
    return items.agg(F.count_distinct("l_orderkey").alias("n")).select("n", (F.abs(F.lit(estimate) / F.col("n") - 1) < 0.15).alias("near"))


# -- space -------------------------------------------------------------------------------------------

BOX = "lat BETWEEN -33.333 AND 21.777 AND lon BETWEEN -71.111 AND 12.345"


@register("geojson_within", f"SELECT c_custkey FROM (SELECT c_custkey, {place_sql('c_custkey')} FROM customer) WHERE {BOX}")
def geojson_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside a polygon that a GeoJSON collection gives."""
    ring = [[-71.111, -33.333], [12.345, -33.333], [12.345, 21.777], [-71.111, 21.777], [-71.111, -33.333]]
    shapes = geojson.polygons({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}}]})
    return table(spark, sf_dir, "customer").where(spatial.within_any(place("c_custkey"), shapes)).select("c_custkey")


@register("geo_window", f"SELECT c_custkey FROM (SELECT c_custkey, {place_sql('c_custkey')} FROM customer) WHERE {BOX}")
def geo_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(spatial.in_box(place("c_custkey"), (-33.333, -71.111, 21.777, 12.345))).select("c_custkey")


@register("geo_cells", f"SELECT CAST(floor((lat + 90) / 5.0) * 73 + floor((lon + 180) / 5.0) AS BIGINT) AS cell, count(*) AS n FROM (SELECT {place_sql('c_custkey')} FROM customer) GROUP BY 1")
def geo_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(spatial.cell(place("c_custkey"), 5.0).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@register("geo_circle_box", "SELECT c_custkey, true AS inside FROM customer")
def geo_circle_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No point within 2500 km of a place lies outside the circle's bounding box, which is what prunes."""
    p = place("c_custkey")
    near = spatial.distance(p, spatial.point(F.lit(40.0), F.lit(-3.0))) <= 2_500_000
    return table(spark, sf_dir, "customer").select("c_custkey", (~near | spatial.in_box(p, spatial.bounding_box(40.0, -3.0, 2_500_000))).alias("inside"))


# -- text --------------------------------------------------------------------------------------------

TOKENS = {
    "The U.S.A. paid 1,234.5 for 3.14!": "the usa paid 1.234.5 for 3.14",
    "don't O’Neill's co-op e.g. x": "don't o'neill's co op eg x",
    "¿Qué es un ÍNDICE?": "qué es un índice",
    "": "",
}


@expect("text_token_rules", "text tokens", list(TOKENS.items()))
def text_token_rules(spark: SparkSession, sf_dir: str):
    return [(t, " ".join(analysis.tokenize(t))) for t in TOKENS]


ENGLISH = dict(zip("running nations caresses ponies relational happily skies dying news generously hopping".split(), "run nation caress poni relat happili sky die news generous hop".split()))
SPANISH = dict(zip("canciones rápidamente gatos comiendo índices invertidos hablaban".split(), "cancion rapid gat com indic invert habl".split()))


@expect("text_stems", "language word stem", [*(("english", w, s) for w, s in ENGLISH.items()), *(("spanish", w, s) for w, s in SPANISH.items())])
def text_stems(spark: SparkSession, sf_dir: str):
    return [(language, w, analysis.plain(stemming.STEMMERS[language](w))) for language, words in (("english", ENGLISH), ("spanish", SPANISH)) for w in words]


ANALYSED = {("english", "The running of the ponies isn't news to me"): "run poni news", ("spanish", "Los índices invertidos y las canciones"): "indic invert cancion", ("english", "the of and"): ""}


@expect("text_analysis", "language text terms", [(*k, v) for k, v in ANALYSED.items()])
def text_analysis(spark: SparkSession, sf_dir: str):
    """Tokens without stop words, stemmed and without accents, as the index column gives them."""
    out = []
    for language in ("english", "spanish"):
        df = spark.createDataFrame([(t,) for own, t in ANALYSED if own == language], "text string")
        out += [(language, r["text"], " ".join(r["terms"])) for r in df.select("text", analysis.analysed(F.col("text"), language, spark).alias("terms")).collect()]
    return out


@register(
    "text_match_stemmed",
    r"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'),
    lambda w: w IN ('ere', 'ering', 'ére', 'ered', 'eres', 'eringly', 'éré', 'eredly'))) > 0""",
)
def text_match_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATCH with English stems finds the documents with any form of the word (the forms that the tables have)."""
    engine = session(spark, sf_dir)
    engine.register("documents", table(spark, sf_dir, "documents"), "doc_id", [Index("d", "text", "SPIMI", {"language": "english"})])
    return engine.sql("SELECT doc_id FROM documents WHERE MATCH(text, 'eringly') USING TF_IDF")


EXPANDED = {"mandos inalámbricos xbox": "mandos inalámbricos xbox controller gamepad wireless", "auriculares": "auriculares headset headphones", "mando control": "mando control controller gamepad", "zzz": "zzz", "": ""}


@expect("query_expansion", "query expanded", list(EXPANDED.items()))
def query_expansion(spark: SparkSession, sf_dir: str):
    return spark.createDataFrame([(q,) for q in EXPANDED], "query string").select("query", recommend.expanded(F.col("query")).alias("expanded"))


QUESTIONS = {
    "¿Qué es un índice invertido?": ("index inverted", "invertido"),
    "¿Cómo funciona un árbol B+ en bases de datos?": ("b-tree database", ""),
    "explica la cuantizacion de grafos": ("quantization graph", ""),
    "optimizador vectorial distribuido": ("optimizer vector distribuido", "optimizador vectorial"),
    "¿que es?": ("", ""),
}


@expect("question_keywords", "question keywords cognates", [(q, *found) for q, found in QUESTIONS.items()])
def question_keywords(spark: SparkSession, sf_dir: str):
    """Keywords of a question, and its words that begin like one of them, cut to five letters."""
    out = spark.createDataFrame([(q,) for q in QUESTIONS], "question string").withColumn("keywords", passages.keywords_of(F.col("question")))
    english = F.split("keywords", " ")
    return out.select("question", "keywords", F.array_join(passages.cognates_of(F.col("question"), english), " ").alias("cognates"))


@register("chunk_documents", r"SELECT doc_id, true AS numbered, true AS sized, true AS whole FROM documents WHERE regexp_matches(text, '\S')")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks: numbered from 1, of 200 to 500 words (but a document's only one), and together its words."""
    docs = table(spark, sf_dir, "documents")
    chunks = passages.chunk_texts(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "words", "text"))).alias("c"))

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(lambda t: " ".join(passages.clean(t).split()))

    n = F.size("c")
    sized = F.forall("c", lambda x: (x["words"] <= 500) & ((x["words"] >= 200) | (n == 1)) & (x["words"] == F.size(F.split(x["text"], " "))))
    found = chunks.join(docs.select("doc_id", cleaned("text").alias("all")), "doc_id")
    numbers = F.transform("c", lambda x: x["nth"]) == F.sequence(F.lit(1), n)
    return found.select("doc_id", numbers.alias("numbered"), sized.alias("sized"), (F.array_join(F.transform("c", lambda x: x["text"]), " ") == F.col("all")).alias("whole"))


# -- vectors and media -------------------------------------------------------------------------------


@register("vec_metric_choice", f"SELECT vec_id, round(1 / (1 + list_distance({E}, {Q})), 9) AS s FROM embeddings ORDER BY list_distance({E}, {Q}), vec_id LIMIT 12")
def vec_metric_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes on a column: the metric says which one is meant."""
    media.register_extractor("IMAGE", media.vectors_file)
    engine = session(spark, sf_dir)
    own = [Index("c", "embedding", "HNSW", {"metric": "cosine"}), Index("e", "embedding", "HNSW", {"metric": "euclidean"})]
    engine.register("embeddings", table(spark, sf_dir, "embeddings"), "vec_id", own)
    found = engine.sql(f"SELECT vec_id, SIMILARITY_SCORE() AS s FROM embeddings WHERE SIMILAR_TO(embedding, '{json.dumps(QUERY)}', k=12) USING HNSW WITH METRIC = euclidean")
    return found.withColumn("s", F.round("s", 9))


def _shares(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether the mean recall over all queries is 0.9 at least."""
    return vectors.recall_at_k(found, truth).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


ENOUGH = "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0"


@register("vec_ivf", ENOUGH)
def vec_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the stored inverted lists with the probes that the build chose, against exact search."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/korvid-lists-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    Files(spark, path).go_with_the_session()
    ivf = vectors.build_ivf(df, "embedding", "cosine").write(path)
    return _shares(ivf.search_all(asked(df), 10, "vec_id"), vectors.top_k_join(df, asked(df), "embedding", 10, "cosine", "vec_id"))


@register("vec_graph_recall", ENOUGH)
def vec_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the kept layered graphs against exact search."""
    from korvid.operators import graph

    df = table(spark, sf_dir, "embeddings")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/korvid-graphs-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    Files(spark, path).go_with_the_session()
    graph.build_graphs(df, "embedding", "euclidean", "vec_id").write.mode("overwrite").parquet(path)
    found = graph.search_graphs(spark.read.parquet(path), asked(df), 10)
    return _shares(found, vectors.top_k_join(df, asked(df), "embedding", 10, "euclidean", "vec_id"))


@register("vec_ivf_append", f"SELECT vec_id FROM embeddings ORDER BY list_distance({E}, {Q}), vec_id LIMIT 10")
def vec_ivf_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists made from half of the rows take the other half; all of them probed."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ivf = vectors.build_ivf(df.where("vec_id % 2 = 0"), "embedding", "euclidean", 8).append(df.where("vec_id % 2 <> 0"))
    return ivf.search(QUERY, 10, probes=8, tie="vec_id").select("vec_id")


@register("bow_codebook", "SELECT CAST(label AS BIGINT) AS doc_id, count(*) AS n, true AS known FROM embeddings GROUP BY 1")
def bow_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook over descriptors: each document's histogram counts all of its descriptors, in words of the codebook."""
    df = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), "embedding")
    words = vectors.visual_words(df, "embedding", vectors.train_codebook(df, "embedding", 16)).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    return words.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.every(F.col("word").between(0, 15)).alias("known"))


@expect("media_files_once", "path length calls", [("a", 2.0, 2), ("b", 2.0, 2), ("c", 1.0, 2)])
def media_files_once(spark: SparkSession, sf_dir: str):
    """Files of equal bytes are extracted once, those that a cache knows not at all."""
    files = spark.createDataFrame([("a", b"xx"), ("b", b"xx"), ("c", b"y")], "path string, content binary")
    first = media.extract_files(files, lambda content: [len(content)])
    cache = first.select("key", "vector").distinct()
    again = media.extract_files(files, lambda content: [0.0], cache)
    calls = cache.count()
    return again.select("path", F.col("vector")[0].cast("double").alias("length"), F.lit(calls).cast("long").alias("calls"))


@expect("audio_features", "hz frames width finite", [(440, 22, 13, True), (4000, 22, 13, True)])
def audio_features(spark: SparkSession, sf_dir: str):
    """Half a second of a tone: a frame for each 512 samples of 22,050 a second, 13 coefficients each."""
    out = []
    for hz in (440, 4000):
        content = io.BytesIO()
        with wave.open(content, "wb") as f:
            f.setnchannels(1), f.setsampwidth(2), f.setframerate(44_100)
            f.writeframes((np.sin(2 * np.pi * hz * np.arange(22_050) / 44_100) * 20_000).astype("<i2").tobytes())
        found = audio.mfcc(content.getvalue())
        out.append((hz, found.shape[0], found.shape[1], bool(np.isfinite(found).all())))
    return out


@expect("image_pixels", "row column red green blue", [(y, x, 3 * y + x, 3 * y + x, 3 * y + x) for y in range(2) for x in range(3)])
def image_pixels(spark: SparkSession, sf_dir: str):
    picture = images.read_pnm(b"P5\n3 2\n255\n" + bytes(range(6)))
    return [(y, x, *map(int, picture[y, x])) for y in range(2) for x in range(3)]


@expect("image_descriptors", "doc_id corners unit turned", [(0, True, True, True), (1, True, True, True), (2, True, True, True)])
def image_descriptors(spark: SparkSession, sf_dir: str):
    """Local descriptors of pictures: many, of length 1, and mostly those of the picture turned by a right angle."""
    rng, pictures = np.random.default_rng(5), {}
    for i in range(3):
        picture = rng.normal(120, 12, (96, 96))
        for x, y, w, h, g in rng.integers([0, 0, 8, 8, -80], [88, 88, 40, 40, 80], (30, 5)):
            picture[y : y + h, x : x + w] += g
        pictures[i] = np.clip(picture, 0, 255).astype(np.uint8)
    files = [(i + 10 * k, bytearray(b"P5\n96 96\n255\n" + np.rot90(p, k).tobytes())) for i, p in pictures.items() for k in range(2)]
    found: dict[int, list] = {}
    for r in descriptors.descriptors_of(spark.createDataFrame(files, "doc_id long, content binary")).collect():
        found.setdefault(r["doc_id"], []).append(r["descriptor"])
    own = {i: np.array(v) for i, v in found.items()}
    near = lambda a, b: float((np.sqrt(np.maximum(0, 2 - 2 * a @ b.T)).min(axis=1) < 0.35).mean())
    return [(i, len(own[i]) > 10, bool(np.allclose(np.linalg.norm(own[i], axis=1), 1, atol=1e-4)), near(own[i], own[10 + i]) > 0.4) for i in pictures]


@register("signal_by_image", f"SELECT vec_id AS id, round(list_cosine_similarity({E}, {Q}), 9) AS value FROM embeddings ORDER BY list_cosine_similarity({E}, {Q}) DESC, vec_id LIMIT 102")
def signal_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommend.by_image(table(spark, sf_dir, "embeddings"), "embedding", QUERY, tie="vec_id")
    return found.select("id", F.round("value", 9).alias("value"))


# -- shop and assistant ------------------------------------------------------------------------------

TITLES = [
    ("Mario for Nintendo Switch", "Video Games", "switch", None), ("Optical Switch Keyboard", "Video Games > PC", "pc", "teclado"), ("PS4 / PS5 headset", "", "ps5,ps4", "audífonos"),
    ("Game", "Video Games > Wii U > Games", "wii u", "juego"), ("Carrying case", "", "", "estuche"), ("Xbox One charger cable", "", "xbox one", "cargador o cable"),
]


@expect("title_rules", "title category platforms type", TITLES)
def title_rules(spark: SparkSession, sf_dir: str):
    """Platforms and product types that titles and categories name."""
    rows = spark.createDataFrame([t[:2] for t in TITLES], "title string, category string")
    return rows.select("title", "category", F.array_join(recommend.platforms(F.col("title"), F.col("category")), ",").alias("platforms"), recommend.product_type(F.col("title"), F.col("category")).alias("type"))


@expect("signal_bonus_platform", "origin id value", [("switch", 1, 1.0), ("switch", 4, 1.0)])
def signal_bonus_platform(spark: SparkSession, sf_dir: str):
    """A bonus for the origin's platform if it has exactly one."""
    rows = spark.createDataFrame([(1, "Zelda Nintendo Switch", ""), (2, "PS5 pad", ""), (3, "thing", None), (4, "Case for Nintendo Switch and PS4", "")], "id long, title string, category string")
    found = [(name, recommend.same_platform(rows, own)) for name, own in (("switch", ["switch"]), ("two", ["switch", "ps4"]), ("none", []))]
    return [(name, r["id"], r["value"]) for name, df in found for r in df.collect()]


@expect("doubles_dropped", "rule ids", [("titles", "2,3,4,5"), ("images", "3,4,5")])
def doubles_dropped(spark: SparkSession, sf_dir: str):
    """Rows of an origin's or a kept row's title or image; a row that its image rejects leaves its title to others."""
    titles = ["red case FOR switch new!", "Blue mouse", "blue mouse (2024)", "", "", "Blue: mouse"]
    origin, ranked = {"id": 0, "title": "Red Case for Switch, new"}, [{"id": i + 1, "title": t} for i, t in enumerate(titles)]
    image = {0: np.array([1.0, 0]), 2: np.array([1.0, 0.01]), 3: np.array([0, 1.0])}
    ids = lambda rows: ",".join(str(r["id"]) for r in rows)
    return [("titles", ids(recommend.without_duplicates(origin, ranked))), ("images", ids(recommend.without_duplicates(origin, ranked, image.get, 3)))]


BASE = {
    "title": "A <b>pad</b> &amp; more", "description": ["one two three four five six seven eight nine ten", ""], "features": ["eleven twelve thirteen fourteen fifteen"], "price": "$1,299.996",
    "average_rating": 4.5, "images": [{"variant": "PT01", "large": "http://b"}, {"variant": "MAIN", "large": None, "hi_res": "http://a", "thumb": None}], "main_category": "Video Games",
    "categories": ["Video Games", "PC", "Accessories"], "store": "S", "details": {"x": "y"}, "rating_number": 1,
}
CHANGES = [
    {}, {"price": "free"}, {"images": []}, {"main_category": "Books"}, {"details": {"Type of item": "DVD"}}, {"details": {"ISBN-13": "1"}}, {"title": "Film [DVD]"},
    {"features": ["eleven twelve thirteen fourteen"]}, {"title": "Case for PS5 only", "rating_number": 9}, {"categories": ["Video Games", "Deals"], "title": "thing", "store": None},
]


@expect("products_clean", "id asin title price brand category image_url", [
    (1, "A8", "Case for PS5 only", 1300.0, "S", "Video Games > PlayStation 5 > Accessories", "http://a"), (2, "A0", "A pad & more", 1300.0, "S", "Video Games > PC > Accessories", "http://a"),
    (3, "A9", "thing", 1300.0, "Desconocida", "Video Games", "http://a"),
])
def products_clean(spark: SparkSession, sf_dir: str):
    """Product records as JSON lines: other goods, incomplete ones and those of under 15 words go, the rest is put right and numbered."""
    lines = [json.dumps({**BASE, "parent_asin": f"A{i}", **c}) for i, c in enumerate(CHANGES)] + [json.dumps({**BASE, "parent_asin": "A0", "rating_number": 0})]
    path = f"{fresh(spark).catalog.root}/products"
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return shop.products(shop.read_products(spark, path)).select("id", "asin", "title", "price", "brand", "category", "image_url")


OLD = "Video Games > Legacy Systems > "


@expect("categories_follow_titles", "path title category", [
    (OLD + "PlayStation Systems > PlayStation 2 > Accessories", "Headset for PS5 and Xbox One", "Video Games > PlayStation 5 > Accessories"),
    (OLD + "PlayStation Systems > PlayStation 2 > Accessories", "PS2 cable", OLD + "PlayStation Systems > PlayStation 2 > Accessories"),
    (OLD + "Sega Systems > Genesis > Cables", "PS4 stand", "Video Games > PlayStation 4 > Cables"), ("", "nothing", "Video Games"),
    ("Video Games > PlayStation 4 > Games", "a game", "Video Games > PlayStation 4 > Games"),
])
def categories_follow_titles(spark: SparkSession, sf_dir: str):
    titles = ["Headset for PS5 and Xbox One", "PS2 cable", "PS4 stand", "nothing", "a game"]
    paths = [OLD + "PlayStation Systems > PlayStation 2 > Accessories"] * 2 + [OLD + "Sega Systems > Genesis > Cables", "", "Video Games > PlayStation 4 > Games"]
    rows = spark.createDataFrame(list(zip(paths, titles)), "path string, title string")
    return rows.select("path", "title", shop.category(F.split("path", " > "), F.col("title")).alias("category"))


@register("catalogue_page", "SELECT p_partkey AS id, p_type AS category, p_name AS description, p_retailprice AS price FROM part WHERE p_type = 'SMALL' AND p_retailprice BETWEEN 950 AND 1400 ORDER BY p_partkey LIMIT 30 OFFSET 10")
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the catalogue by category and price, through the dialect."""
    engine = session(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("description"), F.col("p_retailprice").alias("price"))
    engine.register("products", part, "id")
    return recommend.catalogue(engine, "SMALL", None, 950, 1400, 30, 10)


@register("made_stock", "SELECT p_partkey AS product, true AS few, true AS known, true AS units FROM part")
def made_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product is in one to three different stores that exist, with 1 to 20 units."""
    stores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    made = recommend.made_stock(stores, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))
    known = made.join(stores.withColumnRenamed("id", "store").withColumn("there", F.lit(True)), "store", "left")
    n = F.count(F.lit(1))
    return known.groupBy("product").agg((n.between(1, 3) & (F.count_distinct("store") == n)).alias("few"), (F.count("there") == n).alias("known"), F.every(F.col("units").between(1, 20)).alias("units"))


@expect("page_cleaning", "page text", [(1, "intro\nReferences\nx"), (2, "fine fragmentation\na b"), (3, "end")])
def page_cleaning(spark: SparkSession, sf_dir: str):
    """Pages up to the last bibliography of the second half, cleaned."""
    pages = [(1, "intro\nReferences\nx"), (2, "ﬁne frag-\n  mentation\r\na\x00b"), (3, "end\n 7. REFERENCES \n[1] x"), (4, "more")]
    return [(n, passages.clean(t)) for n, t in passages.without_references(pages)]


@expect("assistant_answer", "question keywords first answer citations", [("¿Qué es un índice invertido?", "index inverted", 0, "It maps terms [1], see [7].", "1"), ("¿que es?", "", -1, "", "")])
def assistant_answer(spark: SparkSession, sf_dir: str):
    """Keywords, retrieval, a model's answer and its checked citations."""
    from korvid.operators import text as text_ops

    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(["an inverted index maps terms", "a graph of neighbors", "the index of a database"])], "id long, document long, text string")
    index, out = text_ops.build_index(docs, "id", "text", "english"), []
    for question in ("¿Qué es un índice invertido?", "¿que es?"):
        a = passages.ask(question, index, docs, 2, lambda system, message: "It maps terms [1], see [7].")
        out.append((question, a["keywords"], a["passages"][0]["id"] if a["passages"] else -1, a["answer"] or "", ",".join(map(str, a["citations"]))))
    return out


@expect("source_precision", "question precision first_hit", [(1, 0.5, 1), (2, 0.0, 0)])
def source_precision(spark: SparkSession, sf_dir: str):
    returned = spark.createDataFrame([(1, 1, "B-tree"), (1, 2, "none"), (2, 1, "x"), (2, 2, "y")], "question long, n int, text string")
    return passages.source_precision(returned, {1: ["b-?tree"], 2: ["z"]}).withColumn("first_hit", F.col("first_hit").cast("long"))


@expect("type_precision", "query_id precision", [(1, 0.5), (2, 0.0)])
def type_precision(spark: SparkSession, sf_dir: str):
    types = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, type string")
    return recommend.type_precision(spark.createDataFrame([(1, 3), (1, 4), (2, 4)], "query_id long, id long"), types)


@expect("map_stores", "id osm_id name kind district address", [(1, "node/9", "C", "", "sub", "st 5"), (2, "way/1", "B b", "x" * 20, "", "")])
def map_stores(spark: SparkSession, sf_dir: str):
    """Map elements become stores: named ones inside the box, numbered by type and id."""
    elements = [
        {"type": "way", "id": 1, "center": {"lat": 1.0, "lon": 1.0}, "tags": {"name": " B  b ", "shop": "x" * 30}},
        {"type": "node", "id": 9, "lat": 2.0, "lon": 2.0, "tags": {"name": "C", "addr:suburb": "sub", "addr:street": "st", "addr:housenumber": "5"}},
        {"type": "node", "id": 10, "lat": 2.0, "lon": 2.0, "tags": {"name": " "}}, {"type": "node", "id": 3, "lat": 99.0, "lon": 2.0, "tags": {"name": "far"}}, {"type": "node", "id": 4, "tags": {"name": "nowhere"}},
    ]
    path = f"{fresh(spark).catalog.root}/elements"
    spark.createDataFrame([(json.dumps({"elements": elements}),)], "value string").write.text(path)
    return shop.read_stores(spark, path, (0, 0, 10, 10)).drop("place")


FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2101.00001v3</id><title>A
 title</title><published>2021-01-02T00:00:00Z</published><summary> s </summary><author><name>A B</name></author><author><name>C</name></author><arxiv:primary_category term="cs.DB"/></entry></feed>"""


@expect("feed_entries", "arxiv_id title authors year abstract category topic license", [("2101.00001", "A title", "A B, C", 2021, "s", "cs.DB", "t", "http://l")])
def feed_entries(spark: SparkSession, sf_dir: str):
    """A feed of papers, and the licence of a metadata record."""
    return [(*e.values(), shop.parse_license("<r xmlns='x'><license> http://l </license></r>")) for e in shop.parse_feed(FEED, "t")]
