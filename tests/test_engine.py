"""The session: definitions, constraints, transactions, COPY, errors, EXPLAIN."""

import json

import pytest

from korvid.engine import Engine, result_json
from korvid.errors import ConflictError, SQLExecutionError, SQLIntegrityError, SQLSemanticError
from korvid.sources import csv as csv_source
from korvid.sources import media


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "tables"))


@pytest.fixture()
def school(engine):
    engine.execute(
        "CREATE TABLE courses (cid INT PRIMARY KEY, name VARCHAR(10));"
        "CREATE TABLE pupils (id INT PRIMARY KEY, name VARCHAR(10), course INT REFERENCES courses ON DELETE CASCADE);"
        "CREATE TABLE marks (pupil INT REFERENCES pupils(id) ON DELETE CASCADE, mark INT);"
        "CREATE TABLE grants (pupil INT REFERENCES pupils ON DELETE RESTRICT, amount FLOAT);"
        "INSERT INTO courses VALUES (1, 'maths'), (2, 'music');"
        "INSERT INTO pupils VALUES (10, 'ana', 1), (11, 'bob', 1), (12, 'cy', 2);"
        "INSERT INTO marks VALUES (10, 5), (10, 6), (11, 7), (12, 8)"
    )
    return engine


def rows(engine, sql):
    return sorted(engine.execute(sql).rows())


def test_cascade_and_restrict(school):
    school.execute("INSERT INTO grants VALUES (12, 1)")
    with pytest.raises(SQLIntegrityError):
        school.execute("DELETE FROM courses WHERE cid = 2")
    assert len(rows(school, "SELECT id FROM pupils")) == 3
    assert school.execute("DELETE FROM courses WHERE cid = 1").affected == 1
    assert rows(school, "SELECT id FROM pupils") == [(12,)] and rows(school, "SELECT mark FROM marks") == [(8,)]
    school.execute("DELETE FROM grants; DELETE FROM courses")
    assert rows(school, "SELECT pupil FROM marks") == []


def test_self_reference_cascades_through_a_cycle(engine):
    engine.execute("CREATE TABLE emp (id INT PRIMARY KEY, boss INT REFERENCES emp ON DELETE CASCADE); INSERT INTO emp VALUES (1, 1), (2, 1), (3, 2), (4, 4)")
    assert engine.execute("DELETE FROM emp WHERE id = 1").affected == 1
    assert rows(engine, "SELECT id FROM emp") == [(4,)]


@pytest.mark.parametrize("sql", ["INSERT INTO pupils VALUES (10, 'x', 1)", "INSERT INTO pupils VALUES (20, 'x', 1), (20, 'y', 1)", "INSERT INTO pupils VALUES (21, 'x', 9)"])
def test_keys_are_checked_and_statements_are_atomic(school, sql):
    with pytest.raises(SQLIntegrityError):
        school.execute(sql)
    assert len(rows(school, "SELECT id FROM pupils")) == 3


def test_transactions(school, spark):
    school.execute("BEGIN; DELETE FROM marks; INSERT INTO courses VALUES (3, 'art')")
    assert rows(school, "SELECT cid FROM courses") == [(1,), (2,), (3,)]
    other = Engine(spark, school.catalog.root)
    assert rows(other, "SELECT cid FROM courses") == [(1,), (2,)]
    school.execute("ROLLBACK")
    assert len(rows(school, "SELECT mark FROM marks")) == 4
    school.execute("BEGIN; INSERT INTO courses VALUES (4, 'sport')")
    other.execute("INSERT INTO courses VALUES (5, 'dance')")
    with pytest.raises(ConflictError):
        school.execute("COMMIT")
    for bad in ("BEGIN", ):
        with pytest.raises(SQLExecutionError):
            school.execute(bad)
    school.execute("ROLLBACK")
    with pytest.raises(SQLExecutionError):
        school.execute("COMMIT")


def test_tables_reopen(school, spark):
    again = Engine(spark, school.catalog.root)
    assert rows(again, "SELECT name FROM pupils") == [("ana",), ("bob",), ("cy",)]
    with pytest.raises(SQLIntegrityError):
        again.execute("INSERT INTO pupils VALUES (10, 'x', 1)")
    assert rows(again, "SELECT p.name, c.name FROM pupils p JOIN courses c ON p.course = c.cid WHERE c.cid = 2") == [("cy", "music")]


def test_values_are_checked_and_cut(engine):
    engine.execute("CREATE TABLE v (id INT PRIMARY KEY, s VARCHAR(3), f FLOAT, p POINT)")
    engine.execute("INSERT INTO v VALUES (1, 'año!', 2, POINT(1, 2))")
    assert engine.execute("SELECT s, f, p FROM v").rows() == [("añ", 2.0, (1.0, 2.0))]
    for bad in ("(2, 3, 1.0, POINT(0, 0))", "(2.5, 'a', 1.0, POINT(0, 0))", "(NULL, 'a', 1.0, POINT(0, 0))", "(2, 'a', TRUE, POINT(0, 0))", "(2, 'a', 1.0, 'x')", "(2, 'a', 1.0)"):
        with pytest.raises(SQLSemanticError):
            engine.execute(f"INSERT INTO v VALUES {bad}")
    with pytest.raises(SQLSemanticError):
        engine.execute("INSERT INTO v (id, s) VALUES (2, 'a')")


def test_copy_is_all_or_nothing(engine, tmp_path):
    engine.execute("CREATE TABLE c (id INT PRIMARY KEY, name VARCHAR(4), place POINT, x FLOAT)")
    good, bad, twice = tmp_path / "good.csv", tmp_path / "bad.csv", tmp_path / "twice.csv"
    good.write_text('﻿id,name,place,x\n1,"a,""b",“x”,1\n'.replace("“x”", '"(1, 2)"') + '\n2,ñandú,"POINT(3,4)",-2.5e1\n', encoding="utf-8")
    assert engine.execute(f"COPY c FROM '{good}' WITH (FORMAT csv, HEADER true)").affected == 2
    assert rows(engine, "SELECT * FROM c") == [(1, 'a,"b', (1.0, 2.0), 1.0), (2, "ñan", (3.0, 4.0), -25.0)]
    bad.write_text('id,name,place,x\n3,a,"(1,2)",1\n4,b,"(1,2)",zz\n')
    with pytest.raises(SQLExecutionError, match="line 3"):
        engine.execute(f"COPY c FROM '{bad}' WITH (FORMAT csv, HEADER)")
    twice.write_text('7|a|(1,2)|1\n7|b|(1,2)|2\n')
    with pytest.raises(SQLIntegrityError):
        engine.execute(f"COPY c FROM '{twice}' WITH (DELIMITER '|')")
    assert len(rows(engine, "SELECT id FROM c")) == 2
    latin = tmp_path / "latin.csv"
    latin.write_bytes("8;é;(1,2);1\n".encode("latin-1"))
    engine.execute(f"COPY c FROM '{latin}' WITH (DELIMITER ';', ENCODING 'LATIN1')")
    assert rows(engine, "SELECT name FROM c WHERE id = 8") == [("é",)]


def test_inferred_schema_loads(engine, tmp_path):
    f = tmp_path / "9 shops.csv"
    f.write_text("Id;Name;Price;Photo\n1;a;1.5;x.png\n2;" + "b" * 300 + ";2;y.JPG\n")
    create, copy = csv_source.infer(str(f), {"t_9_shops"})
    assert create == 'CREATE TABLE "t_9_shops_2" ("id" INT PRIMARY KEY, "name" TEXT, "price" FLOAT, "photo" IMAGE)'
    media.register_extractor("IMAGE", lambda path: [float(len(path)), 1.0])
    engine.execute(f"{create}; {copy}")
    assert rows(engine, 'SELECT id, price, photo FROM "t_9_shops_2"') == [(1, 1.5, "x.png"), (2, 2.0, "y.JPG")]


BAD = """SELECT x FROM courses
SELECT cid FROM nowhere
SELECT courses.cid FROM courses c
SELECT name FROM pupils p JOIN courses c ON p.course = c.cid
SELECT p.id FROM pupils p JOIN courses c ON p.course > c.cid
SELECT p.id FROM pupils p JOIN courses p ON p.course = p.cid
SELECT c.id FROM pupils p JOIN courses c ON p.course = p.id
SELECT id FROM pupils WHERE COUNT(*) > 1
SELECT COUNT(*) FROM pupils GROUP BY SUM(id)
SELECT id, COUNT(*) FROM pupils
SELECT id FROM pupils GROUP BY name
SELECT id, id FROM pupils
SELECT id FROM pupils ORDER BY 2
SELECT DISTINCT name FROM pupils ORDER BY id
SELECT id FROM pupils WHERE id
SELECT id FROM pupils WHERE name + 1 = 2
SELECT id FROM pupils WHERE id LIKE 'a'
SELECT id FROM pupils WHERE id < 'a'
SELECT SUM(name) FROM pupils
SELECT SCORE() FROM pupils
SELECT id FROM pupils WHERE MATCH(name, 'a') USING BM25
SELECT id FROM pupils WHERE SIMILAR_TO('x', k=1) USING IVF
SELECT DISTANCIA(id, id) FROM pupils
SELECT id FROM pupils WHERE WITHIN(name, POLYGON((0,0),(0,1),(1,1)))
SELECT x.* FROM pupils
SELECT id AS k FROM pupils WHERE k = 1
CREATE TABLE courses (a INT)
CREATE TABLE z (a INT REFERENCES marks)
CREATE TABLE z (a FLOAT REFERENCES courses)
CREATE TABLE z (a TEXT PRIMARY KEY)
CREATE TABLE z (a INT) USING BTREE
CREATE INDEX i ON pupils (nope)
CREATE INDEX i ON pupils (id) USING SPIMI
CREATE INDEX i ON pupils (name) USING SPIMI WITH (LANGUAGE = 'klingon')
INSERT INTO nowhere VALUES (1)
DELETE FROM pupils WHERE COUNT(*) = 1""".split("\n")


def test_errors_show_before_any_job_also_on_empty_tables(engine):
    engine.execute(
        "CREATE TABLE courses (cid INT PRIMARY KEY, name VARCHAR(10)); CREATE TABLE pupils (id INT PRIMARY KEY, name VARCHAR(10), course INT REFERENCES courses); CREATE TABLE marks (pupil INT, mark INT)"
    )
    for sql in BAD:
        with pytest.raises((SQLSemanticError, SQLExecutionError)):
            engine.execute(sql)


def test_errors_of_a_run(school):
    with pytest.raises(SQLExecutionError):
        school.execute("SELECT id / 0 FROM pupils").rows()
    result = school.try_execute("SELECT nope FROM pupils")
    assert "nope" in result.error and json.loads(result_json(result)) == {"error": result.error}


def test_text_search_in_the_dialect(engine):
    engine.execute("CREATE TABLE d (id INT PRIMARY KEY, t TEXT, y INT); CREATE INDEX i ON d (t) USING SPIMI WITH (LANGUAGE = 'spanish')")
    engine.execute("INSERT INTO d VALUES (1, 'los índices invertidos', 1), (2, 'un índice espacial', 2), (3, 'nada', 3)")
    assert [r[0] for r in engine.execute("SELECT id FROM d WHERE MATCH(t, 'índice invertido') USING BM25").rows()] == [1, 2]
    assert [r[0] for r in engine.execute("SELECT id FROM d WHERE MATCH(t, 'indices') USING BM25 AND y > 1").rows()] == [2]
    engine.execute("INSERT INTO d VALUES (4, 'índice índice', 4); DELETE FROM d WHERE id = 2")
    assert [r[0] for r in engine.execute("SELECT id, SCORE() AS s FROM d WHERE MATCH(t, 'indice') USING TF_IDF ORDER BY s DESC LIMIT 1").rows()] == [4]
    for bad in ("MATCH(t, 'a') USING BM25 OR y = 1", "NOT MATCH(t, 'a') USING BM25", "MATCH(t, 'a') USING BM25 AND MATCH(t, 'b') USING BM25", "MATCH(y, 'a') USING BM25"):
        with pytest.raises(SQLSemanticError):
            engine.execute(f"SELECT id FROM d WHERE {bad}")
    with pytest.raises(SQLSemanticError):
        engine.execute("SELECT COUNT(*), MAX(SCORE()) FROM d WHERE MATCH(t, 'a') USING BM25")


def test_similarity_in_the_dialect(engine):
    media.register_extractor("IMAGE", media.vectors_file)
    engine.execute("CREATE TABLE f (id INT PRIMARY KEY, photo IMAGE); CREATE INDEX h ON f (photo) USING HNSW WITH (METRIC = cosine); CREATE INDEX v ON f (photo) USING IVF")
    engine.execute("INSERT INTO f VALUES (1, '[1, 0]'), (2, '[0, 1]'), (3, '[1, 1]'), (4, '[0, 0]')")
    near = "SELECT id, SIMILARITY_SCORE() AS s FROM f WHERE SIMILAR_TO('[2, 0]', k=3) USING HNSW"
    assert [r[0] for r in engine.execute(near).rows()] == [1, 3, 2]  # the zero vector has no cosine
    assert [r[0] for r in engine.execute(near + " AND id > 1").rows()] == [3, 2]
    assert [r[0] for r in engine.execute("SELECT id FROM f WHERE SIMILAR_TO(photo, '[0, 0]', k=2) USING IVF").rows()] == [4, 1]
    for bad in ("SIMILAR_TO('[0, 0]', k=2) USING HNSW", "SIMILAR_TO('[1, 2, 3]', k=2) USING IVF", "SIMILAR_TO('no file', k=2) USING IVF"):
        with pytest.raises(SQLExecutionError):
            engine.execute(f"SELECT id FROM f WHERE {bad}")
    with pytest.raises(SQLSemanticError):
        engine.execute("SELECT id FROM f WHERE SIMILAR_TO('[1, 0]', k=1) USING HNSW WITH METRIC = euclidean")


def test_explain_is_honest(school):
    plan = school.execute("EXPLAIN SELECT p.id FROM pupils p JOIN courses c ON p.course = c.cid WHERE p.id > 10 ORDER BY p.id LIMIT 2").plan
    text = "\n".join(plan)
    for part in ("Limit", "Sort Key: p.id", "Filter: (p.id > 10)", "Hash Join", "Hash Cond: (p.course = c.cid)", "Seq Scan on pupils p", "Physical Plan:"):
        assert part in text
    assert "Index Scan" not in text
    counted = "\n".join(school.execute("EXPLAIN ANALYZE DELETE FROM marks WHERE mark > 6").plan)
    assert "Delete on marks" in counted and "rows=2" in counted
    assert len(rows(school, "SELECT mark FROM marks")) == 2


def test_scans_are_pruned_and_filters_pushed(spark, sf_dir):
    engine = Engine(spark)
    engine.register("lineitem", spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    plan = engine.sql("SELECT l_returnflag FROM lineitem WHERE l_quantity > 40")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
