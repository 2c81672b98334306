"""Lexer and parser: trees, precedence, errors with their place."""

import pytest

from korvid.errors import SQLLexError, SQLParseError
from korvid.sql import ast as a
from korvid.sql.lexer import tokenize
from korvid.sql.parser import parse_one, parse_script


def where(text):
    return parse_one(f"SELECT a FROM t WHERE {text}").where


def test_tokens_fold_names_and_keep_quoted_ones():
    kinds = [(t.kind, t.value) for t in tokenize("""SeLeCt Abc "Ab""c" 'it''s' 1 2.5 .5e1 <> -- end\n/* a /* b */ c */ ;""")]
    assert kinds == [("word", "SELECT"), ("name", "abc"), ("name", 'Ab"c'), ("string", "it's"), ("integer", 1), ("float", 2.5), ("float", 5.0), ("symbol", "!="), ("symbol", ";"), ("end", None)]


@pytest.mark.parametrize("text, line, column", [("SELECT 'a", 1, 8), ("a\n /* x", 2, 2), ('SELECT ""', 1, 8), ("SELECT 1a", 1, 8), ("SELECT a ? b", 1, 10), ("1e999", 1, 1), ("1.2.3", 1, 1)])
def test_lexical_errors_have_a_place(text, line, column):
    with pytest.raises(SQLLexError) as e:
        tokenize(text)
    assert (e.value.line, e.value.column) == (line, column) and "^" in str(e.value)


def test_precedence():
    r = a.Ref
    assert where("a = 1 OR b = 2 AND NOT c = 3") == a.Binary(
        "OR", a.Binary("=", r("a"), a.Literal(1)), a.Binary("AND", a.Binary("=", r("b"), a.Literal(2)), a.Unary("NOT", a.Binary("=", r("c"), a.Literal(3))))
    )
    assert where("a + b * -2 - 1 > 0") == a.Binary(
        ">", a.Binary("-", a.Binary("+", r("a"), a.Binary("*", r("b"), a.Literal(-2))), a.Literal(1)), a.Literal(0)
    )
    assert where("a NOT BETWEEN 1 AND 2 AND b IS NOT NULL") == a.Binary("AND", a.Between(r("a"), a.Literal(1), a.Literal(2), True), a.IsNull(r("b"), True))
    assert where("a NOT IN (1, b) OR x.y LIKE 'z%'") == a.Binary("OR", a.InList(r("a"), (a.Literal(1), r("b")), True), a.Like(r("y", "x"), a.Literal("z%")))


def test_select_with_everything():
    q = parse_one("SELECT DISTINCT e.*, COUNT(DISTINCT x) AS n, y z FROM emp AS e INNER JOIN dep d ON e.d = d.id GROUP BY y, 1 HAVING COUNT(*) > 1 ORDER BY n DESC, y NULLS FIRST LIMIT 3 OFFSET 4;")
    assert q.distinct and q.limit == 3 and q.offset == 4
    assert q.items == (a.SelectItem(a.Star("e")), a.SelectItem(a.Aggregate("COUNT", a.Ref("x"), True), "n"), a.SelectItem(a.Ref("y"), "z"))
    assert q.table == a.TableRef("emp", "e") and q.joins[0].table == a.TableRef("dep", "d")
    assert q.order_by == (a.OrderItem(a.Ref("n"), True, True), a.OrderItem(a.Ref("y"), False, True))
    assert q.group_by == (a.Ref("y"), a.Literal(1)) and q.having == a.Binary(">", a.Aggregate("COUNT", None), a.Literal(1))


def test_special_calls():
    assert where("MATCH(txt, 'a b') USING TF_IDF") == a.Match(a.Ref("txt"), "a b", "TF_IDF")
    assert where("SIMILAR_TO('f.png', k = 5) USING IVF WITH METRIC = 'dot'") == a.SimilarTo(None, "f.png", 5, "IVF", "dot_product")
    assert where("WITHIN(p, POLYGON((0,0), POINT(0,1), (1,1), (0,0)))").polygon == a.Polygon((((0.0, 0.0), (0.0, 1.0), (1.0, 1.0)),))
    q = parse_one("SELECT DISTANCIA(p, POINT(1, -2)) AS d, DISTANCIA(p, q, 'haversine') FROM t ORDER BY DISTANCIA(p, q) USING EUCLIDEAN")
    assert [i.expr.metric for i in q.items] == ["EUCLIDEAN", "HAVERSINE"] and q.order_by[0].expr.metric == "EUCLIDEAN"
    assert parse_one("SELECT match, score, k FROM text").items[0].expr == a.Ref("match")


def test_definitions_and_changes():
    t = parse_one("CREATE TABLE n (id INT PRIMARY KEY, s VARCHAR(5), d INT REFERENCES p(id) ON DELETE CASCADE, x FLOAT, FOREIGN KEY (x) REFERENCES q ON DELETE NO ACTION) USING BTREE")
    assert t.primary_key == "id" and t.organisation == "BTREE" and t.columns[1] == a.ColumnDef("s", "VARCHAR", 5)
    assert t.foreign_keys == (a.ForeignKey("d", "p", "id", "CASCADE"), a.ForeignKey("x", "q", None, "RESTRICT"))
    assert parse_one("CREATE INDEX i ON t (c) USING SPIMI WITH (LANGUAGE = 'es')") == a.CreateIndex("i", "t", "c", "SPIMI", {"language": "es"})
    assert parse_one("CREATE INDEX i ON t USING HNSW (c) WITH (METRIC = COSINE)") == a.CreateIndex("i", "t", "c", "HNSW", {"metric": "cosine"})
    assert parse_one("INSERT INTO t (a, b) VALUES (1, -2.5), ('x', POINT(1, 2))").rows[1] == (a.Literal("x"), a.Point(1, 2))
    assert parse_one("DELETE FROM t x WHERE x.a = 1") == a.Delete(a.TableRef("t", "x"), a.Binary("=", a.Ref("a", "x"), a.Literal(1)))
    assert parse_one("COPY t (a) FROM 'f' WITH (FORMAT csv, HEADER, DELIMITER ';', ENCODING 'LATIN1')") == a.Copy("t", ("a",), "f", True, ";", "LATIN1")
    assert [s.action for s in parse_script("BEGIN TRANSACTION; COMMIT; END; ROLLBACK;")] == ["BEGIN", "COMMIT", "COMMIT", "ROLLBACK"]
    assert parse_one("EXPLAIN ANALYZE DELETE FROM t") == a.Explain(a.Delete(a.TableRef("t", "t")), True)


@pytest.mark.parametrize(
    "text",
    """SELECT
SELECT a
SELECT a FROM t WHERE
SELECT a FROM t LEFT JOIN u ON t.a = u.a
SELECT SUM(*) FROM t
SELECT COUNT(DISTINCT *) FROM t
SELECT SUM(MAX(a)) FROM t
SELECT a FROM t LIMIT -1
SELECT a FROM t LIMIT 1.5
SELECT a FROM t; SELECT
SELECT a FROM t UNION SELECT a FROM t
INSERT INTO t (a, a) VALUES (1, 2)
INSERT INTO t (a, b) VALUES (1)
INSERT INTO t VALUES (1), (1, 2)
INSERT INTO t VALUES (a)
CREATE TABLE t (a INT, a INT)
CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)
CREATE TABLE t (a INT, PRIMARY KEY (b))
CREATE TABLE t (a VARCHAR)
CREATE TABLE t (a DATE)
CREATE INDEX i ON t (a) USING HASH WITH (LANGUAGE = 'es')
CREATE INDEX i ON t (a) USING SPIMI WITH (METRIC = cosine)
SELECT POINT(91, 0) FROM t
SELECT a FROM t WHERE WITHIN(p, POLYGON((0,0),(1,1),(0,0)))
SELECT a FROM t WHERE WITHIN(p, POLYGON((0,0),(1,1),(2,2)))
SELECT a FROM t WHERE SIMILAR_TO('x', k=0) USING IVF
COPY t FROM 'f' WITH (DELIMITER ';;')
UPDATE t SET a = 1
EXPLAIN BEGIN
SELECT a FROM t WHERE a NOT = 1""".split("\n"),
)
def test_syntax_errors(text):
    with pytest.raises((SQLParseError, SQLLexError)):
        parse_script(text)


def test_nesting_is_bounded_and_statements_are_single():
    deep = lambda n: "SELECT a FROM t WHERE " + "(" * n + "a" + ")" * n + " = 1"
    parse_one(deep(60))
    with pytest.raises(SQLParseError):
        parse_one(deep(70))
    with pytest.raises(SQLParseError):
        parse_one("SELECT a FROM t; SELECT a FROM t")
    with pytest.raises(SQLParseError) as e:
        parse_one("SELECT a\nFROM t WHERE >")
    assert (e.value.line, e.value.column) == (2, 14)
