"""Relational queries, through the dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.operators import sketches
from korvid.plans.registry import FLAGSHIP, dialect, register, session
from korvid.session import table

dialect("flagship_filter_group_having", FLAGSHIP, "lineitem", FLAGSHIP.replace("COUNT(*) AS n", "COUNT(*) AS n"))

SAME = {
    "scan_project": ("SELECT r_regionkey, r_name FROM region", "region"),
    "filter_equality": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 17", "orders"),
    "filter_between_in_like": (
        "SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_nationkey IN (1, 3, 5, 7) "
        "AND c_name LIKE '%7%' AND NOT c_mktsegment LIKE 'A%'",
        "customer",
    ),
    "filter_not_between_not_in": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45 AND p_size NOT IN (1, 2, 50) AND p_name NOT LIKE '%ring'", "part"),
    "filter_or_precedence": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR NOT (o_custkey >= 100 OR o_totalprice < 50000)", "orders"),
    "filter_three_valued": ("SELECT o_orderkey FROM orders WHERE (o_totalprice > 150000 OR NULL) AND NOT (o_custkey > 1000 AND NULL)", "orders"),
    "filter_null_comparison": ("SELECT COUNT(*) AS n FROM orders WHERE o_custkey = NULL OR o_custkey IN (1, NULL) OR NULL IS NULL AND o_custkey < 10", "orders"),
    "filter_is_null": ("SELECT c_custkey FROM customer WHERE c_name IS NOT NULL AND NOT c_acctbal IS NULL", "customer"),
    "filter_range_reversed": ("SELECT o_orderkey FROM orders WHERE 100 > o_orderkey AND o_orderkey > -5", "orders"),
    "filter_mixed_numbers": ("SELECT s_suppkey FROM supplier WHERE s_suppkey = 17.0 OR s_acctbal >= 9000", "supplier"),
    "filter_string_order": ("SELECT n_name FROM nation WHERE n_name > 'F' AND n_name < 'P'", "nation"),
    "like_underscore": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '_e%' OR p_name LIKE '%g__r'", "part"),
    "project_constants": ("SELECT r_regionkey, 1 AS one, 'x''y' AS text, TRUE AS yes FROM region", "region"),
    "join_two_tables": ("SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'", "nation region"),
    "join_inner_equi_residual": (
        "SELECT o.o_orderkey AS o, c.c_custkey AS c, n.n_name AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20 "
        "INNER JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_nationkey < 10",
        "orders customer nation",
    ),
    "join_three_way_group": (
        "SELECT c.c_mktsegment AS segment, COUNT(*) AS n, SUM(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_discount > 0.04 GROUP BY c.c_mktsegment",
        "lineitem orders customer",
    ),
    "join_two_keys": ("SELECT COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey WHERE a.l_linenumber < b.l_linenumber", "lineitem"),
    "join_self_band": (
        "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'purchase' "
        "AND b.event_id > a.event_id AND b.event_id <= a.event_id + 50",
        "events",
    ),
    "join_or_across_sides": ("SELECT o.o_orderkey AS k, c.c_custkey AS c FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000 OR c.c_acctbal < -900", "orders customer"),
    "agg_all": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(l_tax) AS m, SUM(l_quantity) AS q, AVG(l_quantity) AS a, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "lineitem",
    ),
    "agg_global_empty": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_tax) AS a, MIN(l_shipdate) AS m FROM lineitem WHERE l_quantity > 1000000", "lineitem"),
    "agg_min_max_text": ("SELECT MIN(n_name) AS a, MAX(n_name) AS b FROM nation", "nation"),
    "group_without_aggregate": ("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment HAVING MIN(c_acctbal) < 0", "customer"),
    "having_filter": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 20 AND MAX(o_totalprice) > 300000", "orders"),
    "having_no_group": ("SELECT COUNT(*) AS n FROM orders HAVING MAX(o_totalprice) > 1", "orders"),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem"),
    "order_by_alias": ("SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b DESC, k LIMIT 10", "customer"),
    "order_by_position": ("SELECT s_acctbal, s_suppkey FROM supplier ORDER BY 1 DESC, 2 LIMIT 7", "supplier"),
    "order_by_hidden_column": ("SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 12", "part"),
    "limit_zero": ("SELECT r_name FROM region ORDER BY r_name LIMIT 0", "region"),
    "order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5", "orders"),
    "order_by_aggregate": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY COUNT(*) DESC, o_orderpriority LIMIT 3", "orders"),
}
for _name, (_sql, _tables) in SAME.items():
    dialect(_name, _sql, _tables, _sql)

# What the dialect means differently, or another engine writes differently.
dialect(
    "agg_distinct",
    "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS c, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a, MIN(DISTINCT l_linenumber) AS lo, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag",
    "lineitem",
    "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS c, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a, MIN(l_linenumber) AS lo, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag",
)
dialect(
    "agg_sum_integers",
    "SELECT n_regionkey, SUM(n_nationkey) AS s, AVG(n_nationkey) AS a FROM nation GROUP BY n_regionkey",
    "nation",
    "SELECT n_regionkey, CAST(SUM(n_nationkey) AS BIGINT) AS s, AVG(n_nationkey) AS a FROM nation GROUP BY n_regionkey",
)
dialect(
    "group_by_expression",
    "SELECT l_orderkey % 10 AS k, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_orderkey % 10",
    "lineitem",
    "SELECT l_orderkey % 10 AS k, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey % 10",
)
dialect(
    "arith_integers",
    "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber * 2 - 3 AS b, -l_linenumber AS c FROM lineitem",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(l_linenumber + 1 AS BIGINT) AS a, CAST(l_linenumber * 2 - 3 AS BIGINT) AS b, -l_linenumber AS c FROM lineitem",
)
dialect("group_by_constant", "SELECT COUNT(*) AS n FROM region GROUP BY 1", "region", "SELECT COUNT(*) AS n FROM region")
dialect(
    "arith_floor_mod",
    "SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS a, (0 - l_linenumber) % 3 AS b, l_linenumber % -3 AS c, (0 - l_linenumber) % -3 AS d, (0 - l_quantity) % 7 AS e FROM lineitem",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 3 AS BIGINT) AS a, CAST(((-l_linenumber) % 3 + 3) % 3 AS BIGINT) AS b, CAST(-(((-l_linenumber) % 3 + 3) % 3) AS BIGINT) AS c, "
    "CAST(-(l_linenumber % 3) AS BIGINT) AS d, ((-l_quantity) % 7 + 7) % 7 AS e FROM lineitem",
)
dialect(
    "arith_division",
    "SELECT l_orderkey, l_linenumber, l_linenumber / 4 AS q, l_quantity / 7 AS r FROM lineitem",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, l_linenumber / 4.0 AS q, round(l_quantity / 7, 9) AS r FROM lineitem",
    r=9,
)
dialect("compare_unlike_types", "SELECT COUNT(*) AS n FROM customer WHERE c_custkey != 'x' AND NOT c_name = 5 AND c_name != TRUE", "customer", "SELECT COUNT(*) AS n FROM customer")
dialect("like_without_escapes", r"SELECT 'a\b' LIKE 'a\b' AS same, 'a%b' LIKE 'a\%b' AS other, r_regionkey FROM region", "region", "SELECT true AS same, false AS other, r_regionkey FROM region")
dialect(
    "join_star_labels",
    "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "nation region",
    'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
)
dialect(
    "default_labels",
    "SELECT n.n_regionkey, COUNT(*), SUM(DISTINCT n.n_nationkey) FROM nation n GROUP BY n.n_regionkey",
    "nation",
    'SELECT n_regionkey AS "n.n_regionkey", COUNT(*) AS "count(*)", CAST(SUM(DISTINCT n_nationkey) AS BIGINT) AS "sum(distinct n.n_nationkey)" FROM nation GROUP BY 1',
)
dialect(
    "distinct_ordered",
    "SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 5000 ORDER BY c_nationkey DESC LIMIT 8",
    "customer",
    "SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 5000 ORDER BY c_nationkey DESC LIMIT 8",
)
dialect(
    "time_range",
    "SELECT COUNT(*) AS n, MIN(l_shipdate) AS m FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1996-07-01'",
    "lineitem",
    "SELECT COUNT(*) AS n, MIN(l_shipdate) AS m FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01'",
)


def _gaps(spark: SparkSession, sf_dir: str):
    engine = session(spark, sf_dir)
    engine.register("gaps", table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k")), "o_orderkey")
    return engine


def placed(ordered: DataFrame) -> DataFrame:
    """An ordered result with each row's place: the partitions are ordered, so their sizes say where each begins."""
    rows = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()).cache()
    sizes, starts, at = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}, {}, 1
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part"))
    return rows.select(*ordered.columns, (base + F.col("_nth").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("place"))


@register("order_nulls_default", "SELECT o_orderkey, nullif(o_custkey % 7, 0) AS k, row_number() OVER (ORDER BY nullif(o_custkey % 7, 0) DESC NULLS FIRST, o_orderkey) AS place FROM orders")
def order_nulls_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(_gaps(spark, sf_dir).sql("SELECT o_orderkey, k FROM gaps ORDER BY k DESC, o_orderkey"))


@register("order_nulls_ascending", "SELECT o_orderkey, nullif(o_custkey % 7, 0) AS k, row_number() OVER (ORDER BY nullif(o_custkey % 7, 0) ASC NULLS LAST, o_orderkey) AS place FROM orders")
def order_nulls_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(_gaps(spark, sf_dir).sql("SELECT o_orderkey, k FROM gaps ORDER BY k, o_orderkey"))


@register("order_nulls_explicit", "SELECT o_orderkey, nullif(o_custkey % 7, 0) AS k, row_number() OVER (ORDER BY nullif(o_custkey % 7, 0) ASC NULLS FIRST, o_orderkey) AS place FROM orders")
def order_nulls_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(_gaps(spark, sf_dir).sql("SELECT o_orderkey, k FROM gaps ORDER BY k ASC NULLS FIRST, o_orderkey"))


@register("group_nulls", "SELECT nullif(o_custkey % 7, 0) AS k, count(*) AS n, count(nullif(o_custkey % 7, 0)) AS m FROM orders GROUP BY 1")
def group_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).sql("SELECT k, COUNT(*) AS n, COUNT(k) AS m FROM gaps GROUP BY k")


@register(
    "stats_analyze",
    """SELECT * FROM (
      SELECT 'c_custkey' AS "column", count(*) AS "rows", count(DISTINCT c_custkey) AS "distinct", CAST(min(c_custkey) AS DOUBLE) AS "min", CAST(max(c_custkey) AS DOUBLE) AS "max" FROM customer
      UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name), NULL, NULL FROM customer
      UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey), min(c_nationkey), max(c_nationkey) FROM customer
      UNION ALL SELECT 'c_acctbal', count(*), count(DISTINCT c_acctbal), min(c_acctbal), max(c_acctbal) FROM customer
      UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment), NULL, NULL FROM customer)""",
)
def stats_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = session(spark, sf_dir)
    engine.register("customer", table(spark, sf_dir, "customer"), "c_custkey")
    return engine.analyze("customer")



@register("kmv_distinct_small", "SELECT CAST(count(DISTINCT n_name) AS DOUBLE) AS estimate FROM nation")
def kmv_distinct_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.kmv_estimate(table(spark, sf_dir, "nation"), "n_name")






@register("dml_cascade", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey <> 2 AND n_nationkey <> 0")
def dml_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE, INSERT, DELETE with cascade, ROLLBACK and COMMIT; what is left."""
    engine = session(spark, sf_dir)
    rows = lambda name: table(spark, sf_dir, name).collect()
    values = lambda found: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in found)
    engine.execute("CREATE TABLE areas (id INT PRIMARY KEY, name VARCHAR(20)) USING BTREE")
    engine.execute("CREATE TABLE lands (id INT PRIMARY KEY, name VARCHAR(30), region INT REFERENCES areas ON DELETE CASCADE)")
    engine.execute(f"INSERT INTO areas VALUES {values(rows('region'))}")
    engine.execute(f"INSERT INTO lands VALUES {values(rows('nation'))}")
    engine.execute("BEGIN; DELETE FROM areas; ROLLBACK")
    engine.execute("BEGIN; DELETE FROM areas WHERE id = 2; DELETE FROM lands WHERE id = 0; COMMIT")
    return engine.sql("SELECT id, name, region FROM lands")
