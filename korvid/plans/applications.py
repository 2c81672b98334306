"""Queries of the two applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.apps import passages, recommend
from korvid.plans.registry import register
from korvid.session import table
from korvid.sources import shop

PURCHASES = "SELECT user_id AS u, event_id % 50 AS product, epoch(ts) AS ts, event_id, value FROM events WHERE event_type = 'purchase'"


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return events.select(F.col("user_id").alias("user"), (F.col("event_id") % 50).alias("product"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts"), "event_id", "value")


@register(
    "copurchase_window_join",
    f"""WITH p AS (SELECT u, product, CAST(floor(ts) AS BIGINT) AS ts FROM ({PURCHASES}))
    SELECT a.product, b.product AS id, count(*) AS value FROM p a JOIN p b ON a.u = b.u WHERE a.product <> b.product AND b.ts BETWEEN a.ts - 86400 AND a.ts + 86400 GROUP BY ALL""",
)
def copurchase_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.also_bought(purchases(spark, sf_dir), seconds=86400)


@register(
    "copurchase_one_product",
    f"""WITH p AS (SELECT u, product, CAST(floor(ts) AS BIGINT) AS ts FROM ({PURCHASES}))
    SELECT a.product, b.product AS id, count(*) AS value FROM p a JOIN p b ON a.u = b.u WHERE a.product = 7 AND b.product <> 7 AND b.ts BETWEEN a.ts - 2592000 AND a.ts + 2592000 GROUP BY ALL""",
)
def copurchase_one_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.also_bought(purchases(spark, sf_dir), 7)


SIGNALS = """a AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS v FROM part WHERE p_partkey <> 5 AND p_size > 0 ORDER BY p_size DESC, p_partkey LIMIT 101),
    b AS (SELECT p_partkey AS id, p_retailprice AS v FROM part WHERE p_partkey <> 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 101),
    both_lists AS (SELECT id FROM a UNION SELECT id FROM b)"""


def signals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two lists of candidates, and a bonus over what is in them."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id").where("id <> 5")
    best = lambda c: part.select("id", F.col(c).cast("double").alias("value")).where("value > 0").orderBy(F.desc("value"), "id").limit(recommend.CANDIDATES)
    lists = {"size": best("p_size"), "price": best("p_retailprice")}
    ids = lists["size"].select("id").union(lists["price"].select("id")).distinct()
    candidates = part.withColumn("category", F.col("p_type")).join(ids, "id", "left_semi")
    return {**lists, "category": recommend.same_category(candidates, "SMALL")}


@register(
    "rrf_fusion",
    f"""WITH {SIGNALS}, parts AS (SELECT id, 61.0 / (60 + row_number() OVER (ORDER BY v DESC, id)) * (1 / 2.0) AS x FROM a
      UNION ALL SELECT id, 61.0 / (60 + row_number() OVER (ORDER BY v DESC, id)) * (0.75 / 2.0) FROM b
      UNION ALL SELECT p_partkey, 0.25 / 2.0 FROM part JOIN both_lists ON p_partkey = id WHERE p_type = 'SMALL')
    SELECT id, round(sum(x), 9) AS score FROM parts GROUP BY 1""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommend.fuse(5, signals(spark, sf_dir), {"size": 1, "price": 0.75, "category": 0.25}, limit=1000)
    return found.select("id", F.round("score", 9).alias("score"))


@register(
    "max_fusion",
    f"""WITH {SIGNALS} SELECT id, round(sum(x), 9) AS score FROM (SELECT id, v / (SELECT max(v) FROM a) / 2 AS x FROM a UNION ALL SELECT id, v / (SELECT max(v) FROM b) / 2 FROM b)
    GROUP BY 1""",
)
def max_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {k: v for k, v in signals(spark, sf_dir).items() if k != "category"}
    found = recommend.fuse(5, lists, {"size": 1, "price": 1}, "max", limit=1000)
    return found.select("id", F.round("score", 9).alias("score"))


@register("signal_bonus_category", "SELECT p_partkey AS id, CAST(1 AS DOUBLE) AS value FROM part WHERE p_type = (SELECT p_type FROM part WHERE p_partkey = 1)")
def signal_bonus_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"))
    return recommend.same_category(part, part.where("id = 1").first()["category"])


@register(
    "purchases_clean",
    f"""WITH f AS (SELECT u AS "user", product, min(CAST(floor(ts) AS BIGINT)) AS ts, arg_min(value, floor(ts)) AS rating FROM ({PURCHASES}) WHERE event_id % 9 <> 0 GROUP BY ALL),
    k AS (SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY "user") BETWEEN 2 AND 20)
    SELECT row_number() OVER (ORDER BY ts, "user", product) AS id, "user", product, ts, rating FROM k""",
)
def purchases_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = purchases(spark, sf_dir).select("user", "product", "ts", F.col("value").alias("rating"), (F.col("event_id") % 9 != 0).alias("verified"))
    return shop.clean_purchases(found)


@register(
    "dedupe_title_key",
    """SELECT id, title, score FROM (SELECT p_partkey AS id, p_name AS title, p_retailprice AS score, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS nth
      FROM part WHERE p_name <> 'red widget') WHERE nth = 1 ORDER BY score DESC, id LIMIT 12""",
)
def dedupe_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"))
    return recommend.first_per_title(ranked, "Red Widget", 12)


@register("category_counts", "SELECT p_type AS category, count(*) AS products FROM part GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.category_counts(table(spark, sf_dir, "part").withColumnRenamed("p_type", "category"))


@register(
    "html_clean",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages""",
)
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", shop.html_text(F.col("html")).alias("text"))


@register(
    "citations_extract",
    r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(
      regexp_extract_all(text || ' see [2] and [1, 3][9]', '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: regexp_split_to_array(g, '\s*,\s*'))),
      lambda x: TRY_CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 5))), ',') AS numbers FROM conversations""",
)
def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.citations(F.concat("text", F.lit(" see [2] and [1, 3][9]")), F.lit(5))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(",", F.array_sort(found).cast("array<string>")).alias("numbers"))


@register("library_counts", "SELECT r_regionkey AS id, r_name AS name, count(n_nationkey) AS passages FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return passages.library(documents, table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("document")))


@register(
    "balanced_selection",
    """WITH t AS (SELECT p_partkey AS id, 1 AS tier, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_retailprice DESC, p_partkey) AS r, p_size % 4 AS topic FROM part
      UNION ALL SELECT p_partkey, 0, p_partkey, 0 FROM part WHERE p_partkey BETWEEN 3 AND 6),
    f AS (SELECT id, min((tier, r, topic)) AS spot FROM t GROUP BY 1)
    SELECT id, CAST(row_number() OVER (ORDER BY spot, id) AS INTEGER) AS nth FROM f ORDER BY spot, id LIMIT 40""",
)
def balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", (F.col("p_size") % 4).alias("topic"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p_retailprice"), "id"))
    ranked = part.select("id", "topic", rank.cast("long").alias("rank"))
    seeds = part.where("id BETWEEN 3 AND 6").select("id", F.col("id").alias("nth"))
    return shop.balanced_selection(ranked, seeds, 40)


@register(
    "behaviour_recall",
    """WITH r AS (SELECT o_custkey AS query_id, o_orderkey % 40 AS id FROM orders),
    t AS (SELECT DISTINCT o_custkey AS query_id, o_orderkey % 30 AS id FROM orders)
    SELECT query_id, round(count(h.id) / least(10, count(*)), 9) AS recall FROM t LEFT JOIN (SELECT DISTINCT * FROM r) h USING (query_id, id) GROUP BY 1""",
)
def behaviour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    made = lambda m: orders.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % m).alias("id"))
    return recommend.behaviour_recall(made(40), made(30)).withColumn("recall", F.round("recall", 9))
