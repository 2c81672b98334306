"""Full-text queries over documents, with the JVM's word tokens so that SQL can express the analysis."""

from __future__ import annotations

import dataclasses
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.apps import passages
from korvid.catalog import Files, Index
from korvid.operators import text as text_ops
from korvid.plans.registry import register, session
from korvid.session import table

QUERY = "that from erea"
TERMS = "('that'), ('from'), ('erea')"
POSTINGS = """
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE strlen(term) <= 255 GROUP BY ALL),
d AS (SELECT doc_id, coalesce(length, 0) AS length, coalesce(norm, 0) AS norm FROM documents
      LEFT JOIN (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS length, sqrt(sum(power(1 + log10(tf), 2))) AS norm FROM p GROUP BY 1) USING (doc_id)),
n AS (SELECT count(*) AS n, avg(length) AS mean FROM d),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
"""
BM25 = f"""{POSTINGS},
bm25 AS (SELECT doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
         FROM p JOIN df USING (term) JOIN d USING (doc_id), n WHERE term IN (SELECT * FROM (VALUES {TERMS})) GROUP BY 1)"""
TFIDF = f"""{POSTINGS},
q AS (SELECT term, log10(n.n / df) AS w FROM df, n WHERE term IN (SELECT * FROM (VALUES {TERMS})) AND df < n.n),
tfidf AS (SELECT doc_id, round(sum(w * (1 + log10(tf))) / ((SELECT sqrt(sum(w * w)) FROM q) * any_value(norm)), 9) AS score
          FROM p JOIN q USING (term) JOIN d USING (doc_id) GROUP BY 1)"""


def index(spark: SparkSession, sf_dir: str) -> text_ops.StoredIndex:
    """The corpus' stored index: written at the application's first query over the corpus, read by all."""
    name = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()[:16]
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/korvid-text-{name}"
    held = text_ops.open_index(spark, path)
    if held is None:
        Files(spark, path).go_with_the_session()
        held = text_ops.write_index(text_ops.build_index(table(spark, sf_dir, "documents"), "doc_id", "text", simple=True), path)
    return held


def rounded(scored: DataFrame) -> DataFrame:
    """Scores to nine digits, so that copies tie whatever the order of their sums."""
    return scored.select("doc_id", F.round("score", 9).alias("score"))


@register("text_tokens_df", f"WITH {POSTINGS} SELECT term, df FROM df")
def text_tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_ops.all_terms(index(spark, sf_dir))


@register("text_doc_stats", f"WITH {POSTINGS} SELECT doc_id, length, round(norm, 6) AS norm FROM d")
def text_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).docs.select("doc_id", "length", F.round("norm", 6).alias("norm"))


@register("text_boolean_and", f"WITH {POSTINGS} SELECT doc_id FROM p WHERE term IN (SELECT * FROM (VALUES {TERMS})) GROUP BY 1 HAVING count(*) = 3")
def text_boolean_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_ops.boolean_and(index(spark, sf_dir), QUERY)


@register("text_tfidf_topk", f"WITH {TFIDF} SELECT doc_id, score FROM tfidf ORDER BY score DESC, doc_id LIMIT 20")
def text_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_ops.top(rounded(text_ops.tf_idf(index(spark, sf_dir), QUERY)), 20)


@register("text_bm25_topk", f"WITH {BM25} SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 20")
def text_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_ops.top(rounded(text_ops.bm25(index(spark, sf_dir), QUERY)), 20)


@register("text_estimate", f"WITH {POSTINGS} SELECT CAST(sum(df) AS BIGINT) AS candidates, CAST(ceil(sum(df) / 128.0) AS BIGINT) AS pages FROM df WHERE term IN (SELECT * FROM (VALUES {TERMS}))")
def text_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, pages = text_ops.estimate(index(spark, sf_dir), QUERY)
    return spark.createDataFrame([(candidates, pages)], "candidates long, pages long")


@register("text_append", f"WITH {POSTINGS} SELECT term, df FROM df")
def text_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus indexed first, the other half appended as a segment, both then consolidated."""
    docs = table(spark, sf_dir, "documents")
    made = lambda half: text_ops.build_index(docs.where(half), "doc_id", "text", simple=True)
    return text_ops.all_terms(_written(spark, made("doc_id % 2 = 0")).add(made("doc_id % 2 <> 0")).consolidate())


def _written(spark: SparkSession, made: text_ops.TextIndex) -> text_ops.StoredIndex:
    """An index of its own, which goes with the session."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/korvid-text-{uuid.uuid4().hex}"
    Files(spark, path).go_with_the_session()
    return text_ops.write_index(made, path)


@register("text_remove", f"WITH {POSTINGS} SELECT term, count(*) AS df FROM p JOIN documents USING (doc_id) WHERE lang <> 'fr' GROUP BY 1")
def text_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id")
    held = index(spark, sf_dir)
    return text_ops.all_terms(dataclasses.replace(held).remove(gone))  # the manifest stays as it is


@register("text_match_filtered", f"WITH {BM25} SELECT doc_id, lang, score FROM bm25 JOIN documents USING (doc_id) WHERE lang <> 'fr' ORDER BY score DESC, doc_id")
def text_match_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATCH in the dialect, with another condition."""
    engine = session(spark, sf_dir)
    engine.register("documents", table(spark, sf_dir, "documents"), "doc_id", [Index("d", "text", "SPIMI", {"analysis": "simple"})])
    found = engine.sql(f"SELECT doc_id, lang, SCORE() AS score FROM documents WHERE MATCH(text, '{QUERY}') USING BM25 AND lang <> 'fr'")
    return found.withColumn("score", F.round("score", 9))



@register(
    "text_snippet",
    """SELECT doc_id, concat(CASE WHEN s > 1 THEN '...' ELSE '' END, substr(text, s, 60), CASE WHEN length(text) >= s + 60 THEN '...' ELSE '' END) AS snippet
    FROM (SELECT doc_id, text, greatest(1, CASE WHEN instr(lower(text), 'that from') > 0 THEN instr(lower(text), 'that from') WHEN instr(lower(text), 'that') > 0 THEN instr(lower(text), 'that')
      WHEN instr(lower(text), 'from') > 0 THEN instr(lower(text), 'from') ELSE 1 END - 30) AS s FROM documents)""",
)
def text_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_ops.snippet(F.col("text"), "that from", 60).alias("snippet"))


@register(
    "bow_tfidf_vectors",
    f"""WITH {POSTINGS}, h AS (SELECT p.doc_id, term AS word, (1 + log10(tf)) * log10(CAST((SELECT count(DISTINCT doc_id) FROM p) AS DOUBLE) / df) AS raw FROM p JOIN df USING (term)),
    s AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM h GROUP BY 1)
    SELECT doc_id, word, round(CASE WHEN norm > 0 THEN raw / norm ELSE 0 END, 8) AS weight FROM h JOIN s USING (doc_id)""",
)
def bow_tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = index(spark, sf_dir).postings.select("doc_id", F.col("term").alias("word"), "tf")
    return text_ops.bow_tf_idf(histogram).select("doc_id", "word", F.round("weight", 8).alias("weight"))


@register(
    "rag_retrieve",
    f"""WITH {BM25}, c AS (SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 25),
    r AS (SELECT doc_id AS id, source AS document, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS nth FROM c JOIN documents USING (doc_id)
          WHERE score >= 0.7 * (SELECT max(score) FROM c))
    SELECT id, document, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS n FROM r WHERE nth <= 2 ORDER BY score DESC, id LIMIT 5""",
)
def rag_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document"))
    return passages.retrieve(rounded(text_ops.bm25(index(spark, sf_dir), QUERY)), docs, 5).select("id", "document", "score", "n")



@register(
    "chunk_word_totals",
    r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([a-z])-\n\s*([a-z])', '\1\2', 'g'), '[\x09-\x0d\x1c-\x20\x7f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) AS BIGINT) AS words
    FROM documents WHERE regexp_matches(text, '\S')""",
)
def chunk_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No word is lost or doubled: the words of each document's chunks."""
    return passages.chunk_texts(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum("words").alias("words"))
