"""The corpus pipeline: documents through the stages, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.llm import langid, line_dedup, mixing, packing, simhash
from korvid.llm.common import stored, unused

#: A document goes if its language can't be told, or is told with less than this probability.
LEAST_SCORE = 0.3
#: The share of the clean corpus' tokens that the mix draws.
MIX_SHARE = 0.75


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: the rows whose text has a letter and a language told with LEAST_SCORE at least.

    Null and empty texts go, repeated rows stay or go together, an empty table stays empty, and all
    columns come back as they were, the row's own lang too.
    """
    lang, score = unused(docs, "lang_pred", "score")
    found = langid.identify(docs, langid.fit(docs, langid.held_out()), into=(lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: every row, its text without common lines, n_chars following where lines went.

    Null texts come back empty; rows with a null id lose nothing; an empty table stays empty.
    """
    lines, gone = unused(docs, "n_lines", "n_dropped")
    kept = line_dedup.dedup_lines(docs, into=(lines, gone))
    changed = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).drop(lines, gone)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each group of texts linked by a five-word Jaccard of 0.8 or more, the least id.

    Rows with a null id stay; texts without words are equal; an empty table stays empty.
    """
    return simhash.keep_first(docs, width=5, least=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: rows drawn for the raked shares of sources, languages and topics, MIX_SHARE of all tokens.

    Null sources and languages are categories; repeated rows are drawn together; an empty table stays empty.
    """
    into = unused(docs, "topic", "tokens", "probability")
    return mixing.mixed(docs, into=tuple(into), keep=MIX_SHARE).drop(*into)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row for each piece of each document; null texts have the end's id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_common_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("mixing_sources", mixed),
    ("best_fit_packing", packed),
]

#: Models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is stored before the next, which reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
