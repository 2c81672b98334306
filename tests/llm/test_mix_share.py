"""The pipeline's mix must not shrink because of one rare category."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from korvid.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(3)
    langs, sources = ["en"] * 6 + ["de"] * 2 + ["fr"], ["web", "web", "books"]
    return [(i, " ".join(["word"] * rng.randint(20, 300)), rng.choice(langs), rng.choice(sources), 0) for i in range(3000)]


@pytest.mark.parametrize("rare", [[], [(9000, "one two three four five", "xx", "web", 0)], [(9001, "one two three four five", None, None, 0)]])
def test_one_rare_row_leaves_the_mix_its_size(spark, rare):
    docs = spark.createDataFrame(rows() + rare, DOCS)
    drawn = corpus_pipeline.mixed(spark, docs, None)
    size = lambda df: df.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(size(drawn) / size(docs) - corpus_pipeline.MIX_SHARE) < 0.03
    assert {r[0] for r in rare} <= {r.doc_id for r in drawn.select("doc_id").collect()}


def test_scale_against_plain_water_filling(spark):
    cells = [("a", 1000, 700.0), ("b", 500, 600.0), ("c", 5, 200.0), ("d", 50, 55.0), ("e", 9, 0.0)]
    raked = spark.createDataFrame(cells, "source string, tokens long, weight double").withColumn("rate", F.col("weight") / F.col("tokens"))
    for keep in (0.1, 0.75, 0.99):
        scale = mixing.scale_for(raked, keep)
        assert sum(min(n, scale * w) for _, n, w in cells) == pytest.approx(keep * 1564)
    # The cell without weight can't fill a target beyond the others' tokens.
    assert sum(min(n, mixing.scale_for(raked, 1.0) * w) for _, n, w in cells) == pytest.approx(1555)
