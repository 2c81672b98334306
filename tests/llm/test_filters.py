"""Licence scans, mixing and language ID."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvid.llm import langid, licenses, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(texts, lang="en"):
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]


# -- Licences --------------------------------------------------------------------------------


def test_licenses_survive_case_punctuation_copyright_and_spelling(spark):
    mit = licenses.KNOWN[0][1]
    texts = [
        mit,
        "Copyright (c) 2020 Some Body\n\n" + mit.upper().replace(",", " ;"),
        "© Nobody\nCopyright 1999-2001, X\nAll rights reserved.\n" + mit.replace(" ", "\n  "),
        mit.replace("sublicense", "sublicence").replace("MERCHANTABILITY", "MERCHANTIBILITY"),
        mit + " And one word more.",
        mit.replace("free of charge", "at a charge"),
        None,
        "",
        " \n ",
        "prose\nReleased under the mit Licence!\nmore\n** Licensed under CC BY-NC 4.0 **\nReleased under the MIT License.",
        "Released under the MIT License.",
        "word " * 50000,
    ]
    rows = [*doc_rows(texts), (None, mit, None, None, None), (20, mit, None, None, None), (20, mit, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("license", F.lit("clash"))
    got = defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r.doc_id].append((r.license, r.notices))
    assert [got[i][0][0] for i in range(12)] == ["MIT"] * 4 + [None] * 6 + ["MIT", None]
    assert got[9] == [(None, "CC-BY-NC-4.0,MIT")] and got[10] == [("MIT", "MIT")]
    assert got[None] == [("MIT", "MIT")] and len(got[20]) == 2 and got[6] == got[7] == got[8] == [(None, "")]
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_notices_are_those_of_the_rows_own_text(spark):
    rows = [(1, "Released under the MIT License."), (1, "other text"), (None, "Licensed under the MIT License."), (2, "licence licence\nx"), (3, "license license\nx")]
    got = sorted((r.doc_id or 0, r.notices, r.digest) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("known", F.lit("clash"))).collect())
    assert [r[:2] for r in got] == [(0, "MIT"), (1, ""), (1, "MIT"), (2, ""), (3, "")]
    assert got[3][2] == got[4][2]


@pytest.mark.parametrize("name", sorted(licenses.TITLES))
def test_licence_files_with_and_without_title(spark, name):
    texts = [t for n, t in licenses.TEXTS if n == name]
    files = [*texts, *(f"{title}\n\nCopyright (c) 2024 Some Body\n\n{t}\n" for t in texts for title in licenses.TITLES[name])]
    got = licenses.scan(spark.createDataFrame(list(enumerate(files)), "doc_id long, text string")).collect()
    assert len(got) == len(files) and {r.license for r in got} == {name}


# -- Mixing ----------------------------------------------------------------------------------


def brute_rake(cells, targets, rounds):
    total = sum(cells.values())
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for d, shares in enumerate(targets):
            held = defaultdict(float)
            for k, v in w.items():
                held[k[d]] += v
            w = {k: v * shares.get(k[d], 0) * total / held[k[d]] if held[k[d]] else 0.0 for k, v in w.items()}
    return w


def test_raking_equals_brute_force_and_meets_the_targets(spark):
    rng = random.Random(3)
    cells = {(s, c, t): rng.randrange(1, 900) for s in "abcd" for c in "xy" for t in "mn"}
    targets = [{"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, {"x": 0.5, "y": 0.5}, {"m": 0.25, "n": 0.75}]
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, dict(zip(mixing.DIMENSIONS, targets))).collect()}
    assert got == pytest.approx(brute_rake(cells, targets, mixing.ROUNDS))
    once = mixing.rake(df, dict(zip(mixing.DIMENSIONS, targets)), rounds=1)
    assert {(r.source, r.lang, r.topic): r.weight for r in once.collect()} == pytest.approx(brute_rake(cells, targets, 1))
    total = sum(got.values())
    for d, shares in enumerate(targets):
        for name, share in shares.items():
            assert sum(v for k, v in got.items() if k[d] == name) / total == pytest.approx(share, abs=1e-3)


def test_drawn_shares_follow_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(200, 400), rng.choice(["en", "en", "de"]), rng.choice(["hot"] * 6 + ["cold", "mild"]), 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tokens", F.lit("clash"))
    targets = {"source": {"hot": 0.4, "cold": 0.3, "mild": 0.3}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mixed(docs, targets, keep=0.25).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    total = sum(r.n for r in got)
    assert {r.source: round(r.n / total, 1) for r in got} == targets["source"]
    absent = mixing.mixed(docs, {"source": {"hot": 1.0}})
    assert {r.source for r in absent.select("source").distinct().collect()} == {"hot"}


def test_mixing_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "", "", 0), (3, "long " * 60000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs, temper=dict.fromkeys(mixing.DIMENSIONS, 1.0), keep=1.0)
    assert got.columns == [*docs.columns, "topic", "tokens", "probability"]
    assert got.count() == 5  # natural shares keep everything
    assert mixing.mixed(spark.createDataFrame([], DOCS)).collect() == []


def test_mixing_by_a_given_topic_and_awkward_columns(spark):
    rows = [(i, "a b c d", "en", "s", i, "sport" if i % 4 == 0 else None) for i in range(800)]
    docs = spark.createDataFrame(rows, DOCS + ", subject string").withColumn("TOPIC", F.lit("clash")).withColumn("a.b", F.lit(1)).withColumn("_sum", F.lit(1))
    got = mixing.mixed(docs, {"topic": {"sport": 0.5, "": 0.5}}, keep=0.4, topic_col="subject")
    assert got.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "subject", "a.b", "_sum", "topic", "tokens", "probability"]
    shares = {r.topic: r.n for r in got.groupBy("topic").agg(F.sum("tokens").alias("n")).collect()}
    assert abs(shares["sport"] / sum(shares.values()) - 0.5) < 0.08


# -- Language --------------------------------------------------------------------------------


def corpus(n, seed):
    rng = random.Random(seed)
    parts = {"aa": "the and ing tion er wh".split(), "bb": "der sch ung keit ü ein".split(), "cc": "que eau é ç ou ment".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return rows


def test_language_on_rows_never_learnt(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame(rows, DOCS)
    # The held-out rows' languages are wrong on purpose: nothing may be learnt from them.
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    model = langid.fit(spoiled, langid.held_out())
    assert model.languages == ["aa", "bb", "cc"]
    assert (model.weights == 0).mean() > 0.5  # sparse
    truth = {r[0]: r[2] for r in rows}
    got = langid.identify(docs.drop("lang"), model).select("doc_id", langid.held_out().alias("h"), "lang_pred", "score").collect()
    held = [r for r in got if r.h]
    right = np.array([r.lang_pred == truth[r.doc_id] for r in held])
    assert len(held) > 150 and right.mean() > 0.98
    assert abs(np.mean([r.score for r in held]) - right.mean()) < 0.05  # calibrated


def test_language_with_awkward_columns(spark):
    docs = spark.createDataFrame([(1, "abc", (2,)), (2, "xyz", (3,))], "doc_id long, text string, s struct<`a b`: int>").withColumn("tick`s", F.lit("en")).withColumn("SCORE", F.lit(1))
    got = langid.identify(docs, langid.fit(docs, F.lit(False), lang_col="`tick``s`"))
    assert got.columns == ["doc_id", "text", "s", "tick`s", "lang_pred", "score"]
    assert sorted((r[0], r[1], r[2][0], r[4]) for r in got.collect()) == [(1, "abc", 2, "en"), (2, "xyz", 3, "en")]


def test_languages_beyond_the_sample_are_not_learnt(spark):
    rows = [(i, "abc", f"l{i % 3 if i < 30 else i}", None, 0) for i in range(34)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), F.lit(False), sample=12)
    assert model.languages == ["l0", "l1", "l2"]


def test_language_edge_cases(spark):
    model = langid.fit(spark.createDataFrame(corpus(300, 2), DOCS), langid.held_out())
    texts = [None, "", " 12 !? ", "the", "THE\nTION", "que eau " * 40000]
    docs = spark.createDataFrame(doc_rows(texts), DOCS).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und"] * 3 + ["aa", "aa", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].score == 0
    assert langid.identify(docs.limit(0), model).collect() == []
    nothing = langid.fit(spark.createDataFrame([(1, "a", None, None, 0), (None, "b", "en", None, 0)], DOCS), langid.held_out())
    assert nothing.predict("abc") == ("und", 0.0)
    one = langid.fit(spark.createDataFrame([(1, "abc", "en", None, 0), (3, None, "en", None, 0)], DOCS), F.lit(False))
    assert one.predict("abc") == ("en", 1.0)
