"""Suffix-array dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvid.llm import substring_dedup as sd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 2, int)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + length + 1] -= 1
        cover = np.cumsum(gone)[1:-1] > 0
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((len(x), int(cover.sum()), spans, bytes(b for b, g in zip(x, cover) if not g)))
    return out


def check(spark, texts, length):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tid", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in sd.drop_repeated(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def make(seed, n=30, size=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randrange(10, 60)) for _ in range(4)]
    base = text(size // 4)
    out = [None, "", "short", base, base, "ab" * 300, "a" * 500, base + base, "x" * 41]
    for _ in range(n):
        kind = rng.randrange(3)
        if kind == 0:  # near copies
            w = base.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        elif kind == 1:
            out.append(text(20) + rng.choice(passages) + text(15) + rng.choice(passages))
        else:
            out.append(text(rng.randrange(5, 80)))
    return out


@pytest.mark.parametrize("length", [16, 41])
def test_equals_brute_force(spark, length):
    check(spark, make(length), length)


def test_large_groups_get_longer_leads(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 2)
    check(spark, make(7, 25), 40)


def test_production_length(spark):
    check(spark, make(9, 15, 1600), 400)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 100)
    check(spark, make(8, 20), 30)


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "q" + "abcdefgh" * 10, "", "", 0), (1, "unique " * 2, "", "", 0), (1, "another text of its own", "", "", 0), (1, "another text of its own", "", "", 0)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sd.drop_repeated(spark.createDataFrame(rows, DOCS), 20).collect())
    assert got == [(0, 81, 80), (1, 14, 0), (1, 23, 23), (1, 23, 23)]
    assert sd.drop_repeated(spark.createDataFrame([], DOCS), 20).collect() == []


def test_multikey_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 24)).astype(np.uint8)
    rows[100:200] = rows[0:100]
    order, common = sd.multikey_sort(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(texts)
    assert all(a[:c] == b[:c] and (c == 24 or a[c] != b[c]) for a, b, c in zip(texts, texts[1:], common[1:].tolist()))


@pytest.mark.parametrize("split, most", [(2, 10_000), (2, 3), (8, 1)])
def test_hot_keys_in_several_parts_lose_nothing(spark, monkeypatch, split, most):
    monkeypatch.setattr(sd, "SPLIT", split)
    monkeypatch.setattr(sd, "HOT_KEYS", most)
    rng = random.Random(4)
    rows = spark.createDataFrame([(None if i % 7 == 0 else i, min(rng.randrange(1, 40), 20)) for i in range(600)], "did long, k long")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 3 != 0")
    want = Counter((r.did, r.k) for r in rows.collect() if r.k % 3)
    assert Counter((r.did, r.k) for r in sd._having(rows, keys, ["k"]).collect()) == want
    assert sd._having(rows, keys.where("false"), ["k"]).count() == 0


def test_equals_brute_force_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sd, "SPLIT", 4)
    check(spark, make(9) + make(9)[3:5] * 20, 16)
