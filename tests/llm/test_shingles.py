"""The pipeline's near-dedup stage against all pairs by exact five-word Jaccard."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from korvid.llm import shingles, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def five(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets, label = [five(r[1]) for r in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    first = {}
    for k, x in enumerate(label):
        first[x] = min(first.get(x, rows[k][0]), rows[k][0])
    return sorted(r[0] for k, r in enumerate(rows) if first[label[k]] == r[0])


def changed_words(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return words


def near_copies():
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        for copy in range(4):
            rows.append((len(rows), " ".join(changed_words(rng, words, copy * len(words) // 120)), "en", "s", 0))
    rows += [(900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, "one two", "en", "s", 0), (903, "One  two", "en", "s", 0)]
    return rows


def test_stage_keeps_what_all_pairs_keep(spark):
    rows = near_copies()
    got = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, DOCS), None)
    want = brute_kept(rows)
    assert len(want) < len(rows) / 2
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("wide", [4096, 16])
def test_large_buckets_of_copies_of_one_text(spark, monkeypatch, wide):
    monkeypatch.setattr(shingles, "WIDE", wide)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(changed_words(rng, words, 2) if i else words), "en", "s", 0) for i in range(100)]
    assert [r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, DOCS), width=5, least=0.8).collect()] == brute_kept(rows) == [0]


def test_wide_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingles, "WIDE", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(8):  # chains: each text is alike to the one before only
        own = list(words)
        for _ in range(12):
            own = changed_words(rng, own, rng.randint(2, 4))
            rows.append((len(rows), " ".join(own), "en", "s", 0))
    rng.shuffle(rows)
    got = simhash.keep_first(spark.createDataFrame(rows, DOCS), width=5, least=0.8)
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    factors, terms = rng.integers(0, 2**64 - 1, (2, 2000), np.uint64)
    base = rng.integers(0, 2**63, 5000).astype(np.uint64)
    a, b = (shingles.signature(x, factors | np.uint64(1), terms) for x in (base[:4500], base[500:]))
    assert abs((a == b).mean() - 0.8) < 0.04
