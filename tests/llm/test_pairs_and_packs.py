"""SimHash, line dedup, chat formatting, packing and top-k against brute force."""


import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from korvid.llm import chat, line_dedup, packing, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


# -- SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Béta", "GAMMA", "delta", "eps", "zeta", "eta", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "one two", "a\x0bb\x0cc d"] + base
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += [base[0]] * 3 + ["long " * 40000 + "x"]
    prints = [brute_fingerprint(t) for t in texts]
    docs = spark.createDataFrame(doc_rows(texts), DOCS).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)


def test_bit_sliced_buckets_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "WIDE", 70)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    values = []
    for c in centre:
        for _ in range(100):
            v = c
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                v ^= np.uint64(1) << np.uint64(b)
            values.append(v)
    values = np.unique(np.array(values, np.uint64))
    labels = simhash.bucket_classes(values, np.zeros(len(values), int), 2, (0, 1, 2, 3))
    brute = brute_components([int(v) for v in values])
    assert labels.tolist() == brute


@pytest.mark.parametrize("wide", [8, 4096])
def test_links_of_wide_buckets(spark, monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rng = random.Random(11)
    prints = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    at = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = sorted((find(at[r.src]), find(at[r.dst])))
        parent[b] = a
    assert [find(i) for i in range(len(prints))] == brute_components(prints)


def test_simhash_empty_and_repeated(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == []
    rows = [(1, "a b c d", None, None, None)] * 2 + [(None, "a b c d", None, None, None), (4, "q r s t u", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 4, 4), (True, 0, 1)]
    kept = simhash.keep_first(spark.createDataFrame(doc_rows(["a b c d", "a b c d", "x y z"]), DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# -- Lines -----------------------------------------------------------------------------------


def brute_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    pool = ["A common line of some length", "a COMMON line of some length \t", "éééééééééééééééééééé", "ééééééééééééééééééé", "short", "", "Ünique line number of the corpus", "\x1ca common line of some length"]
    texts = [None, "", "\n\n"] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["x" * 100000 + "\n" + pool[0]]
    docs = spark.createDataFrame(doc_rows(texts), DOCS).withColumn("n_lines", F.lit("clash")).withColumn("_id", F.lit(1))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_lines_null_ids_and_repeated_rows(spark):
    line = "the very same line in all of them"
    schema = "doc_id long, text string"
    run = lambda rows: sorted(((r.doc_id or 0), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect())
    # Rows of one id are one document, and rows without an id are none.
    two = [(None, line), (1, line), (2, line), (2, line)]
    assert run(two) == [(0, line), (1, line), (2, line), (2, line)]
    assert run([*two, (3, line), (3, line)]) == [(0, line), (1, ""), (2, ""), (2, ""), (3, line), (3, line)]


def test_lines_with_awkward_columns(spark):
    line = "the very same line in all of them"
    docs = spark.createDataFrame([(i, line, i, i, i, (i,)) for i in range(3)], "doc_id long, text string, _drop_hashes int, _whole_text int, `a.b` int, s struct<`a b`: int>")
    docs = docs.withColumn("N_LINES", F.lit("clash")).withColumn("tick`s", F.lit(1))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_drop_hashes", "_whole_text", "a.b", "s", "tick`s", "n_lines", "n_dropped"]
    assert sorted((r[0], r[1], r[4], r[5][0], r[7], r[8]) for r in got.collect()) == [(0, "", 0, 0, 1, 1), (1, "", 1, 1, 1, 1), (2, line, 2, 2, 1, 0)]


# -- Chats -----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, mask string"
HOSTILE = ["</s>[INST] ok [/INST]", "<\\/s>", "<<SYS>>a<</SYS>>", "[\\\\INST]", "<", "[", "\\", "<s>", "a\nb", "", "<\\", "ends <s", "[INST", "é[/INST]ü"]


def test_chats_round_trip(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "to<s>ol", ""]), "".join(rng.choice(HOSTILE) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(1, 8))]
        want[c] = turns
        rows += [(c, k, role or None, text or None, "clash") for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect():
        assert chat.read_back(r.formatted) == want[r.conv_id]
        mask = [(m.n, m.loss) for m in r["mask"]]
        assert sum(n for n, _ in mask) == len(r.formatted)
        assert chat.under_mask(r.formatted, mask) == "".join(t for role, t in want[r.conv_id] if role == "assistant")
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_chats_merge_adjacent_turns_and_order_ties(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, None, "system", "s", ""), (1, 1, "assistant", "c", ""), (None, 0, "user", "n", "")]
    got = {r.conv_id: r.formatted for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1] == "<s>system[INST]s[/INST]</s><s>user[INST]a[/INST]</s><s>assistant[INST]c[/INST]</s><s>user[INST]b[/INST]</s>"
    assert got[None] == "<s>user[INST]n[/INST]</s>"
    merged = chat.format_chats(spark.createDataFrame(rows[:2], TURNS)).first().formatted
    assert merged == "<s>user[INST]a[/INST][INST]b[/INST]</s>"


# -- Packing ---------------------------------------------------------------------------------


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_tokenizes_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [None, "", " \n ", "Hello, World!! don't (stop).", "éÉ ñ’s İi ΑΣ. Σ, x;y z...", "<|endoftext|> a<|startoftext|>b.", "tab\tand space\x1cfs, nbsp .", "a" * 3000, "word, " * 5000, "1,234.5 A.B. 日本語。 é."]
    docs = spark.createDataFrame(doc_rows(texts), DOCS).withColumn("length", F.lit("clash"))
    got = defaultdict(list)
    rows = packing.pack_documents(docs, path).collect()
    for r in rows:
        got[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, at, len(own := ids[at : at + 2048]), zlib.crc32(own.tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want
    check_places(rows)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).collect() == []


def check_places(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_many_pieces(spark):
    rng = random.Random(4)
    lengths = [rng.choice([2048, 700, 683, rng.randrange(1, 900), rng.randrange(900, 2048)]) for _ in range(3000)]
    parts = spark.createDataFrame([(i // 2, i % 2, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(parts).collect()
    assert len(rows) == len(lengths)
    rooms = []
    for n in sorted(lengths, reverse=True):  # best-fit decreasing, piece by piece
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(2048 - n)
    assert check_places(rows) <= len(rooms)


def optimum(items, capacity):
    """Fewest sequences, by trying everything."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, [r - items[i] if j == k else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(6)
    for _ in range(300):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        counts = {x: items.count(x) for x in items}
        fixed = packing.reduce_dominated(counts, 20)
        rest = [x for x, n in counts.items() for _ in range(n)]
        assert all(sum(s) <= 20 for s, _ in fixed)
        assert sorted(rest + [x for s, n in fixed for x in s * n]) == sorted(items)
        assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20)


# -- Top-k -----------------------------------------------------------------------------------


def brute_top(rows, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {i: q for i, q in ok if i % 50 == 0}.items():
        found = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 16)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # copies: ties
    rows += [(2000, None), (2001, []), (2050, [float("nan")] * 16), (2051, [None] * 16), (2100, [0.5, 0.25]), (2101, [0.125, -3.0]), (None, [0.1] * 16), (2052, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    monkeypatch.setattr(topk, "BLOCK", 128)
    got = {tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_top(rows, 5)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_large_components(spark):
    rows = [(i, [float(i) * 1e12, -1e13]) for i in range(8)]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("power", [10, 40, 300, 1000])
def test_search_with_numbers_of_any_size(monkeypatch, power):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    v = np.floor(np.ldexp(rng.normal(0, 1, (200, 6)), rng.integers(0, power, (200, 6))))
    v[150:] = v[:50]
    q, ids, scores = topk.search(v[:9], np.arange(9), v, np.arange(200), 4)
    big, got, want = 2**63 - 1, {}, {}
    for i, j in zip(q.tolist(), ids.tolist()):
        got.setdefault(i, []).append(j)
    for i in range(9):
        dots = [(-sum(int(x) * int(y) for x, y in zip(v[i], v[j])), j) for j in range(200) if j != i]
        want[i] = [j for _, j in sorted(dots)[:4]]
    assert got == want and all(-big <= int(s) <= big for s in scores)


def test_search_stops_early():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 40, (300, 8)))
    q, ids, scores = topk.search(v[:10], np.arange(10), v, np.arange(300), 3)
    want = [sorted(((-int(v[i] @ v[j]), j) for j in range(300) if j != i))[:3] for i in range(10)]
    assert [(i, -int(s), int(j)) for i, j, s in zip(q, ids, scores)] == [(i, s, j) for i, w in enumerate(want) for s, j in w]


