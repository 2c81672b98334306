"""The pipeline stage by stage on a small corpus, against brute force."""

import random
import subprocess
import sys
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from korvid.llm import common, langid  # noqa: E402

from test_filters import corpus  # noqa: E402
from test_pairs_and_packs import brute_components, brute_fingerprint, brute_lines, check_places  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small():
    rng = random.Random(9)
    line = "the very same line of twenty letters"
    rows = []
    for i, text, lang, _, _ in corpus(400, 5):
        if i % 9 == 0:
            text += f"\n{line}"
        if i % 7 == 0 and i:
            text, lang = rows[-1][1:3]
        rows.append((i, text, lang, rng.choice(["hot", "hot", "cold"]), len(text)))
    rows += [(1000, None, "aa", "hot", None), (1001, "12 34 !!", "aa", None, 8), (1002, "", None, None, 0)]
    return rows


def test_stages(spark, small):
    docs = spark.createDataFrame(small, DOCS)
    tables = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        tables[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == tables["start"].columns
    rows = {name: [tuple(r) for r in df.collect()] for name, df in tables.items()}

    told = rows["language_id"]
    assert set(told) < set(small) and {r[0] for r in small} - {r[0] for r in told} == {1000, 1001, 1002}

    lines = brute_lines([(r[0], r[1]) for r in told])
    assert {r[0]: r[1] for r in rows["line_dedup"]} == {i: x[0] for i, x in lines.items()}
    assert any(x[2] for x in lines.values()) and all(r[4] == len(r[1]) for r in rows["line_dedup"])

    before = sorted(rows["line_dedup"])
    parts = brute_components([brute_fingerprint(r[1]) for r in before])
    assert sorted(rows["simhash_near_dedup"]) == [r for k, r in enumerate(before) if parts[k] == k]

    drawn = set(rows["mixing_sources"])
    assert drawn <= set(rows["simhash_near_dedup"]) and len(drawn) > len(before) / 4

    pieces = tables["best_fit_packing"].collect()
    lengths = defaultdict(int)
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert set(lengths) == {r[0] for r in drawn} and min(lengths.values()) >= 1
    check_places(pieces)


def test_stages_leave_own_columns_alone(spark, small):
    names = ["lang_pred", "SCORE", "n_lines", "n_dropped", "topic", "Tokens", "probability", "_topic", "a.b", "gone"]
    docs = spark.createDataFrame([(*r, *(f"{n} of {r[0]}" for n in names)) for r in small[:90]], DOCS + "".join(f", `{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), docs.schema)
        assert docs.columns[5:] == names
    rows = docs.collect()
    assert len(rows) > 20 and all(r[5 + k] == f"{n} of {r[0]}" for r in rows for k, n in enumerate(names))


def test_empty_documents_and_extra_columns(spark):
    docs = spark.createDataFrame([], DOCS).withColumn("score", F.lit("clash")).withColumn("fp", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, None)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "fp"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == 0
    assert langid.UNKNOWN == "und"


def test_idle_workers_hold_no_freed_memory(spark):
    """Workers live on between the stages, beside a JVM that needs the executor's memory."""

    def freed(batches):
        import ctypes
        import re
        import time

        import pyarrow as pa

        def held():
            with open("/proc/self/smaps_rollup") as f:
                return int(re.search(r"Private_Dirty:\s+(\d+)", f.read())[1]) // 1024

        for _ in batches:
            pass
        owner, before = sys.modules["_korvid_worker"].owner if "_korvid_worker" in sys.modules else "", held()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        time.sleep(1)  # so that each worker gets a task
        yield pa.record_batch([pa.array([owner]), pa.array([before - held()])], names=["owner", "mb"])

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([50, 400, 20000 if i % 200 == 0 else 300]))), "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    langid.identify(docs, langid.fit(docs, langid.held_out())).write.format("noop").mode("overwrite").save()
    found = [r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(freed, "owner string, mb long").collect() if r.owner == "langid"]
    assert found and max(found) < 12, found


def test_tokenizer_starts_no_threads():
    """A worker is one of several on its machine, and each thread would keep caches of its own."""
    code = """
import os, public_tokenizers
from korvid.llm import packing
words = packing.words(public_tokenizers.path("word_bpe_49k.json"))
before = len(os.listdir("/proc/self/task"))
words.encode([" ".join(f"{i}\u00e9{k}" for k in range(50)) for i in range(200)])
print(len(os.listdir("/proc/self/task")) - before)
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, check=True, text=True).stdout.strip() == "0"


def test_checkpoints_leave_no_shuffle_files(spark):
    """They would stay until the driver happens to collect its garbage, and add up over a stage."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in found.split("\n") if "/shuffle_" in x and x.endswith(".data")}

    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    held = common.checkpoint(spark.range(0, 20000, 1, 4).groupBy((F.col("id") % 5000).alias("k")).count())
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before and spark.conf.get(setting) == was
    assert held.count() == 5000 and held.agg(F.sum("count")).first()[0] == 20000
