"""Full-text operators: postings, boolean search, TF-IDF and BM25 rankings.

Two kinds of index answer the same questions. A TextIndex is a column of counted terms per document:
a query looks at each document's own terms and shuffles nothing. A StoredIndex is on disk: postings
sorted by term, which carry their document's length and norm, so that a query reads the row groups of
its own terms and nothing else; its dictionary and totals say what the query costs beforehand.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvid.catalog import Files
from korvid.functions import analysis

K1, B = 1.2, 0.75
#: Segments after which a stored index is rewritten as one.
MOST_SEGMENTS = 16


def query_terms(query: str, language: str | None) -> list[str]:
    """The query's terms in order, repeats included."""
    if language is None:
        found = analysis.tokenize(query)
    else:
        found = analysis.analyse(query, language, analysis.stop_words(language))
    return [t for t in found if len(t.encode()) <= analysis.LONGEST]


@dataclass(frozen=True)
class TextIndex:
    """base(doc_id, length, norm, terms): one row per document, empty ones too."""

    base: DataFrame
    language: str | None = None

    @property
    def postings(self) -> DataFrame:
        return self.base.select("doc_id", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf")

    @property
    def docs(self) -> DataFrame:
        return self.base.select("doc_id", "length", "norm")

    def query_terms(self, query: str) -> list[str]:
        return query_terms(query, self.language)

    def cached(self) -> "TextIndex":
        return TextIndex(self.base.cache(), self.language)

    def counts(self, terms: list[str]) -> tuple[int, float, dict[str, int]]:
        """(documents, mean length, the terms' document frequencies), in one pass."""
        has = lambda t: F.exists("terms", lambda x: x["term"] == t)
        each = [F.count(F.when(has(t), 1)).alias(f"t{i}") for i, t in enumerate(terms)]
        row = self.base.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *each).first()
        return row["n"], row["mean"] or 0.0, {t: row[f"t{i}"] for i, t in enumerate(terms) if row[f"t{i}"]}

    def matches(self, terms: list[str]) -> DataFrame:
        """(doc_id, length, norm, found: array of struct(term, tf)) of documents with any of the terms."""
        own = F.filter("terms", lambda x: x["term"].isin(*terms)) if terms else F.slice("terms", 1, 0)
        return self.base.select("doc_id", "length", "norm", own.alias("found")).where(F.size("found") > 0)

    def dictionary(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass
class StoredIndex:
    """Segments of postings(term, doc_id, tf, length, norm), terms(term, df) and docs(doc_id, length, norm) below a path.

    The manifest names the segments with their documents and total lengths, the folders of removed
    document ids, and what the index covers (`tag`). Segments are never changed: appending adds one,
    removing adds a list of ids, consolidating writes one new segment and names it alone.
    """

    spark: SparkSession
    path: str
    language: str | None = None
    segments: list[dict] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)

    def save(self) -> "StoredIndex":
        files = Files(self.spark, self.path)
        files.make()
        held = {"language": self.language, "segments": self.segments, "removed": self.removed, "tag": self.tag}
        files.replace("index.json", json.dumps(held))
        return self

    def query_terms(self, query: str) -> list[str]:
        return query_terms(query, self.language)

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['name']}/{what}" for s in self.segments])

    def _left(self, df: DataFrame) -> DataFrame:
        """Without the documents that were removed."""
        if not self.removed:
            return df
        return df.join(self.spark.read.schema("doc_id long").parquet(*[f"{self.path}/{r}" for r in self.removed]), "doc_id", "left_anti")

    @property
    def all_postings(self) -> DataFrame:
        return self._left(self._read("postings", "term string, doc_id long, tf long, length long, norm double"))

    @property
    def postings(self) -> DataFrame:
        return self.all_postings.select("term", "doc_id", "tf")

    @property
    def docs(self) -> DataFrame:
        return self._left(self._read("docs", "doc_id long, length long, norm double"))

    def counts(self, terms: list[str]) -> tuple[int, float, dict[str, int]]:
        """(documents, mean length, document frequencies): from the manifest and the dictionary's rows of these terms."""
        if self.removed:
            row = self.docs.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).first()
            n, total = row["n"], row["total"] or 0
        else:
            n, total = (sum(s[k] for s in self.segments) for k in ("docs", "total"))
        found = self.dictionary().where(F.col("term").isin(*terms)).collect() if terms else []
        return n, total / n if n else 0.0, {r["term"]: r["df"] for r in found}

    def matches(self, terms: list[str]) -> DataFrame:
        """(doc_id, length, norm, found) of documents with any of the terms; reads their postings only."""
        hits = self.all_postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
        own = F.collect_list(F.struct("term", "tf")).alias("found")
        return hits.groupBy("doc_id").agg(F.first("length").alias("length"), F.first("norm").alias("norm"), own)

    def dictionary(self) -> DataFrame:
        if self.removed:  # the counts of the segments still have the removed documents
            return self.all_postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        terms = self._read("terms", "term string, df long")
        return terms if len(self.segments) < 2 else terms.groupBy("term").agg(F.sum("df").alias("df"))

    def add(self, more: TextIndex, name: str | None = None, consolidate: bool = True) -> "StoredIndex":
        """A further segment (new ids only); a segment of the same name is replaced. Nothing old is read again."""
        segment = _write_segment(more, self.path, name or uuid.uuid4().hex)
        self.segments = [s for s in self.segments if s["name"] != segment["name"]] + [segment]
        if consolidate and len(self.segments) > MOST_SEGMENTS:
            self.consolidate()
        return self

    def remove(self, ids: DataFrame) -> "StoredIndex":
        """Without the documents of ids(doc_id): their ids are kept beside the segments."""
        name = f"removed-{uuid.uuid4().hex}"
        ids.select(F.col("doc_id").cast("long")).write.parquet(f"{self.path}/{name}")
        self.removed = [*self.removed, name]
        return self

    def consolidate(self) -> "StoredIndex":
        """One segment without the removed documents; the old files stay until vacuum(), for those who read them."""
        name = uuid.uuid4().hex
        segment = _write_sorted(self.all_postings, self.docs, self.path, name)
        self.segments, self.removed = [segment], []
        return self

    def vacuum(self) -> None:
        """Deletes what the manifest doesn't name."""
        Files(self.spark, self.path).keep_only({"index.json", *self.removed, *(s["name"] for s in self.segments)})


def _write_segment(index: TextIndex, path: str, name: str) -> dict:
    base = index.base.persist()
    postings = base.select("doc_id", "length", "norm", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", "length", "norm")
    segment = _write_sorted(postings, base.select("doc_id", "length", "norm"), path, name)
    base.unpersist()
    return segment


def _write_sorted(postings: DataFrame, docs: DataFrame, path: str, name: str) -> dict:
    """Sorted by term, so that a term's pages are found by their bounds; a frequent term's postings may fill several files."""
    dealt = postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    dealt.write.mode("overwrite").option("parquet.page.size", 1 << 16).parquet(f"{path}/{name}/postings")
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").option("parquet.page.size", 1 << 14).parquet(f"{path}/{name}/terms")
    docs.write.mode("overwrite").parquet(f"{path}/{name}/docs")
    row = docs.sparkSession.read.schema("doc_id long, length long, norm double").parquet(f"{path}/{name}/docs").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).first()
    return {"name": name, "docs": row["n"], "total": row["total"] or 0}


def write_index(index: TextIndex, path: str, tag: list[str] = ()) -> StoredIndex:
    spark = index.base.sparkSession
    return StoredIndex(spark, path, index.language, tag=list(tag)).add(index).save()


def open_index(spark: SparkSession, path: str) -> StoredIndex | None:
    """The index at the path; None if there is none."""
    text = Files(spark, path).read("index.json")
    return None if text is None else StoredIndex(spark, path, **json.loads(text))


TERMS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))


def build_index(docs: DataFrame, id_col: str, text_col: str, language: str | None = None, simple: bool = False) -> TextIndex:
    """simple: lower-cased runs of letters and digits; else the full token rules (and the language's stems).

    A document's terms are counted where its text is read, so nothing is shuffled.
    """
    stops = analysis.stop_words(language)
    longest = analysis.LONGEST

    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            terms, counts, ends, lengths, norms = [], [], [0], [], []
            for text in texts:
                if text is None:
                    found = Counter()
                elif simple and language is None:
                    found = Counter(analysis.simple_words(text))
                else:
                    found = Counter(analysis.analyse(text, language, stops, known))
                kept = [(t, n) for t, n in found.items() if len(t) <= longest // 4 or len(t.encode()) <= longest]
                terms += [t for t, _ in kept]
                counts += [n for _, n in kept]
                ends.append(len(terms))
                lengths.append(sum(n for _, n in kept))
                norms.append(math.sqrt(sum((1 + math.log10(n)) ** 2 for _, n in kept)))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], fields=list(TERMS.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), pa.array(norms, pa.float64()), lists], names=["doc_id", "length", "norm", "terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return TextIndex(rows.mapInArrow(run, "doc_id long, length long, norm double, terms array<struct<term: string, tf: long>>"), language)


def all_terms(index: TextIndex | StoredIndex) -> DataFrame:
    return index.dictionary()


def estimate(index: TextIndex | StoredIndex, query: str, page: int = 128) -> tuple[int, int]:
    """(candidate documents at most, pages of postings) that a query would read."""
    total = sum(index.counts(sorted(set(index.query_terms(query))))[2].values())
    return total, math.ceil(total / page)


def boolean_and(index: TextIndex | StoredIndex, query: str) -> DataFrame:
    """(doc_id): documents with all of the query's terms; none for an empty query."""
    terms = sorted(set(index.query_terms(query)))
    return index.matches(terms).where(F.size("found") == len(terms)).select("doc_id")


def _sum_over(found: str, weights: dict[str, float], share) -> Column:
    """The sum over the found terms of their weight times share(tf)."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    # Sorted, so that equal documents have equal sums whatever the order of their postings.
    parts = F.transform(F.array_sort(found), lambda x: F.element_at(table, x["term"]) * share(x["tf"]))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def _no_scores(index: TextIndex | StoredIndex) -> DataFrame:
    return index.matches([]).select("doc_id", F.lit(0.0).alias("score"))


def tf_idf(index: TextIndex | StoredIndex, query: str) -> DataFrame:
    """(doc_id, score): lnc.ltc cosine; terms that all documents have drop out."""
    terms = index.query_terms(query)
    n, _, df = index.counts(sorted(set(terms)))
    weights = {t: (1 + math.log10(terms.count(t))) * math.log10(n / df[t]) for t in dict.fromkeys(terms) if df.get(t)}
    weights = {t: w for t, w in weights.items() if w > 0}
    if not weights:
        return _no_scores(index)
    size = math.sqrt(sum(w * w for w in weights.values()))
    dot = _sum_over("found", weights, lambda tf: 1 + F.log10(tf))
    return index.matches(list(weights)).select("doc_id", (dot / (F.lit(size) * F.col("norm"))).alias("score"))


def bm25(index: TextIndex | StoredIndex, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score): each distinct query term once; every document with a term counts."""
    n, mean, df = index.counts(sorted(set(index.query_terms(query))))
    if not df:
        return _no_scores(index)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    flat = k1 * (1 - b + b * F.col("length") / F.lit(mean))
    return index.matches(list(idf)).select("doc_id", _sum_over("found", idf, lambda tf: tf * (k1 + 1) / (tf + flat)).alias("score"))


RANKINGS = {"TF_IDF": tf_idf, "BM25": bm25}


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best; ties go to the smaller id. Planned without a full sort."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def append(index: TextIndex, docs: DataFrame, id_col: str, text_col: str, simple: bool = False) -> TextIndex:
    """The index with further documents (new ids); nothing old is read again."""
    more = build_index(docs, id_col, text_col, index.language, simple)
    return TextIndex(index.base.unionByName(more.base), index.language)


def remove(index: TextIndex, ids: DataFrame) -> TextIndex:
    """The index without the documents of ids(doc_id)."""
    return TextIndex(index.base.join(ids, "doc_id", "left_anti"), index.language)


def snippet(text: Column, query: str, length: int = 160) -> Column:
    """The text's window around the query, or else the first of its words that it holds."""
    low = F.lower(text)
    places = [F.locate(w, low) for w in [query.lower(), *query.lower().split()] if w]
    at = F.coalesce(*[F.when(p > 0, p) for p in places], F.lit(1)) if places else F.lit(1)
    start = F.greatest(F.lit(1), at - length // 2)
    cut = F.substring(text, start, F.lit(length))
    head = F.when(start > 1, F.lit("...")).otherwise(F.lit(""))
    tail = F.when(F.length(text) >= start + length, F.lit("...")).otherwise(F.lit(""))
    return F.concat(head, cut, tail)


def bow_histogram(words: DataFrame) -> DataFrame:
    """words(doc_id, word) -> (doc_id, word, tf)."""
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))


def bow_tf_idf(histogram: DataFrame) -> DataFrame:
    """(doc_id, word, weight): (1 + log10 tf) * log10(N / df), to unit length; zero vectors stay zero."""
    n = histogram.select("doc_id").distinct().count()
    idf = histogram.groupBy("word").agg(F.log10(F.lit(float(n)) / F.count(F.lit(1))).alias("idf"))
    raw = histogram.join(idf, "word").select("doc_id", "word", ((1 + F.log10("tf")) * F.col("idf")).alias("raw"))
    norms = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "word", F.col("raw"), norms.alias("norm")).select("doc_id", "word", F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(F.lit(0.0)).alias("weight"))
