"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, everything but letters becomes one blank, and the n-grams of one to three
characters are hashed to FEATURES columns. A feature is the n-gram's share of the text's n-grams
times its inverse document frequency, counted over every row that may be learnt from. The weights
come from follow-the-regularised-leader with an elastic net (L1 makes them sparse), a temperature
fitted on a part of the sample that the weights have not seen calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvid.llm.common import kept_places, numbered_columns, place_of, schema_of, small, tidy, worker_state

FEATURES = 1 << 15
#: At most about so many labelled rows train the weights, shared evenly by the languages.
SAMPLE = 2000
#: A learnt language has at least so many rows of the sample, so SAMPLE // LEAST languages are learnt at most.
LEAST = 4
#: Features are scaled so that the usual learning rates fit.
SCALE = 100.0
#: Fixed multipliers of the hash, odd and large.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    state = worker_state("langid")
    if "letters" not in state:
        state["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return state["letters"]


def gram_counts(text: str) -> np.ndarray | None:
    """How often each feature's n-grams stand in the text; None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)[letter | np.r_[True, letter[:-1]]].astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    a, b, c = (codes * np.uint64(m) for m in MIX)
    two = a[:-1] + b[1:]
    grams = np.concatenate([a, two * np.uint64(MIX[2]), (two[:-1] + c[2:]) * np.uint64(MIX[1])])
    grams ^= grams >> np.uint64(29)
    return np.bincount((grams * np.uint64(MIX[0]) >> np.uint64(49)).astype(np.int64), minlength=FEATURES)


@dataclass
class Model:
    """weights: (features, languages), the inverse document frequencies included."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        logits = (counts @ self.weights * (SCALE / counts.sum()) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


class Ftrl:
    """Follow-the-regularised-leader, per-coordinate rates, elastic net."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1.0
        g = x[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def learnable(id_col: str, lang_col: str, held_out: Column) -> Column:
    return F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(rows that have each feature, rows) over all of texts(text)."""

    def run(batches):
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                counts = gram_counts(text) if text else None
                if counts is not None:
                    total += counts > 0
                rows += 1
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.r_[seen, -1]), pa.array(np.r_[total[seen], rows])], names=["feature", "n"])

    # One row per task and feature, then FEATURES + 1 rows at most.
    parts = texts.mapInArrow(tidy(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df, rows = np.zeros(FEATURES, np.int64), 0
    for r in parts.collect():
        if r["feature"] < 0:
            rows = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, rows


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, epochs: int = 3) -> Model:
    """Learns from rows with an id and a language that are not held out.

    The document frequencies cover all of them; the weights and the temperature see a hashed
    sample of about `sample` rows (the documented bound of what the driver gets), shared evenly
    by the languages. A language needs LEAST rows of it, so at most sample // LEAST languages can
    be learnt: the most frequent ones, by name among equals. Null texts count as empty, repeated
    rows as several; without a usable row nothing is learnt and all is `und`.
    """
    usable = docs.where(learnable(id_col, lang_col, held_out))
    own = usable.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    sizes = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, sample // LEAST)).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0))
    df, rows = document_frequencies(own.select("text"))
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0

    quota = max(1, sample // len(languages))
    share = {r["lang"]: min(1.0, quota / r["count"]) for r in sizes}
    unit = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    pick = F.lit(False)
    for lang, part in share.items():
        pick = pick | ((F.col("lang") == lang) & (unit < part))

    def vectors(batches):
        for batch in small(batches):
            out = []
            for key, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = gram_counts(text)
                if counts is not None:
                    seen = np.flatnonzero(counts)
                    out.append((key, lang, seen.astype(np.int32).tobytes(), counts[seen].astype(np.int32).tobytes()))
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "lang", "f", "n"])

    # The sample is hashed, so its size only varies a little; the limit makes the bound strict, by the hash too.
    picked = own.where(pick).mapInArrow(tidy(vectors), "id string, lang string, f binary, n binary")
    got = picked.orderBy(F.xxhash64("id"), "id", "lang", "f").limit(2 * sample + 2 * len(languages)).collect()
    got.sort(key=lambda r: (r["id"][::-1], r["lang"], r["f"]))
    examples = []
    for r in got:
        f, n = np.frombuffer(r["f"], np.int32), np.frombuffer(r["n"], np.int32)
        examples.append((np.r_[f, FEATURES], np.r_[n * idf[f] * (SCALE / n.sum()), 1.0], languages.index(r["lang"])))
    rng = np.random.default_rng(7)
    rng.shuffle(examples)
    cut = len(examples) // 5
    seen, unseen = examples[cut:], examples[:cut]
    model = Ftrl(FEATURES, len(languages), alpha=0.5, beta=1.0, l1=0.02, l2=0.1)
    for _ in range(epochs):
        for k in rng.permutation(len(seen)):
            model.learn(*seen[k])
    w = model.weights(slice(None))
    return Model(languages, w[:-1] * idf[:, None], w[-1], temperature([(x @ w[f], y) for f, x, y in unseen]))


def temperature(scored: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of the least log loss, by golden section on its logarithm.

    The targets are (n + 1) / (n + 2) for the right language, the rest for the others: n examples
    without an error don't prove certainty.
    """
    if not scored or len(scored[0][0]) < 2:
        return 1.0
    logits, labels = np.array([s for s, _ in scored]), np.array([y for _, y in scored])
    doubt = 1.0 / (len(labels) + 2)
    targets = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    targets[np.arange(len(labels)), labels] = 1.0 - doubt

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (z * targets).sum(axis=1)).mean())

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs plus the columns `into`: lang_pred and score (0 to 1), from the whole text alone.

    A null or empty text or one without letters gets `und` and 0, as does everything if no
    language could be learnt; equal probabilities go to the first language by name. Repeated
    rows get equal results, an empty table stays empty, other columns pass through, whatever their
    names, and own columns named as in `into` (case aside) are replaced.
    """
    text_at, keep = place_of(docs, text_col), kept_places(docs, into)

    def run(batches):
        for batch in small(batches):
            found = [model.predict(t) for t in batch.column(0).to_pylist()]
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.record_batch([*batch.columns[1:], *made], names=[*(f"c{i}" for i in keep), "lang", "score"])

    rows = numbered_columns(docs).select(F.col(f"c{text_at}").alias("text"), *[f"c{i}" for i in keep])
    schema = schema_of(docs, keep, lang=T.StringType(), score=T.DoubleType())
    return rows.mapInArrow(tidy(run), schema).toDF(*[docs.columns[i] for i in keep], *into)


def held_out(id_col: str = "doc_id") -> Column:
    """The fixed fold that is never learnt from; false for a null id, which isn't learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
