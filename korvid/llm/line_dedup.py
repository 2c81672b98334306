"""Line dedup: hash normalised lines, count documents per hash, drop and reassemble."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvid.llm.common import as_bytes, checkpoint, kept_places, numbered_columns, place_of, schema_of, small, tidy, worker_state

SPACE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key has fewer code points than min_chars."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", into: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the text's common lines dropped, plus the columns `into`: n_lines and n_dropped.

    A line goes if its key (stripped of ASCII white space, A-Z lower-cased) has at least
    min_chars code points and stands in at least min_docs documents, unless this row's id is the
    largest among them. A document is an id: repeated rows of one id count once, and all of them
    keep a line whose largest id is theirs. Rows with a null id are no documents: they neither
    count nor lose anything. A null text counts as one empty line and comes back empty. An empty
    table stays empty; other columns pass through, whatever their names, and own columns named as
    in `into` (case aside) are replaced.
    """

    def hashes(batches):
        worker_state("line_dedup")
        for batch in small(batches):
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {h for line in text.split(b"\n") if (h := line_hash(line, min_chars))}
                ids += [i] * len(own)
                out += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "hash"])

    def rebuild(batches):
        worker_state("line_dedup")
        for batch in small(batches):
            texts, total, gone = [], [], []
            for text, drops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = text.split(b"\n")
                left = lines
                if drops:
                    drops = frozenset(drops)
                    left = [x for x in lines if line_hash(x, min_chars) not in drops]
                texts.append(text if len(left) == len(lines) else b"\n".join(left))
                total.append(len(lines))
                gone.append(len(lines) - len(left))
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary())]
            yield pa.record_batch([*batch.columns[2:], *made], names=[*(f"c{i}" for i in rest), "total", "gone", "whole"])

    id_at, text_at = place_of(docs, id_col), place_of(docs, text_col)
    keep = kept_places(docs, into)
    rest = [i for i in keep if i != text_at]
    own = numbered_columns(docs)
    key = F.col(f"c{id_at}").cast("long")
    # One row for each row and distinct hash: the count needs no distinct and combines before the shuffle.
    lines = own.where(key.isNotNull()).select(key.alias("id"), as_bytes(f"c{text_at}").alias("text")).mapInArrow(tidy(hashes), "id long, hash binary")
    # Several rows of one id are rare: where the rows reach min_docs their ids are counted, else they can't.
    counted = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    # Cut off from its aggregation, so that a join on a line of very many documents can be split.
    common = checkpoint(counted)
    twice = own.where(key.isNotNull()).groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        pairs = lines.join(common.select("hash"), "hash", "left_semi").groupBy("hash", "id").agg(F.lit(1).alias("one"))
        common = checkpoint(pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs))
    drops = lines.join(common, "hash").where("id < last").groupBy(F.col("id").alias("drop_id")).agg(F.collect_set("hash").alias("drops"))
    base = own.select(as_bytes(f"c{text_at}").alias("text"), key.alias("key"), *[f"c{i}" for i in rest])
    # The small side is built into hash tables: the texts are shuffled once and never sorted.
    joined = base.join(drops.hint("shuffle_hash"), F.col("key") == F.col("drop_id"), "left").select("text", "drops", *[f"c{i}" for i in rest])
    schema = schema_of(docs, rest, total=T.LongType(), gone=T.LongType(), whole=T.BinaryType())
    made = joined.mapInArrow(tidy(rebuild), schema)
    order = [F.col("whole").cast("string") if i == text_at else F.col(f"c{i}") for i in keep]
    return made.select(*order, "total", "gone").toDF(*[docs.columns[i] for i in keep], *into)
