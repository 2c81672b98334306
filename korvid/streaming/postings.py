"""An index that follows a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from korvid.operators.text import StoredIndex, build_index, open_index


def follow(docs: DataFrame, id_col: str, text_col: str, path: str, checkpoint: str, language: str | None = None) -> StreamingQuery:
    """Adds each micro-batch as a segment of the stored index at path, which open_index reads.

    A segment has its batch's number, so a batch that is run again after a failure replaces its
    rows instead of doubling them. Many small segments are for StoredIndex.consolidate, which gives
    numbers up: run it when the stream stands.
    """

    def write(batch: DataFrame, number: int) -> None:
        index = build_index(batch, id_col, text_col, language, simple=language is None)
        held = open_index(batch.sparkSession, path) or StoredIndex(batch.sparkSession, path, language)
        held.segments = [s for s in held.segments if s["name"] != f"batch-{number}"]
        held.add(index, f"batch-{number}", consolidate=False).save()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
