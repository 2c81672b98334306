"""Best-fit packing with Martello-Toth dominance reduction.

Only the lengths matter to a packing, so the instance is the histogram of piece lengths: at most
`capacity` counts, whatever the size of the corpus. The driver packs the histogram, treating equal
sequences as one pattern with a count, and gets a list of runs (length, ranks from..to -> sequences
and place). The pieces get their rank among those of their length and look up their run.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvid.llm.common import checkpoint, small, tidy, worker_state

CAPACITY, EOS = 2048, 0
#: Words whose ids one Python worker keeps.
CACHED = 700_000
#: Ranks are counted in this many parts of each length, so that a hot length is no single task.
PARTS = 64


class Words:
    """A tokenizer that keeps the ids of the strings between blanks, which are encoded by themselves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ids: dict[str, bytes] = {"": b""}
        # Between a letter and the closing marks at a chunk's end the pattern always cuts.
        self.tail = re.compile(r"([.,!?;:])(?<=[a-z].)([.,!?;:]*)(?=[ \n]|$)")
        self.plain = re.compile(r"[a-z]+").fullmatch

    def chunks(self, text: str) -> list[str]:
        """Parts that the tokenizer encodes alike alone and in the text."""
        try:  # of these characters each has one small letter, the one that the tokenizer takes
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return self.tail.sub(r" \1\2", text).replace("\n", " ").split(" ")

    def fresh(self, chunks: set[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if self.plain(c)]
        other = list(chunks.difference(plain))
        # Byte-level marks leave small letters as they are: the model can take such words at once.
        tokenize, pack = self.model.tokenize, struct.pack
        made = {}
        for c in plain:
            ids = [t.id for t in tokenize(c)]
            made[c] = pack(f"<{len(ids)}I", *ids)
        for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            made[c] = pack(f"<{len(e.ids)}I", *e.ids)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, little-endian unsigned 32 bits."""
        chunked = [self.chunks(t) for t in texts]
        known = self.ids
        made = self.fresh(set().union(*chunked).difference(known))
        if len(known) + len(made) > CACHED:
            return [b"".join([known[c] if c in known else made[c] for c in chunks]) for chunks in chunked]
        known.update(made)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in chunked]


def words(path: str) -> Words:
    """One for each Python worker, which is one of several on its machine: threads of its own would only hold memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    state = worker_state("tokenizer")
    if path not in state:
        state[path] = Words(path)
    return state[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents' ids plus EOS, cut only beyond the capacity."""

    def run(batches):
        for batch in small(batches):
            rows = []
            encode = words(tokenizer).encode
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(ids), 256):
                for i, raw in zip(ids[lo : lo + 256], encode(texts[lo : lo + 256])):
                    raw += EOS.to_bytes(4, "little")
                    for k in range(0, len(raw), 4 * capacity):
                        own = raw[k : k + 4 * capacity]
                        rows.append((i, k // (4 * capacity), k // 4, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


Run = tuple[int, int, int, int, int, int]


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction; takes the fixed sets (lengths, how many) out of counts.

    For a piece j, from the longest on, a set is fixed if it dominates every other feasible set
    with j, that is if whatever else could stand beside j can be exchanged for what does:
    - {j} if not even the shortest piece fits beside j;
    - {j, k} if they fill the sequence, or if no two pieces fit beside j and k is the longest
      that does;
    - {j, a, b} if they fill the sequence, no three pieces fit beside j, a is the longest that
      does and no length lies between a and b.
    What can't be decided stays for the best fit.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(counts)

    def take(*items: int) -> None:
        n = min(counts[x] // items.count(x) for x in items)
        fixed.append((items, n))
        for x in set(items):
            counts[x] -= n * items.count(x)
            if not counts[x]:
                del counts[x]
                del lengths[bisect_left(lengths, x)]

    def there(x: int, *but: int) -> bool:
        return counts.get(x, 0) > but.count(x)

    def decide(j: int) -> bool:
        room = capacity - j
        least: list[int] = []
        for x in lengths:
            least += [x] * min(3, counts[x] - (x == j))
            if len(least) >= 3:
                break
        if not least or least[0] > room:
            take(j)
            return True
        if there(room, j):
            take(j, room)
            return True
        at = bisect_left(lengths, room + 1) - 1
        at -= not there(lengths[at], j)
        a = lengths[at]
        if len(least) < 2 or least[0] + least[1] > room:
            take(j, a)
            return True
        b = room - a
        if (len(least) < 3 or sum(least[:3]) > room) and there(b, j, a) and b in (a, lengths[at - 1]):
            take(j, a, b)
            return True
        return False

    for j in lengths[::-1]:
        while j in counts and decide(j):
            pass
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: the same packing as piece by piece, with equal sequences as one."""
    open_by: dict[int, list[list]] = {}
    rooms: list[int] = []

    def add(items: tuple[int, ...], n: int) -> None:
        room = capacity - sum(items)
        if room not in open_by:
            open_by[room] = []
            insort(rooms, room)
        open_by[room].append([items, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    add((length,) * each, left // each)
                if left % each:
                    add((length,) * (left % each), 1)
                break
            room = rooms[at]
            items, n = open_by[room].pop()
            if not open_by[room]:
                del open_by[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                add(items + (length,) * each, full)
                left -= full * each
                n -= full
            if n and left:  # fewer are left than one sequence takes
                add(items + (length,) * left, 1)
                left, n = 0, n - 1
            if n:
                add(items, n)
    return [(tuple(items), n) for group in open_by.values() for items, n in group]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs (length, first rank, past rank, first sequence, pieces of the run per sequence, offset) and the number of sequences."""
    counts = {k: v for k, v in counts.items() if v}
    total = 0
    patterns = reduce_dominated(counts, capacity)
    patterns += best_fit(counts, capacity)
    used: dict[int, int] = {}
    runs: list[Run] = []
    for items, n in patterns:
        at = 0
        for length in dict.fromkeys(items):
            each = items.count(length)
            first = used.get(length, 0)
            used[length] = first + each * n
            runs.append((length, first, first + each * n, total, each, at))
            at += each * length
        total += n
    return runs, total


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts(..., doc_id, piece, length) with sequence_id and offset (no gaps, from 0)."""
    parts = parts.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int"))
    # At most capacity * PARTS rows, whatever the input.
    table = parts.groupBy("length", "_part").count().collect()
    counts: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for r in sorted(table, key=lambda r: (r["length"], r["_part"])):
        offsets[r["length"], r["_part"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    runs, _ = plan(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 6)
    starts = np.zeros((capacity + 1, PARTS), np.int64)
    for (length, part), first in offsets.items():
        starts[length, part] = first

    def place(batches):
        for batch in batches:
            names = batch.schema.names
            get = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False)
            length = get("length")
            rank = starts[length, get("_part")] + get("_rank")
            # Runs are sorted by length and first rank; ranks stay far below 2**44.
            run = table[np.searchsorted(table[:, 0] << 44 | table[:, 1], length << 44 | rank, "right") - 1]
            nth = rank - run[:, 1]
            made = [pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)]
            keep = [c for c in names if c not in ("_part", "_rank")]
            yield pa.record_batch([*(batch.column(names.index(c)) for c in keep), *made], names=[*keep, "sequence_id", "offset"])

    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = parts.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "_part"]
    return ranked.mapInArrow(tidy(place), ", ".join([*keep, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A null text counts as empty and still gives its EOS. Rows are documents of their own, so
    repeated rows are packed again, and null ids are kept. An empty table gives no rows; other
    columns are not read.
    """
    return pack(checkpoint(pieces(docs, tokenizer, capacity, id_col, text_col)), capacity)
