"""Suffix-array dedup of long repeated byte strings.

Only some suffixes are sorted: those at anchors. The anchor of a window of `length` bytes is the
place in it of the least hash of GRAM bytes, so equal windows have their anchor at the same
offset, and each window is compared with windows of anchors with equal leading tokens only. An
anchor owns a run of windows, given by the distances lo..hi from their starts to the anchor; its
segment is the bytes of those windows.

1. Anchors with a head (hash of the leading tokens) that stands once are dropped; segments that
   are equal as a whole are one class, of which one member is sorted and all are repeated.
2. The classes' suffixes are range-partitioned by leading tokens with sampled splitters. A bucket
   sorts them by multikey quicksort, to the right and, reversed, to the left of the anchor. The
   neighbours' common prefixes give, for every distance s, who agrees with whom on the s bytes
   before and the length - s bytes after the anchor; who agrees on both has an equal window.
3. Splitters are whole leading tokens, so no group lies on both sides of a boundary. A group too
   large for one bucket gets longer leading tokens instead: its windows are cut into blocks of
   distances, and each block's key is the bytes that all of its windows share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import as_bytes, checkpoint, numbered_columns, place_of, small, stored, worker_state

#: Bytes that make a head; windows need at least twice as many.
GRAM = 64
#: Classes that one bucket may hold of one group.
GROUP = 256
#: Suffixes that a bucket sorts at once, but for the rest of the last group.
STRETCH = 16384
#: Each time leading tokens grow, blocks of distances shrink by this factor.
BRANCH = 7
#: Keys with so many rows are dealt to several tasks; at most HOT_KEYS of them, those with the most rows.
SPLIT, HOT_KEYS = 256, 10_000
#: Bytes hashed at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
MARK = "did long, tid long, pos long, lo int, hi int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n at least."""
    state = worker_state("powers")
    if len(state.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for table, x in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
            table[0] = 1
            done = 1
            while done < size:
                take = min(done, size - done)
                table[done : done + take] = table[:take] * np.uint64(pow(x, done, 1 << 64))
                done += take
        state["up"], state["down"] = up, down
    return state["up"], state["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int, gram: int) -> list[np.ndarray]:
    """pos, lo, hi, head and body (two words, the XXH3 digest of the whole segment) of the text's anchors."""
    found = [_anchors(text[at : at + PIECE + length - 1], length, gram, at) for at in range(0, max(1, len(text) - length + 1), PIECE)]
    return [np.concatenate(x) for x in zip(*found)]


def _anchors(text: bytes, length: int, gram: int, shift: int) -> list[np.ndarray]:
    n = len(text)
    if n < length:
        return [np.zeros(0, np.int64)] * 6
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    heads = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # The least hash of each window, the leftmost on ties: by its upper bits and then its place.
    m, width = len(heads), length - gram + 1
    low = np.full(-(-m // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    low[:m] = heads & ~np.uint64(0xFFFFFF) | np.arange(m, dtype=np.uint64)
    rows = low.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(right[: m - width + 1], left[width - 1 : m]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    pos = at[first]
    lo, hi = pos - last, pos - first
    spots = zip(first.tolist(), (last + length).tolist(), (lo * length + hi).tolist())
    body = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:z], seed) for a, z, seed in spots]), np.int64).reshape(-1, 2)
    return [pos + shift, lo, hi, heads[pos].view(np.int64), body[:, 0], body[:, 1]]


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows (width a multiple of 8) and each one's common prefix with the one before.

    Multikey quicksort over tokens of eight bytes, all parts of a round at once: a part is split by
    the token of its middle row in smaller, equal and larger rows, and its equal rows go on with
    the next token.
    """
    words = rows.view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    places, part, depth = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    while len(places):
        # places: where the unsettled rows stand; part: their parts' numbers, in order; depth: their parts' tokens.
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[starts, len(places)])
        token = words[order[places], depth]
        pivot = np.repeat(token[starts + sizes // 2], sizes)
        side = 3 * np.repeat(np.arange(len(starts)), sizes) + 1 + (token > pivot) - (token < pivot)
        turn = np.argsort(side, kind="stable")
        order[places], side, depth = order[places][turn], side[turn], depth[turn]
        depth = depth + (side % 3 == 1)
        new = np.r_[True, side[1:] != side[:-1]]
        alone = new & np.r_[new[1:], True]
        left = ~alone & (depth < words.shape[1])
        places, part, depth = places[left], side[left], depth[left]
    common = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 4096):
        a, b = rows[order[at - 1 : at + 4095][: len(order[at : at + 4096])]], rows[order[at : at + 4096]]
        differ = a != b
        common[at : at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, common


def repeated_windows(segments: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, least s, greatest s) of all runs of distances whose windows equal another row's."""
    n, deep = len(segments), int(hi.max(initial=0))
    wide = -(-max(8, length) // 8) * 8
    back = -(-max(8, deep) // 8) * 8
    after = np.frombuffer(b"".join([s[h:].ljust(wide, b"\0") for s, h in zip(segments, hi.tolist())]), np.uint8).reshape(n, wide)
    before = np.frombuffer(b"".join([s[:h][::-1].ljust(back, b"\0") for s, h in zip(segments, hi.tolist())]), np.uint8).reshape(n, back)
    (right, right_common), (left, left_common) = multikey_sort(after), multikey_sort(before)
    same = np.zeros((deep + 3, n), bool)
    right_id, left_id = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(int(lo.min(initial=0)), deep + 1):
        own = np.flatnonzero((lo <= s) & (hi >= s))
        if len(own) < 2:
            continue
        right_id[right] = np.cumsum(right_common < length - s)
        left_id[left] = np.cumsum(left_common < s) if s else 0
        key = right_id[own] * (n + 1) + left_id[own]
        order = np.argsort(key, kind="stable")
        equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        same[s + 1, own[order[equal]]] = True
        same[s + 1, own[order[equal + 1]]] = True
    turns = same[1:] != same[:-1]
    row, edge = np.nonzero(turns.T)  # the edges of each row's runs come in pairs
    return list(zip(row[::2].tolist(), edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


_SPOT = ["did", "tid", "pos", "lo", "hi"]
_SPOT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _resolve(rows: DataFrame, length: int) -> DataFrame:
    """rows(lead, did, tid, pos, lo, hi, seg) -> marks(did, tid, pos, lo, hi) of the repeated windows."""

    def solve(held):
        did, tid, pos, lo, hi, seg = ([x for part in held for x in part[c]] for c in range(6))
        found = repeated_windows(seg, np.array(lo), np.array(hi), length)
        return _batch([(did[i], tid[i], pos[i], a, b) for i, a, b in found], _SPOT, _SPOT_KINDS)

    def run(batches):
        # A bucket is taken in stretches that end between two leads.
        held, size, before = [], 0, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            at = 0
            for k, lead in enumerate(cols[6]):
                if lead != before:
                    if size + k - at >= STRETCH:
                        held.append([c[at:k] for c in cols[:6]])
                        yield solve(held)
                        held, size, at = [], 0, k
                    before = lead
            held.append([c[at:] for c in cols[:6]])
            size += len(cols[6]) - at
        if size:
            yield solve(held)

    dealt = rows.repartitionByRange("lead").sortWithinPartitions("lead").select(*_SPOT, "seg", "lead")
    return dealt.mapInArrow(run, MARK)


def _longer_leads(rows: DataFrame, width: int, length: int, deepest: int) -> DataFrame:
    """Cuts each row's distances into blocks of the width and keys them by the bytes all their windows share."""

    def run(batches):
        for batch in small(batches):  # a segment becomes up to BRANCH pieces
            out = []
            for did, tid, pos, lo, hi, seg in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for first in range(lo // width * width, hi + 1, width):
                    last = min(first + width - 1, deepest)
                    a, b = max(lo, first), min(hi, last)
                    own = seg[hi - b : hi - a + length]
                    lead = xxhash.xxh3_128_digest(own[b - first : b - last + length] + first.to_bytes(4, "little"))
                    out.append((lead, xxhash.xxh3_128_digest(own + a.to_bytes(4, "little")), did, tid, pos, a, b, own))
            yield _batch(out, ["lead", "whole", *_SPOT, "seg"], [pa.binary(), pa.binary(), *_SPOT_KINDS, pa.binary()])

    schema = "lead binary, whole binary, did long, tid long, pos long, lo int, hi int, seg binary"
    return rows.select(*_SPOT, "seg").mapInArrow(run, schema)


def _own_repeats(found: list[np.ndarray], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A text's anchors, each class once with its number n, and marks for the classes that stand in it repeatedly.

    Periodic texts have one class at very many places: it is settled here and counts as one row.
    A mark stands for the bytes pos - hi to pos - lo + length.
    """
    pos, lo, hi, head, body, more = found
    order = np.lexsort((more, body, head))
    key = np.stack([head, body, more], axis=1)[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)][: len(key)])
    n = np.diff(np.r_[first, len(key)])
    rows = [*(x[order[first]] for x in found), n]
    many = np.sort(order[np.repeat(n > 1, n)])
    start, end = pos[many] - hi[many], np.maximum.accumulate(pos[many] - lo[many] + length) if len(many) else many
    cut = np.flatnonzero(np.r_[True, start[1:] > end[:-1]][: len(many)])
    a, z = start[cut], end[np.r_[cut[1:], len(many)] - 1] if len(many) else end
    return rows, [a, length - (z - a), np.zeros_like(a)]


def _anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """Anchors with head, body, more (the rest of it) and n; rows with n = 0 are marks."""

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in small(batches):
            did, tid, texts = (batch.column(i).to_pylist() for i in range(3))
            made = [_own_repeats(anchors(t, length, gram_of(length)), length) for t in texts]
            many = [len(rows[0]) + len(marks[0]) for rows, marks in made]
            cols = [pa.array([x for i, n in zip(own, many) for x in [i] * n], pa.int64()) for own in (did, tid)]
            for k, kind in enumerate(kinds):
                parts = [x for rows, marks in made for x in (rows[k], marks[k] if k < 3 else np.zeros(len(marks[0]), np.int64))]
                cols.append(pa.array(np.concatenate(parts) if parts else [], kind))
            yield pa.record_batch(cols, names=[*_SPOT, "head", "body", "more", "n"])

    return docs.select("did", "tid", "text").mapInArrow(run, f"{MARK}, head long, body long, more long, n long")


def gram_of(length: int) -> int:
    return max(1, min(GRAM, length // 2))


def _cut_segments(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The segments of the wanted(did, tid, pos, lo, hi, d) anchors."""

    def run(batches):
        for batch in small(batches):
            out = []
            unpack = zstandard.ZstdDecompressor().decompress
            for did, tid, packed, spots in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = unpack(packed)
                out += [(did, tid, x["pos"], x["lo"], x["hi"], text[x["pos"] - x["hi"] : x["pos"] - x["lo"] + length], x["d"]) for x in spots]
            yield _batch(out, [*_SPOT, "seg", "d"], [*_SPOT_KINDS, pa.binary(), pa.int64()])

    spots = wanted.groupBy("did", "tid").agg(F.collect_list(F.struct("pos", "lo", "hi", "d")).alias("spots"))
    return _by_row(texts, spots, "inner").select("did", "tid", "packed", "spots").mapInArrow(run, f"{MARK}, seg binary, d long")


def _by_row(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Joins on (did, tid), null ids included; the texts are shuffled but never sorted."""
    other = other.withColumnsRenamed({"did": "_did", "tid": "_tid"})
    same = F.col("did").eqNullSafe(F.col("_did")) & (F.col("tid") == F.col("_tid"))
    return texts.join(other.hint("shuffle_hash"), same, how).drop("_did", "_tid")


def _having(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that have one of the keys of found(keys, n), n being about its number of rows.

    A key with many rows stands once for each part of its rows. "Many" is the least power of two
    from SPLIT on that at most HOT_KEYS keys reach, so the table of them that every task gets is bounded.
    """
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["k"] for r in found.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    p = SPLIT.bit_length() - 1
    while sum(k for q, k in sizes.items() if q >= p) > HOT_KEYS:
        p += 1
    if max(sizes, default=0) < p:
        return rows.join(found.select(*keys), keys)
    parts = F.when(power >= p, F.ceil(F.col("n") / (1 << p)).cast("int")).otherwise(1)
    hot = found.where(power >= p).select(*keys, parts.alias("parts"))
    # A stored table is read in the same order again, so a row's part is the same when a task is repeated.
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("part", F.floor(F.rand(5) * F.coalesce("parts", F.lit(1))).cast("int"))
    spread = found.select(*keys, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(spread, [*keys, "part"]).drop("part", "parts")


def _repeats(table: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """marks(did, tid, pos, lo, hi): the runs of windows that stand elsewhere too.

    table: all anchors and the texts' own marks; texts(did, tid, packed): the compressed texts.
    """
    one = F.min(F.struct(*_SPOT)).alias("one")
    n = F.count(F.lit(1))
    marks = [table.where("n = 0").select(*_SPOT)]
    found = table.where("n > 0")
    heads = checkpoint(found.groupBy("head").agg(F.sum("n").alias("n")).where("n > 1"))
    found = stored(_having(found, heads, ["head"]))  # else the classes would be counted by the join's partitions
    classes = checkpoint(found.groupBy("head", "body", "more").agg(F.sum("n").alias("n"), one))
    copies = classes.where("n > 1").select("head", "body", "more", "n")
    marks.append(_having(found.where("n = 1"), copies, ["head", "body", "more"]).select(*_SPOT))

    # What is left to compare: a member of each class whose head other classes have too.
    sizes = checkpoint(classes.groupBy("head").agg(n.alias("d")).where("d > 1"))
    rows = stored(_cut_segments(texts, classes.join(sizes, "head").select("one.*", "d"), length))
    lead = F.substring(F.col("seg"), F.col("hi") + 1, F.lit(gram_of(length)))
    marks.append(_resolve(rows.where(F.col("d") <= GROUP).withColumn("lead", lead), length))

    # Groups too large for a bucket: longer leading tokens, by ever smaller blocks of distances.
    deepest = length - gram_of(length)
    width = BRANCH
    while width < deepest + 1:
        width *= BRANCH
    large = rows.where(F.col("d") > GROUP)
    while width > 1 and not large.isEmpty():
        width //= BRANCH
        cut = stored(_longer_leads(large, width, length, deepest))
        classes = checkpoint(cut.groupBy("lead", "whole").agg(n.alias("n"), one))
        copies = classes.where("n > 1").select("lead", "whole", "n")
        marks.append(_having(cut, copies, ["lead", "whole"]).select(*_SPOT))
        sizes = checkpoint(classes.groupBy("lead").agg(n.alias("d")).where("d > 1"))
        chosen = classes.join(sizes, "lead").select("lead", "one.*", "d")
        rows = stored(cut.join(chosen, ["lead", *_SPOT]).select("lead", *_SPOT, "seg", "d"))
        marks.append(_resolve(rows.where(F.col("d") <= GROUP), length))
        large = rows.where(F.col("d") > GROUP)
    found_all = marks[0]
    for more in marks[1:]:
        found_all = found_all.unionByName(more)
    return found_all


def drop_repeated(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for every row of docs.

    A byte of the text's UTF-8 goes if it is in a string of `length` bytes that starts at another
    place too, in the same text or another; strings are judged on the texts as they are given.
    spans: array of struct(start, end), the maximal removed runs; kept: the other bytes (binary,
    as a cut may fall inside a character).

    A null text counts as empty; texts below the length lose nothing. Rows are documents of
    their own: repeated rows repeat each other, whatever their ids. Null ids are kept. An empty
    table gives none; other columns are not read. Equality of whole segments is taken from their
    128-bit XXH3 digest, that of single windows from their bytes (but in groups of over GROUP).
    """
    own, key = numbered_columns(docs), f"c{place_of(docs, id_col)}"
    text = as_bytes(f"c{place_of(docs, text_col)}")
    rows = own.select(F.col(key).cast("long").alias("did"), F.xxhash64(text).alias("tid"), text.alias("text"))

    def pack(batches):
        for batch in small(batches):
            squeeze = zstandard.ZstdCompressor(level=1).compress
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(map(squeeze, batch.column(2).to_pylist()), pa.binary())], names=["did", "tid", "packed"])

    def rebuild(batches):
        for batch in small(batches):
            out = []
            unpack = zstandard.ZstdDecompressor().decompress
            for did, packed, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text, spans = unpack(packed), []
                for r in sorted(ranges or (), key=lambda r: r["a"]):
                    if spans and r["a"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], r["b"])
                    else:
                        spans.append({"start": r["a"], "end": r["b"]})
                kept, at = [], 0
                for x in spans:
                    kept.append(text[at : x["start"]])
                    at = x["end"]
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((did, len(text), len(text) - len(left), spans, left))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield _batch(out, ["doc_id", "n_bytes", "n_removed", "spans", "kept"], kinds)

    texts = rows.mapInArrow(pack, "did long, tid long, packed binary")
    marks = _repeats(stored(_anchor_table(rows, length)), texts, length)
    span = F.struct((F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + length).alias("b"))
    ranges = marks.groupBy("did", "tid").agg(F.collect_list(span).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return _by_row(texts, ranges, "left").select("did", "packed", "ranges").mapInArrow(rebuild, schema)
