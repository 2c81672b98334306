"""SimHash near-dedup by bit-sliced comparison.

Fingerprints whose distance is at most 2 agree on at least two of four 16-bit blocks, so six
tables keyed by two blocks hold every such pair in one bucket. Inside a bucket the fingerprints
stand as bit planes, 64 to a machine word: one exclusive-or compares a fingerprint's bit with 64
others, carry-save counters add up the distances, and blocks of 64 that have all gone beyond the
radius are abandoned. A bucket gives the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import as_bytes, checkpoint, numbered_columns, place_of, small
from korvid.llm.components import connected_components

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Shingles counted at once; below 65536, so that 16-bit counters can't overflow.
SEGMENT = 32768
#: Larger buckets are divided by the blocks that their key leaves out.
WIDE = 4096


def _spread() -> np.ndarray:
    """Of each byte value, its eight bits, most significant first, as 16-bit lanes in two words."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits.astype(np.uint16)).view(np.uint64)


def shingle_digests(text: bytes, width: int) -> tuple[bytes, int]:
    """The big-endian XXH64 digests of a text's word shingles, one after the other, and their number."""
    words = text.lower().split()
    if not words:
        return b"", 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < width:
        return digest(joined, 42), 1
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])]), len(starts)


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """One 64-bit fingerprint (as int64) for each text."""
    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    spread, parts, owners, held = _spread(), [], [], 0

    def flush() -> None:
        lanes = spread[np.frombuffer(b"".join(parts), np.uint8)].reshape(-1, 16)
        starts = np.cumsum([0, *(len(p) // 8 for p in parts[:-1])])
        sums = np.ascontiguousarray(np.add.reduceat(lanes, starts, axis=0)).view(np.uint16)
        np.add.at(counts, np.array(owners), sums)

    for i, text in enumerate(texts):
        digests, totals[i] = shingle_digests(text, width)
        for at in range(0, len(digests), SEGMENT * 8):
            part = digests[at : at + SEGMENT * 8]
            if held + len(part) > SEGMENT * 8 and parts:
                flush()
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(i)
            held += len(part)
    if parts:
        flush()
    return np.packbits(2 * counts > totals[:, None], axis=1).reshape(-1).view(">i8").astype(np.int64)


def with_fingerprint(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): every row's fingerprint as a signed long, and a hash of its text."""

    def run(batches):
        for batch in small(batches):
            fps = fingerprints(batch.column(2).to_pylist(), width)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, fp long")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): the text as bytes, empty for null."""
    text = as_bytes(f"c{place_of(docs, text_col)}")
    return numbered_columns(docs).select(F.col(f"c{place_of(docs, id_col)}").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """values: (blocks, 64) fingerprints -> (blocks, 64) planes; plane p has bit p of all 64 lanes."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within_radius(queries: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each query and its own block of planes, the lanes (of those given) within the radius.

    The distances are held as carry-save counters: one word for each binary digit and one for
    lanes that went beyond the radius, where they stay.
    """
    hits = np.zeros(len(queries), np.uint64)
    alive = np.arange(len(queries))
    digits = [np.zeros(len(queries), np.uint64) for _ in range((radius + 1).bit_length())]
    over = ~lanes
    for p in range(64):
        carry = planes[alive, p] ^ (np.uint64(0) - ((queries[alive] >> np.uint64(p)) & np.uint64(1)))
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        beyond = np.full(len(alive), FULL)
        for k, digit in enumerate(digits):
            beyond &= digit if (radius + 1) >> k & 1 else ~digit
        over = over | beyond
        if p % 8 == 7:
            keep = over != FULL
            alive, over, digits = alive[keep], over[keep], [d[keep] for d in digits]
            if not len(alive):
                break
    hits[alive] = ~over
    return hits


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] for all i; a label is the smallest index of its class."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return
        np.minimum.at(labels, la, np.minimum(la, lb))
        np.minimum.at(labels, lb, np.minimum(la, lb))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def bucket_classes(values: np.ndarray, bucket: np.ndarray, radius: int, free: tuple[int, ...]) -> np.ndarray:
    """Labels of the classes linked inside the buckets; bucket holds nondecreasing numbers.

    free: the 16-bit blocks that the buckets' key leaves out.
    """
    labels = np.arange(len(values))
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(values)])
    for s, n in zip(starts[sizes > WIDE], sizes[sizes > WIDE]):
        _divide(values, labels, np.arange(s, s + n), radius, [(16 * k, 16) for k in free])
    small = (sizes > 1) & (sizes <= WIDE)
    _compare(values, labels, starts[small], sizes[small], radius)
    return labels


def _divide(values: np.ndarray, labels: np.ndarray, rows: np.ndarray, radius: int, free: list[tuple[int, int]]) -> None:
    """A wide bucket: of the bits that are still free, cut in radius + 1 parts, one must agree."""
    total = sum(n for _, n in free)
    places = [p for first, n in free for p in range(first, first + n)]
    cuts = [round(total * k / (radius + 1)) for k in range(radius + 2)]
    for lo, hi in zip(cuts, cuts[1:]):
        key = np.zeros(len(rows), np.uint64)
        for p in places[lo:hi]:
            key = key << np.uint64(1) | (values[rows] >> np.uint64(p)) & np.uint64(1)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sizes = np.diff(np.r_[starts, len(rows)])
        inner = np.arange(len(rows))
        left = [(p, 1) for p in places[:lo] + places[hi:]]
        deep = (sizes > WIDE) & (len(left) > radius + 1)
        for s, n in zip(starts[deep], sizes[deep]):
            _divide(values, labels, rows[order[s : s + n]], radius, left)
        flat = (sizes > 1) & ~deep
        _compare(values[rows[order]], inner, starts[flat], sizes[flat], radius)
        merge(labels, rows[order], rows[order[inner]])


def _compare(values: np.ndarray, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> None:
    """Merges the classes of all fingerprints of a bucket that are within the radius."""
    for a, b in hits(values, starts, sizes, radius):
        merge(labels, a, b)


def hits(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, most: int = 1 << 16):
    """Compares all fingerprints of each bucket by blocks of 64; yields the pairs (rows, rows) within the radius.

    A bucket is `sizes` values from `starts`; a block's own rows come with themselves too.
    """
    if not len(starts):
        return
    blocks = -(-sizes // 64)
    first = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    owner = np.repeat(np.arange(len(starts)), blocks)
    base = starts[owner] + 64 * (np.arange(n) - first[owner])
    filled = np.minimum(64, starts[owner] + sizes[owner] - base)
    at = np.minimum(base[:, None] + np.arange(64), len(values) - 1)
    planes = bit_planes(values[at])
    lanes = np.where(filled == 64, FULL, (np.uint64(1) << (filled % 64).astype(np.uint64)) - np.uint64(1))
    last = first[owner] + blocks[owner]
    # A block's own fingerprints are compared with it and with the later blocks of its bucket.
    work = filled * (last - np.arange(n))
    ends = np.cumsum(work)
    done = 0
    while done < n:
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, "right")))
        mine = np.arange(done, upto)
        pair_from = np.repeat(mine, last[mine] - mine)
        offset = np.arange(len(pair_from)) - np.repeat(np.cumsum(last[mine] - mine) - (last[mine] - mine), last[mine] - mine)
        pair_to = pair_from + offset
        rows = np.repeat(np.arange(len(pair_from)), filled[pair_from])
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(filled[pair_from]) - filled[pair_from], filled[pair_from])
        query, block = base[pair_from[rows]] + inside, pair_to[rows]
        found = within_radius(values[query], planes[block], lanes[block], radius)
        some = np.flatnonzero(found)
        bits = np.unpackbits(found[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who, lane = np.nonzero(bits)
        yield query[some[who]], base[block[some[who]]] + lane
        done = upto


def linked(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps(fp long, distinct) -> links (src, dst) that connect what lies within the radius."""
    if radius != 2:
        raise ValueError("the tables of two blocks out of four are made for a radius of 2")
    pairs = list(combinations(range(4), 2))
    keys = [
        F.struct(F.lit(i).alias("tab"), F.shiftleft(part(a), 16).bitwiseOR(part(b)).alias("key"))
        for i, (a, b) in enumerate(pairs)
    ]
    rows = fps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.tab", "k.key", "fp")
    wide = checkpoint(rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select("tab", "key"))
    if not wide.isEmpty():
        # Of the 32 bits that a wide bucket's key leaves out, one of three parts must agree too. After
        # that a bucket has 42 bits in common, so no task gets more than 2**22 fingerprints of one.
        other = {i: tuple(sorted(set(range(4)) - set(ab))) for i, ab in enumerate(pairs)}
        free = F.coalesce(*[F.when(F.col("tab") == i, F.shiftleft(part(c), 16).bitwiseOR(part(d))) for i, (c, d) in other.items()])
        longer = [
            F.struct(
                (F.col("tab") * 3 + len(pairs) + k).alias("tab"),
                F.shiftleft("key", 11).bitwiseOR(F.shiftrightunsigned(free, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).alias("key"),
            )
            for k, (first, bits) in enumerate(((0, 11), (11, 11), (22, 10)))
        ]
        split = rows.join(wide, ["tab", "key"], "left_semi").select(F.explode(F.array(*longer)).alias("k"), "fp").select("k.tab", "k.key", "fp")
        rows = rows.join(wide, ["tab", "key"], "left_anti").unionByName(split)

    def classes(held):
        tab, key, fp = (np.concatenate(x) for x in zip(*held))
        bucket = np.cumsum(np.r_[0, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
        values, out = fp.view(np.uint64), []
        for t in np.unique(tab):
            own = np.flatnonzero(tab == t)
            first = t if t < len(pairs) else (t - len(pairs)) // 3
            labels = bucket_classes(values[own], bucket[own], radius, tuple(set(range(4)) - set(pairs[first])))
            other = np.flatnonzero(labels != np.arange(len(own)))
            out.append(pa.record_batch([pa.array(fp[own[other]]), pa.array(fp[own[labels[other]]])], names=["src", "dst"]))
        return out

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tab, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            whole = np.flatnonzero((tab != tab[-1]) | (key != key[-1]))
            if len(whole):  # all but the last bucket are complete
                cut = whole[-1] + 1
                held.append((tab[:cut], key[:cut], fp[:cut]))
                yield from classes(held)
                held = [(tab[cut:], key[cut:], fp[cut:])]
            elif held and (held[-1][0][-1] != tab[0] or held[-1][1][-1] != key[0]):
                yield from classes(held)
                held = [(tab, key, fp)]
            else:
                held.append((tab, key, fp))
        if held:
            yield from classes(held)

    dealt = rows.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
    return dealt.mapInArrow(run, "src long, dst long")


def part(k: int):
    """The k-th 16 bits of fp."""
    return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash) for every row of docs.

    Equal fingerprints are one node, so groups of copies cost one row. A null text counts as
    empty, and texts without words have fingerprint zero, linked like any other. A null doc_id
    is kept but never names a component (a component of nulls only has null). Repeated rows
    give repeated results; an empty table gives none; other columns of docs are not read.
    """
    prints = checkpoint(with_fingerprint(docs, width, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = connected_components(linked(nodes.select("fp"), radius))
    grouped = nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    grouped = checkpoint(grouped)
    least = grouped.groupBy("label").agg(F.min("low").alias("component_id"))
    names = grouped.join(least, "label").select("fp", "component_id")
    return prints.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None, width: int = 3, radius: int = 2) -> DataFrame:
    """docs without the rows whose near-duplicate component has a smaller doc_id.

    Without `least` texts are linked by their fingerprints alone, as in near_duplicates; with it,
    by a Jaccard of their shingle sets of `least` or more, as in shingles.alike. Rows with a null
    id stay, and rows that repeat both id and text stay or go together. An empty table gives
    none; other columns pass through, whatever their names.
    """
    if least is None:
        found = near_duplicates(docs, width, radius, id_col, text_col)
    else:
        from korvid.llm import shingles

        found = shingles.alike(docs, width, least, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("hash")).distinct()
    own = numbered_columns(docs)
    same = (F.col(f"c{place_of(docs, id_col)}").cast("long") == F.col("gone")) & (F.xxhash64(as_bytes(f"c{place_of(docs, text_col)}")) == F.col("hash"))
    # The ids are built into hash tables: the texts are shuffled once and never sorted.
    return own.join(gone.hint("shuffle_hash"), same, "left_anti").toDF(*docs.columns)
