"""SimHash near-dedup of texts with a Jaccard of their word shingles of at least `least`.

At a Jaccard of 0.8 two 64-bit fingerprints differ in about ten bits and in up to twenty, and no
table keyed by fingerprint bits is selective at that distance. So the buckets are keyed by 20
bands of 5 MinHash values of the same shingles: a pair of Jaccard J shares one with probability
1 - (1 - J**5)**20, which is 0.9996 at 0.8. Inside a bucket the fingerprints are compared bit-sliced,
as in simhash; what is within RADIUS is counted on the whole shingle sets, so no link is below
`least`. Buckets of over WIDE different sets are never gathered: their rows are counted against
one of them, and the rest is compared with all of them in a grid of cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import checkpoint, small, tidy, worker_state
from korvid.llm.components import connected_components
from korvid.llm.simhash import hits, id_and_text, shingle_digests

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: Fingerprints of a Jaccard of 0.8 differ in 9.7 +- 2.9 bits.
RADIUS = 22
#: Different sets that one task compares with each other, and blocks of 64 that are compared at once.
WIDE, AT_ONCE = 4096, 1 << 13


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's word shingles, sorted."""
    return np.unique(np.frombuffer(shingle_digests(text, width)[0], ">u8").astype(np.uint64))


def signature(own: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(own), 2048):
        values = (own[None, at : at + 2048] * factors[:, None] + terms[:, None]) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=1))
    return least.astype(np.uint32)


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The bits that over half of the set's hashes have, as one 64-bit word."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(own)).view(np.uint64)


def described(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, node, keys, fp): node hashes the shingle set, 0 for texts without words."""

    def run(batches):
        worker_state("shingles")
        rng = np.random.default_rng(5)
        factors, terms = rng.integers(0, 2**64 - 1, (2, BANDS * ROWS), np.uint64)
        factors |= np.uint64(1)
        for batch in small(batches):
            nodes, keys, prints = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, width)
                values = signature(own, factors, terms).reshape(BANDS, ROWS)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0)
                keys.append([xxhash.xxh64_intdigest(v.tobytes()) for v in values])
                prints.append(int(fingerprint(own)[0]))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), signed(keys))
            yield pa.record_batch([batch.column(0), batch.column(1), signed(nodes), lists, signed(prints)], names=["doc_id", "text_hash", "node", "keys", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, text_hash long, node long, keys array<long>, fp long")


def jaccard_reaches(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    n = np.count_nonzero(a[np.minimum(a.searchsorted(b), len(a) - 1)] == b) if len(a) else 0
    return n >= least * (len(a) + len(b) - n) - 1e-9


def forest(prints: np.ndarray, sets: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of each bucket's rows by exact Jaccard, none inside a component that earlier links made."""
    label, members, out = np.arange(len(sets)), {}, []
    for a, b in hits(prints, starts, sizes, RADIUS, AT_ONCE):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
        for x, others in zip(a[cuts].tolist(), np.split(b, cuts[1:]) if len(cuts) else ()):
            for y in others[label[others] != label[x]].tolist():
                i, j = int(label[x]), int(label[y])
                if i == j or not jaccard_reaches(sets[x], sets[y], least):
                    continue
                out.append((x, y))
                p, q = members.pop(i, [i]), members.pop(j, [j])
                if len(p) < len(q):  # the smaller component is named anew
                    i, p, q = j, q, p
                label[q] = i
                members[i] = p + q
    return out


def in_buckets(rows: DataFrame, schema: str, solve) -> DataFrame:
    """rows(band, key, node and others) -> what solve gives for each run of whole buckets."""

    def run(batches):
        worker_state("shingles")
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            band, key = (batch.column(i).to_numpy() for i in range(2))
            if held and (held[-1].column(0)[-1].as_py() != band[0] or held[-1].column(1)[-1].as_py() != key[0]):
                yield solve(pa.Table.from_batches(held))
                held = []
            whole = np.flatnonzero((band != band[-1]) | (key != key[-1]))
            if len(whole):  # all but the last bucket are complete
                cut = whole[-1] + 1
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = rows.repartition("band", "key").sortWithinPartitions("band", "key", "node")
    return dealt.mapInArrow(tidy(run), schema)


def bounds(held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    band, key = (held.column(i).to_numpy() for i in range(2))
    starts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])])
    return starts, np.diff(np.r_[starts, len(band)])


def near_in_buckets(rows: DataFrame) -> DataFrame:
    """rows(band, key, node, fp) -> (band, key, node) of those with another within RADIUS in their bucket."""

    def solve(held):
        starts, sizes = bounds(held)
        near = np.zeros(held.num_rows, bool)
        for a, b in hits(held.column(3).to_numpy().view(np.uint64), starts[sizes > 1], sizes[sizes > 1], RADIUS, AT_ONCE):
            other = a != b
            near[a[other]] = near[b[other]] = True
        cut = held.filter(pa.array(near)).combine_chunks()
        return pa.record_batch([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in cut.columns[:3]], names=["band", "key", "node"])

    return in_buckets(rows, "band int, key long, node long", solve)


def sets_of(docs: DataFrame, prints: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, fp, own): the shingle sets of the wanted nodes."""
    # One row stands for each set, so that the texts of a group of copies are read once.
    one = prints.join(wanted, "node").groupBy("node", "fp").agg(F.min(F.struct("text_hash", "doc_id")).alias("one"))
    one = one.select("node", "fp", F.col("one.text_hash").alias("_hash"), F.col("one.doc_id").alias("_doc"))
    rows = id_and_text(docs, id_col, text_col)
    same = rows["doc_id"].eqNullSafe(one["_doc"]) & (rows["text_hash"] == one["_hash"])
    texts = rows.join(one.hint("shuffle_hash"), same).select("node", "fp", "text")

    def run(batches):
        for batch in small(batches):
            sets = [shingle_set(t, width).view(np.int64) for t in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "fp", "own"])

    return texts.mapInArrow(tidy(run), "node long, fp long, own array<long>").dropDuplicates(["node"])


def as_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        flat, ends = chunk.values.to_numpy().view(np.uint64), chunk.offsets.to_numpy()
        out += [flat[a:z] for a, z in zip(ends, ends[1:])]
    return out


def linked_in_buckets(rows: DataFrame, least: float) -> DataFrame:
    """rows(band, key, node, fp, own) -> links (src, dst)."""

    def solve(held):
        node = held.column(2).to_numpy()
        found = forest(held.column(3).to_numpy().view(np.uint64), as_sets(held.column(4)), *bounds(held), least)
        src, dst = (node[[pair[k] for pair in found]] if found else node[:0] for k in range(2))
        return pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return in_buckets(rows.select("band", "key", "node", "fp", "own"), "src long, dst long", solve)


def linked_in_wide(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """rows(band, key, node, n) of wide buckets -> links (src, dst), by the exact Jaccard of all pairs but those
    already joined by the bucket's least node."""

    def count(batches):
        for batch in batches:
            ok = [jaccard_reaches(a, b, least) for a, b in zip(as_sets(pa.chunked_array([batch.column(2)])), as_sets(pa.chunked_array([batch.column(3)])))]
            yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["src", "dst"])

    # Cut off from their aggregations, so that joins on a wide bucket can be split.
    hubs = checkpoint(rows.groupBy("band", "key").agg(F.min("node").alias("hub"), F.max("n").alias("n")))
    rows = rows.select("band", "key", "node").join(hubs, ["band", "key"])
    pairs = rows.where("node <> hub").select("hub", "node").distinct()
    counted = pairs.join(sets.select(F.col("node").alias("hub"), F.col("own").alias("hub_own")), "hub").join(sets.select("node", "own"), "node")
    links = checkpoint(counted.select("hub", "node", "hub_own", "own").mapInArrow(tidy(count), "src long, dst long"))
    rest = rows.where("node <> hub").join(links, (F.col("node") == F.col("dst")) & (F.col("hub") == F.col("src")), "left_anti")
    rest = checkpoint(rest.select("band", "key", "node", "n"))
    if rest.isEmpty():
        return links
    counts = checkpoint(rest.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")))
    cells, parts = F.ceil(F.col("n") / WIDE).cast("int"), F.ceil(F.col("m") / WIDE).cast("int")
    spot = lambda count: F.pmod(F.xxhash64("node"), count)
    span = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    cell = lambda own, across: F.xxhash64("key", own.cast("long"), across.cast("long")).alias("key")
    left = rest.join(counts, ["band", "key"]).withColumn("across", span(cells)).select("band", cell(spot(parts), F.col("across")), "node")
    right = rows.join(counts, ["band", "key"]).withColumn("down", span(parts)).select("band", cell(F.col("down"), spot(cells)), "node")
    both = left.unionByName(right).groupBy("band", "key", "node").agg(F.lit(1).alias("one")).select("band", "key", "node")
    return links.unionByName(linked_in_buckets(both.join(sets, "node"), least))


def links(docs: DataFrame, prints: DataFrame, width: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """Links (src, dst) that join all nodes of a bucket whose exact Jaccard is at least `least`."""
    nodes = checkpoint(prints.where("node <> 0").groupBy("node").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    rows = nodes.select(F.posexplode("keys").alias("band", "key"), "node", "fp")
    wide = checkpoint(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE))
    some_wide = not wide.isEmpty()
    narrow = rows.join(wide, ["band", "key"], "left_anti") if some_wide else rows
    shared = checkpoint(near_in_buckets(narrow))
    wanted = shared.select("node")
    if some_wide:
        large = checkpoint(rows.join(wide, ["band", "key"]).select("band", "key", "node", "n"))
        wanted = wanted.union(large.select("node"))
    sets = checkpoint(sets_of(docs, prints, wanted.distinct(), width, id_col, text_col))
    found = linked_in_buckets(shared.join(sets, "node"), least)
    return found.unionByName(linked_in_wide(large, sets, least)) if some_wide else found


def alike(docs: DataFrame, width: int = WIDTH, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, text_hash) for every row of docs: the least doc_id that a chain of links reaches.

    Two rows are linked if the sets of their word shingles have a Jaccard of at least `least`; a
    text of fewer than `width` words is one shingle, and texts without words (null too) are equal.
    A null doc_id is kept but never names a component. Repeated rows give repeated results; an
    empty table gives none; other columns are not read.
    """
    prints = checkpoint(described(docs, width, id_col, text_col))
    labels = connected_components(links(docs, prints, width, least, id_col, text_col))
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("low")).join(labels, "node", "left")
    nodes = checkpoint(nodes.select("node", "low", F.coalesce("label", "node").alias("label")))
    names = nodes.join(nodes.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("node", "component_id")
    return prints.join(names, "node").select("doc_id", "component_id", "text_hash")
