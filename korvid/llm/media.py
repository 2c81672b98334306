"""Media columns: copies of images by local descriptors, also cropped, resized, turned or edited ones.

Corners at several scales get a binary descriptor of 128 brightness tests in a patch turned by
its own orientation, and of 64 in one of twice its width. Hash tables keyed by BITS of the 128 each bring
descriptors together that may match; those within RADIUS and AROUND do. A true match at 9 differing tests meets in one of the TABLES with
probability 0.76, at 5 with 0.96, and an image has about 30 corners of which INLIERS must match. A
pair of images is linked if enough matches agree on one similarity (scale, turn and shift), tried
for every two of them. Equal images are one class from the start.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import checkpoint, numbered_columns, place_of, stored
from korvid.llm.components import connected_components

#: Of the 128 tests near a corner and the 64 around it, so many may differ.
RADIUS, AROUND = 13, 14
TABLES, BITS = 6, 21
#: The scales, the corners taken of an image at each, and the patch's half width.
SCALES, CORNERS, REACH = (1.0, 0.8, 0.64, 0.512), (12, 8, 6, 4), 9
TURNS = 180
#: Matches that must agree on a similarity, and by how many pixels and of what they may differ.
INLIERS, NEAR, SCALE_OFF, TURN_OFF = 3, 3.0, 1.35, 25.0
#: Points nearer to each other than this are one place.
APART = 5.0
#: Larger buckets are compared as values: in blocks of BLOCK, equal descriptors as one.
WIDE, BLOCK = 32, 1024
#: Rows of one descriptor in a bucket up to which all their pairs are made at once; those of more are made block by block.
MEMBERS = 1024
#: A corner in one number: its place in the image's list, turn, scale, and x and y in sixteenths of a pixel.
NTH, TURN, SCALE, PLACE = 6, 8, 2, 22
FEATURE = "media_id long, digest binary, node long, meta long, d0 long, d1 long, d2 long"


def masks() -> np.ndarray:
    """(TABLES, 2) words: the tests that each table's key takes, each test in about as many tables."""
    rng = np.random.default_rng(8)
    places = np.concatenate([rng.permutation(128) for _ in range(-(-TABLES * BITS // 128) + 1)])
    out = np.zeros((TABLES, 2), np.uint64)
    for k in range(TABLES):
        for p in places[k * BITS : (k + 1) * BITS]:
            out[k, p // 64] |= np.uint64(1) << np.uint64(p % 64)
    return out


def packed(nth, turn, scale, x, y):
    meta = np.asarray(y, np.int64)
    for value, bits in ((x, PLACE), (scale, SCALE), (turn, TURN), (nth, NTH)):
        meta = meta << bits | np.asarray(value, np.int64)
    return meta


def _turned(points: np.ndarray) -> np.ndarray:
    """(TURNS, tests, 2, 2): the offsets, row and column, of each test's two points, for each turn."""
    out = np.empty((TURNS, len(points), 2, 2), np.int64)
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        out[t] = np.rint(points @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]))[..., ::-1]
    return out


def _independent(held: np.ndarray, n: int) -> np.ndarray:
    """n of the tests: those that hold in about half of the patches and depend least on the tests chosen before."""
    held = held.astype(np.float32)
    mean = held.mean(axis=0)
    even = np.argsort(np.abs(mean - 0.5), kind="stable")
    even = even[np.abs(mean[even] - 0.5) <= 0.25]
    alike = np.abs(np.corrcoef(held[:, even].T))
    for bound in np.arange(0.2, 1.01, 0.05):
        free, picked = np.ones(len(even), bool), []
        for j in range(len(even)):
            if free[j]:
                picked.append(j)
                free &= alike[j] < bound
        if len(picked) >= n:
            break
    return even[picked[:n]]


@functools.lru_cache(maxsize=1)
def chosen_tests() -> tuple[np.ndarray, np.ndarray]:
    """The tests near a corner and around it, chosen from random ones over the corners of some drawn pictures.

    Patches of one orientation are alike on the whole, so that plain random tests would let unrelated corners agree.
    """
    rng = np.random.default_rng(20)
    points = rng.normal(0, REACH / 2.0, (12_000, 2, 2))
    apart = np.hypot(*(points[:, 0] - points[:, 1]).T)
    points = points[(np.hypot(*points.transpose(2, 0, 1)) <= REACH - 0.5).all(axis=1) & (apart >= 3)][:3000]
    wide = 2 * points[2000:]
    pictures = np.stack([draw(b"%d" % k) for k in range(80)])
    _, _, held = _described(pictures, (_turned(points), _turned(wide)))
    return _turned(points[_independent(held[:, : len(points)], 128)]), _turned(wide[_independent(held[:, len(points) :], 64)])


def _box(images: np.ndarray, reach: int) -> np.ndarray:
    """Means over squares of 2 * reach + 1, borders repeated."""
    n = 2 * reach + 1
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (reach + 1, reach)
        sums = np.cumsum(np.pad(images, pad, mode="edge"), axis=axis, dtype=np.float64)
        size = images.shape[axis]
        images = ((np.take(sums, range(n, n + size), axis) - np.take(sums, range(size), axis)) / n).astype(np.float32)
    return images


def _shrink(images: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return images

    def weights(size: int) -> np.ndarray:
        small = max(1, round(size * scale))
        edges = np.arange(small + 1) * size / small
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(hi, np.arange(size) + 1) - np.maximum(lo, np.arange(size)), 0, None)
        return (cover / cover.sum(axis=1, keepdims=True)).astype(np.float32)

    return weights(images.shape[1]) @ images @ weights(images.shape[2]).T


def _described(images: np.ndarray, tests: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """images: (n, height, width), grey -> (image, meta, tests held) of all corners."""
    out = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros((0, tests[0].shape[1] + tests[1].shape[1]), bool))]
    before = 0
    ys, xs = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1]
    disc = (xs**2 + ys**2 <= REACH**2).astype(np.float32)
    for level, (scale, most) in enumerate(zip(SCALES, CORNERS)):
        grey = _shrink(images.astype(np.float32), scale)
        n, h, w = grey.shape
        border = REACH + 1
        first, before = before, before + most
        if h <= 2 * border or w <= 2 * border:
            continue
        soft = _box(_box(grey, 1), 1)
        gy, gx = np.gradient(soft, axis=(1, 2))
        xx, yy, xy = (_box(g, 2) for g in (gx * gx, gy * gy, gx * gy))
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = corner.copy()
        for axis in (1, 2):
            line = peak
            for by in (-2, -1, 1, 2):
                peak = np.maximum(peak, np.roll(line, by, axis))
        corner = np.where((corner == peak) & (corner > 1e-3), corner, 0)[:, border:-border, border:-border].reshape(n, -1)
        k = min(most, corner.shape[1])
        best = np.argsort(-corner, axis=1, kind="stable")[:, :k]
        image, nth = np.nonzero(np.take_along_axis(corner, best, 1) > 0)
        if not len(image):
            continue
        y, x = np.divmod(best[image, nth], w - 2 * border)
        y, x = y + border, x + border
        patch = soft[image[:, None, None], y[:, None, None] + ys, x[:, None, None] + xs]
        angle = np.arctan2((patch * disc * ys).sum(axis=(1, 2)), (patch * disc * xs).sum(axis=(1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        held = []
        for own, seen in zip(tests, (soft, _box(_box(grey, 2), 2))):
            spots = own[turn] + np.stack([y, x], axis=1)[:, None, None]  # beyond the image its edge goes on
            values = seen[image[:, None, None], np.clip(spots[..., 0], 0, h - 1), np.clip(spots[..., 1], 0, w - 1)]
            held.append(values[..., 0] < values[..., 1])
        held = np.concatenate(held, axis=1)
        place = (np.rint(16 * (z + 0.5) / size * whole).astype(np.int64) for z, size, whole in ((x, w, images.shape[2]), (y, h, images.shape[1])))
        out.append((image, packed(first + nth, turn, level, *place), held))
    return tuple(np.concatenate([part[i] for part in out]) for i in range(3))


def features(images: np.ndarray, tests: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple]:
    """images: (n, height, width), grey -> (image, meta, d0, d1, d2) of all corners."""
    image, meta, held = _described(images, chosen_tests() if tests is None else tests)
    words = np.packbits(held, axis=1).view(">i8").astype(np.int64)
    return list(zip(image.tolist(), meta.tolist(), *words.T.tolist()))


def describe(media: DataFrame, id_col: str = "media_id") -> DataFrame:
    """media(media_id, width, height, pixels binary, grey rows) -> one row per corner, and one
    row without a descriptor for every image, with the digest of its pixels; node is its first word."""
    tests = chosen_tests()

    def run(batches):
        for batch in batches:
            ids, widths, heights, pixels = (batch.column(i).to_pylist() for i in range(4))
            rows, sized = [], {}
            for i, (w, h, p) in enumerate(zip(widths, heights, pixels)):
                p = p or b""
                digest = hashlib.sha256(b"%d,%d," % (w or 0, h or 0) + p).digest()
                rows.append((ids[i], digest, int.from_bytes(digest[:8], "little", signed=True), None, None, None, None))
                if w and h and len(p) == w * h:
                    sized.setdefault((h, w), []).append(i)
            done = {}
            for (h, w), own in sized.items():
                for at in range(0, len(own), 128):
                    # Equal images in a batch are described once.
                    fresh = {rows[i][1]: i for i in own[at : at + 128] if rows[i][1] not in done}
                    stack = np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in fresh.values()]) if fresh else None
                    names = list(fresh)
                    for d in names:
                        done[d] = i = fresh[d]
                    for image, *rest in features(stack, tests) if fresh else ():
                        rows.append((None, None, rows[fresh[names[image]]][2], *rest))
            kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 5]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["media_id", "digest", "node", "meta", "d0", "d1", "d2"])

    own = [F.col(f"c{place_of(media, c)}") for c in (id_col, "width", "height", "pixels")]
    return numbered_columns(media).select(own[0].cast("long"), own[1].cast("int"), own[2].cast("int"), own[3]).mapInArrow(run, FEATURE)


def _near_pairs(starts: np.ndarray, sizes: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of the same group within the radius; a group is `sizes` rows from `starts`."""
    row = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = np.repeat(starts + sizes, sizes) - row - 1
    i = np.repeat(row, later)
    j = i + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    near = alike(d[i], d[j])
    return i[near], j[near]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether descriptors, three words each in the last dimension, match."""
    apart = np.bitwise_count(a ^ b)
    return (apart[..., 0] + apart[..., 1] <= RADIUS) & (apart[..., 2] <= AROUND)


def _near_values(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of different descriptors of a wide bucket, block by block."""
    out = [(np.zeros(0, int), np.zeros(0, int))]
    for a in range(0, len(d), BLOCK):
        for b in range(a, len(d), BLOCK):
            i, j = np.nonzero(alike(d[a : a + BLOCK, None], d[None, b : b + BLOCK]))
            out.append((a + i, b + j))
    i, j = (np.concatenate([x[k] for x in out]) for k in range(2))
    return i[i < j], j[i < j]


def _bucket_pairs(d: np.ndarray, rows: np.ndarray, large_pairs: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """A wide bucket: equal descriptors are one member of it, and its near pairs are those of their rows.

    Two members with over MEMBERS**2 pairs of rows go to large_pairs, for _in_blocks; without that list each row is
    paired with the other's first only.
    """
    values, member = np.unique(d[rows], axis=0, return_inverse=True)
    member = member.reshape(-1)
    order = rows[np.argsort(member, kind="stable")]
    sizes = np.bincount(member)
    starts = np.cumsum(sizes) - sizes
    u, v = _near_values(values)
    u, v = np.r_[u, np.flatnonzero(sizes > 1)], np.r_[v, np.flatnonzero(sizes > 1)]
    large = sizes[u] * sizes[v] > MEMBERS**2
    out = []
    for x, y in zip(u[large], v[large]):
        xs, ys = order[starts[x] : starts[x] + sizes[x]], order[starts[y] : starts[y] + sizes[y]]
        if large_pairs is not None:
            large_pairs.append((xs, ys))
            continue
        out += [(np.full(len(ys), xs[0]), ys), (xs, np.full(len(xs), ys[0]))]
    u, v = u[~large], v[~large]
    n = sizes[u] * sizes[v]
    pair = np.repeat(np.arange(len(u)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = k // sizes[v[pair]], k % sizes[v[pair]]
    once = (u[pair] != v[pair]) | (i < j)
    out.append((order[starts[u[pair]] + i][once], order[starts[v[pair]] + j][once]))
    return out


def _in_blocks(xs: np.ndarray, ys: np.ndarray):
    """All pairs of two members' rows, those of a member with itself once; BLOCK**2 at a time."""
    alone = xs[0] == ys[0]
    for a in range(0, len(xs), BLOCK):
        for b in range(a if alone else 0, len(ys), BLOCK):
            x, y = xs[a : a + BLOCK], ys[b : b + BLOCK]
            i, j = np.triu_indices(len(x), 1) if alone and a == b else np.indices((len(x), len(y))).reshape(2, -1)
            yield x[i], y[j]


def matches(corners: DataFrame) -> DataFrame:
    """corners(node, meta, d0, d1, d2) -> (src, dst, a, b): matched corners of different nodes, src < dst.

    Rows are dealt by a table's key, so a bucket lies in one partition, where it is read in order.
    """
    chosen = masks()
    own = lambda c, m: F.col(c).bitwiseAND(F.lit(int(m.astype(np.int64))).cast("long"))
    # The lowest three bits of a key are the table's number.
    keys = [F.shiftleft(F.xxhash64(own("d0", chosen[k, 0]), own("d1", chosen[k, 1])), 3).bitwiseOR(F.lit(k).cast("long")) for k in range(TABLES)]
    rows = corners.select(F.explode(F.array(*keys)).alias("key"), "node", "meta", "d0", "d1", "d2")

    def solve(held):
        key, node, meta, *words = (np.concatenate(x) for x in zip(*held))
        tab, d = key & 7, np.stack(words, axis=1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = (sizes > 1) & (sizes <= WIDE)
        parts, large = [_near_pairs(starts[small], sizes[small], d)] if small.any() else [], []
        for s, n in zip(starts[sizes > WIDE], sizes[sizes > WIDE]):
            parts += _bucket_pairs(d, np.arange(s, s + n)[np.argsort(node[s : s + n], kind="stable")], large)
        yield matched(node, meta, tab, d, *(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, int) for k in range(2)))
        for xs, ys in large:
            for i, j in _in_blocks(xs, ys):
                yield matched(node, meta, tab, d, i, j)

    def matched(node, meta, tab, d, i, j):
        i, j = np.where(node[i] <= node[j], i, j), np.where(node[i] <= node[j], j, i)
        keep = node[i] != node[j]
        for k in range(TABLES):  # a pair that an earlier table has too is left to it
            keep &= ~(((d[i, :2] ^ d[j, :2]) & chosen[k] == 0).all(axis=1) & (tab[i] > k))
        i, j = i[keep], j[keep]
        return pa.record_batch([pa.array(x) for x in (node[i], node[j], meta[i], meta[j])], names=["src", "dst", "a", "b"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            key = cols[0]
            whole = np.flatnonzero(key != key[-1])
            if not len(whole) and held and held[-1][0][-1] != key[0]:
                yield from solve(held)
                held = []
            if len(whole):  # all but the last bucket are complete
                cut = whole[-1] + 1
                held.append([c[:cut] for c in cols])
                yield from solve(held)
                held, cols = [], [c[cut:] for c in cols]
            held.append(cols)
        if held:
            yield from solve(held)

    dealt = rows.repartition("key").sortWithinPartitions("key", "node", "meta")
    return dealt.mapInArrow(run, "src long, dst long, a long, b long")


def unpacked(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the list, turn in degrees, scale, point as a complex number) of corners."""
    parts = []
    for bits in (NTH, TURN, SCALE, PLACE, PLACE):
        parts.append(meta & ((1 << bits) - 1))
        meta = meta >> bits
    return parts[0], parts[1] * (360.0 / TURNS), np.array(SCALES)[parts[2]], (parts[3] + 1j * parts[4]) / 16.0


def places(z: np.ndarray) -> int:
    """How many points there are of which no two are within APART pixels, taken as they come."""
    left, n = np.ones(len(z), bool), 0
    while left.any():
        n += 1
        left &= np.abs(z - z[left.argmax()]) > APART
    return n


def agree(a: np.ndarray, b: np.ndarray, inliers: int) -> bool:
    """Whether enough matches (a[i], b[i]) fit one similarity; every two of them propose one."""
    (na, ta, sa, za), (nb, tb, sb, zb) = unpacked(a), unpacked(b)
    if len(np.unique(na)) < inliers or len(np.unique(nb)) < inliers:
        return False
    # Of an object's size, 1 / scale pixels of the image are one of the patch.
    size, turn = sa / sb, tb - ta
    i, j = np.triu_indices(len(a), 1)
    apart = np.abs(za[j] - za[i])
    far = apart >= 2 * NEAR
    i, j = i[far], j[far]
    with np.errstate(divide="ignore", invalid="ignore"):
        move = (zb[j] - zb[i]) / (za[j] - za[i])
        for at in range(0, len(move), 4096):
            m, first = move[at : at + 4096], i[at : at + 4096]
            off = np.abs(m[:, None] * (za[None] - za[first][:, None]) + zb[first][:, None] - zb[None])
            grown = np.abs(m)[:, None] / size[None]
            twisted = np.abs((np.degrees(np.angle(m))[:, None] - turn[None] + 180.0) % 360.0 - 180.0)
            fits = (off <= NEAR * np.maximum(1.0, np.abs(m))[:, None]) & (grown <= SCALE_OFF) & (grown >= 1 / SCALE_OFF) & (twisted <= TURN_OFF)
            for row in np.unique(fits[fits.sum(axis=1) >= inliers], axis=0):
                # One place gives corners at several scales, which count once.
                if places(za[row]) >= inliers and places(zb[row]) >= inliers:
                    return True
    return False


def consensus(matched: DataFrame, inliers: int = INLIERS) -> DataFrame:
    """Pairs (src, dst) of which enough matches agree on one similarity."""
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & {(1 << NTH) - 1} as int))")
    enough = (F.bit_count("ma") >= inliers) & (F.bit_count("mb") >= inliers)
    # A pair has few corners on each side, so its matches are few; most pairs go here.
    pairs = matched.groupBy("src", "dst").agg(F.bit_or(bit("a")).alias("ma"), F.bit_or(bit("b")).alias("mb"), F.collect_set(F.struct("a", "b")).alias("m"))
    rows = pairs.where(enough).select("src", "dst", F.transform("m", lambda x: x["a"]).alias("a"), F.transform("m", lambda x: x["b"]).alias("b"))

    def run(batches):
        for batch in batches:
            sides = [[np.array(x, np.int64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            ok = pa.array([agree(x, y, inliers) for x, y in zip(*sides)], pa.bool_())
            yield pa.record_batch([batch.column(k).filter(ok) for k in range(2)], names=["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def copies(media: DataFrame, id_col: str = "media_id", inliers: int = INLIERS) -> DataFrame:
    """(media_id, class_id, n_links) for every row of media.

    class_id is the least media_id that a chain of links reaches; n_links counts the other
    images that are equal or were linked directly. Null, empty or malformed pixels have no corners and
    are linked only to rows that are equal in size and pixels. Null ids are kept and name no
    class; repeated rows are copies. An empty table gives none; other columns are not read.
    """
    found = stored(describe(media, id_col))
    images = found.where("meta IS NULL").select("media_id", "digest", "node")
    nodes = checkpoint(images.groupBy("digest", "node").agg(F.min("media_id").alias("low"), F.count(F.lit(1)).alias("n")))
    # Equal images were described in several batches perhaps: their corners count once.
    corners = found.where("meta IS NOT NULL").groupBy("node", "meta", "d0", "d1", "d2").agg(F.lit(1).alias("one")).drop("one")
    links = checkpoint(consensus(matches(corners), inliers))
    labels = connected_components(links)
    both = links.union(links.select("dst", "src"))
    sizes = nodes.select(F.col("node").alias("dst"), "n")
    partners = both.join(sizes, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("others"))
    classes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = checkpoint(classes.join(partners, "node", "left").select("digest", "low", "label", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    least = classes.groupBy("label").agg(F.min("low").alias("class_id"))
    names = checkpoint(classes.join(least, "label").select("digest", "class_id", "n_links"))
    return images.join(names, "digest").select("media_id", "class_id", "n_links")


# -- Images to look at ------------------------------------------------------------------------

SIDE = 64
#: Variants of an image: the number is added to VARIANTS * id.
VARIANTS = 8


def draw(seed: bytes) -> np.ndarray:
    """A grey picture of overlapping rectangles on a grainy ground, fixed by the seed."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed).digest()[:8], "little"))
    out = 128 + 60 * _box(rng.normal(size=(1, SIDE, SIDE)).astype(np.float32), 1)[0].astype(float)
    for x, y, w, h, g in zip(*rng.integers([[0], [0], [6], [6], [-70]], [[SIDE - 4], [SIDE - 4], [26], [26], [70]], (5, 26)).tolist()):
        out[y : y + h, x : x + w] += g
    return np.clip(out, 0, 255).astype(np.uint8)


def turned(image: np.ndarray, degrees: float, size: float = 1.0) -> np.ndarray:
    """Turned about its middle and resized, by bilinear interpolation; black beyond its edges."""
    h, w = image.shape
    y, x = np.mgrid[: round(h * size), : round(w * size)]
    z = ((x - (x.max() / 2)) + 1j * (y - (y.max() / 2))) / size * np.exp(-1j * np.radians(degrees))
    x, y = z.real + (w - 1) / 2, z.imag + (h - 1) / 2
    left, top = (np.clip(np.floor(v).astype(int), 0, n - 2) for v, n in ((x, w), (y, h)))
    a, b = np.clip(x - left, 0, 1), np.clip(y - top, 0, 1)
    g = image.astype(float)
    mixed = (g[top, left] * (1 - a) + g[top, left + 1] * a) * (1 - b) + (g[top + 1, left] * (1 - a) + g[top + 1, left + 1] * a) * b
    mixed[(x < 0) | (y < 0) | (x > w - 1) | (y > h - 1)] = 0
    return np.rint(mixed).astype(np.uint8)


def edited(image: np.ndarray, variant: int) -> np.ndarray:
    """1: cropped; 2: darker with less contrast; 3: a corner painted over and a frame cut off; 4: turned
    by 7 degrees; 5: at three quarters of its size; 6: blurred, in 16 shades; 7: turned by 100 degrees, at 1.25 of its size."""
    if variant == 1:
        return image[7 : SIDE - 5, 4 : SIDE - 8]
    if variant == 2:
        return (image * 0.8 + 10).astype(np.uint8)
    if variant == 3:
        image = image.copy()
        image[:20, :20] = 255
        return image[: SIDE - 3, : SIDE - 3]
    if variant == 4:
        return turned(image, 7.0)
    if variant == 5:
        return _shrink(image[None].astype(np.float32), 0.75)[0].astype(np.uint8)
    if variant == 6:
        return (_box(image[None].astype(np.float32), 1)[0] // 16 * 16 + 8).astype(np.uint8)
    if variant == 7:
        return turned(image, 100.0, 1.25)
    return image


def drawn_from(vectors: DataFrame, every: int = 20) -> DataFrame:
    """media(media_id, width, height, pixels): one picture per vector, and for ids that `every`
    divides its edited variants too; equal vectors give equal pictures."""

    def run(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = draw(np.array(v or [], np.float64).tobytes())
                for k in range(VARIANTS if i is not None and i % every == 0 else 1):
                    own = edited(image, k)
                    out.append((None if i is None else VARIANTS * i + k, own.shape[1], own.shape[0], own.tobytes()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["media_id", "width", "height", "pixels"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "media_id long, width int, height int, pixels binary")
