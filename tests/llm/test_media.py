"""Image copies: planted edits, and matches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvid.llm import media

MEDIA = "media_id long, width int, height int, pixels binary"


def rows_of(images):
    return [(i, im.shape[1], im.shape[0], bytearray(im.tobytes())) for i, im in images]


def test_planted_copies_are_found_and_others_left_alone(spark):
    n, v = 120, media.VARIANTS
    vectors = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(n)] + [(501, [3.0, 0.5])], "vec_id long, embedding array<float>")
    got = {r.media_id: r for r in media.copies(media.drawn_from(vectors, every=5).withColumn("class_id", F.lit("clash"))).collect()}
    want = {v * i + k: v * i for i in range(n) for k in range(v if i % 5 == 0 else 1)} | {v * 501: v * 3}
    assert set(got) == set(want)
    wrong = [m for m, c in want.items() if got[m].class_id != c]
    assert all(got[m].class_id == m for m in wrong)  # missed, never mixed up
    missed = {k: sum(m % v == k for m in wrong) for k in range(1, v)}
    # Of the 24 variants of each kind: cropped, darker, painted, turned, smaller, blurred, turned and larger.
    assert all(x <= (6 if k == 5 else 2) for k, x in missed.items())
    assert sum(missed.values()) <= 0.1 * 24 * (v - 1) and got[v * 3].n_links >= 1


def test_turned_images_agree_on_their_similarity(spark):
    picture = media.draw(b"any")
    sides = [media.features(np.stack([x])) for x in (picture, media.turned(picture, 33.0), media.draw(b"another"))]
    meta, words = ([np.array([r[1] for r in side]) for side in sides], [np.array([r[2:] for r in side]).view(np.uint64) for side in sides])

    def linked(i, j):
        a, b = np.nonzero(media.alike(words[i][:, None], words[j][None]))
        return media.agree(meta[i][a], meta[j][b], media.INLIERS)

    assert linked(0, 1) and not linked(0, 2) and not linked(1, 2)


@pytest.mark.parametrize("wide", [64, 3])
def test_matches_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(media, "WIDE", wide)
    rng = np.random.default_rng(2)
    rows = []
    for base in rng.integers(-(2**63), 2**63 - 1, (12, 3)):
        for node in rng.choice(40, 5, replace=False):
            d = base.view(np.uint64).copy()
            for b in rng.integers(0, 192, rng.integers(0, 20)):
                d[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            rows.append((int(node), len(rows), *d.view(np.int64).tolist()))
    corners = spark.createDataFrame(rows, "node long, meta long, d0 long, d1 long, d2 long")
    got = [(r.a, r.b) for r in media.matches(corners).collect()]
    assert len(set(got)) == len(got)
    words = [np.array(r[2:], np.int64).view(np.uint64) for r in rows]
    want, meet = set(), media.masks()
    for p in rows:
        for q in rows:
            differ = words[p[1]] ^ words[q[1]]
            few = np.bitwise_count(differ[:2]).sum() <= media.RADIUS and np.bitwise_count(differ[2]) <= media.AROUND
            if p[0] < q[0] and few and ((meet & differ[:2]) == 0).all(axis=1).any():
                want.add((p[1], q[1]))
    assert set(got) == want and len(want) > 20


def test_odd_rows(spark):
    flat = np.full((40, 40), 9, np.uint8)
    tiny = np.arange(9, dtype=np.uint8).reshape(3, 3)
    rows = rows_of([(1, flat), (2, flat), (3, tiny)]) + [(4, None, None, None), (5, 2, 2, bytearray(b"x")), (None, 40, 40, bytearray(flat.tobytes())), (1, 40, 40, bytearray(flat.tobytes()))]
    got = sorted((r.media_id or 0, r.class_id, r.n_links) for r in media.copies(spark.createDataFrame(rows, MEDIA)).collect())
    assert got == [(0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0)]
    assert media.copies(spark.createDataFrame([], MEDIA)).collect() == []
