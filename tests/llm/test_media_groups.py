"""Hundreds of edited copies of one image, and descriptors that many images share."""

import numpy as np
import pytest

from korvid.llm import media

MEDIA = "media_id long, width int, height int, pixels binary"


def test_hundreds_of_edited_copies_are_one_class(spark):
    image, rows = media.draw(b"one"), []
    for i in range(200):
        own = image.copy()
        own[:10, :10] = i
        rows.append((i, 64, 64, bytearray(own.tobytes())))
    rows.append((500, 64, 64, bytearray(media.draw(b"another").tobytes())))
    got = {r.media_id: (r.class_id, r.n_links) for r in media.copies(spark.createDataFrame(rows, MEDIA)).collect()}
    assert got == {i: (0, 199) for i in range(200)} | {500: (500, 0)}


@pytest.mark.parametrize("members", [1024, 10])
def test_wide_buckets_of_nearly_equal_descriptors(monkeypatch, members):
    monkeypatch.setattr(media, "MEMBERS", members)
    monkeypatch.setattr(media, "BLOCK", 64)
    rng = np.random.default_rng(6)
    d = np.zeros((300, 3), np.uint64)
    for row in d[100:]:
        for b in rng.integers(32, 192, rng.integers(0, 20)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    found = media._bucket_pairs(d, np.arange(300))
    got = {(min(a, b), max(a, b)) for i, j in found for a, b in zip(i.tolist(), j.tolist()) if a != b}
    near = media.alike(d[:, None], d[None])
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    assert got == want if members == 1024 else got < want and {b for _, b in got} >= set(range(1, 100))


def test_wide_bucket_without_near_pairs():
    d = np.random.default_rng(3).integers(0, 2**64 - 1, (60, 3), np.uint64)
    d[:, 0] &= np.uint64(0xFFFFFFFF00000000)
    assert sum(len(i) for i, _ in media._bucket_pairs(d, np.arange(60))) == 0


def test_large_members_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(media, "MEMBERS", 4)
    monkeypatch.setattr(media, "BLOCK", 16)
    image, rows = media.draw(b"one"), []
    for i in range(70):
        own = image.copy()
        own[:10, :10] = i
        rows.append((i, 64, 64, bytearray(own.tobytes())))
    got = {tuple(r) for r in media.copies(spark.createDataFrame(rows, MEDIA)).select("media_id", "class_id", "n_links").collect()}
    assert got == {(i, 0, 69) for i in range(70)}
