"""Local image descriptors and bags of visual words over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvid.functions import descriptors, images
from korvid.operators import text as text_ops
from korvid.operators import vectors


def picture(seed, side=96):
    rng = np.random.default_rng(seed)
    out = 110 + 25 * descriptors.smoothed(rng.normal(size=(side, side)), 2) * 5
    for x, y, w, h, g in rng.integers([0, 0, 8, 8, -80], [side - 8, side - 8, 40, 40, 80], (30, 5)):
        out[y : y + h, x : x + w] += g
    return np.clip(out, 0, 255).astype(np.uint8)


def alike(a, b):
    """The share of a's descriptors whose nearest of b is clearly nearer than the second."""
    d = np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))
    near = np.sort(d, axis=1)[:, :2]
    return float((near[:, 0] < 0.75 * near[:, 1]).mean())


def test_descriptors_survive_turns_light_and_size():
    image = picture(1)
    own, other = descriptors.local_descriptors(image), descriptors.local_descriptors(picture(2))
    assert own.shape[1] == descriptors.WIDTH and len(own) > 40
    assert np.allclose(np.linalg.norm(own, axis=1), 1)
    for changed, least in ((np.rot90(image).copy(), 0.4), ((image * 0.7 + 20).astype(np.uint8), 0.4), (image[8:, 5:], 0.25)):
        assert alike(own, descriptors.local_descriptors(changed)) > least
    assert alike(own, descriptors.local_descriptors((descriptors.resampled(image / 1.0, 0.7)).astype(np.uint8))) > 0.1
    assert alike(own, other) < 0.1


def test_flat_and_small_images_have_none():
    for image in (np.full((80, 80), 7), np.zeros((3, 3)), np.full((80, 80, 3), 9)):
        assert descriptors.local_descriptors(image).shape == (0, descriptors.WIDTH)


@pytest.mark.parametrize("words", [24])
def test_bags_of_visual_words_find_the_same_picture(spark, words):
    pnm = lambda image: b"P5\n%d %d\n255\n" % image.shape[::-1] + image.tobytes()
    pictures = {i: picture(i) for i in range(6)} | {10 + i: np.rot90(picture(i)).copy() for i in range(6)}
    files = spark.createDataFrame([(i, bytearray(pnm(p))) for i, p in pictures.items()] + [(99, None)], "doc_id long, content binary")
    rows = descriptors.descriptors_of(files).cache()
    assert rows.where("doc_id = 99").isEmpty()
    own = descriptors.local_descriptors(images.read_pnm(pnm(pictures[3])))
    assert rows.where("doc_id = 3").count() == len(own)
    codebook = vectors.train_codebook(rows, "descriptor", words)
    histogram = text_ops.bow_histogram(vectors.visual_words(rows, "descriptor", codebook))
    weighted = text_ops.bow_tf_idf(histogram.select("doc_id", F.col("word").cast("string").alias("word"), "tf"))
    bags = {i: np.zeros(words) for i in pictures}
    for r in weighted.collect():
        bags[r.doc_id][int(r.word)] = r.weight
    for i in range(6):
        assert max((bags[i] @ bags[j], j) for j in pictures if j != i)[1] == 10 + i
    counts = {(r.doc_id, r.word): r.tf for r in histogram.collect()}
    assert descriptors.visual_histogram(images.read_pnm(pnm(pictures[3])), codebook).tolist() == [counts.get((3, w), 0) for w in range(words)]
    assert np.linalg.norm(descriptors.visual_histogram(pictures[3], codebook, np.ones(words))) == pytest.approx(1)
