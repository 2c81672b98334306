"""Local image descriptors: corners and histograms of gradient directions around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from korvid.functions.images import read_pnm

#: Sizes at which corners are looked for, the corners of an image at most, and the numbers of a descriptor.
SIZES, CORNERS = (1.0, 0.7, 0.5), 200
CELLS, DIRECTIONS, REACH = 4, 8, 8
WIDTH = CELLS * CELLS * DIRECTIONS
#: No number of a descriptor counts for more than this share of its length.
LARGEST = 0.2


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness from 0 to 1 of an image of one or three channels."""
    image = np.asarray(image, float)
    return (image @ (0.299, 0.587, 0.114) if image.ndim == 3 else image) / 255.0


def smoothed(image: np.ndarray, reach: int = 1) -> np.ndarray:
    """Means over squares, borders repeated."""
    n = 2 * reach + 1
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        image = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), n, axis=axis).mean(axis=-1)
    return image


def resampled(image: np.ndarray, size: float) -> np.ndarray:
    """Bilinear, smoothed before so that fine detail doesn't alias."""
    if size == 1.0:
        return image
    h, w = image.shape
    y, x = (np.clip((np.arange(max(2, round(n * size))) + 0.5) / size - 0.5, 0, n - 1) for n in (h, w))
    top, left = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    b, a = (y - top)[:, None], (x - left)[None]
    g = smoothed(image)
    at = lambda dy, dx: g[np.ix_(top + dy, left + dx)]
    return (at(0, 0) * (1 - a) + at(0, 1) * a) * (1 - b) + (at(1, 0) * (1 - a) + at(1, 1) * a) * b


def corners(image: np.ndarray, most: int) -> np.ndarray:
    """(n, 2): rows and columns of the strongest corners that stand above their neighbours, away from the border."""
    gy, gx = np.gradient(smoothed(image))
    xx, yy, xy = (smoothed(g, 2) for g in (gx * gx, gy * gy, gx * gy))
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    around = np.lib.stride_tricks.sliding_window_view(np.pad(strength, 2, constant_values=-np.inf), (5, 5)).max(axis=(2, 3))
    edge = 2 * REACH
    found = np.argwhere((strength == around) & (strength > 1e-8))
    found = found[(found >= edge).all(axis=1) & (found < np.array(image.shape) - edge).all(axis=1)]
    return found[np.argsort(-strength[tuple(found.T)], kind="stable")[:most]]


def described(image: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """(n, WIDTH): for each corner, directions in CELLS x CELLS squares turned by the corner's main direction, of length 1."""
    gy, gx = np.gradient(smoothed(image))
    length, direction = np.hypot(gx, gy), np.arctan2(gy, gx)
    steps = np.arange(-REACH, REACH + 1)
    v, u = (x.ravel() for x in np.meshgrid(steps, steps, indexing="ij"))
    near = np.exp(-(u**2 + v**2) / (2 * REACH**2))
    out = np.zeros((len(spots), WIDTH))
    for row, (y, x) in enumerate(spots):
        spot = np.rint(y + v).astype(int), np.rint(x + u).astype(int)
        bins, turns = np.histogram(direction[spot], 36, (-np.pi, np.pi), weights=length[spot] * near)
        main = turns[bins.argmax()] + np.pi / 36
        spot = np.rint(y + v * np.cos(main) + u * np.sin(main)).astype(int), np.rint(x + u * np.cos(main) - v * np.sin(main)).astype(int)
        which = ((direction[spot] - main) % (2 * np.pi) / (2 * np.pi) * DIRECTIONS).astype(int) % DIRECTIONS
        cell = (v + REACH) * CELLS // (2 * REACH + 1) * CELLS + (u + REACH) * CELLS // (2 * REACH + 1)
        np.add.at(out[row], cell * DIRECTIONS + which, length[spot] * near)
    for _ in range(2):  # cut, and brought to length 1 again
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.minimum(np.divide(out, size, out=np.zeros_like(out), where=size > 0), LARGEST)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def local_descriptors(image: np.ndarray, most: int = CORNERS) -> np.ndarray:
    """(n, WIDTH) over all sizes; none for a flat or very small image."""
    whole, out = grey(image), [np.zeros((0, WIDTH))]
    for size in SIZES:
        if min(whole.shape) * size <= 4 * REACH + 1:
            break
        level = resampled(whole, size)
        out.append(described(level, corners(level, round(most * size * size / sum(s * s for s in SIZES)))))
    return np.concatenate(out)


def descriptors_of(files: DataFrame, decode=read_pnm, most: int = CORNERS) -> DataFrame:
    """files(doc_id, content) -> (doc_id, nth, descriptor), a row for each corner."""

    def run(batches):
        for batch in batches:
            ids, nth, flat = [], [], [np.zeros((0, WIDTH))]
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = local_descriptors(decode(bytes(content)), most) if content is not None else flat[0]
                ids += [name] * len(own)
                nth += range(len(own))
                flat.append(own)
            rows = np.concatenate(flat).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), pa.array(rows.ravel()))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(nth, pa.int32()), lists], names=["doc_id", "nth", "descriptor"])

    return files.selectExpr("cast(doc_id as long) doc_id", "content").mapInArrow(run, "doc_id long, nth int, descriptor array<float>")


def visual_histogram(image: np.ndarray, codebook: np.ndarray, weights: np.ndarray | None = None, most: int = CORNERS) -> np.ndarray:
    """One image's bag of visual words over a codebook, for an extractor: counts, or with weights (the words' inverse
    document frequencies) (1 + log10 tf) * weight brought to length 1."""
    found = local_descriptors(image, most)
    nearest = ((codebook**2).sum(axis=1) - 2 * found @ codebook.T).argmin(axis=1) if len(found) else np.zeros(0, int)
    counts = np.bincount(nearest, minlength=len(codebook)).astype(float)
    if weights is None:
        return counts
    scaled = np.where(counts > 0, 1 + np.log10(np.maximum(counts, 1)), 0.0) * weights
    size = np.linalg.norm(scaled)
    return scaled / size if size else scaled
