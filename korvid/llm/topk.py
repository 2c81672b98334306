"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A candidate block holds, for each dimension, its vectors in the order of that component: one
sorted list, read from the top for queries with a positive weight there and from the bottom for
the others. Lists are only read in sequence. After each stretch of every list, a candidate's read
components count as they are, and its unread ones lie between the list's far end and the place
reached, which gives a lower and an upper bound of its score. A query stops on a block once k lower
bounds (of this block or of those before it) stand at or above all other upper bounds; the scores
of the few that are left open are then resolved. Numbers too large for exact sums in double
precision widen the bounds by what rounding can do, and the open scores are resolved as integers.

The bounds of a block are matrix products, two for each stretch, so a query that has to read far
costs more than a plain scan of the block would; what the lists save are the scores resolved.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most candidates and queries of one cell of the grid; candidates of one block of lists and queries compared at once.
CELL, QUERIES, BLOCK, BATCH = 65536, 8192, 2048, 1024
#: Small tables are cut in up to so many cells, to keep all cores busy.
SPREAD = 64
#: Shares of the lists after which the bounds are looked at.
STRETCHES = (0.15, 0.4, 0.7, 1.0)
#: Sums below these are exact in single and double precision.
EXACT32, EXACT = 2.0**21, 2.0**50


class Lists:
    """The sorted lists of one block of candidates, and what each stretch of them tells about the bounds.

    A bound of a query with the weights w (positive parts, then negative parts) is w @ ends for the
    unread components, put right by w @ read for those that were read.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors, n = vectors, len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        lists = np.take_along_axis(vectors, order, axis=0)
        self.steps = []
        for share in STRETCHES:
            at = max(1, math.ceil(n * share))
            read = rank >= n - at, rank < at
            ends = [(lists[0], lists[-1]), (lists[n - at], lists[at - 1])]
            self.steps.append([(np.concatenate(pair), np.hstack([np.where(r, vectors - e, vectors.dtype.type(0)) for r, e in zip(read, pair)])) for pair in ends])


def search_block(lists: Lists, weights: np.ndarray, own: tuple[np.ndarray, np.ndarray], floor: np.ndarray, slack: np.ndarray, k: int):
    """(query, candidate) of all that can be among a query's k best.

    own: pairs of a query and a row that has its id. floor[q]: a score that the k-th best reaches;
    slack[q]: by how much a bound may be off.
    """
    n = len(lists.vectors)
    barred = np.zeros((len(weights), n), bool)
    barred[own] = True
    open_q, out = np.arange(len(weights)), []
    for (far, worst), (edge, best) in lists.steps:
        w, wide, mine = weights[open_q], slack[open_q][:, None], barred[open_q]
        low = (w @ far)[:, None] + w @ worst.T - wide
        high = (w @ edge)[:, None] + w @ best.T + wide
        low[mine] = -np.inf
        bar = floor[open_q]
        if n >= k:
            bar = np.maximum(bar, np.partition(low, n - k, axis=1)[:, n - k])
        left = (high >= bar[:, None]) & ~mine
        # Few enough are left: their scores are resolved, exactly.
        done = (left.sum(axis=1) <= max(4 * k, n // 64)) | (worst is lists.steps[-1][0][1])
        who, cand = np.nonzero(left[done])
        out.append((open_q[done][who], cand))
        open_q = open_q[~done]
        if not len(open_q):
            break
    return tuple(np.concatenate([x[i] for x in out]) for i in range(2))


def best_of(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best: higher score first, then the smaller id."""
    order = np.lexsort((ids, -scores, q))
    first = np.searchsorted(q[order], q[order], "left")
    return order[np.arange(len(q)) - first < k]


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(row of queries, id, score): the k best of all candidates but those with the query's id."""
    largest = [float(np.abs(x).max(initial=0)) for x in (queries, vectors)]
    bound = max(1.0, largest[0]) * max(1.0, largest[1]) * max(1, queries.shape[1])
    a, b = queries, vectors
    if bound < EXACT32:
        a, b = a.astype(np.float32), b.astype(np.float32)
    elif bound >= EXACT:  # powers of two keep the digits and let no product overflow
        a, b = (np.ldexp(x, -max(0, math.frexp(m)[1] - 400)) for x, m in zip((a, b), largest))
    blocks = [Lists(b[at : at + BLOCK]) for at in range(0, len(b), BLOCK)]
    parts = [_search(a[at : at + BATCH], query_ids[at : at + BATCH], blocks, b, ids, k, bound < EXACT) for at in range(0, len(a), BATCH)]
    q, row, s = (np.concatenate([np.zeros(0, int), *(p[i] + (n * BATCH if i == 0 else 0) for n, p in enumerate(parts))]) for i in range(3))
    if bound < EXACT:
        return q, ids[row], s
    whole = lambda v: [int(x) for x in v]
    most, found = 2**63 - 1, {}
    for i, r in zip(q.tolist(), row.tolist()):
        found.setdefault(i, []).append((-sum(x * y for x, y in zip(whole(queries[i]), whole(vectors[r]))), int(ids[r])))
    out = [(i, name, min(most, max(-most, -s))) for i in sorted(found) for s, name in sorted(found[i])[:k]]
    return tuple(np.array(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def _search(a: np.ndarray, names: np.ndarray, blocks: list[Lists], b: np.ndarray, ids: np.ndarray, k: int, exact: bool):
    """(query, row of the candidates, score): the k best, or where sums aren't exact all that may be among them."""
    weights = np.hstack([np.maximum(a, 0), np.minimum(a, 0)])
    slack = np.zeros(len(a), a.dtype) if exact else np.abs(a) @ np.abs(b).max(axis=0) * 2.0**-40
    q_all, r_all, s_all = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    floor = np.full(len(a), -np.inf)
    for n, lists in enumerate(blocks):
        at = n * BLOCK
        block_ids = ids[at : at + BLOCK]
        spot = np.argsort(block_ids, kind="stable")
        lo, hi = (np.searchsorted(block_ids[spot], names, side) for side in ("left", "right"))
        rows = np.repeat(np.arange(len(a)), hi - lo)
        own = rows, spot[np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
        q, c = search_block(lists, weights, own, floor, slack, k)
        q_all, r_all = np.r_[q_all, q], np.r_[r_all, at + c]
        s_all = np.r_[s_all, np.einsum("ij,ij->i", a[q], lists.vectors[c])]
        best = best_of(q_all, ids[r_all], s_all, k)
        counts = np.bincount(q_all[best], minlength=len(a))
        full = counts >= k
        floor[full] = s_all[best][(np.cumsum(counts) - 1)[full]] - slack[full]
        if not exact:
            best = np.flatnonzero(s_all + slack[q_all] >= floor[q_all])
        q_all, r_all, s_all = q_all[best], r_all[best], s_all[best]
    return q_all, r_all, s_all


def exact_top_k(
    vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best integer inner products.

    Components become floor(scale * x). is_query is a condition on id_col; every row but the
    query's own id is a candidate, ties go to the smaller id. Rows whose id or vector is null,
    whose vector is empty or holds a null component, or one that is not finite times scale, take no part; vectors of
    another length than the query's are no candidates. Repeated rows are candidates of their
    own, and a repeated query is answered once. Scores beyond a long are clamped. An empty
    table gives no rows; other columns are not read.

    The grid: candidates in cells of at most about CELL rows, queries in blocks of at most about
    QUERIES rows; a task holds one cell, so neither grows with the table.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull()).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("m")).first()
    cells = max(1, math.ceil(totals["n"] / CELL), min(SPREAD, math.ceil(totals["n"] / BLOCK)))
    blocks = max(1, math.ceil(totals["m"] / QUERIES))
    cell = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(cells)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    left = asked.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), block.alias("block"), "vec_id", "v")
    right = rows.select(F.size("v").alias("dim"), cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")

    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        names, ids = queries["vec_id"].to_numpy(np.int64), found["vec_id"].to_numpy(np.int64)
        a, b = (np.floor(scale * np.stack(x["v"].to_numpy()).astype(float)) for x in (queries, found))
        q, near, scores = search(a, names, b, ids, k)
        return pd.DataFrame({"query_id": names[q], "vec_id": np.asarray(near, np.int64), "score": np.asarray(scores).astype(np.int64)})

    parts = (
        left.groupBy("dim", "cell", "block")
        .cogroup(right.groupBy("dim", "cell", "block"))
        .applyInPandas(run, "query_id long, vec_id long, score long")
    )
    # The window's limit also works before the shuffle.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
