"""Navigable small-world graphs, one per partition: approximate search whose results merge."""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvid.operators.vectors import AIMED_RECALL, _scores

#: Rows of a graph, and neighbours of each, by which its width is measured.
WIDTH_SAMPLE, WIDTH_NEAR = 64, 10
#: The least width of a search.
WIDTH = 50


class Graph:
    """A layered graph: `links` neighbours per node (twice as many below), greedy best-first search."""

    def __init__(self, vectors: np.ndarray, metric: str, links: int = 8, build: int = 50, seed: int = 42):
        self.v, self.metric, self.links, self.build = vectors, metric, links, build
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(len(vectors))) / np.log(links)).astype(int), 12)
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        self.width = 0
        for node, level in enumerate(levels.tolist()):
            self._add(node, level)

    def near(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return np.nan_to_num(_scores(q[None], self.v[nodes], self.metric)[0], nan=-np.inf)

    def _search(self, q: np.ndarray, entry: int, width: int, layer: dict[int, list[int]]) -> list[tuple[float, int]]:
        start = float(self.near(q, [entry])[0])
        seen, ahead, best = {entry}, [(-start, entry)], [(start, entry)]
        while ahead:
            s, node = heapq.heappop(ahead)
            if len(best) >= width and -s < best[0][0]:
                break
            fresh = [x for x in layer[node] if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for score, x in zip(self.near(q, fresh).tolist(), fresh):
                if len(best) < width or score > best[0][0]:
                    heapq.heappush(best, (score, x))
                    heapq.heappush(ahead, (-score, x))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def _pick(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes that no nearer pick is nearer to; then the nearest of the rest."""
        picks: list[int] = []
        for score, node in found:
            if len(picks) < most and (not picks or (self.near(self.v[node], picks) < score).all()):
                picks.append(node)
        return picks + [n for _, n in found if n not in picks][: most - len(picks)]

    def _add(self, node: int, level: int) -> None:
        q, at = self.v[node], self.entry
        top = len(self.layers) - 1
        for depth in range(top, level, -1):
            at = self._search(q, at, 1, self.layers[depth])[0][1]
        for depth in range(min(top, level), -1, -1):
            layer, most = self.layers[depth], self.links * (2 if depth == 0 else 1)
            found = self._search(q, at, self.build, layer)
            at = found[0][1]
            layer[node] = self._pick(found, self.links)
            for other in layer[node]:
                layer[other].append(node)
                if len(layer[other]) > most:
                    scores = self.near(self.v[other], layer[other]).tolist()
                    layer[other] = self._pick(sorted(zip(scores, layer[other]), key=lambda x: (-x[0], x[1])), most)
        while len(self.layers) <= level:
            self.layers.append({node: []})
            self.entry = node

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        at = self.entry
        for depth in range(len(self.layers) - 1, 0, -1):
            at = self._search(q, at, 1, self.layers[depth])[0][1]
        return self._search(q, at, max(k, width), self.layers[0])[:k]

    def measure(self, width: int, seed: int = 42) -> None:
        """Doubles the width until searches between two of the graph's rows find AIMED_RECALL of their true neighbours.

        Rows themselves are easy to find, as the graph leads to them; queries that it doesn't hold are not.
        """
        rng = np.random.default_rng(seed)
        pairs = rng.integers(0, len(self.v), (WIDTH_SAMPLE, 2))
        asked = self.v[pairs].mean(axis=1)
        scores = np.nan_to_num(_scores(asked, self.v, self.metric), nan=-np.inf)
        k = min(WIDTH_NEAR, len(self.v))
        least = np.partition(scores, len(self.v) - k, axis=1)[:, len(self.v) - k]
        self.width = width
        while self.width < len(self.v):
            # By scores, so that rows as near as the last count alike.
            hits = sum(s >= t - 1e-12 for q, t in zip(asked, least) for s, _ in self.search(q, k, self.width))
            if hits >= AIMED_RECALL * k * len(asked):
                break
            self.width *= 2

    def to_bytes(self) -> bytes:
        """Vectors and layers, for from_bytes."""
        parts = {"v": self.v, "metric": np.array(self.metric), "sizes": np.array([self.links, self.build, self.entry, len(self.layers), self.width])}
        for depth, layer in enumerate(self.layers):
            nodes = sorted(layer)
            parts[f"nodes{depth}"] = np.array(nodes, np.int32)
            parts[f"ends{depth}"] = np.cumsum([0, *(len(layer[n]) for n in nodes)]).astype(np.int32)
            parts[f"links{depth}"] = np.array([x for n in nodes for x in layer[n]], np.int32)
        out = io.BytesIO()
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, content: bytes) -> "Graph":
        held = np.load(io.BytesIO(content))
        graph = cls.__new__(cls)
        graph.v, graph.metric = held["v"], str(held["metric"])
        graph.links, graph.build, graph.entry, depth, graph.width = (int(x) for x in held["sizes"])
        graph.layers = []
        for d in range(depth):
            ends, links = held[f"ends{d}"], held[f"links{d}"].tolist()
            graph.layers.append({n: links[a:z] for n, a, z in zip(held[f"nodes{d}"].tolist(), ends, ends[1:])})
        return graph


def build_graphs(df: DataFrame, column: str, metric: str = "euclidean", tie: str = "id", shard: int = 5000) -> DataFrame:
    """(shard, ids, graph): a graph over every shard of about `shard` rows, to be written and searched again and again.

    Each measures the width that its searches need, against all of its rows.
    """
    shards = max(1, round(df.count() / shard))
    rows = df.where(F.col(column).isNotNull()).select(F.col(tie).cast("long").alias("id"), F.col(column).alias("v"), F.pmod(F.xxhash64(tie), F.lit(shards)).cast("int").alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        made = Graph(np.stack(pdf["v"].to_numpy()).astype(float), metric)
        made.measure(WIDTH)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "ids": [pdf["id"].to_numpy()], "graph": [made.to_bytes()]})

    return rows.groupBy("shard").applyInPandas(run, "shard int, ids array<long>, graph binary")


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, width: int = WIDTH, without: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity, rank) for queries(query_id, q): every graph is searched for every query, with the width
    that it has measured or the given one if that is larger.

    without(id): rows deleted since the graphs were built; each graph then gives as many more as it
    has lost, so none of the k that are left is missed for their sake.
    """
    last = graphs.agg(F.max("shard")).first()[0] or 0
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"))
    right = graphs.select("shard", "ids", "graph")
    if without is not None:
        lost = graphs.select("shard", F.explode("ids").alias("id")).join(without.select(F.col("id").cast("long")), "id").groupBy("shard").agg(F.collect_set("id").alias("lost"))
        right = right.join(lost, "shard", "left")
    else:
        right = right.withColumn("lost", F.lit(None).cast("array<long>"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, content, lost in zip(b["ids"], b["graph"], b["lost"]):
            graph, gone = Graph.from_bytes(content), set(() if lost is None else lost)
            for n, q in zip(a["query_id"], a["q"]):
                found = [(n, ids[x], s) for s, x in graph.search(np.asarray(q, float), k + len(gone), max(width, graph.width, k + len(gone))) if ids[x] not in gone]
                out += found[:k]
        return pd.DataFrame(out, columns=["query_id", "id", "similarity"])

    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(run, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def approximate_top_k(df: DataFrame, column: str, queries: DataFrame, k: int, metric: str = "euclidean", tie: str = "id", shard: int = 5000, width: int = WIDTH) -> DataFrame:
    """The same over graphs that are built for this call only."""
    return search_graphs(build_graphs(df, column, metric, tie, shard), queries, k, width)
