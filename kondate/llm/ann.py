"""Nearest neighbours: a hierarchical navigable small-world graph per shard, kept as flat neighbour arrays."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kondate.llm.common import Scratch

INDEX = "shard int, nodes int, dims int, entry int, top int, vectors binary, members array<array<long>>, links binary, upper_nodes array<binary>, upper_links array<binary>"
HITS = "query_id long, vec_id long, score double"


class Graph:
    """One shard's graph. links[level] holds `width` neighbours a node, -1 for none; rows[level] maps a node to its row."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], rows: list[dict[int, int] | None], entry: int, top: int):
        self.x, self.links, self.rows, self.entry, self.top = vectors, links, rows, entry, top
        self.seen, self.turn = np.zeros(len(vectors), "i8"), 0

    def neighbours(self, node: int, level: int) -> np.ndarray:
        row = self.links[level][self.rows[level][node] if level else node]
        return row[row >= 0]

    def search(self, query: np.ndarray, starts: list[tuple[float, int]], level: int, width: int) -> list[tuple[float, int]]:
        """The `width` nearest nodes found on a level from the starts, nearest first; distances are squared."""
        self.turn += 1
        seen, turn, x = self.seen, self.turn, self.x
        ahead = list(starts)
        heapq.heapify(ahead)
        best = [(-d, n) for d, n in starts]
        heapq.heapify(best)
        for _, n in starts:
            seen[n] = turn
        while ahead:
            d, node = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= width:
                break
            near = self.neighbours(node, level)
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            gap = x[near] - query
            far = np.einsum("ij,ij->i", gap, gap)
            for d, n in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-d, n))
                    heapq.heappush(ahead, (d, n))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, n))
                    heapq.heappush(ahead, (d, n))
        return sorted((-d, n) for d, n in best)

    def nearest(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        start = [(float(((self.x[self.entry] - query) ** 2).sum()), self.entry)]
        for level in range(self.top, 0, -1):
            start = self.search(query, start, level, 1)
        return self.search(query, start, 0, width)


def spread(x: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Up to `most` neighbours, each nearer to the node than to any chosen before; then the nearest of the rest."""
    ids = np.array([n for _, n in found])
    points = x[ids]
    norms = np.einsum("ij,ij->i", points, points)
    between = norms[:, None] + norms[None, :] - 2 * points @ points.T
    to_node = np.array([d for d, _ in found])
    free = np.ones(len(ids), bool)
    chosen: list[int] = []
    for i in range(len(ids)):
        if free[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            free &= between[i] > to_node
    if len(chosen) < most:
        had = set(chosen)
        chosen += [i for i in range(len(ids)) if i not in had][: most - len(chosen)]
    return ids[chosen].tolist()


def build_graph(vectors: np.ndarray, m: int, breadth: int) -> Graph:
    """Insert the vectors one by one: descend greedily, search each level of the new node, link both ways."""
    n = len(vectors)
    draw = np.random.default_rng(n).random(n)
    levels = np.minimum((-np.log(1 - draw) / math.log(m)).astype(int), 12)
    top = int(levels.max(initial=0))
    rows: list[dict[int, int] | None] = [None] + [{int(v): i for i, v in enumerate(np.flatnonzero(levels >= k))} for k in range(1, top + 1)]
    links = [np.full((n, 2 * m), -1, "i4")] + [np.full((len(rows[k]), m), -1, "i4") for k in range(1, top + 1)]
    graph = Graph(vectors, links, rows, 0, int(levels[0]) if n else 0)
    for node in range(1, n):
        level, query = int(levels[node]), vectors[node]
        start = [(float(((vectors[graph.entry] - query) ** 2).sum()), graph.entry)]
        for k in range(graph.top, level, -1):
            start = graph.search(query, start, k, 1)
        for k in range(min(level, graph.top), -1, -1):
            start = graph.search(query, start, k, breadth)
            table, row = links[k], rows[k]
            chosen = spread(vectors, start, m)
            table[row[node] if k else node, : len(chosen)] = chosen
            for other in chosen:
                at = row[other] if k else other
                free = np.flatnonzero(table[at] < 0)
                if len(free):
                    table[at, free[0]] = node
                    continue
                near = np.append(table[at], node)
                gap = vectors[near] - vectors[other]
                far = np.einsum("ij,ij->i", gap, gap)
                order = np.argsort(far, kind="stable")
                table[at] = spread(vectors, list(zip(far[order].tolist(), near[order].tolist(), strict=True)), table.shape[1])
        if level > graph.top:
            graph.entry, graph.top = node, level
    return graph


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v of the vectors that take part: of the commonest length, all finite, not all zero, one for each vec_id.

    Of rows that share a vec_id the smallest vector, component by component, takes part.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.size("v") == (common["dims"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """v, members: every distinct vector with its `most` smallest identifiers.

    That is all that a search for fewer results than `most` can return of equal vectors, so a vector that a third of
    all rows share is one node of one graph. The rank filter prunes equal rows before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def build_index(nodes: DataFrame, shards: int, m: int = 16, breadth: int = 80) -> DataFrame:
    """One row per shard: its vectors, the identifiers of each, and the graph as flat neighbour arrays."""

    def build(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort([x[0] for x in part["members"]], kind="stable")
        vectors = np.ascontiguousarray(np.stack(part["v"].to_list()).astype("f8")[order])
        graph = build_graph(vectors, m, breadth)
        upper = [np.array(list(r), "i4").tobytes() for r in graph.rows[1:]]
        return pd.DataFrame({
            "shard": [key[0]], "nodes": [len(vectors)], "dims": [vectors.shape[1]], "entry": [graph.entry], "top": [graph.top], "vectors": [vectors.tobytes()],
            "members": [[part["members"].iloc[i] for i in order]], "links": [graph.links[0].tobytes()], "upper_nodes": [upper], "upper_links": [[t.tobytes() for t in graph.links[1:]]],
        })

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, INDEX)


def load_graph(row: pd.Series, m: int) -> Graph:
    vectors = np.frombuffer(row["vectors"], "f8").reshape(row["nodes"], row["dims"])
    rows = [None] + [{v: i for i, v in enumerate(np.frombuffer(b, "i4").tolist())} for b in row["upper_nodes"]]
    links = [np.frombuffer(row["links"], "i4").reshape(-1, 2 * m)] + [np.frombuffer(b, "i4").reshape(-1, m) for b in row["upper_links"]]
    return Graph(vectors, links, rows, row["entry"], row["top"])


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int, m: int = 16, width: int = 256, block_rows: int = 16384) -> DataFrame:
    """query_id, vec_id, score of each query's k nearest of every shard.

    Queries are dealt to blocks of about `block_rows`; each block meets each shard's graph in a task of its own, which
    gets the graph once.
    """
    blocks = max(1, -(-queries.count() // block_rows))

    def search(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graphs) and len(asked):
            row = graphs.iloc[0]
            graph = load_graph(row, m)
            for query_id, v in zip(asked["vec_id"].tolist(), asked["v"], strict=True):
                query = np.asarray(v, "f8")
                hits = []
                for _, node in graph.nearest(query, max(width, 2 * k))[: 2 * k]:
                    score = float(np.sqrt(((graph.x[node] - query) ** 2).sum()))
                    hits += [(score, i) for i in row["members"][node] if i != query_id]
                out += [(query_id, i, score) for score, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "i8", "vec_id": "i8", "score": "f8"})

    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return copies.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(search, HITS)


def shards_for(nodes: int, shard_rows: int, most: int) -> int:
    """As many shards as hold `shard_rows` each, up to `most`; from then on shards grow, not searches."""
    return min(most, max(1, -(-nodes // shard_rows)))


def nearest_neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 16384, most_shards: int = 1024, m: int = 16, breadth: int = 80, width: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    Every usable row is indexed; the distance is Euclidean in double precision, ties go to the smaller vec_id. Null
    or zero vectors, those with null or non-finite components or of another length than most take no part; a repeated
    vec_id counts once, with the smallest of its vectors. An empty table gives an empty result; other columns are not
    read. A query is searched in every shard, of which there are never more than `most_shards`, so the work of a query
    grows with the logarithm of the table beyond most_shards x shard_rows vectors. Up to there, shards keep to
    `shard_rows`; beyond, a task holds 1 / `most_shards` of the vectors.
    """
    scratch = Scratch(embeddings.sparkSession, "ann")
    rows = scratch.table(usable(embeddings), "rows")
    nodes = scratch.table(distinct_vectors(rows, k + 1), "nodes")
    shards = shards_for(nodes.count(), shard_rows, most_shards)
    index = scratch.table(build_index(nodes, shards, m, breadth), "index")
    queries = rows.where(F.col("vec_id") % every == 0)
    hits = search_index(index, queries, shards, k, m, width)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
