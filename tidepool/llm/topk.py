"""Exact top-k by inner product: branch and bound over a ball tree in each shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import Queries, best, finite, packed, past_shards, ranked, results, waves

#: Whole numbers up to here are exact in a double, and so is any sum of them that stays below.
EXACT = float(1 << 53)
LOWEST = -(1 << 63)


@dataclass
class Node:
    lo: int
    hi: int
    center: np.ndarray
    radius: float
    children: tuple[Node, Node] | None = None
    number: int = 0


def ball_tree(data: np.ndarray, leaf: int = 256) -> tuple[list[Node], np.ndarray]:
    """The nodes, the root first, and the order of rows in which each node is a range."""
    order = np.arange(len(data))
    nodes: list[Node] = []

    def build(lo: int, hi: int) -> Node:
        rows = data[order[lo:hi]].astype(float)
        center = rows.mean(axis=0)
        away = np.sqrt(((rows - center) ** 2).sum(axis=1))
        node = Node(lo, hi, center, float(away.max()) * (1 + 1e-9), number=len(nodes))
        nodes.append(node)
        if hi - lo > leaf and node.radius > 0:
            one = rows[away.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            side = rows @ (other - one)
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(side, mid)]
            node.children = build(lo, lo + mid), build(lo + mid, hi)
        return node

    build(0, len(data))
    return nodes, order


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: by doubles where they hold them, else by 64-bit integers, else by
    unbounded ones.  A product beyond 64 bits is an error."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    out = a.astype(object) @ b.astype(object).T
    if out.size and (out.max() >= 1 << 63 or out.min() <= LOWEST):
        raise OverflowError("an inner product is beyond 64 bits")
    return out.astype(np.int64)


def whole(data: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x).  A number beyond 64 bits is an error."""
    out = np.floor(data * scale)
    if not (np.abs(out) < 2.0**63).all():
        raise OverflowError(f"a component times {scale} is beyond 64 bits")
    return out.astype(np.int64)


def search_tree(nodes: list[Node], data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(indexes of queries, ids, scores): the k best of each query in one shard that score ``floor`` (its kth score so far)
    or more; and how many rows were scored, over all queries.

    ``data`` and ``ids`` stand in the tree's order.  A node's bound is q.center + |q| radius.  Each query opens the node of the
    highest bound that it has met: an inner one gives its two children, a leaf its scores, which raise the query's kth
    score; it stops when no bound reaches that.  Queries that open the same node at the same turn do it together."""
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    bounds = np.full((len(queries), len(nodes)), -np.inf)

    def enter(node: Node, who: np.ndarray) -> None:
        away = queries[who] @ node.center + norms[who] * node.radius
        bounds[who, node.number] = away + np.abs(away) * 1e-9 + norms[who] * 1e-9 * (1 + np.abs(node.center).max()) + 1e-6

    kth = floor.astype(np.int64).copy()
    kept_ids = [np.zeros(0, np.int64)] * len(queries)
    kept = [np.zeros(0, np.int64)] * len(queries)
    scored, active = 0, np.arange(len(queries))
    enter(nodes[0], active)
    while len(active):
        best_node = bounds[active].argmax(axis=1)
        go = bounds[active, best_node] >= kth[active]
        active, best_node = active[go], best_node[go]
        for at in np.unique(best_node):
            node, who = nodes[at], active[best_node == at]
            bounds[who, at] = -np.inf
            if node.children:
                for child in node.children:
                    enter(child, who)
                continue
            scores = products(queries[who], data[node.lo : node.hi])
            scored += scores.size
            scores[query_ids[who][:, None] == ids[node.lo : node.hi]] = LOWEST
            for q, row in zip(who.tolist(), scores, strict=True):
                good = np.flatnonzero((row >= kth[q]) & (row > LOWEST))
                if len(good):
                    all_ids, all_scores = np.concatenate((kept_ids[q], ids[node.lo + good])), np.concatenate((kept[q], row[good]))
                    top = best(all_ids, all_scores, k)
                    kept_ids[q], kept[q] = all_ids[top], all_scores[top]
                    if len(top) == k:
                        kth[q] = max(kth[q], kept[q][-1])
    return np.repeat(np.arange(len(queries)), [len(x) for x in kept]), np.concatenate(kept_ids), np.concatenate(kept), scored


def rounds(shards: int) -> list[tuple[int, int]]:
    """Ranges of shards: a sixteenth of them, up to a quarter, the rest."""
    cuts = sorted({0, max(1, shards // 16), max(1, shards // 4), shards})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, id_column: str = "vec_id", vector_column: str = "embedding", shard: int = 4 << 20, wave: int = 16 << 20, leaf: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products of floor(scale * x) vectors.

    Queries are the rows where ``is_query`` (a condition on ``id``) holds; rows with the query's id are no candidates of it.
    An id may occur on many rows: each is a candidate, and each is a query of its own.
    Vectors that are null, empty or hold null or non-finite components take no part, nor does a null id.
    A query meets vectors of its own length only.  Components and scores beyond 64 bits are an error.

    Rows lie in shards of about ``shard`` bytes, each with a ball tree.  Queries pass in waves of about ``wave`` bytes, which
    go to the shards; shards do not move.  A wave visits the shards in rounds of growing size: what a round finds gives each
    query's kth score, which goes with the wave into the next round as its floor, and within a task from shard to shard."""
    rows = finite(vectors, id_column, vector_column)
    as_whole = lambda data: whole(data, scale)
    shards, parts = packed(rows, shard, as_whole)
    queries, count = packed(rows.where(is_query), wave, as_whole)
    found = []
    for asked in waves(queries, count, np.int64):
        top, floors = None, {dim: np.full(len(q.ids), LOWEST) for dim, q in asked.items()}
        for lo, hi in rounds(parts):

            def search(asked: Queries, ids: np.ndarray, data: np.ndarray, memory: dict, floors=floors) -> Iterator[tuple]:
                """``memory``: each query's k best scores in this task's shards."""
                dim = data.shape[1]
                nodes, order = ball_tree(data, leaf)
                held = memory.setdefault("best", np.full((len(asked.ids), k), LOWEST))
                for at in range(0, len(asked.ids), 1024):
                    some = slice(at, at + 1024)
                    floor = np.maximum(floors[dim][some], held[some].min(axis=1))
                    who, near, scores, _ = search_tree(nodes, data[order], ids[order], asked.data[some], asked.ids[some], k, floor)
                    for q in np.unique(who):
                        held[at + q] = np.sort(np.concatenate((held[at + q], scores[who == q])))[-k:]
                    yield who + at, near, scores

            here = past_shards(shards.where((F.col("part") >= lo) & (F.col("part") < hi)), asked, np.int64, search, "long", "found")
            top = here if top is None else top.unionByName(here)
            if hi < parts:
                top = written(ranked(top, k).drop("rank"), "top")
                full = top.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
                known = {r.query_row: r.floor for r in full.collect()}  # a wave's queries at most
                floors = {dim: np.array([known.get(q.first + i, LOWEST) for i in range(len(q.ids))], np.int64) for dim, q in asked.items()}
        found.append(ranked(top, k))
    return results(found, rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long"))
