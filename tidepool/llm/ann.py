"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing, then exact distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Queries, best, finite, packed, past_shards, ranked, results, waves


@lru_cache(maxsize=8)
def probe_sets(hashes: int, probes: int) -> np.ndarray:
    """The first ``probes`` perturbation sets in the order of their expected score, smallest first, as rows of 0 and 1
    over the 2 * ``hashes`` boundaries sorted by distance.

    Boundary j's expected squared distance is known in closed form; sets grow from {1} by shifting or
    extending their largest member, so a heap gives them in order.  A set may not hold both sides of a hash."""
    m = hashes
    near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    far = [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    cost = [0.0, *near, *far]
    out = np.zeros((probes, 2 * m), np.int64)
    heap, n = [(cost[1], (1,))], 0
    while heap and n < probes:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
        if all(2 * m + 1 - j not in chosen for j in chosen):
            out[n, [j - 1 for j in chosen]] = 1
            n += 1
    return out[:n]


class Tables:
    """p-stable hash tables over unit vectors: h(x) = floor((a.x + b) / width), a normal, b uniform.

    Directions are drawn a vector's length of them at a time and made orthogonal, with the lengths that normal ones have
    in the mean: each by itself is as before, but together they say more of a distance."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 7):
        rng = np.random.default_rng((seed, dim))
        drawn = []
        while len(drawn) * dim < tables * hashes:
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            drawn.append(q * np.sign(np.diag(r)))
        self.a = np.concatenate(drawn)[: tables * hashes].reshape(tables, hashes, dim) * (np.sqrt(dim) / width)
        self.b = rng.random((tables, hashes))
        self.mix = rng.integers(1, 1 << 62, hashes, np.int64) | 1  # a bucket's key is linear in its hashes, so a perturbed key is a sum

    def spots(self, table: int, units: np.ndarray) -> np.ndarray:
        return units @ self.a[table].T + self.b[table]

    def keys(self, table: int, units: np.ndarray) -> np.ndarray:
        return np.floor(self.spots(table, units)).astype(np.int64) @ self.mix

    def probes(self, table: int, units: np.ndarray, probes: int) -> np.ndarray:
        """Each query's own key and those of its perturbed buckets."""
        spots = self.spots(table, units)
        cell = np.floor(spots)
        off = spots - cell
        away = np.concatenate((off, 1 - off), axis=1)  # to the lower and the upper boundary
        step = np.concatenate((-self.mix, self.mix))
        steps = step[np.argsort(away, axis=1, kind="stable")]
        own = cell.astype(np.int64) @ self.mix
        return own[:, None] + np.concatenate((np.zeros((len(units), 1), np.int64), steps @ probe_sets(self.mix.size, probes).T), axis=1)


def units_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths, without overflow or underflow on the way."""
    top = np.abs(data).max(axis=1)
    scaled = data / top[:, None]
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / norm[:, None], norm * top


class Index:
    """One shard's tables: for each, rows sorted by bucket key."""

    def __init__(self, data: np.ndarray, tables: Tables, count: int):
        self.units, _ = units_of(data)
        self.tables = tables
        self.sorted = []
        for t in range(count):
            keys = tables.keys(t, self.units)
            order = np.argsort(keys, kind="stable")
            self.sorted.append((keys[order], order))

    def hits(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """In how many tables each row lies in a bucket that the query probes: a matrix of small numbers."""
        met = np.zeros((len(queries), len(self.units)), np.uint8)
        flat = met.reshape(-1)
        for t, (keys, order) in enumerate(self.sorted):
            asked = self.tables.probes(t, queries, probes)
            lo, hi = np.searchsorted(keys, asked, "left").ravel(), np.searchsorted(keys, asked, "right").ravel()
            who = np.repeat(np.arange(len(queries)), asked.shape[1])
            some = hi > lo
            lo, size, who = lo[some], (hi - lo)[some], who[some]
            if len(size):
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                flat[np.repeat(who, size) * len(self.units) + order[at]] += 1  # a table's probed buckets are distinct, so a row comes once
        return met


def chosen(hits: np.ndarray, votes: int, least: int) -> np.ndarray:
    """The rows that ``votes`` tables or more offer; fewer tables will do, in the end none, while there are under ``least``
    rows."""
    while votes:
        some = np.flatnonzero(hits >= votes)
        if len(some) >= least:
            return some
        votes -= 1
    return np.arange(len(hits))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 32, hashes: int = 8, width: float = 2.0, probes: int = 100, votes: int = 7, least: int = 800, id_column: str = "vec_id", vector_column: str = "embedding", shard: int = 8 << 20, wave: int = 32 << 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest cosines found for each query.

    Queries are the rows where ``is_query`` (a condition on ``id``) holds; rows with the query's id are no candidates of it.
    An id may occur on many rows: each is a candidate, and each is a query of its own.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor does a null id.
    A query meets vectors of its own length only.

    All rows are indexed, in shards of about ``shard`` bytes with tables of their own; they are dealt by place, not by bucket,
    so a common vector's bucket is spread over all shards, and equal vectors keep equal scores.  Queries pass in waves of
    about ``wave`` bytes, which go to the shards; shards do not move.  In a shard each table offers the rows of a query's
    own bucket and of ``probes`` perturbed ones; merged, the rows that ``votes`` tables offer are candidates, for which exact
    cosines are computed.  Where they are fewer than ``least``, fewer votes do, and at last all rows of the shard are
    candidates: the fewer rows there are, the further off the nearest ones lie."""
    rows = finite(vectors, id_column, vector_column).where(F.exists("vector", lambda x: x != 0))
    shards, _ = packed(rows, shard)
    queries, count = packed(rows.where(is_query), wave)

    def search(asked: Queries, ids: np.ndarray, data: np.ndarray, memory: dict) -> Iterator[tuple]:
        index = Index(data, Tables(data.shape[1], tables, hashes, width), tables)
        lengths = np.sqrt((data * data).sum(axis=1))
        units, _ = units_of(asked.data)
        found: list[tuple] = []
        for lo in range(0, len(units), 256):
            for q, hits in enumerate(index.hits(units[lo : lo + 256], probes), lo):
                other = ids != asked.ids[q]
                some = chosen(np.where(other, hits, 0), votes, max(k, least))
                some = some[other[some]]
                scores = cosines(data[some], lengths[some], asked.data[q])
                top = best(ids[some], scores, k)
                found.append((np.full(len(top), q), ids[some][top], scores[top]))
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))

    found = [ranked(past_shards(shards, w, np.float64, search, "double", "near"), k) for w in waves(queries, count, np.float64)]
    return results(found, rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"))


def cosines(data: np.ndarray, lengths: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines, each row summed alone: equal rows get equal scores wherever they stand."""
    length = np.sqrt((query * query).sum())
    score = (data * query).sum(axis=1) / (lengths * length)
    odd = ~((lengths > 1e-150) & (lengths < 1e150)) | ~(1e-150 < length < 1e150)
    if odd.any():  # squares over- or underflow: by unit vectors
        unit, _ = units_of(query[None])
        score[odd] = (units_of(data[odd])[0] * unit).sum(axis=1)
    return np.clip(score, -1, 1)
