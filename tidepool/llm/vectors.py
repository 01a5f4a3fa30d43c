"""Vector tables as packed shards, and waves of queries that go past them; both searches share this."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FOUND = "query_row long, query_id long, vec_id long, score"


def finite(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, dim, vector`` (doubles) of the rows whose id is given and whose vector is neither null nor empty
    and holds finite components only."""
    v = F.col(vector_column).cast("array<double>")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null")
    return rows.where((F.size("vector") > 0) & good).select("id", F.size("vector").alias("dim"), "vector")


def packed(vectors: DataFrame, size: int, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, int]:
    """``dim, part, ids, data``: every row, in parts of about ``size`` bytes, and the number of parts.

    Rows are dealt by where they stand in the input, so neither a repeated id nor a repeated vector makes a part
    large.  Within a part rows stand by id, then by components."""
    held = vectors.agg(F.sum(8 * (F.col("dim") + 1))).first()[0] or 0
    n = max(1, -(-held // size))
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        dim, part = group.column("dim")[0].as_py(), group.column("part")[0].as_py()
        ids = group.column("id").to_numpy()
        data = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.lexsort((*data.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        ids, data = ids[order], data[order]
        if transform:
            data = transform(data)
        row = [[dim], [part], [ids.tobytes()], [np.ascontiguousarray(data).tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dim", "part", "ids", "data"])

    dealt = dealt.repartition(min(4 * n, 4096), "dim", "part")
    return written(dealt.groupBy("dim", "part").applyInArrow(pack, "dim int, part int, ids binary, data binary"), "packed"), n


@dataclass
class Queries:
    """The queries of one length in a wave.  ``first``: the wave's number of the first; ``state``: what a task has found so far."""

    first: int
    ids: np.ndarray
    data: np.ndarray


def waves(queries: DataFrame, count: int, kind: type) -> Iterator[dict[int, Queries]]:
    """Each wave of queries by vector length.  A wave is one part: it comes to the driver and goes to all tasks."""
    for wave in range(count):
        out, first = {}, 0
        for row in queries.where(F.col("part") == wave).orderBy("dim").collect():
            ids = np.frombuffer(row.ids, np.int64)
            out[row.dim] = Queries(first, ids, np.frombuffer(row.data, kind).reshape(len(ids), row.dim))
            first += len(ids)
        if out:
            yield out


def past_shards(shards: DataFrame, wave: dict[int, Queries], kind: type, search: Callable, score: str, name: str) -> DataFrame:
    """``query_row, query_id, vec_id, score``, written: ``search(queries, ids, data, memory)`` over every shard for the wave's
    queries of its length.  It yields (indexes of queries, ids, scores); ``memory`` lasts as long as the task, shard
    after shard."""
    sent = shards.sparkSession.sparkContext.broadcast(wave)  # one wave's bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[int, dict] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                if dim not in sent.value:
                    continue
                asked = sent.value[dim]
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                data = np.frombuffer(batch.column("data")[i].as_buffer(), kind).reshape(len(ids), dim)
                for who, found, scores in search(asked, ids, data, memory.setdefault(dim, {})):
                    yield pa.RecordBatch.from_arrays([pa.array(who + asked.first), pa.array(asked.ids[who]), pa.array(found), pa.array(scores)], ["query_row", "query_id", "vec_id", "score"])

    out = written(shards.mapInArrow(run, f"{FOUND} {score}"), name)
    sent.destroy()
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: highest score first, ties to the smaller id.  A query has k rows a shard at most."""
    order: list[Column] = [F.desc("score"), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def results(found: list[DataFrame], empty: DataFrame) -> DataFrame:
    """``query_id, rank, vec_id, score`` of all waves."""
    out = empty
    for f in found:
        out = out.unionByName(f.select(*out.columns))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
