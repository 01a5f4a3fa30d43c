"""Plumbing that the operators of this package share: the shared folder, written tables, Arrow maps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: A key with more rows than this does not go to one task.
HOT = 100_000

_folders: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors all see, under ``spark.checkpoint.dir``.

    The cluster names the place; that it does not is an error, but for a local master, which gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidepool-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/tidepool-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_clean)
    _folders.append((spark, folder))
    return folder


def _clean() -> None:
    for spark, folder in _folders:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have stopped before
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, and a lost
    executor costs nothing that was written."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, by_key: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row a key and the number ``n`` of rows that have it (not in the result).

    Rows of a key with over ``hot`` rows stay where they are and meet its one row there; there are at most (rows / ``hot``)
    such keys, which are broadcast after counting.  All others shuffle."""
    often = by_key.where(F.col("n") > hot).drop("n")
    known = often.count()
    if not 0 < known <= BROADCAST_ROWS:
        return rows.join(by_key.drop("n"), key)
    there = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(by_key.where(F.col("n") <= hot).drop("n"), key)
    return there.unionByName(rest)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
