"""Streams of titles against stored queries, and streams of operations into the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidepool.operators import learn
from tidepool.operators.match import QuerySet

from .registry import Registry


def percolate_stream(titles: DataFrame, query_set: QuerySet, scope: str = "standard", tags: dict | None = None) -> DataFrame:
    """``titles`` (a stream) with the queries that match each: a stream-static join with nothing to remember, as each pair
    comes from one signature only.  Copies of one query are not put together; dedupe a batch where ids repeat.  The postings
    go to all tasks, and are an error if they are too large for that: then match batch by batch (``percolate_batches``)."""
    pairs = query_set.filtered(tags).pairs(titles, scope, "broadcast")
    return pairs.select(*titles.columns, "query_id")


def windowed_counts(matches: DataFrame, time_column: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Matches of each query by event time, late titles up to ``late``."""
    window = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    return matches.withWatermark(time_column, late).groupBy(window, "query_id").agg(F.count(F.lit(1)).alias("n"))


def percolate_batches(titles: DataFrame, snapshot: Callable[[], QuerySet], sink: Callable[[DataFrame, int], None], scope: str = "standard") -> DataStreamWriter:
    """Each micro-batch against the state that is current when it begins."""

    def run(batch: DataFrame, number: int) -> None:
        sink(snapshot().match(batch, scope), number)

    return titles.writeStream.foreachBatch(run)


def apply_operations(ops: DataFrame, registry: Registry) -> DataStreamWriter:
    """A stream of operations into the log; a batch that comes again is known by its numbers and not added twice, even if the
    log has been compacted since."""

    def run(batch: DataFrame, number: int) -> None:
        registry.append(batch, replay=True)

    return ops.writeStream.foreachBatch(run)


def collect_feedback(titles: DataFrame, snapshot: Callable[[], QuerySet], pairs: list[tuple[str, str]], path: str) -> DataStreamWriter:
    """What the titles of a stream tell of pairs of forms, a batch's counts and sketches in folders of its number, so a batch
    that comes again writes the same; ``gathered`` puts them together."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.select("title_id", "title").persist()
        counts, sketch = learn.observe(batch, snapshot().match(batch, "with_broad"), pairs)
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        sketch.write.mode("overwrite").parquet(f"{path}/sketches/batch={number}")
        batch.unpersist()

    return titles.writeStream.foreachBatch(run)


def gathered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All batches' observations as one."""
    return learn.merged((spark.read.parquet(f"{path}/counts").drop("batch"), spark.read.parquet(f"{path}/sketches").drop("batch")), (spark.read.parquet(f"{path}/counts").drop("batch").limit(0), spark.read.parquet(f"{path}/sketches").drop("batch").limit(0)))
