"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, spread_join, written


def _with_least(links: DataFrame, hot: int | None) -> DataFrame:
    """``links`` with ``m``, the smallest neighbour of ``a``, or ``a`` itself.  The minimum is a sum with map-side combine; of a
    node with over ``hot`` links it goes to the links, so a hub's links never gather in one task.  ``hot`` None: there can be
    no such node."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return links.join(least.drop("n"), "a") if hot is None else spread_join(links, least, "a", hot)


def _large(links: DataFrame, hot: int | None) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, hot).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame, hot: int | None) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = _with_least(down, hot)
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(joined.select("a", F.col("m").alias("b")))


def components(links: DataFrame, hot: int = HOT) -> DataFrame:
    """``links(a, b)`` to ``(a, b)``: every node that is not the smallest of its component, and that smallest node.

    Each round rewires every node to its smallest neighbour, above and then below itself, until no link
    changes; the rounds grow with the logarithm of the longest chain.  Each round's links are a written
    table, compared by their count and an order-free sum of hashes."""
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    state = (links.count(), None)
    while True:
        may_be_hot = hot if 2 * state[0] > hot else None
        links = written(_small(_large(links, may_be_hot).distinct(), may_be_hot).where("a <> b").distinct(), "links")
        row = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if row == state:
            return links
        state = row
