"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BROADCAST_ROWS, HOT, spread_join, texts_of, written
from .components import components

BITS = 64
SEED = 42
SALTS = 32


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of a text: a bit is set if it is set in over half the hashes of its word shingles."""
    joined = b" ".join(words := (text or "").encode().lower().split())
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    hashes = map(xxhash.xxh64_intdigest, [joined[s:e] for s, e in zip(first, last, strict=True)], repeat(SEED))
    counts = np.zeros(BITS, np.int64)
    values = np.fromiter(hashes, np.uint64, n)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((counts * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long), and the columns ``keep``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in texts_of(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], ["doc_id", *keep, "fp"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("fp", LongType())]))


def block_masks(distance: int, blocks: int) -> list[int]:
    """The bit masks to join on.  Two fingerprints that differ in ``distance`` bits agree on ``blocks - distance``
    of the blocks at least, so each pair meets under one of these masks."""
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    parts = [((1 << int(hi - lo)) - 1) << int(lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """More blocks give longer keys: as many as keep a random bucket's expected size below 16."""
    for blocks in range(distance + 1, distance + 8):
        if n >> (BITS * (blocks - distance) // blocks) < 16:
            return blocks
    return distance + 8


def forest(fps: np.ndarray, distance: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Indexes of links that join what is linked among ``fps`` (with ``other``: between the two, numbered on).

    Every pair's distance is looked at, until both ends are known to be joined."""
    pool = fps if other is None else np.concatenate((fps, other))
    side = np.zeros(len(pool), bool) if other is None else np.arange(len(pool)) >= len(fps)
    left = np.arange(len(pool))
    links: list[tuple[int, int]] = []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(pool[left] ^ pool[at]) <= distance
            if other is not None:
                near &= side[left] != side[at]
            if near.any():
                links += [(at, int(x)) for x in left[near]]
                stack += left[near].tolist()
                left = left[~near]
    return links


def links(reps: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = 2048) -> DataFrame:
    """``reps(fp, node)``, fingerprints all different, to ``(a, b)``: links that connect exactly what fingerprints
    within ``distance`` bits connect.

    Rows meet in buckets (mask, masked bits).  In a bucket of up to ``tile`` rows all pairs are verified and a
    spanning forest of the links is kept.  A larger bucket is cut into tiles, and each pair of tiles is a
    bucket of its own, so none holds over twice ``tile`` rows and no pair is lost.

    Buckets of one row are left out.  Where the list of the others is too long to send to all tasks, rows of large buckets
    meet their sizes where they are, or salted, and only the others shuffle, so that no bucket gathers before it is cut."""
    masks = block_masks(distance, blocks or blocks_for(reps.count(), distance))
    spread = reps.select("fp", "node", F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])).alias("mask", "bits"))
    spread = spread.select("fp", "node", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    sizes = written(spread.groupBy("mask", "key").count().where("count > 1"), "sizes")
    tiles = F.ceil(F.col("count") / tile).cast("int").alias("tiles")
    on = ["mask", "key"]
    if sizes.count() <= BROADCAST_ROWS:
        met = spread.join(F.broadcast(sizes.select(*on, tiles)), on)
    else:
        large, small = sizes.where(F.col("count") > tile).select(*on, tiles), sizes.where(F.col("count") <= tile).select(*on, tiles)
        if large.count() <= BROADCAST_ROWS:
            hot, rest = spread.join(F.broadcast(large), on), spread.join(F.broadcast(large.select(*on)), on, "left_anti")
        else:
            copies = large.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
            told = spread.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"], "left").drop("salt")
            hot, rest = told.where("tiles is not null"), told.where("tiles is null").drop("tiles")
        met = hot.unionByName(rest.join(small, on))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.when(F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("lo"), F.greatest(t, F.col("own")).alias("hi")))
    )
    met = met.withColumn("own", own).withColumn("pair", F.explode(pairs))
    met = met.select("mask", "key", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "own", "fp", "node")
    met = met.repartition("mask", "key", "lo", "hi").sortWithinPartitions("mask", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 7), np.int64)
        for batch in batches:
            rows = np.concatenate((kept, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])))
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            done = cuts[-1] if len(cuts) else 0
            kept = rows[done:]
            yield from bucket_links(rows[:done], cuts[:-1])
        yield from bucket_links(kept, np.array([], int))

    def bucket_links(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        edges = np.concatenate(([0], cuts, [len(rows)])).astype(int)
        size = np.diff(edges)
        two = edges[:-1][size == 2]  # most buckets: one comparison each, all at once
        fp = rows[:, 5].view(np.uint64) if rows.flags.c_contiguous else np.ascontiguousarray(rows[:, 5]).view(np.uint64)
        if len(two):
            near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance) & ((rows[two, 2] == rows[two, 3]) | (rows[two, 4] != rows[two + 1, 4]))
            found.append(np.column_stack((rows[two, 6][near], rows[two + 1, 6][near])))
        for lo, hi in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist(), strict=True):
            part, bits = rows[lo:hi], fp[lo:hi]
            if part[0, 2] == part[0, 3]:
                got, nodes = forest(bits, distance), part[:, 6]
            else:
                one = part[:, 4] == part[0, 2]
                got, nodes = forest(bits[one], distance, bits[~one]), np.concatenate((part[one, 6], part[~one, 6]))
            if got:
                found.append(nodes[np.array(got)])
        if found and len(all_ := np.concatenate(found)):
            yield pa.RecordBatch.from_arrays([pa.array(all_[:, 0]), pa.array(all_[:, 1])], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None, tile: int = 2048, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """``doc_id, fp, component_id, root`` and the columns ``keep``: one row per row of ``docs``; ``root`` is a fingerprint that
    stands for the component.

    Links hold between fingerprints that differ in ``distance`` bits or fewer; a component's id is the smallest
    doc_id that links reach.  Texts that are null, empty or white space have fingerprint zero and link like
    any other.  Copies share a fingerprint and count as one node.  A null doc_id is never a component's id,
    unless nothing else is in the component.  Rows of a fingerprint that over ``hot`` rows have do not gather."""
    fps = written(fingerprints(docs, shingle, keep), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # Nodes are the fingerprints themselves; the smallest doc_id of a component follows by a minimum over it.
    reps = written(reps, "reps")
    stars = components(links(reps.select("fp", F.col("fp").alias("node")), distance, blocks, tile), hot)
    stars = stars.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = written(reps.join(stars, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = written(spread_join(rooted.withColumnRenamed("n", "rows"), ids, "root", hot).select("fp", "component_id", "root", F.col("rows").alias("n")), "of")
    return spread_join(fps, of, "fp", hot).select("doc_id", *keep, "fp", "component_id", "root")


def hex_fingerprint(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
