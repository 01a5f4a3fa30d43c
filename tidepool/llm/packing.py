"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .tokens import encoder


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, a binary, with ``keep_ids``).

    A document's ids end in ``end``.  One of more than ``size`` ids is cut into pieces of ``size``, of which the
    first takes what is over.  Null texts count as empty: one piece of the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids = encode(text) + last
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for piece, (at, to) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = ids[4 * at : 4 * to]
                    out.append((doc_id, piece, at, to - at, zlib.crc32(part), *([part] if keep_ids else [])))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: len(columns)])

    types, names = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence numbers and offsets for pieces of these lengths, each at most ``size``.

    A sequence takes the longest piece that is left and then, again and again, the longest that fits.  If a
    gap remains, its smallest piece makes way for two unpacked ones whose sum fills the widened gap
    best, where they fill more than it did; then filling goes on."""
    order = np.argsort(-lengths, kind="stable")
    by_length = np.searchsorted(-lengths[order], -np.arange(size + 1), side="left")  # where each length begins in order
    left = np.bincount(lengths, minlength=size + 1).tolist()
    taken = [0] * (size + 1)
    fits = list(range(size + 1))  # fits[x]: a bound on the longest length up to x that is left, tightened when used

    def longest(x: int) -> int:
        """The longest length up to x of which a piece is left, 0 if none."""
        path = []
        while x and not left[x]:
            path.append(x)
            x = fits[x] if fits[x] < x else x - 1
        for p in path:
            fits[p] = x
        return x

    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number, rest = 0, len(lengths)

    def take(length: int) -> None:
        nonlocal rest
        left[length] -= 1
        rest -= 1

    while rest:
        held: list[int] = []
        gap = size
        while rest:
            while gap and (x := longest(gap)):
                take(x)
                held.append(x)
                gap -= x
            if not gap or not rest:
                break
            least = min(held)
            room, best = gap + least, (least, 0, 0)
            b = longest(room - 1)
            while b and 2 * b > best[0]:
                a = longest(min(b, room - b))
                if a == b and left[b] < 2:
                    a = longest(b - 1)
                if a and a + b > best[0]:
                    best = (a + b, a, b)
                if best[0] == room:
                    break
                b = longest(b - 1)
            if best[0] == least:
                break
            held.remove(least)
            left[least] += 1
            fits_reset(fits, least)
            rest += 1
            for x in best[1:]:
                take(x)
                held.append(x)
            gap = room - best[0]
        at = 0
        for x in held:
            row = order[by_length[x] + taken[x]]
            taken[x] += 1
            sequence[row], offset[row] = number, at
            at += x
        number += 1
    return sequence, offset


def fits_reset(fits: list[int], x: int) -> None:
    """A piece of length x is back: what was looked up past it no longer holds."""
    for y in range(x, len(fits)):
        if fits[y] < x:
            fits[y] = y


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, keep_ids: bool = False, pool: int = 131_072) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``.

    Pieces are dealt by where they stand into pools of about ``pool`` pieces, so equal rows, ids or lengths do not gather; each
    pool is packed by itself from its lengths, and leaves one sequence that is not full.  The number of pools follows from
    the number of documents and of their characters.  Documents that share an id are packed each for itself; other columns
    of ``docs`` are not looked at."""
    rows, letters = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    n = max(1, -(-(rows + (letters or 0) // (3 * size)) // pool))
    cut = pieces(docs, tokenizer, size, end, keep_ids).withColumn("pool", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset = pack(pdf["length"].to_numpy(), size)
        pdf["sequence_id"], pdf["offset"] = sequence + (pdf["pool"].to_numpy(np.int64) << 32), offset
        return pdf.drop(columns="pool")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return cut.groupBy("pool").applyInPandas(run, schema)
