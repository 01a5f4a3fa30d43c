"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import part_text, split_words
from .common import texts_of
from .tokens import PLAIN, Cache, pretokens, vocabulary


def unigram_scores(tokenizer: str) -> dict[bytes, float]:
    """Log-probabilities for the pieces of a byte-level vocabulary by Zipf's rule: the piece of id i has a share in
    proportion to 1 / (i + 2.7).  All bytes are pieces, so every text has a segmentation."""
    ranks = vocabulary(tokenizer).ranks
    total = math.log(math.fsum(1 / (i + 2.7) for i in ranks.values()))
    return {b: -math.log(i + 2.7) - total for b, i in ranks.items()}


class Trie:
    """Pre-tokens as paths of bytes.  Each node holds the best score of all segmentations of its path and the number of
    pieces of the best one, computed once however many words pass through it.

    Of segmentations with equal scores the one found first counts, longest last piece first.  With ``limit`` nodes the
    trie starts anew, so its memory is bounded."""

    def __init__(self, scores: dict[bytes, float], limit: int = 1_000_000):
        self.pieces, self.limit = scores, limit
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.best, self.count = [0.0], [0]
        self.terminal: dict[int, int] = {}

    def insert(self, word: bytes) -> int:
        """The number of pieces in the best segmentation of a word."""
        if len(self.best) + len(word) > self.limit:
            self.clear()
        path, node = [0], 0
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = self.child.get(key, -1)
            if node < 0:
                node = self.child[key] = len(self.best)
                self.extend(word, depth, path)
            path.append(node)
        self.terminal[node] = self.count[node]
        return self.terminal[node]

    def extend(self, word: bytes, depth: int, path: list[int]) -> None:
        """One forward step: the best way to end a piece at this depth."""
        best, count = -math.inf, 0
        for start in range(max(0, depth - self.longest), depth):
            score = self.pieces.get(word[start:depth])
            if score is not None and (total := self.best[path[start]] + score) > best:
                best, count = total, self.count[path[start]] + 1
        self.best.append(best)
        self.count.append(count)


class Counter:
    def __init__(self, tokenizer: str):
        self.vocab = vocabulary(tokenizer)
        self.trie = Trie(unigram_scores(tokenizer))
        self.cache = Cache(self.of_key)

    def of_key(self, key: str) -> int:
        return self.of_part(part_text(key))

    def of_part(self, part: str) -> int:
        if part[:1] == " " and PLAIN(part[1:]):
            return self.trie.insert(part.encode())
        total = 0
        for piece, special in self.vocab.pieces(part):
            total += 1 if special is not None else sum(self.trie.insert(w.encode()) for w in pretokens()(piece))
        return total

    def __call__(self, text: str) -> int:
        words = split_words(text)
        return self.of_part(text) if words is None else sum(map(self.cache.__getitem__, words))


@lru_cache(maxsize=1)
def counter(tokenizer: str) -> Counter:
    return Counter(tokenizer)


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens``: pieces in the best unigram segmentation of each pre-token, summed over the whole text; an added
    token counts one.  Null texts count as empty: none.  One row per row of ``docs``, repeated and null ids too; of
    segmentations that score the same the count is that of the first found.  Other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in texts_of(batch)], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
