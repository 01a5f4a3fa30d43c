"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written
from .tokens import PLAIN, Vocabulary, pretokens, vocabulary

MAGIC = b"TIDELEX1"


# --- the automaton -----------------------------------------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Edges and final states of the smallest acyclic automaton of these sorted, distinct words; state 0 is the root.

    Words are added in order.  When a word leaves the path of the one before, that path's tail can no longer change, and
    each of its states is replaced by an equal one that is there already, if any: equal tails are shared."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(sorted(edges[state].items())))
            same = known.setdefault(key, state)
            if same != state:
                edges[path[-1]][before[len(path) - 1]] = same
                edges[state] = {}

    for word in words:
        common = len(os.path.commonprefix([before, word]))
        close(common)
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        before = word
    close(0)
    return edges, final


def compile_lexicon(ids_of: dict[bytes, list[int]], path: str) -> None:
    """Writes the transducer: for each state its edges with the number that an edge adds, so that the sum along a
    word's path is its place among all words; and at that place the word's ids."""
    words = sorted(ids_of)
    edges, final = minimal_automaton(words)
    order, number = [], {}
    stack = [0]
    while stack:  # states that are reached, the root first
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack += edges[s].values()
    below: dict[int, int] = {}

    def count(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            missing = [t for t in edges[s].values() if t not in below]
            if missing:
                todo += missing
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                todo.pop()
        return below[state]

    count(0)
    keys, targets, adds = [], [], []
    for s in order:
        passed = int(final[s])
        for byte, t in sorted(edges[s].items()):
            keys.append(number[s] << 8 | byte)
            targets.append(number[t])
            adds.append(passed)
            passed += below[t]
    starts = np.cumsum([0, *(len(ids_of[w]) for w in words)])
    flat = [i for w in words for i in ids_of[w]]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32), np.array([final[s] for s in order], np.int8), starts.astype(np.int64), np.array(flat, np.uint32)]
    with open(path, "wb") as f:
        f.write(MAGIC + np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


class Lexicon:
    """A compiled lexicon, memory-mapped: processes on a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path}: not a lexicon")
        sizes = np.frombuffer(self.map, np.int64, 6, 8)
        at, arrays = 56, []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int32, np.int32, np.int8, np.int64, np.uint32), strict=True):
            arrays.append(np.frombuffer(self.map, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.targets, self.adds, self.final, self.starts, self.ids = arrays

    def find(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of words (rows of bytes, padded) among the lexicon's words, -1 where they are none: all walk
        the automaton together, a byte at a time."""
        place = np.zeros(len(words), np.int64)
        state = np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        found = np.full(len(words), -1, np.int64)
        for t in range(words.shape[1] + 1):
            over = lengths[alive] == t
            done = alive[over]
            ok = self.final[state[done]] == 1
            found[done[ok]] = place[done[ok]]
            alive = alive[~over]
            if not len(alive):
                break
            key = state[alive] << 8 | words[alive, t]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            state[alive] = self.targets[at]
            place[alive] += self.adds[at]
        return found


# --- merging -----------------------------------------------------------------------------------------------------------


class Merger:
    """Exact byte-pair merging of many words at once."""

    def __init__(self, vocab: Vocabulary):
        ids = vocab.ranks
        pairs = sorted((ids[a] << 32 | ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(vocab.merges))
        self.codes = np.array([p[0] for p in pairs], np.int64)
        self.rank = np.array([p[1] for p in pairs], np.int32)
        self.made = np.array([p[2] for p in pairs], np.int32)
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.none = np.int32(2**31 - 1)
        self.by_rank = np.array([ids[a + b] for a, b in vocab.merges], np.int32)
        every = np.repeat(self.byte, 256).reshape(256, 256)
        #: Ranks of pairs of bytes: the first round needs no search.
        self.of_bytes = self.lookup(every, every.T)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair among the merges; ``none`` where it is no merge."""
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.rank[at], self.none)

    def merge(self, words: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """The ids of each word: in every round each word's leftmost pair of the lowest rank becomes one id, until no pair
        of any word can merge."""
        cols = np.arange(words.shape[1])
        ids = np.where(cols < lengths[:, None], self.byte[words], -1)
        out: list = [None] * len(ids)
        at = np.arange(len(ids))
        ranks = np.where(cols[1:] < lengths[:, None], self.of_bytes[words[:, :-1], words[:, 1:]], self.none)
        while len(at):
            rows = np.arange(len(at))
            spot = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(at), np.int64)
            going = ranks[rows, spot] != self.none if ranks.shape[1] else np.zeros(len(at), bool)
            over = ids[~going]
            kept = over >= 0
            flat, ends = over[kept].tolist(), kept.sum(axis=1).cumsum().tolist()
            for k, lo, hi in zip(at[~going].tolist(), [0, *ends], ends, strict=False):
                out[k] = flat[lo:hi]
            at, ids, ranks, spot = at[going], ids[going], ranks[going], spot[going]
            if not len(at):
                break
            rows = np.arange(len(at))
            ids[rows, spot] = self.by_rank[ranks[rows, spot]]
            width = ids.shape[1]
            source = np.minimum(cols[: width - 1] + (cols[: width - 1] > spot[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            if width - 1 < 2:
                ranks = np.zeros((len(at), 0), np.int32)
                continue
            source = np.minimum(cols[: width - 2] + (cols[: width - 2] > spot[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, source, 1)
            left = np.flatnonzero(spot > 0)
            ranks[left, spot[left] - 1] = self.lookup(ids[left, spot[left] - 1], ids[left, spot[left]])
            right = np.flatnonzero(spot < width - 2)
            ranks[right, spot[right]] = self.lookup(ids[right, spot[right]], ids[right, spot[right] + 1])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """One long word, in time that grows little faster than its length: a heap of pairs over a linked list."""
        import heapq

        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        table = self.table()
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := table.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = table[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := table.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    @lru_cache(maxsize=1)  # noqa: B019
    def table(self) -> dict:
        pairs = zip((self.codes >> 32).tolist(), (self.codes & 0xFFFFFFFF).tolist(), self.rank.tolist(), self.made.tolist(), strict=True)
        return {(a, b): (r, m) for a, b, r, m in pairs}


LONG = 64
#: Parts whose ids a worker keeps, some 200 bytes each.
CACHED = 300_000


class Codec:
    """Encodes texts through a lexicon, merging what it lacks; decodes ids.

    Ids are kept as comma-joined decimals by word, as texts are made of the same words again and again."""

    def __init__(self, path: str, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocabulary(path), lexicon
        self.merger = Merger(self.vocab)
        self.bytes_of = {str(i): b for i, b in self.vocab.bytes_of.items()}
        self.decimal = [str(i) for i in range(max(self.vocab.bytes_of) + 1)]
        self.cache: dict[str, str] = {}

    def encode_words(self, words: list[str]) -> list[str]:
        """Comma-joined ids of pre-tokens: from the lexicon, else merged."""
        raw = [w.encode() for w in words]
        written = lambda ids: ",".join(map(self.decimal.__getitem__, ids))
        out: list[str] = [""] * len(raw)
        short = [k for k, w in enumerate(raw) if len(w) <= LONG]
        if len(short) < len(raw):
            for k, w in enumerate(raw):
                if len(w) > LONG:
                    out[k] = written(self.merger.merge_long(w))
        if not short:
            return out
        lengths = np.array([len(raw[k]) for k in short])
        width = int(lengths.max())
        matrix = np.frombuffer(b"".join([raw[k].ljust(width, b"\0") for k in short]), np.uint8).reshape(len(short), width)
        places = self.lexicon.find(matrix, lengths) if self.lexicon else np.full(len(short), -1)
        for k, place in zip(short, places.tolist(), strict=True):
            if place >= 0:
                out[k] = written(self.lexicon.ids[self.lexicon.starts[place] : self.lexicon.starts[place + 1]].tolist())
        unseen = np.flatnonzero(places < 0)
        least = 0
        for size in (8, 12, 16, 32, LONG):  # words of about a length together
            some = unseen[(lengths[unseen] > least) & (lengths[unseen] <= size)]
            least = size
            if len(some):
                for k, ids in zip(some.tolist(), self.merger.merge(matrix[some, : min(size, width)], lengths[some]), strict=True):
                    out[short[k]] = written(ids)
        return out

    def words_of(self, text: str) -> list[str | int]:
        """Pre-tokens, and the ids of added tokens."""
        out: list[str | int] = []
        for piece, special in self.vocab.pieces(text):
            if special is None:
                out += pretokens()(piece)
            else:
                out.append(special)
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Comma-joined ids of each text.

        Between single spaces stand parts that are encoded alike everywhere, so only parts that are new are cut into
        pre-tokens, and all new pre-tokens are looked up together."""
        cut = [split_words(t) for t in texts]
        new_parts = list(set().union(*filter(None, cut)) - self.cache.keys())
        spelled = [part_text(p) for p in new_parts]
        lists = [[p] if PLAIN(p[1:] if p[:1] == " " else p) else self.words_of(p) for p in spelled]
        rest = [self.words_of(t) if c is None else None for t, c in zip(texts, cut, strict=True)]
        new = list({w for ws in (*lists, *filter(None, rest)) for w in ws if isinstance(w, str)})
        known: dict[str, str] = {}
        for lo in range(0, len(new), 20_000):
            known.update(zip(new[lo : lo + 20_000], self.encode_words(new[lo : lo + 20_000]), strict=True))
        join = lambda ws: ",".join([known[w] if isinstance(w, str) else str(w) for w in ws])
        now = {p: known[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else join(ws) for p, ws in zip(new_parts, lists, strict=True)}
        if len(self.cache) + len(now) > CACHED:  # starts anew with what these texts need
            self.cache = {p: self.cache[p] for p in set().union(*filter(None, cut)) & self.cache.keys()}
        self.cache.update(now)
        out = [join(ws) if c is None else ",".join(map(self.cache.__getitem__, c)) for c, ws in zip(cut, rest, strict=True)]
        for p in [p for p in now if len(p) > LONG]:
            del self.cache[p]
        return out

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace")


def split_words(text: str) -> list[str] | None:
    """Parts of a text between its spaces, which are encoded by themselves as they are in place; None where spaces stand
    together, as they may form one pre-token.  A part has a space in front of it, and its key here has none; the first
    part, which has none, has a space after it in its key."""
    if "  " in text:
        return None
    parts = text.split(" ")
    if parts[0]:
        parts[0] += " "
        return parts
    return parts[1:]


def part_text(key: str) -> str:
    return key[:-1] if key[-1:] == " " else " " + key


# --- over a table --------------------------------------------------------------------------------------------------------


def reduced(count: Counter, most: int) -> Counter:
    """At most ``most`` of the words, with the next one's count taken from all: what Misra and Gries keep.  A word's count
    is then short by what was taken, at most; one frequent enough is never lost."""
    if len(count) <= most:
        return count
    cut = np.partition(np.fromiter(count.values(), np.int64, len(count)), len(count) - most - 1)[len(count) - most - 1]
    return Counter({w: n - int(cut) for w, n in count.items() if n > cut})


def frequent_words(docs: DataFrame, most: int, held: int = 200_000) -> list[str]:
    """About the ``most`` most frequent words between spaces over all texts, from summaries of bounded size of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                count.update(text.split(" "))
                if len(count) > held:
                    count = reduced(count, held // 2)
        count = reduced(count, most)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long").where(F.length("word").between(1, 32)).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in written(counted.orderBy(F.desc("n"), "word").limit(most), "words").collect()]


def build_lexicon(docs: DataFrame, tokenizer: str, words: int = 30_000) -> str:
    """Compiles the most frequent words (they change the speed, not the ids) and sends the file to every executor; returns its name there."""
    codec = Codec(tokenizer, None)
    pre = sorted({w for word in frequent_words(docs, words) for w in codec.words_of(" " + word) if isinstance(w, str)})
    ids = {w.encode(): [int(i) for i in s.split(",")] for w, s in zip(pre, codec.encode_words(pre), strict=True)}
    path = f"{tempfile.mkdtemp(prefix='tidepool-')}/lexicon-{uuid.uuid4().hex}"  # addFile serves it from here
    compile_lexicon(ids, path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


@lru_cache(maxsize=2)
def codec_of(tokenizer: str, lexicon: str | None) -> Codec:
    return Codec(tokenizer, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def encode_decode(docs: DataFrame, tokenizer: str, lexicon: str | None, batch: int = 256) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded``: ids comma-joined, and the text that they decode to.  Null texts count as empty.  One
    row per row of ``docs``, repeated and null ids too; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer, lexicon)
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                ids = codec.encode(texts_of(part))
                n = pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids), n, pa.array([codec.decode(i) for i in ids])], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids string, n_tokens long, decoded string")
