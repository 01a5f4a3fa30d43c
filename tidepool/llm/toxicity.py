"""Toxicity: noisy-channel restoring of disguised words, then a linear score of the restored text."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import texts_of, written
from .tokens import Cache

#: What a sign can stand for, a fixed table of common substitutions.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SIGNS = re.escape("".join(STANDS_FOR))
#: Words that may be disguised: a sign beside letters or a letter three times.  All others are restored to themselves.
ODD = re.compile(rf"[^\W\d_][{SIGNS}]+[^\W\d_]|(?<![^\W\d_{SIGNS}])[{SIGNS}]+[^\W\d_]|[^\W\d_][{SIGNS}](?!\w|[{SIGNS}])|([^\W\d_])\1\1")
TRIPLE, SIGN = re.compile(r"([^\W\d_])\1\1"), re.compile(f"[{SIGNS}]")
#: Single letters or signs with blanks or marks between them.
SPACED = re.compile(rf"(?<!\S)(?:(?:[^\W\d_]|[{SIGNS}])[\s.\-_*]+){{2,}}(?:[^\W\d_]|[{SIGNS}])(?!\S)")
GAP = re.compile(r"[\s.\-_*]+")
EDGE = ".,;:?\"'()[]{}<>*#%&~`^=-_/\\"
LETTERS = 28  # a to z, the space, all others
SIGN_COST, KEEP_SIGN_COST, REPEAT_COST, ODD_GAP_COST = 1.0, 6.0, 0.7, 3.0
FOLDS, TILTS, STEPS = 4, (1.0, 2.0, 4.0), (50, 100, 200, 300)


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def letter_counts(texts: list[str], at_once: int = 500_000) -> np.ndarray:
    """Counts of three letters in a row; two blanks stand before and after each text.  Some texts at a time, so that what
    they become on the way stays small."""
    total = np.zeros(LETTERS**3, np.int64)
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= at_once or k == len(texts) - 1:
            raw = np.frombuffer(f"  {'  '.join(held)}  ".lower().encode("utf-32-le"), np.uint32)
            code = np.where((raw >= 97) & (raw <= 122), raw - 96, np.where(raw <= 32, 0, 27)).astype(np.int32)
            total += np.bincount(code[:-2] * LETTERS**2 + code[1:-1] * LETTERS + code[2:], minlength=LETTERS**3)
            held, size = [], 0
    return total


class Language:
    """Costs of a letter after two others, from counts over the whole corpus."""

    def __init__(self, counts: np.ndarray):
        shape = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        two = shape.sum(axis=2, keepdims=True)
        one = shape.sum(axis=0, keepdims=True)
        single = (one + 0.5) / (one + 0.5).sum(axis=2, keepdims=True)
        self.cost = -np.log((shape + 20 * single) / (two + 20))
        self.cost = self.cost.tolist()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place of a word the letters it can stand for, with what the channel charges.

    A run of three or more equal letters is one place: it stands for the letter once or twice, or as it is for much."""
    out, at = [], 0
    while at < len(word):
        end = at
        while end < len(word) and word[end] == word[at]:
            end += 1
        c, n = word[at], end - at
        if c in STANDS_FOR:
            out += [[(x, SIGN_COST) for x in STANDS_FOR[c]] + [(c, KEEP_SIGN_COST)]] * n
        elif n >= 3:
            out.append([(c, REPEAT_COST), (c + c, 2 * REPEAT_COST), (c * n, n * REPEAT_COST)])
        else:
            out += [[(c, 0.0)]] * n
        at = end
    return out


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of letters that blanks or marks keep apart.

    A gap stands for nothing or for the blank between two words.  A gap that is like the run's usual one is charged for being a blank,
    a wider or other one for being nothing; the language settles where words end.  Equal letters with usual gaps between them
    are a run of that letter."""
    letters, gaps = GAP.split(run), GAP.findall(run)
    usual = Counter(gaps).most_common(1)[0][0]
    out, at = [], 0
    while at < len(letters):
        end = at + 1
        while end < len(letters) and letters[end] == letters[at] and gaps[end - 1] == usual:
            end += 1
        if at:
            like = gaps[at - 1] == usual
            out.append([("", 0.0 if like else ODD_GAP_COST), (" ", ODD_GAP_COST if like else 0.0)])
        out += lattice(letters[at] * (end - at))
        at = end
    return out


def decode(word: str, language: Language) -> str:
    return cheapest(lattice(word), language)


def cheapest(places: list[list[tuple[str, float]]], language: Language) -> str:
    """The cheapest path through a lattice under the channel and the language.  What all paths begin with is put aside, so
    that a long one costs no more a letter than a short one."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    cost = language.cost
    shared: list[str] = []
    for place in [*places, [(" ", 0.0)]]:
        if len(next(iter(states.values()))[1]) >= 64 and (begin := commonprefix([text for _, text in states.values()])):
            shared.append(begin)
            states = {ends: (so_far, text[len(begin) :]) for ends, (so_far, text) in states.items()}
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (total, text) in states.items():
            for letters, charge in place:
                x, y, sum_ = a, b, total + charge
                for c in letters:
                    k = letter(c)
                    sum_ += cost[x][y][k]
                    x, y = y, k
                if (x, y) not in new or sum_ < new[x, y][0]:
                    new[x, y] = sum_, text + letters
        states = new
    return ("".join(shared) + min(states.values())[1])[:-1]


def joined(text: str, language: Language) -> str:
    """The text in lower case, with letters that marks or blanks keep apart put together to words.  Signs alone stay."""

    def together(m: re.Match) -> str:
        run = m[0]
        return cheapest(spaced_lattice(run), language) if any(c.isalpha() for c in run) else run

    return SPACED.sub(together, text.lower())


def restored_word(word: str, language: Language) -> str:
    if not (TRIPLE.search(word) or SIGN.search(word) and ODD.search(word)):
        return word
    core = word.strip(EDGE).rstrip("!" + EDGE)  # an exclamation mark that ends a word is one
    return word.replace(core, decode(core, language)) if core and ODD.search(core) else word


def restore(text: str, language: Language) -> str:
    """The text in lower case with disguised words restored."""
    return re.sub(r"\S+", lambda m: restored_word(m[0], language), joined(text, language))


def features_of(word: str) -> list[str]:
    """A word's features: itself, its beginnings, and what it holds, over all its letters.  A long word, which can be a whole
    text in a script without spaces, is named by its digest, so that names stay short."""
    w = "".join(filter(str.isalpha, word))
    if len(w) < 3:
        return []
    marked = "^" + w
    grams = [marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)]
    name = f"={w}" if len(w) <= 40 else f"={hashlib.sha256(w.encode('utf-8', 'surrogatepass')).hexdigest()}"
    return [*grams, name] if len(w) >= 4 else [name]


def features_by_word(language: Language, chosen=None, limit: int = 150_000) -> Cache:
    """Of each word, restored, the features that are among ``chosen`` (None: all)."""
    if chosen is None:
        return Cache(lambda w: tuple(features_of(restored_word(w, language))), limit)
    among = frozenset(chosen).intersection
    return Cache(lambda w: tuple(among(features_of(restored_word(w, language)))), limit)


def held_by(text: str, words: Cache, language: Language) -> set[str]:
    """The features of a text's restored words."""
    held: set[str] = set()
    for w in set(joined(text, language).split()):
        if found := words[w]:
            held.update(found)
    return held


@dataclass
class Model:
    """Weights of the chosen features; how each text is scored."""

    language: Language
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def words(self) -> Cache:
        return features_by_word(self.language, self.weights)

    def score(self, text: str, words: Cache) -> float:
        held = held_by(text, words, self.language)
        total = self.bias + math.fsum(self.weights[f] for f in sorted(held))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def language_of(docs: DataFrame) -> Language:
    """Letter statistics over every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            total += letter_counts(texts_of(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    counts = np.zeros(LETTERS**3, np.int64)
    for row in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 28^3 rows at most
        counts[row.gram] = row.n
    return Language(counts)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, most: int = 4000, features: int = 4096, least: int = 3) -> Model:
    """A logistic regression on the presence of ``features`` word pieces in restored texts.

    It learns from the labels where ``learn_from`` (a condition on ``doc_id``) holds, at most ``most`` rows of either
    label, those of the smallest hashes; the rows count as the classes do among all such labels.  A doc_id that is
    labelled twice counts as toxic if one of its labels is.  The letter statistics cover the whole corpus."""
    language = language_of(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(learn_from).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return Model(language, {}, 0.0 if not share else 4.0 if 1 in share else -4.0)
    picked = None
    for value in (0, 1):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # 2 * most rows at most
    sample = written(sample.repartition(12, "doc_id"), "sample")

    def held(chosen: frozenset | None, only: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = features_by_word(language, chosen, 50_000)
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for batch in batches:
                for text, toxic in zip(texts_of(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
                    if only is None or toxic == only:
                        count[min(1, toxic)].update(held_by(text, words, language))
            for toxic, c in count.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["feature", "toxic", "n"])

        return run

    schema = "feature string, toxic int, n long"
    seen = sample.mapInArrow(held(None, 1), schema).groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    often = written(seen.orderBy(F.desc("n"), "feature").limit(16 * features), "often").collect()
    chosen = frozenset(r.feature for r in often)
    in_clean = {r.feature: r.n for r in sample.mapInArrow(held(chosen, 0), schema).groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}

    def gain(feature: str, n: int) -> float:
        p, q = (n + 0.5) / (size.get(1, 0) + 1), (in_clean.get(feature, 0) + 0.5) / (size.get(0, 0) + 1)
        return p * math.log(p / q) if p > q else 0.0

    best = sorted(((-gain(r.feature, r.n), r.feature) for r in often))[:features]
    number = {f: i for i, f in enumerate(f for g, f in best if g < 0)}
    if not number:
        return Model(language, {}, math.log(share[1] / share[0]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = features_by_word(language, number)
        for batch in batches:
            out = [sorted(number[f] for f in held_by(t, words, language)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(batch.schema.get_field_index("toxic"))], ["held", "toxic"])

    weight = {k: share.get(k, 0) / max(1, size.get(k, 0)) for k in (0, 1)}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted((toxic, held) for b in batches for held, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        weights, bias = regress([held for _, held in data], np.array([toxic for toxic, _ in data], float), len(number), weight)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([bias])], ["weights", "bias"])

    data = written(sample.mapInArrow(rows, "held array<int>, toxic int"), "rows")
    row = written(data.repartition(1).mapInArrow(fit, "weights array<double>, bias double"), "weights").first()
    return Model(language, {f: row.weights[i] for f, i in number.items() if row.weights[i]}, row.bias)


def regress(held: list[list[int]], y: np.ndarray, n: int, weight: dict[int, float], ridge: float = 3e-5, at_once: int = 1024) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of present features, by Adam on the whole data.

    What a missed toxic row costs in false alarms (``TILTS``) and the number of steps (``STEPS``) are those with the best F1, at
    the classes' shares, on folds that took no part in the fit; equal rows are in one fold.  All fits go on side by side."""
    fold = np.array([zlib.crc32(np.array(h, np.int32).tobytes()) % FOLDS for h in held])
    x = np.zeros((len(held), n + 1), np.float32)
    x[:, n] = 1
    for k, h in enumerate(held):
        x[k, h] = 1
    fits = [(tilt, f) for tilt in TILTS for f in (*range(FOLDS), None)]
    each = np.stack([np.where(y == 1, tilt * weight[1], weight[0]) * (fold != f if f is not None else 1) for tilt, f in fits], axis=1)
    each = (each / np.maximum(each.sum(axis=0), 1e-300)).astype(np.float32)
    w = np.zeros((n + 1, len(fits)), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    shrink = np.full((n + 1, 1), ridge, np.float32)
    shrink[n] = 0
    best: tuple[float, np.ndarray] | None = None
    for t in range(1, max(STEPS) + 1):
        grad = shrink * w
        for lo in range(0, len(x), at_once):
            part = slice(lo, lo + at_once)
            off = (1 / (1 + np.exp(-np.clip(x[part] @ w, -60, 60))) - y[part, None]) * each[part]
            grad += x[part].T @ off.astype(np.float32)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        if t in STEPS:
            said = x @ w >= 0
            for at, _ in enumerate(TILTS):
                apart = said[np.arange(len(y)), at * (FOLDS + 1) + fold]
                hit, missed, alarm = (weight[c] * float(k.sum()) for c, k in ((1, apart & (y == 1)), (1, ~apart & (y == 1)), (0, apart & (y == 0))))
                f1 = 2 * hit / max(2 * hit + missed + alarm, 1e-300)
                if best is None or f1 > best[0]:
                    best = f1, w[:, at * (FOLDS + 1) + FOLDS].astype(float)
    return best[1][:n], float(best[1][n])


def scores(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``score`` (0 to 1) in place of any column of that name, from the text alone;
    null texts count as empty.  One row per row of ``docs``, repeated and null ids too; equal texts have equal scores."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    read = list(dict.fromkeys([*kept, "text"]))
    at = read.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words()
        for batch in batches:
            out = [model.score(t or "", words) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.float64())], [*kept, "score"])

    docs = docs.select(*read)
    return docs.mapInArrow(run, StructType([*docs.schema.fields[: len(kept)], StructField("score", DoubleType())]))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0
