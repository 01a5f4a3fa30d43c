"""Synthetic queries and titles, the same for a seed everywhere."""

from __future__ import annotations

from dataclasses import dataclass

MASK = (1 << 64) - 1
BRANDS = ("norvik", "tallow", "quill ridge", "brightmoor", "ostra", "kestrel bay", "fenwick", "lumora", "hollin")
ITEMS = ("lantern", "kettle", "saddle", "clock", "violin", "compass", "chair", "globe", "easel", "teapot")
TRAITS = ("brass", "walnut", "enamel", "folding", "carved", "quilted", "tiny", "striped", "hooded")
VARIANTS = ("ivory", "copper", "rose", "amber", "pearl", "slate", "teal", "plum", "sand", "moss")
NEGATIVES = ("copy", "torn", "pieces", "leaflet", "carton")
NOISE = ("lovely", "neat", "estate", "attic", "sale", "old", "grand", "spare", "parcel", "gift", "charming")
FOLDED = {"a": "ā", "e": "ë", "i": "ī", "o": "ō", "u": "ü", "n": "ń", "y": "ÿ"}
JUNK = ("™", "★", "世界", "привет", "½", "!!!", "~")


class SplitMix:
    """The 64-bit SplitMix generator."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        return self.next() % n

    def frac(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def skewed(self, n: int, skew: float) -> int:
        """Small numbers more often, the more the higher ``skew``."""
        return min(n - 1, int(n * self.frac() ** skew))

    def pick(self, items):
        return items[self.below(len(items))]


@dataclass(frozen=True)
class Shape:
    queries: int = 1000
    titles: int = 200
    broad: float = 0.05
    skew: float = 2.0
    family: int = 8
    seed: int = 1
    collections: int = 1200


def _product(r: SplitMix, shape: Shape) -> dict[str, str]:
    return {"year": str(1950 + r.below(70)), "brand": r.pick(BRANDS), "set": f"series{r.skewed(shape.collections, shape.skew)}", "item": r.pick(ITEMS)}


def generate(shape: Shape) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(queries, titles): families of near-alike queries, some broad ones, and titles of the products they ask for."""
    r = SplitMix(shape.seed)
    queries, products = [], []
    while len(queries) < shape.queries:
        if r.frac() < shape.broad:
            queries.append((len(queries), r.pick(ITEMS + TRAITS)))
            continue
        p = _product(r, shape)
        products.append(p)
        for _ in range(min(1 + r.below(shape.family), shape.queries - len(queries))):
            words = [p["year"], p["brand"], p["set"], p["item"]]
            words += [r.pick(TRAITS)] if r.frac() < 0.5 else []
            words += [r.pick(VARIANTS)] if r.frac() < 0.3 else []
            words += [f"-{r.pick(NEGATIVES)}" for _ in range(r.below(4))]
            queries.append((len(queries), " ".join(words)))
    titles = []
    for i in range(shape.titles):
        p = r.pick(products) if products and r.frac() < 0.9 else _product(r, shape)
        words = ([r.pick(NOISE)] if r.frac() < 0.5 else []) + [p["year"], p["brand"], p["set"], p["item"]]
        words += [r.pick(TRAITS)] if r.frac() < 0.7 else []
        words += [r.pick(VARIANTS)] if r.frac() < 0.5 else []
        words += [r.pick(NEGATIVES)] if r.frac() < 0.2 else []
        titles.append((i, " ".join([*words, r.pick(NOISE)])))
    return queries, titles


def negative_queries(seed: int, n: int) -> list[str]:
    """Queries of one to three negated words and nothing else."""
    r = SplitMix(seed)
    return [" ".join(f"-{r.pick(NEGATIVES)}" for _ in range(1 + r.below(3))) for _ in range(n)]


def messy_title(title: str, seed: int) -> str:
    """Other case, accents that fold away, more blanks, signs that separate, and junk around: the features stay."""
    r = SplitMix(seed)
    out = [r.pick(JUNK)] if r.frac() < 0.5 else []
    for word in title.split(" "):
        letters = [FOLDED[c] if c in FOLDED and r.frac() < 0.2 else c.upper() if r.frac() < 0.3 else c for c in word]
        out.append("".join(letters))
    return r.pick((" ", "  ", ", ")).join(out) + r.pick(("", " ", " ★", "!"))


def messy_query(query: str, seed: int) -> str:
    """Other case and accents in words; the signs of the language stay."""
    r = SplitMix(seed)
    return "".join(FOLDED[c] if c in FOLDED and r.frac() < 0.15 else c.upper() if r.frac() < 0.3 else c for c in query)
