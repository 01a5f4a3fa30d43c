"""Text to features: the analysis that queries and titles share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The letters that fold to a plain one.  Capitals that are not listed are left as they are.
FOLDS = {
    "a": "áàâäãåāąÁÀÂÄÃÅ",
    "e": "éèêëēėęÉÈÊË",
    "i": "íìîïīįÍÌÎÏ",
    "o": "óòôöõøōÓÒÔÖÕ",
    "u": "úùûüūÚÙÛÜ",
    "n": "ñńÑ",
    "c": "çćčÇĆČ",
    "s": "šśŠŚ",
    "z": "žźżŽŹŻ",
    "y": "ýÿÝ",
    "l": "łŁ",
}
FOLD = {ord(c): plain for plain, letters in FOLDS.items() for c in letters}
MARKERS = ("#", "/")
DEFAULT_CLASS = {".": "keep", "#": "marker", "/": "marker"}
NUMBER = re.compile(r"[0-9]*\.?[0-9]*")
YEAR = re.compile(r"19[0-9]{2}|20[0-9]{2}")


class Signs(dict):
    """What stands for each sign, by its code, filled as signs are met."""

    def __init__(self, punctuation: dict[str, str] | None = None):
        super().__init__()
        self.kinds = {**DEFAULT_CLASS, **(punctuation or {})}

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isascii() and c.isalnum():
            out = c.lower()
        else:
            out = {"split": " ", "fold": "", "keep": c, "marker": f" {c} "}[self.kinds.get(c, "split")]
        self[code] = out
        return out


PLAIN_SIGNS = Signs()


def clean(text: str, punctuation: dict[str, str] | None = None) -> str:
    """Letters folded, ASCII letters and digits in lower case; every other sign by its class: split (a space), fold
    (nothing), keep (itself) or marker (itself between spaces)."""
    return text.translate(FOLD).translate(Signs(punctuation) if punctuation else PLAIN_SIGNS)


def is_number(token: str) -> bool:
    return bool(NUMBER.fullmatch(token)) and any(c.isdigit() for c in token)


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    feature: str
    mode: str = "collapse"  # collapse, additive or alias


Arc = tuple[str, int, int]


@dataclass
class Analyzer:
    synonyms: dict[str, str] = field(default_factory=dict)
    phrases: list[Phrase] = field(default_factory=list)
    punctuation: dict[str, str] = field(default_factory=dict)
    number_context: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.by_tokens = {p.tokens: p for p in self.phrases}
        self.sizes = sorted({len(p.tokens) for p in self.phrases}, reverse=True)
        self.has_alias = any(p.mode == "alias" for p in self.phrases)

    @property
    def plain(self) -> bool:
        """No phrases: every token stands for itself, and DataFrame functions can do it all."""
        return not self.phrases

    def tokens(self, text: str) -> list[str]:
        return [t for t in clean(text, self.punctuation).split(" ") if t]

    def feature_of(self, tokens: list[str], i: int) -> str | None:
        """What an unconsumed token stands for; None for a marker."""
        token = tokens[i]
        if token in MARKERS:
            return None
        if is_number(token):
            before = tokens[i - 1] if i else ""
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            plain = before in MARKERS or after == "/" or before in self.number_context
            return f"year:{token}" if YEAR.fullmatch(token) and not plain else f"term:{token}"
        return self.synonyms.get(token, f"term:{token}")

    def occurrences(self, tokens: list[str], adjacent: list[bool] | None = None) -> list[tuple[int, Phrase]]:
        """All places of all phrases.  ``adjacent[i]``: token i follows the one before after a single space."""
        out = []
        for i in range(len(tokens)):
            for n in self.sizes:
                p = self.by_tokens.get(tuple(tokens[i : i + n]))
                if p and (adjacent is None or all(adjacent[i + 1 : i + n])):
                    out.append((i, p))
        return out

    def emit(self, text: str, side: str, additive: bool = False, collapse: bool = False) -> tuple[list[Arc], int]:
        """(feature, start, end) over token positions, and their number.

        Leftmost-longest phrases that do not overlap are taken first.  A phrase's tokens count no more by themselves unless it
        is additive, or an alias in a title, or ``additive`` is set.  Without ``collapse`` a phrase's words have to
        stand a single space apart."""
        cleaned = clean(text, self.punctuation)
        tokens, adjacent, gap = [], [], 2
        for piece in cleaned.split(" "):
            if piece:
                tokens.append(piece)
                adjacent.append(gap == 1)
                gap = 1
            else:
                gap += 1
        loose = collapse or side == "query" and self.has_alias
        arcs: list[Arc] = []
        consumed = [False] * len(tokens)
        free = 0
        for i, p in sorted(self.occurrences(tokens, None if loose else adjacent), key=lambda x: (x[0], -sum(map(len, x[1].tokens)) - len(x[1].tokens))):
            if i < free:
                continue
            free = i + len(p.tokens)
            arcs.append((p.feature, i, free))
            if not (additive or p.mode == "additive" or p.mode == "alias" and side == "title"):
                consumed[i:free] = [True] * len(p.tokens)
        for i in range(len(tokens)):
            if not consumed[i] and (f := self.feature_of(tokens, i)):
                arcs.append((f, i, i + 1))
        return arcs, len(tokens)

    def features(self, text: str, side: str = "title", additive: bool = False) -> list[str]:
        return sorted({f for f, _, _ in self.emit(text, side, additive)[0]})

    def title_sets(self, title: str) -> tuple[list[str], list[str]]:
        """(N, P): what a title says, and all that it may be taken to say."""
        n = set(self.features(title))
        if not self.has_alias:
            return sorted(n), sorted(n)
        tokens = self.tokens(title)
        p = n | set(self.features(title, additive=True)) | {f"term:{t}" for t in tokens if t not in MARKERS}
        p |= {phrase.feature for _, phrase in self.occurrences(tokens)}
        return sorted(n), sorted(p)

    def filled(self, text: str, side: str, additive: bool = False) -> tuple[list[Arc], int]:
        """Arcs over run-collapsed text, with the word itself where no arc lies."""
        arcs, n = self.emit(text, side, additive, collapse=True)
        tokens = self.tokens(text)
        covered = {i for _, s, e in arcs for i in range(s, e)}
        return arcs + [(f"term:{tokens[i]}", i, i + 1) for i in range(n) if i not in covered], n

    def title_arcs(self, title: str) -> tuple[list[Arc], list[Arc], int]:
        """(N-arcs, P-arcs, positions)."""
        neg, n = self.filled(title, "title")
        if self.plain:
            return sorted(set(neg)), sorted(set(neg)), n
        pos = set(neg) | set(self.emit(title, "title", additive=True, collapse=True)[0])
        tokens = self.tokens(title)
        pos |= {(f"term:{t}", i, i + 1) for i, t in enumerate(tokens) if t not in MARKERS}
        pos |= {(p.feature, i, i + len(p.tokens)) for i, p in self.occurrences(tokens)}
        return sorted(set(neg)), sorted(pos), n

    def phrase_graph(self, text: str) -> tuple[int, list[tuple[int, int, list[str]]]]:
        """A quoted phrase: the number of positions and arcs (start, end, alternatives)."""
        arcs, n = self.filled(text, "query")
        spans: dict[tuple[int, int], set[str]] = {}
        for f, s, e in arcs:
            spans.setdefault((s, e), set()).add(f)
        return n, [(s, e, sorted(fs)) for (s, e), fs in sorted(spans.items())]


#: So many places and so many comparisons a phrase may take in one title.
MAX_STATES = MAX_WORK = 65_536


def graph_occurs(positions: int, arcs: list[tuple[int, int, list[str]]], title: list[Arc], title_positions: int, most_states: int = MAX_STATES, most_work: int = MAX_WORK) -> bool | None:
    """Whether some path through the phrase reads along some path through the title; None if that takes too much work to tell.

    A place is a node of the phrase with one of the title; comparing an arc of each is a unit of work."""
    leaving: dict[int, list[tuple[int, set[str]]]] = {}
    for s, e, alternatives in arcs:
        leaving.setdefault(s, []).append((e, set(alternatives)))
    there: dict[int, list[tuple[int, str]]] = {}
    for f, s, e in title:
        there.setdefault(s, []).append((e, f))
    seen: set[tuple[int, int]] = set()
    work = 0
    first = leaving.get(0, ())
    for start in range(title_positions + 1):
        if positions and not any(f in alternatives for _, alternatives in first for _, f in there.get(start, ())):
            continue  # a start that no first arc fits is no place
        todo = [(0, start)]
        while todo:
            node, at = todo.pop()
            if node == positions:
                return positions > 0
            for end, alternatives in leaving.get(node, ()):
                for stop, f in there.get(at, ()):
                    work += 1
                    if work > most_work:
                        return None
                    if f in alternatives and (end, stop) not in seen:
                        if len(seen) >= most_states:
                            return None
                        seen.add((end, stop))
                        todo.append((end, stop))
    return False
