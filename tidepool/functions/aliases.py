"""Alias groups under governance: where they come from, what they are, whether they are active."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from .analysis import clean

#: Higher ones decide anew about what lower ones brought in.
PROVENANCE = ("distributional", "learned", "declared")
KINDS = ("single_token_variant", "single_token_distinct", "multi_word", "mixed_kind")
STATUS = ("candidate", "active", "rejected")
MAX_RULES, MAX_FORMS = 10_000, 256


class SynonymFileError(ValueError):
    def __init__(self, line: int, why: str):
        super().__init__(f"line {line}: {why}")
        self.line = line


def surface(form: str) -> str:
    return "".join(c for c in clean(form) if c.isalnum())


def variant_like(a: str, b: str) -> bool:
    """Forms that begin with the same three letters."""
    x, y = surface(a), surface(b)
    return len(x) >= 3 and len(y) >= 3 and x[:3] == y[:3]


def classify(forms: Iterable[str], analyzer=None) -> str:
    """Several words in a form: multi_word; forms of which a query has no feature, or has kinds that differ: mixed_kind;
    else single tokens that look like variants of each other, or do not."""
    forms = list(forms)
    sizes = [len(clean(f).split()) for f in forms]
    if not forms or min(sizes) == 0:
        return "mixed_kind"
    if analyzer is not None:
        kinds = {f.split(":", 1)[0] for form, n in zip(forms, sizes, strict=True) if n == 1 for f in analyzer.features(form, "query")}
        if len(kinds) > 1 or any(n == 1 and len(analyzer.features(form, "query")) != 1 for form, n in zip(forms, sizes, strict=True)):
            return "mixed_kind"
    if max(sizes) > 1:
        return "multi_word"
    return "single_token_variant" if all(variant_like(forms[0], f) for f in forms[1:]) else "single_token_distinct"


def default_status(kind: str, provenance: str) -> str:
    """Declared groups act at once unless they mix kinds; learned ones if they are plain variants; others wait."""
    if provenance == "declared":
        return "candidate" if kind == "mixed_kind" else "active"
    if provenance == "learned":
        return "active" if kind == "single_token_variant" else "candidate"
    return "candidate"


@dataclass(frozen=True)
class Alias:
    forms: tuple[str, ...]
    provenance: str
    kind: str
    status: str
    confidence: float = 0.0
    feedback: dict | None = None


@dataclass
class AliasRegistry:
    entries: dict[tuple[str, ...], Alias] = field(default_factory=dict)

    @staticmethod
    def key(forms: Iterable[str]) -> tuple[str, ...]:
        return tuple(sorted({f.strip() for f in forms if f.strip()}))

    def add(self, forms: Iterable[str], provenance: str, confidence: float = 0.0, analyzer=None) -> Alias | None:
        """Takes a group in.  A rejected one stays rejected; a higher provenance decides anew, the same one only
        upgrades; the higher confidence stays."""
        key = self.key(forms)
        if len(key) < 2:
            return None
        kind = classify(key, analyzer)
        new = Alias(key, provenance, kind, default_status(kind, provenance), confidence)
        old = self.entries.get(key)
        if old:
            confidence = max(old.confidence, confidence)
            rank, was = PROVENANCE.index(provenance), PROVENANCE.index(old.provenance)
            if old.status == "rejected" or rank < was:
                new = replace(old, confidence=confidence)
            elif rank == was and new.status != "active":
                new = replace(old, confidence=confidence)
            else:
                new = replace(new, confidence=confidence, feedback=old.feedback)
        self.entries[key] = new
        return new

    def _set(self, forms: Iterable[str], status: str) -> Alias:
        key = self.key(forms)
        self.entries[key] = replace(self.entries[key], status=status)
        return self.entries[key]

    def activate(self, forms: Iterable[str]) -> Alias:
        return self._set(forms, "active")

    def reject(self, forms: Iterable[str]) -> Alias:
        return self._set(forms, "rejected")

    def record_feedback(self, forms: Iterable[str], overlap: float, titles_a: int, titles_b: int, queries_sampled: int) -> None:
        key = self.key(forms)
        if key in self.entries:
            self.entries[key] = replace(self.entries[key], feedback={"overlap": overlap, "titles_a": titles_a, "titles_b": titles_b, "queries_sampled": queries_sampled})

    def apply(self, reports: Iterable[dict], activate: bool = False) -> tuple[int, list[Alias]]:
        """Takes a report's rows in as evidence of the pairs that are known; with ``activate`` the validated candidates become
        active.  How many were known, and what became active."""
        known, out = 0, []
        for r in reports:
            key = self.key((r["a"], r["b"]))
            if key not in self.entries:
                continue
            known += 1
            self.record_feedback(key, r["overlap"], r["titles_a"], r["titles_b"], min(r["sampled_a"], r["sampled_b"]))
            entry = self.entries[key]
            if activate and r["validated"] and entry.status == "candidate" and entry.kind != "mixed_kind":
                out.append(self.activate(key))
        return known, out

    def activate_validated(self, min_overlap: float = 0.5, min_titles: int = 50, min_queries: int = 20) -> list[Alias]:
        """Candidates whose feedback reaches the bounds become active."""
        out = []
        for a in list(self.entries.values()):
            f = a.feedback
            if a.status == "candidate" and a.kind != "mixed_kind" and f and f["overlap"] >= min_overlap and min(f["titles_a"], f["titles_b"]) >= min_titles and f["queries_sampled"] >= min_queries:
                out.append(self.activate(a.forms))
        return out

    def demote_unexpressible(self, analyzer) -> list[Alias]:
        """Active groups that the vocabulary can no longer express become candidates."""
        out = []
        for a in list(self.entries.values()):
            if a.status == "active" and (kind := classify(a.forms, analyzer)) == "mixed_kind":
                self.entries[a.forms] = replace(a, kind=kind, status="candidate")
                out.append(self.entries[a.forms])
        return out

    def merge(self, other: AliasRegistry) -> AliasRegistry:
        return AliasRegistry({**other.entries, **self.entries})

    def active_groups(self) -> list[tuple[str, ...]]:
        return [a.forms for a in self.entries.values() if a.status == "active"]

    def active_forms(self) -> list[str]:
        return [f for g in self.active_groups() for f in g]

    def import_solr(self, text: str, analyzer=None) -> list[Alias]:
        return [a for group in parse_solr(text) if (a := self.add(group, "declared", 1.0, analyzer))]

    def to_dict(self) -> dict:
        return {"entries": [{k: list(v) if k == "forms" else v for k, v in vars(a).items() if v is not None} for a in self.entries.values()]}

    @classmethod
    def from_dict(cls, data: dict) -> AliasRegistry:
        out = cls()
        for e in data.get("entries", []):
            a = Alias(cls.key(e["forms"]), e["provenance"], e["kind"], e["status"], float(e.get("confidence", 0)), e.get("feedback"))
            if a.provenance not in PROVENANCE or a.kind not in KINDS or a.status not in STATUS:
                raise ValueError(f"alias: {e}")
            out.entries[a.forms] = a
        return out


def parse_solr(text: str) -> list[tuple[str, ...]]:
    """Groups of a synonym file: ``a, b, c`` or ``a, b => c`` (both sides together), # for comments, backslash before a sign
    that is meant as itself.  An error names its line, and then nothing is taken."""
    groups = []
    for number, line in enumerate(text.splitlines(), 1):
        forms, sides, word, at, blank = [], 1, "", 0, True
        while at < len(line):
            c = line[at]
            if c == "\\":
                if at + 1 == len(line):
                    raise SynonymFileError(number, "nothing follows the backslash")
                word, at, blank = word + line[at + 1], at + 2, False
                continue
            if c == "#" and blank and not forms:
                word = ""
                break
            if line.startswith("=>", at):
                forms, word, at, sides = [*forms, word], "", at + 2, sides + 1
                if sides > 2:
                    raise SynonymFileError(number, "more than one =>")
                continue
            if c == ",":
                forms, word = [*forms, word], ""
            else:
                word += c
                blank &= c.isspace()
            at += 1
        if blank and not forms and not word.strip():
            continue
        key = AliasRegistry.key([*forms, word])
        if len([*forms, word]) > MAX_FORMS:
            raise SynonymFileError(number, "too many forms")
        if len(key) < 2:
            raise SynonymFileError(number, "fewer than two forms")
        groups.append(key)
        if len(groups) > MAX_RULES:
            raise SynonymFileError(number, "too many rules")
    return groups
