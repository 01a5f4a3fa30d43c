"""Vocabularies: what words mean the same, what words belong together, how signs and numbers read."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from .aliases import AliasRegistry
from .analysis import Analyzer, Phrase, clean

PUNCTUATION = ("split", "fold", "keep", "marker")
FIELDS = ("synonyms", "phrases", "equivalences", "punctuation", "number_context", "aliases")


class VocabularyError(ValueError):
    pass


def _strict(item: dict, allowed: Iterable[str], where: str) -> dict:
    if not isinstance(item, dict) or set(item) - set(allowed):
        raise VocabularyError(f"{where}: unknown fields {sorted(set(item) - set(allowed)) if isinstance(item, dict) else item!r}")
    return item


@dataclass
class Vocabulary:
    """``synonyms`` (token to feature), ``phrases`` (tokens to feature, additive or not), ``equivalences`` (groups of
    forms), ``punctuation`` (sign to class), ``number_context`` (words before a plain number), ``aliases``."""

    synonyms: dict[str, str] = field(default_factory=dict)
    phrases: dict[tuple[str, ...], tuple[str, bool]] = field(default_factory=dict)
    equivalences: list[tuple[str, ...]] = field(default_factory=list)
    punctuation: dict[str, str] = field(default_factory=dict)
    number_context: list[str] = field(default_factory=list)
    aliases: AliasRegistry = field(default_factory=AliasRegistry)

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        data = _strict(json.loads(text), FIELDS, "vocabulary")
        out = cls(number_context=[str(w) for w in data.get("number_context", [])])
        for s in data.get("synonyms", []):
            _strict(s, ("token", "canonical", "kind"), "synonym")
            out.synonyms.setdefault(s["token"], s["canonical"])
        for p in data.get("phrases", []):
            _strict(p, ("tokens", "canonical", "kind", "additive"), "phrase")
            out.phrases.setdefault(tuple(p["tokens"]), (p["canonical"], bool(p.get("additive", False))))
        out.equivalences = [tuple(g) for g in data.get("equivalences", [])]
        for p in data.get("punctuation", []):
            _strict(p, ("ch", "class"), "punctuation")
            if len(p["ch"]) != 1 or p["class"].lower() not in PUNCTUATION:
                raise VocabularyError(f"punctuation: {p}")
            out.punctuation[p["ch"]] = p["class"].lower()
        if "aliases" in data:
            out.aliases = AliasRegistry.from_dict(data["aliases"])
        return out

    def to_json(self) -> str:
        return json.dumps(
            {
                "synonyms": [{"token": t, "canonical": c} for t, c in self.synonyms.items()],
                "phrases": [{"tokens": list(t), "canonical": c, "additive": a} for t, (c, a) in self.phrases.items()],
                "equivalences": [list(g) for g in self.equivalences],
                "punctuation": [{"ch": c, "class": k} for c, k in self.punctuation.items()],
                "number_context": self.number_context,
                "aliases": self.aliases.to_dict(),
            },
            ensure_ascii=False,
        )

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def merge(self, other: Vocabulary) -> Vocabulary:
        """Both; where they differ, this one's entry stays."""
        return replace(
            self,
            synonyms={**other.synonyms, **self.synonyms},
            phrases={**other.phrases, **self.phrases},
            equivalences=list(dict.fromkeys([*self.equivalences, *other.equivalences])),
            punctuation={**other.punctuation, **self.punctuation},
            number_context=self.number_context or other.number_context,
            aliases=self.aliases.merge(other.aliases),
        )

    def analyzer(self) -> Analyzer:
        """With the active aliases: a form of several words becomes a phrase that titles also keep word by word; one that
        is declared as a phrase keeps its feature."""
        phrases = {t: Phrase(t, c, "additive" if a else "collapse") for t, (c, a) in self.phrases.items()}
        for form in self.aliases.active_forms():
            tokens = tuple(clean(form, self.punctuation).split())
            if len(tokens) > 1:
                old = phrases.get(tokens)
                phrases[tokens] = Phrase(tokens, old.feature if old else "term:" + "_".join(tokens), "alias")
        return Analyzer(dict(self.synonyms), list(phrases.values()), dict(self.punctuation), tuple(w.lower() for w in self.number_context))

    def equivalence_classes(self, analyzer: Analyzer | None = None) -> dict[str, tuple[str, ...]]:
        """Feature to all features that count as it.  A form takes part if a query of it has exactly one feature; groups
        that share a feature are one."""
        analyzer = analyzer or self.analyzer()
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for group in [*self.equivalences, *self.aliases.active_groups()]:
            features = [f for form in group if len(fs := analyzer.features(form, "query")) == 1 for f in fs]
            if len(set(features)) > 1:
                for f in features[1:]:
                    a, b = find(features[0]), find(f)
                    root[max(a, b)] = min(a, b)
        classes: dict[str, list[str]] = {}
        for f in list(root):
            classes.setdefault(find(f), []).append(f)
        return {f: tuple(sorted(c)) for c in classes.values() if len(c) > 1 for f in c}
