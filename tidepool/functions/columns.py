"""The analysis, the predicate and the scores as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import DEFAULT_CLASS, FOLDS, MARKERS, Analyzer

TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)
SEP = "\x01"


def folded(text: Column, spaces: str = "") -> Column:
    """Letters folded; each of ``spaces``, signs that are no letters to fold, is a space."""
    plain = "".join(p * len(letters) for p, letters in FOLDS.items())
    return F.translate(text, "".join(FOLDS.values()) + spaces, plain + " " * len(spaces))


def quoted(signs: Iterable[str]) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(signs))


#: All signs of ASCII.
ASCII_SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def cleaned(text: Column, punctuation: dict[str, str] | None = None) -> Column:
    """As ``analysis.clean``.  Signs go before letters are lowered, as some letters lower to ASCII.  A regex over a class of many
    ranges is slow on every letter it passes, so ASCII's signs are translated with the letters, and one range is left to it."""
    kinds = {**DEFAULT_CLASS, **(punctuation or {})}
    of = lambda kind: [c for c, k in kinds.items() if k == kind]
    out = folded(text, "".join(c for c in ASCII_SIGNS if c != " " and kinds.get(c, "split") == "split"))
    if fold := of("fold"):
        out = F.regexp_replace(out, f"[{quoted(fold)}]", "")
    out = F.regexp_replace(out, f"[^\\x00-\\x7f{quoted(c for c in [*of('keep'), *of('marker')] if not c.isascii())}]", " ")
    if marker := of("marker"):
        out = F.regexp_replace(out, f"([{quoted(marker)}])", " $1 ")
    return F.lower(out)


def tokens(text: Column, punctuation: dict[str, str] | None = None) -> Column:
    return F.filter(F.split(cleaned(F.coalesce(text, F.lit("")), punctuation), " "), lambda t: t != "")


def sequence_of(text: Column, analyzer: Analyzer) -> Column:
    """The feature of every token position; markers, which are no features, stand as term:#.  For a vocabulary without
    phrases."""
    words = tokens(text, analyzer.punctuation)

    def feature(token: Column, i: Column, all_: Column) -> Column:
        """What is looked up least comes last: the length says of most tokens that they are no year."""
        before, after = F.get(all_, i - 1), F.get(all_, i + 1)
        context = before.isin(*MARKERS, *analyzer.number_context) | (after == "/")
        year = (F.length(token) == 4) & token.rlike("^(19|20)[0-9]{2}$") & ~F.coalesce(context, F.lit(False))
        generic = F.concat(F.lit("term:"), token)
        if not analyzer.synonyms:
            return F.when(year, F.concat(F.lit("year:"), token)).otherwise(generic)
        number = token.rlike("^[0-9]*\\.?[0-9]*$") & token.rlike("[0-9]")
        table = F.create_map(*[F.lit(x) for pair in sorted(analyzer.synonyms.items()) for x in pair])
        word = F.coalesce(F.try_element_at(table, token), generic)
        return F.when(year, F.concat(F.lit("year:"), token)).when(number | token.isin(*MARKERS), generic).otherwise(word)

    return F.transform(F.array(words), lambda all_: F.transform(all_, lambda t, i: feature(t, i, all_)))[0]


def features_of(sequence: Column) -> Column:
    """The set of features, sorted: N(T), and P(T) where there are no aliases."""
    return F.sort_array(F.array_except(sequence, F.array(*[F.lit(f"term:{m}") for m in MARKERS])))


# --- the predicate ----------------------------------------------------------------------------------------------------


def required_holds(required: Column, pos: Column) -> Column:
    return F.size(F.array_except(required, pos)) == 0


def anyof_holds(anyof: Column, pos: Column) -> Column:
    return F.forall(anyof, lambda group: F.exists(group, lambda member: F.forall(member, lambda alts: F.arrays_overlap(alts, pos))))


def nothing_forbidden(forbidden: Column, neg: Column) -> Column:
    return ~F.exists(forbidden, lambda m: F.forall(m, lambda f: F.array_contains(neg, f)))


def linear(graph: Column) -> Column:
    """Every arc spans one position."""
    return F.forall(graph["arcs"], lambda a: a["end"] - a["start"] == 1)


def phrase_occurs(graph: Column, sequence: Column) -> Column:
    """Whether a graph of one-position arcs reads along neighbouring positions of a title."""
    last = F.size(sequence) - graph["positions"]
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: F.forall(graph["arcs"], lambda a: F.array_contains(a["alts"], F.get(sequence, i + a["start"]))))


def tags_hold(tags: Column, wanted: dict[str, Iterable[str]]) -> Column:
    """All keys, any of a key's values; no key: all pass; a key without values: none does."""
    out = F.lit(True)
    for key, values in wanted.items():
        pairs = [F.lit(f"{key}{SEP}{v}") for v in values]
        out = out & (F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*pairs)) if pairs else F.lit(False))
    return out


# --- scores ------------------------------------------------------------------------------------------------------------


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(a > 0, F.lit(TOP)).otherwise(F.lit(BOTTOM)))


def saturating_multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.when((a > 0) == (b > 0), F.lit(TOP)).otherwise(F.lit(BOTTOM)))


def title_token_count(title: Column) -> Column:
    """Runs of letters and digits of any script in the title as it came."""
    return F.size(F.regexp_extract_all(title, F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1))).cast("long")


def title_features(title: Column) -> dict[str, Column]:
    return {"title_tokens": title_token_count(title), "title_bytes": F.octet_length(title).cast("long"), "title_digits": F.regexp_count(title, F.lit(r"\p{N}")).cast("long")}


def rank_features(title: Column) -> dict[str, Column]:
    """The nine features of a match, over the compiled columns and the title."""
    out = title_features(title)
    positive = F.col("n_positive_terms").cast("long")
    out["query_positive_terms"] = positive
    out["query_negative_terms"] = F.col("n_negative_terms").cast("long")
    out["query_any_of_groups"] = F.col("n_anyof_groups").cast("long")
    out["query_tag_count"] = F.coalesce(F.size("tags"), F.lit(0)).cast("long")
    out["positive_coverage_milli"] = F.floor(saturating_multiply(positive, F.lit(1000).cast("long")) / F.greatest(out["title_tokens"], F.lit(1).cast("long"))).cast("long")
    out["unmatched_title_tokens"] = F.greatest(out["title_tokens"] - positive, F.lit(0).cast("long"))
    return out
