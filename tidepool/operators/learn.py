"""What a query corpus teaches: synonyms, equivalences, phrases, distributional pairs, and feedback on aliases."""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.aliases import AliasRegistry
from tidepool.functions.columns import folded
from tidepool.functions.dsl import QueryError, parse
from tidepool.functions.vocabulary import Vocabulary

# --- text helpers ------------------------------------------------------------------------------------------------------


def corpus_tokens(text: Column) -> Column:
    """Runs of letters, digits and dots, in lower case; signs of the query language separate, what is negated counts too."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9.]+)"), F.lit(1)), F.lower)


def normal_token(text: Column) -> Column:
    """Folded, in lower case, other signs as single underscores inside."""
    return F.regexp_replace(F.lower(F.regexp_replace(folded(text), "[^A-Za-z0-9]+", "_")), "^_|_$", "")


# --- any-of groups ---------------------------------------------------------------------------------------------------


def anyof_groups(queries: DataFrame) -> DataFrame:
    """``query_id, clause, forms``: the positive any-of groups of two members or more, as written, sorted and distinct."""

    @F.udf("array<array<string>>", useArrow=True)
    def groups(text: str) -> list[list[str]]:
        try:
            return [sorted(set(c.members)) for c in parse(text or "") if c.kind == "anyof" and not c.negated]
        except QueryError:
            return []

    out = queries.select("query_id", F.posexplode(groups("query")).alias("clause", "forms"))
    return out.where(F.size("forms") >= 2)


def group_support(queries: DataFrame, min_count: int = 2) -> DataFrame:
    """``forms, n``: groups by the number of clauses that are them."""
    return anyof_groups(queries).groupBy("forms").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def synonym_pairs(queries: DataFrame, min_count: int = 2) -> DataFrame:
    """``alias, canonical, n``: of each group the longest member, ties to the smallest, stands for the others; a pair counts
    once a query; each alias keeps its most frequent canonical form."""
    normal = F.array_distinct(F.filter(F.transform("forms", normal_token), lambda x: x != ""))
    rows = anyof_groups(queries).select("query_id", normal.alias("forms")).where(F.size("forms") >= 2)
    best = F.array_min(F.transform("forms", lambda x: F.struct((-F.octet_length(x)).alias("n"), x.alias("f"))))["f"]
    pairs = rows.withColumn("canonical", best).select("query_id", "canonical", F.explode("forms").alias("alias")).where("alias <> canonical").distinct()
    counted = pairs.groupBy("alias", "canonical").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    rank = F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("n"), "canonical"))
    return counted.withColumn("_r", rank).where("_r = 1").select("alias", "canonical", "n")


def equivalence_pairs(queries: DataFrame, min_count: int = 2) -> DataFrame:
    """``a, b, n`` with a < b: forms that stand in one group, by the number of queries."""
    one = anyof_groups(queries).select("query_id", "forms", F.explode("forms").alias("a"))
    pairs = one.select("query_id", "a", F.explode("forms").alias("b")).where("a < b").distinct()
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# --- phrases -------------------------------------------------------------------------------------------------------------


def bigrams(texts: DataFrame, column: str = "text", id_column: str = "doc_id", words: Column | None = None) -> DataFrame:
    """``a, b, n, texts``: neighbouring tokens, their number and that of the texts that hold them."""
    rows = texts.select(F.col(id_column).alias("id"), (corpus_tokens(F.col(column)) if words is None else words).alias("w"))
    pairs = rows.select("id", F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    within = pairs.groupBy("id", "p.a", "p.b").agg(F.count(F.lit(1)).alias("k"))
    return within.groupBy("a", "b").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts"))


def npmi_phrases(texts: DataFrame, min_count: int = 3, tau: float = 0.3, column: str = "text", id_column: str = "doc_id", words: Column | None = None) -> DataFrame:
    """``a, b, n, texts, npmi``: pairs that stand together more than their parts would by chance.  All shares are of the
    number of tokens."""
    rows = texts.select(F.explode(corpus_tokens(F.col(column)) if words is None else words).alias("w"))
    single = rows.groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    total = single.agg(F.sum("k").alias("total"))
    pairs = bigrams(texts, column, id_column, words).where(F.col("n") >= min_count)
    met = pairs.join(single.select(F.col("w").alias("a"), F.col("k").alias("ka")), "a").join(single.select(F.col("w").alias("b"), F.col("k").alias("kb")), "b").join(F.broadcast(total))  # one row
    share = F.col("n") / F.col("total")
    value = F.log(share / ((F.col("ka") / F.col("total")) * (F.col("kb") / F.col("total")))) / -F.log(share)
    return met.where("n < total").withColumn("npmi", value).where(F.col("npmi") >= tau).select("a", "b", "n", "texts", "npmi")


def glued(words: Column, phrases: Column) -> Column:
    """Neighbours that are a phrase as one token, from left to right."""

    def step(state: Column, word: Column) -> Column:
        both = F.concat(state["last"], F.lit("_"), word)
        joins = state["last"].isNotNull() & F.array_contains(phrases, both)
        done = F.when(joins, F.concat(state["out"], F.array(both))).when(state["last"].isNotNull(), F.concat(state["out"], F.array(state["last"]))).otherwise(state["out"])
        return F.struct(done.alias("out"), F.when(joins, F.lit(None).cast("string")).otherwise(word).alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"))
    return F.aggregate(words, start, step, lambda s: F.when(s["last"].isNotNull(), F.concat(s["out"], F.array(s["last"]))).otherwise(s["out"]))


def all_rows(rows: DataFrame, most: int | None, what: str) -> list:
    """Every row; an error, and no part of them, if there are more than ``most``."""
    out = (rows if most is None else rows.limit(most + 1)).collect()
    if most is not None and len(out) > most:
        raise ValueError(f"over {most} {what} learned: raise most or min_count")
    return out


def learn_phrases(texts: DataFrame, min_count: int = 3, tau: float = 0.3, iterations: int = 2, column: str = "text", id_column: str = "doc_id", most: int | None = None) -> dict[tuple[str, ...], tuple[str, bool]]:
    """Additive phrases, found again over glued tokens so that longer ones grow.  All of them come to the driver, as a
    vocabulary is an object of the driver; more than ``most`` a round, if it is given, are an error."""
    rows = texts.select(F.col(id_column).alias("doc_id"), corpus_tokens(F.col(column)).alias("w"))
    out: dict[tuple[str, ...], tuple[str, bool]] = {}
    for _ in range(iterations):
        found = npmi_phrases(rows, min_count, tau, id_column="doc_id", column="w", words=F.col("w")).orderBy(F.desc("n"), "a", "b")
        found = all_rows(found, most, "phrases")
        names = [f"{r.a}_{r.b}" for r in found]
        fresh = {tuple(n.split("_")): (f"term:{n}", True) for n in names}
        if not set(fresh) - set(out):
            break
        out |= fresh
        rows = rows.select("doc_id", glued(F.col("w"), F.split(F.lit(" ".join(names)), " ")).alias("w"))  # one literal; tokens hold no space
    return out


# --- distributional pairs ------------------------------------------------------------------------------------------------


def positive_bags(queries: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """``query_id, w``: the distinct tokens of each query's positive clauses; neighbours in a clause that are one of ``phrases``
    (``a_b``) are one token."""

    @F.udf("string", useArrow=True)
    def positive(text: str) -> str:
        """A line for each clause; neighbouring plain words are one."""
        try:
            clauses = [c for c in parse(text or "") if not c.negated]
        except QueryError:
            return ""
        runs = groupby(enumerate(clauses), lambda k: -1 if k[1].kind == "term" else k[0])
        return " \n ".join(" ".join(" ".join(c.members) if c.kind == "anyof" else c.text for _, c in run) for _, run in runs)

    if not phrases:
        return queries.select("query_id", F.array_distinct(corpus_tokens(positive("query"))).alias("w"))
    known = F.split(F.lit(" ".join(phrases)), " ")
    clauses = F.transform(F.split(positive("query"), "\n"), lambda c: glued(corpus_tokens(c), known))
    return queries.select("query_id", F.array_distinct(F.flatten(clauses)).alias("w"))


def plain_runs(queries: DataFrame) -> DataFrame:
    """``query_id, w``: the tokens of the plain words of each query in order, as they may form phrases."""

    @F.udf("string", useArrow=True)
    def words(text: str) -> str:
        try:
            return " ".join(c.text for c in parse(text or "") if not c.negated and c.kind != "anyof")
        except QueryError:
            return ""

    return queries.select("query_id", corpus_tokens(words("query")).alias("w"))


def discover_pairs(queries: DataFrame, min_count: int = 10, vocabulary: int = 4096, similarity: float = 0.6, together: float = 0.05, top: int = 100, bags: DataFrame | None = None, glue: bool = False, tau: float = 0.3) -> DataFrame:
    """``a, b, similarity, together``: words that are used alike (cosine of their PPMI contexts) but hardly in one query.

    ``glue``: words that stand together more than by chance (``min_count``, ``tau``) are one token first, and a pair whose
    tokens share a word is none."""
    if bags is None:
        runs = plain_runs(queries) if glue else None
        found = npmi_phrases(runs, min_count, tau, "w", "query_id", F.col("w")).orderBy(F.desc("n"), "a", "b").collect() if glue else []  # phrases of the vocabulary's size
        bags = positive_bags(queries, [f"{r.a}_{r.b}" for r in found])
    rows = bags.select("query_id", F.explode("w").alias("w"))
    n = bags.where(F.size("w") > 0).agg(F.count(F.lit(1)).alias("total"))
    often = rows.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_count).orderBy(F.desc("k"), "w").limit(vocabulary)
    rows = rows.join(F.broadcast(often), "w")  # ``vocabulary`` rows at most
    both = rows.select("query_id", F.col("w").alias("a"), F.col("k").alias("ka")).join(rows.select("query_id", F.col("w").alias("b"), F.col("k").alias("kb")), "query_id").where("a <> b")
    counts = both.groupBy("a", "b", "ka", "kb").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n))
    weights = counts.withColumn("ppmi", F.log(F.col("c") * F.col("total") / (F.col("ka") * F.col("kb")))).where("ppmi > 0")
    norms = weights.groupBy("a").agg(F.sqrt(F.sum(F.col("ppmi") * F.col("ppmi"))).alias("norm"))
    left, right = (weights.select(F.col("a").alias(x), "b", F.col("ppmi").alias(f"w{x}")) for x in ("x", "y"))
    dots = left.join(right, "b").where("x < y").groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"))
    met = dots.join(norms.select(F.col("a").alias("x"), F.col("norm").alias("nx")), "x").join(norms.select(F.col("a").alias("y"), F.col("norm").alias("ny")), "y")
    pairs = counts.select(F.col("a").alias("x"), F.col("b").alias("y"), (F.col("c") / F.least("ka", "kb")).alias("together"))
    out = met.join(pairs, ["x", "y"], "left").select(F.col("x").alias("a"), F.col("y").alias("b"), (F.col("dot") / (F.col("nx") * F.col("ny"))).alias("similarity"), F.coalesce("together", F.lit(0.0)).alias("together"))
    if glue:
        out = out.where(~F.arrays_overlap(F.split("a", "_"), F.split("b", "_")))
    return out.where((F.col("similarity") >= similarity) & (F.col("together") <= F.lit(together))).orderBy(F.desc("similarity"), "a", "b").limit(top)


# --- aliases -------------------------------------------------------------------------------------------------------------


def learn_aliases(queries: DataFrame, aliases: AliasRegistry, min_count: int = 2, analyzer=None) -> int:
    """Takes any-of groups of at least ``min_count`` clauses into the registry as learned; how many became active.  A
    group's confidence is 0.5 at ``min_count`` and nears 1 as it recurs."""
    activated = 0
    for r in group_support(queries, min_count).orderBy(F.desc("n"), "forms").collect():
        old = aliases.entries.get(aliases.key(r.forms))
        new = aliases.add(r.forms, "learned", r.n / (r.n + max(1, min_count)), analyzer)
        activated += new is not None and new.status == "active" and (old is None or old.status != "active")
    return activated


def record_candidates(pairs: DataFrame, aliases: AliasRegistry, analyzer=None) -> tuple[int, int, int]:
    """Takes distributional pairs (``a, b, similarity``) into the registry as candidates, which never act by themselves; how
    many are new, were known, and stay rejected."""
    fresh = seen = rejected = 0
    for r in pairs.select("a", "b", "similarity").orderBy(F.desc("similarity"), "a", "b").collect():
        known = aliases.key((r.a, r.b)) in aliases.entries
        sure = min(1.0, max(0.0, r.similarity)) if r.similarity is not None and math.isfinite(r.similarity) else 0.0
        new = aliases.add((r.a, r.b), "distributional", sure, analyzer)
        if new is not None:
            rejected += new.status == "rejected"
            seen += new.status != "rejected" and known
            fresh += new.status != "rejected" and not known
    return fresh, seen, rejected


# --- feedback ------------------------------------------------------------------------------------------------------------

#: A sketch keeps this many of a side's queries, and an overlap is taken from so many of the union.
RAW, SAMPLE = 1024, 256


def holds_run(words: Column, run: Column) -> Column:
    """Whether ``run`` stands in ``words`` in one piece."""
    at = F.when(F.size(words) >= F.size(run), F.sequence(F.lit(1), F.size(words) - F.size(run) + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(at, lambda i: F.slice(words, i, F.size(run)) == run)


def forms_held(texts: DataFrame, id_column: str, text_column: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """``id, a, b, ha, hb``: which of a pair's forms a text holds, for texts that hold one.  Texts meet forms by the forms'
    first words; the pairs are a list of the driver's."""
    rows = [(a, b, side, form.lower().split(" ")) for a, b in pairs for side, form in (("a", a), ("b", b))]
    forms = texts.sparkSession.createDataFrame(rows, "a string, b string, side string, run array<string>").withColumn("first", F.get("run", F.lit(0)))
    words = texts.select(F.col(id_column).alias("id"), corpus_tokens(F.col(text_column)).alias("w"))
    met = words.withColumn("first", F.explode(F.array_distinct("w"))).join(F.broadcast(forms), "first").where(holds_run(F.col("w"), F.col("run")))
    return met.groupBy("id", "a", "b").agg(F.bool_or(F.col("side") == "a").alias("ha"), F.bool_or(F.col("side") == "b").alias("hb"))


def feedback(titles: DataFrame, matches: DataFrame, pairs: list[tuple[str, str]], queries: DataFrame | None = None) -> DataFrame:
    """``a, b, titles_a, titles_b, titles_both, queries_sampled, overlap``: for each pair of forms how many titles hold
    only one or both, and how far the queries that match the ones and the others are the same (Jaccard).

    Queries whose own text names one of the forms are left out when ``queries`` is given."""
    seen = forms_held(titles, "title_id", "title", pairs).withColumnRenamed("id", "title_id")
    counts = seen.groupBy("a", "b").agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in (("titles_a", "ha and not hb"), ("titles_b", "hb and not ha"), ("titles_both", "ha and hb"))])
    found = seen.where("ha <> hb").join(matches, "title_id").select("a", "b", "query_id", "ha").distinct()
    if queries is not None:
        own = forms_held(queries, "query_id", "query", pairs).select("a", "b", F.col("id").alias("query_id"))
        found = found.join(own, ["a", "b", "query_id"], "left_anti")
    sides = found.groupBy("a", "b", "query_id").agg(F.count(F.lit(1)).alias("sides"))
    jaccard = sides.groupBy("a", "b").agg(F.count(F.lit(1)).alias("queries_sampled"), (F.count(F.when(F.col("sides") == 2, 1)) / F.count(F.lit(1))).alias("overlap"))
    return counts.join(jaccard, ["a", "b"], "left").select("a", "b", "titles_a", "titles_b", "titles_both", F.coalesce("queries_sampled", F.lit(0).cast("long")).alias("queries_sampled"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def smallest(found: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Of each key's distinct queries those of the smallest hashes, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "query_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def observe(titles: DataFrame, matches: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """What a batch tells of pairs of forms: (``a, b, titles_a, titles_b, titles_both``; the sketch ``a, b, side, hash,
    query_id`` of the queries that match titles with only one of the forms: per side those of the ``RAW`` smallest hashes).
    Both merge with those of other batches as if all had been one."""
    seen = forms_held(titles, "title_id", "title", pairs).withColumnRenamed("id", "title_id")
    counts = seen.groupBy("a", "b").agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in (("titles_a", "ha and not hb"), ("titles_b", "hb and not ha"), ("titles_both", "ha and hb"))])
    found = seen.where("ha <> hb").join(matches, "title_id").select("a", "b", F.when(F.col("ha"), "a").otherwise("b").alias("side"), F.xxhash64("query_id").alias("hash"), "query_id").distinct()
    return counts, smallest(found, ["a", "b", "side"], "hash", RAW)


def merged(one: tuple[DataFrame, DataFrame] | None, other: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two batches' observations as one."""
    if one is None:
        return other
    counts = one[0].unionByName(other[0]).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("titles_a", "titles_b", "titles_both")])
    return counts, smallest(one[1].unionByName(other[1]).distinct(), ["a", "b", "side"], "hash", RAW)


def report(observed: tuple[DataFrame, DataFrame], queries: DataFrame, pairs: list[tuple[str, str]], min_overlap: float = 0.5, min_titles: int = 50, min_queries: int = 20) -> DataFrame:
    """``a, b, titles_a, titles_b, titles_both, sampled_a, sampled_b, excluded, overlap, validated``.

    Sampled queries whose own text names one of the forms, and those that are no longer live, are left out.  The overlap is the
    Jaccard index of the two sides over the union's ``SAMPLE`` smallest hashes: exact while that many hold all.  A pair is
    validated if the overlap, both sides' titles and both sides' sampled queries reach their bounds."""
    counts, sketch = observed
    own = forms_held(queries, "query_id", "query", pairs).select("a", "b", F.col("id").alias("query_id")).withColumn("own", F.lit(True))
    told = sketch.join(queries.select("query_id", F.lit(True).alias("live")).distinct(), "query_id", "left").join(own, ["a", "b", "query_id"], "left")
    good = F.col("live").isNotNull() & F.col("own").isNull()
    excluded = told.groupBy("a", "b").agg(F.count(F.when(~good, 1)).alias("excluded"))
    kept = smallest(told.where(good).select("a", "b", "side", "hash", "query_id"), ["a", "b", "side"], "hash", SAMPLE)
    sampled = kept.groupBy("a", "b").agg(*[F.count(F.when(F.col("side") == x, 1)).alias(f"sampled_{x}") for x in "ab"])
    union = smallest(kept.groupBy("a", "b", "hash", "query_id").agg(F.count(F.lit(1)).alias("sides")), ["a", "b"], "hash", SAMPLE)
    overlap = union.groupBy("a", "b").agg((F.count(F.when(F.col("sides") == 2, 1)) / F.count(F.lit(1))).alias("overlap"))
    out = counts
    for more in (sampled, excluded, overlap):
        out = out.join(more, ["a", "b"], "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sampled_a", "sampled_b", "excluded")]
    both = (F.col("sampled_a") > 0) & (F.col("sampled_b") > 0)
    out = out.select("a", "b", "titles_a", "titles_b", "titles_both", *numbers, F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    out = out.withColumn("overlap", F.when(both, F.col("overlap")).otherwise(0.0))
    fine = (F.col("overlap") >= min_overlap) & (F.least("titles_a", "titles_b") >= min_titles) & (F.least("sampled_a", "sampled_b") >= min_queries)
    return out.withColumn("validated", fine)


def learn_vocabulary(queries: DataFrame, min_count: int = 2, equivalences: bool = False, phrases: bool = False, tau: float = 0.3, npmi_min: int = 3, iterations: int = 2, most: int | None = None) -> Vocabulary:
    """A vocabulary from any-of groups, as synonyms and phrases or as equivalences, with phrases of the corpus if asked.
    All of them come to the driver; more than ``most`` of a kind, if it is given, are an error."""
    out = Vocabulary()
    if equivalences:
        rows = all_rows(equivalence_pairs(queries, min_count).orderBy(F.desc("n"), "a", "b"), most, "equivalences")
        out.equivalences = [(r.a, r.b) for r in rows]
    else:
        for r in all_rows(synonym_pairs(queries, min_count).orderBy(F.desc("n"), "alias"), most, "synonyms"):
            tokens = tuple(r.alias.split("_"))
            if len(tokens) > 1:
                out.phrases[tokens] = (f"term:{r.canonical}", False)
            else:
                out.synonyms[r.alias] = f"term:{r.canonical}"
    if phrases:
        found = learn_phrases(queries, npmi_min, tau, iterations, "query", "query_id", most)
        out = out.merge(Vocabulary(phrases=found))
    return out
