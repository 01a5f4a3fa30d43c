"""Why a query matches or not, and figures about queries, postings and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import columns as C
from tidepool.plans import cover

from .match import QuerySet, phrases_hold, title_views


def explain(query_set: QuerySet, titles: DataFrame) -> DataFrame:
    """``title_id, query_id, candidate, matched, cost_class, title_features, failures`` for each of ``titles(title_id, title,
    query_id)`` and every live copy of its query.  A failure names the clause that does not hold."""
    views = title_views(titles.select("title_id", "title", "query_id"), query_set.analyzer)
    rows = views.join(query_set.rows, "query_id")
    if query_set.analyzer.plain:
        phrase = F.forall("required_phrases", lambda g: C.phrase_occurs(g, F.col("sequence")))
        banned = F.exists("forbidden_phrases", lambda g: C.phrase_occurs(g, F.col("sequence")))
    else:
        none = F.array().cast(query_set.rows.schema["required_phrases"].dataType)
        phrase = phrases_hold("required_phrases", none, "pos_arcs", "neg_arcs", "positions")
        banned = ~phrases_hold(none, "forbidden_phrases", "pos_arcs", "neg_arcs", "positions")
    missing = F.array_except("required", "pos")
    present = F.filter("forbidden", lambda m: F.forall(m, lambda f: F.array_contains(F.col("neg"), f)))
    unmet = F.size(F.filter("anyof", lambda g: ~F.exists(g, lambda m: F.forall(m, lambda a: F.arrays_overlap(a, F.col("pos"))))))
    failures = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing required: "), F.array_join(F.array_sort(missing), ", "))),
            F.when(F.size(present) > 0, F.concat(F.lit("forbidden present: "), F.array_join(F.array_sort(F.flatten(present)), ", "))),
            F.when(unmet > 0, F.concat(F.lit("any-of groups unmet: "), unmet.cast("string"))),
            F.when(~phrase, F.lit("required phrase absent")),
            F.when(banned, F.lit("forbidden phrase present")),
        )
    )
    sigs = F.array_union(cover.title_signatures(F.col("pos"), F.col("probe"), query_set.mask), F.array(F.lit(cover.UNIVERSAL)))
    out = rows.select("title_id", "query_id", F.arrays_overlap("signatures", sigs).alias("candidate"), "cost_class", F.col("pos").alias("title_features"), failures.alias("failures"))
    return out.withColumn("matched", F.size("failures") == 0)


def class_counts(query_set: QuerySet) -> DataFrame:
    return query_set.rows.groupBy("cost_class").agg(F.count(F.lit(1)).alias("n"))


def percentiles(counts: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Nearest-rank percentiles of a column: the value at rank ceil(p * count)."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    rows = counts.withColumn("_r", F.row_number().over(ordered)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda p: F.max(F.when(F.col("_r") == F.greatest(F.ceil(F.col("_n") * p / 100), F.lit(1)), F.col(value)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *[at(p).alias(f"p{p}") for p in (50, 95, 99)], F.max(value).alias("max"))


def posting_stats(query_set: QuerySet) -> DataFrame:
    """Lengths of the posting lists of each lane."""
    return percentiles(cover.postings(query_set.rows).groupBy("lane", "sig").agg(F.count(F.lit(1)).alias("n")), ["lane"])


def candidate_stats(query_set: QuerySet, titles: DataFrame, scope: str = "standard") -> DataFrame:
    """Candidates per title, titles without any included."""
    found = query_set.candidates(titles, scope).groupBy("title_id").agg(F.count(F.lit(1)).alias("n"))
    every = titles.select("title_id").join(found, "title_id", "left").select(F.lit("all").alias("titles"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return percentiles(every, ["titles"])


def match_stats(query_set: QuerySet, titles: DataFrame, scope: str = "standard") -> DataFrame:
    """Counts of a batch in one row: titles, probes, postings read, candidates, emissions, matches, doubles among them."""
    views = title_views(titles.select("title_id", "title"), query_set.analyzer)
    sigs = views.select("title_id", F.explode(F.array_union(cover.title_signatures(F.col("pos"), F.col("probe"), query_set.mask), F.array(F.lit(cover.UNIVERSAL)))).alias("sig"))
    read = sigs.join(cover.postings(query_set.visible(scope)), "sig")
    pairs = query_set.pairs(titles.select("title_id", "title"), scope).select("title_id", "query_id")
    parts = [
        titles.agg(F.count(F.lit(1)).alias("titles")),
        sigs.agg(F.count(F.lit(1)).alias("probes")),
        read.agg(F.count(F.lit(1)).alias("postings"), F.count(F.when(F.col("lane") == "broad", 1)).alias("broad_postings"), F.countDistinct("title_id", "row_id").alias("candidates")),
        pairs.agg(F.count(F.lit(1)).alias("emissions"), F.countDistinct("title_id", "query_id").alias("matches")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out.withColumn("duplicates", F.col("emissions") - F.col("matches"))


def distinct_bodies(query_set: QuerySet) -> DataFrame:
    """How many queries say different things."""
    body = F.sha2(F.to_json(F.struct("required", "anyof", "forbidden", "required_phrases", "forbidden_phrases")), 256)
    return query_set.rows.agg(F.count(F.lit(1)).alias("queries"), F.countDistinct(body).alias("bodies"))


def shown(table: DataFrame, columns: str | None = None, sort: str | None = None) -> DataFrame:
    """A table's columns ``a,b`` in the order of ``c,d:desc``."""
    if columns:
        table = table.select(*[c.strip() for c in columns.split(",")])
    if sort:
        table = table.orderBy(*[F.desc(k[0]) if k[1:] == ["desc"] else F.asc(k[0]) for k in (s.strip().split(":") for s in sort.split(","))])
    return table
