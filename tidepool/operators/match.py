"""Which stored queries match which titles."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import columns as C
from tidepool.functions.analysis import Analyzer, graph_occurs
from tidepool.functions.tasks import spread
from tidepool.functions.vocabulary import Vocabulary
from tidepool.plans import cover
from tidepool.plans.lowering import compile_queries, refused_queries

ARCS = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
VIEW = T.StructType([T.StructField("neg", T.ArrayType(T.StringType())), T.StructField("pos", T.ArrayType(T.StringType())), T.StructField("neg_arcs", ARCS), T.StructField("pos_arcs", ARCS), T.StructField("positions", T.IntegerType())])

#: So many signatures are looked for in each title before they are exploded.
FEW_SIGNATURES = 256
#: Postings of up to so many bytes are sent to the titles.
BROADCAST_BYTES = 64 << 20
#: Where every title would meet on one key, it meets on one of so many.
SALTS = 64
#: The titles of a meaning that very many queries share meet copies of those queries.
MEMBER_SALTS = 16


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with these columns, computed once.  The optimizer writes a plain column's expression into every place that
    reads it, and array functions share no work between places; it does not look through a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def title_views(titles: DataFrame, analyzer: Analyzer, title: str = "title") -> DataFrame:
    """``titles`` with ``neg``, ``pos``, ``probe`` and, for phrases, ``sequence`` or arcs, on all cores and by ``title_id``.

    Without phrases in the vocabulary all of it is DataFrame functions; with phrases titles are analysed in batches in
    Python."""
    titles = spread(titles, *[c for c in titles.columns if c == "title_id"])
    if analyzer.plain:
        out = computed(titles, sequence=C.sequence_of(F.col(title), analyzer))
        out = computed(out, pos=C.features_of(F.col("sequence")), probe=F.sort_array(F.array_distinct("sequence")))
        return out.withColumn("neg", F.col("pos"))

    @F.pandas_udf(VIEW)
    def views(texts: pd.Series) -> pd.DataFrame:
        known = {}
        for t in set(texts):
            neg, pos = analyzer.title_sets(t or "")
            neg_arcs, pos_arcs, n = analyzer.title_arcs(t or "")
            as_dicts = [[{"feature": f, "start": s, "end": e} for f, s, e in arcs] for arcs in (neg_arcs, pos_arcs)]
            known[t] = (neg, pos, *as_dicts, n)
        return pd.DataFrame([known[t] for t in texts], columns=VIEW.names)

    out = titles.withColumn("_v", views(title)).select(*titles.columns, "_v.*")
    return out.withColumn("probe", F.array_sort(F.array_union("pos", F.transform("pos_arcs", lambda a: a["feature"]))))


@F.arrow_udf(T.BooleanType())
def phrases_hold(required: pa.Array, forbidden: pa.Array, pos_arcs: pa.Array, neg_arcs: pa.Array, positions: pa.Array) -> pa.Array:
    """Whether all required graphs occur in P-arcs and no forbidden one in N-arcs; null graphs: true.  A graph that takes too much
    work to tell rejects nothing: a required one counts as there, a forbidden one as not there."""

    def occurs(g, arcs, n) -> bool | None:
        return graph_occurs(g["positions"], [(a["start"], a["end"], list(a["alts"])) for a in g["arcs"]], [(a["feature"], a["start"], a["end"]) for a in arcs], n)

    out = []
    # lists, as the conversion of such columns to pandas crashes on batches without any graph
    for req, forb, pos, neg, n in zip(*[c.to_pylist() for c in (required, forbidden, pos_arcs, neg_arcs, positions)], strict=True):
        ok = all(occurs(g, pos, n) is not False for g in (req if req is not None else ()))
        out.append(ok and not any(occurs(g, neg, n) is True for g in (forb if forb is not None else ())))
    return pa.array(out, pa.bool_())


def predicate(analyzer: Analyzer) -> Column:
    """The exact predicate over a row of compiled and title columns, without phrases where those need Python."""
    out = C.required_holds(F.col("required"), F.col("pos")) & C.nothing_forbidden(F.col("forbidden"), F.col("neg")) & C.anyof_holds(F.col("anyof"), F.col("pos"))
    if analyzer.plain:
        out = out & F.forall("required_phrases", lambda g: C.phrase_occurs(g, F.col("sequence")))
        out = out & ~F.exists("forbidden_phrases", lambda g: C.phrase_occurs(g, F.col("sequence")))
    return out


def with_phrases(rows: DataFrame, analyzer: Analyzer) -> DataFrame:
    """The phrase check for vocabularies with phrases: after all else, and with graphs and arcs only where there are graphs."""
    if analyzer.plain:
        return rows
    some = (F.size("required_phrases") > 0) | (F.size("forbidden_phrases") > 0)
    given = [F.when(some, F.col(c)) for c in ("required_phrases", "forbidden_phrases", "pos_arcs", "neg_arcs")]
    return rows.where(phrases_hold(*given, F.coalesce("positions", F.lit(0))))


def ids_differ(titles: DataFrame) -> bool:
    """Whether no two titles share an id."""
    return not titles.groupBy("title_id").count().where("count > 1").limit(1).count()


def told(found: DataFrame, members: DataFrame) -> DataFrame:
    """``title_id, body`` with all ``members`` of the body, which may be very many.

    Few members go to the titles.  Else both sides are dealt out, as one body may have most of the rows."""
    if members.limit(cover.BROADCAST_ROWS + 1).count() <= cover.BROADCAST_ROWS:
        return found.join(F.broadcast(members), "body")
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("title_id"), F.lit(MEMBER_SALTS)).cast("int"))
    copies = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(MEMBER_SALTS - 1))))
    return dealt.join(copies.hint("merge"), ["body", "salt"]).drop("salt")


def rejected(queries: DataFrame, vocabulary: Vocabulary | None = None, accept_class_d: bool = False) -> DataFrame:
    """``query_id, kind, pos`` of the queries that a ``QuerySet`` would not take, without building one."""
    vocabulary = vocabulary or Vocabulary()
    analyzer = vocabulary.analyzer()
    found = refused_queries(queries.select("query_id", "query"), analyzer, vocabulary.equivalence_classes(analyzer), accept_class_d)
    return found.where("refusal is not null").select("query_id", "refusal.kind", "refusal.pos")


BODY = ("required", "anyof", "forbidden", "required_phrases", "forbidden_phrases")


@dataclass(frozen=True)
class QuerySet:
    """Compiled and classified queries: ``row_id, query_id, tags, priority, ...``, one row per live copy of a query.

    Rows are kept in the cluster's memory or on its disks until ``release``."""

    rows: DataFrame
    rejected: DataFrame
    analyzer: Analyzer
    mask: cover.Mask
    frequency: DataFrame
    held: tuple[DataFrame, ...] = ()
    kept: dict = field(default_factory=dict, init=False, compare=False)

    @classmethod
    def build(cls, queries: DataFrame, vocabulary: Vocabulary | None = None, theta: int = 0, accept_class_d: bool = False, mask: Iterable[str] | None = None, keep: DataFrame | None = None) -> QuerySet:
        """``queries(query_id, query)``, with or without ``row_id, tags, priority, version, generation``.

        ``mask``: the hot features, frozen earlier; None: those of these queries.  Queries that do not parse, and
        those without a positive clause unless accepted, are in ``rejected`` with their ``error``."""
        vocabulary = vocabulary or Vocabulary()
        analyzer = vocabulary.analyzer()
        for name, value in (("row_id", F.col("query_id")), ("tags", F.array().cast("array<string>")), ("priority", F.lit(0).cast("long")), ("version", F.lit(1)), ("generation", F.col("query_id"))):
            if name not in queries.columns:
                queries = queries.withColumn(name, value)
        compiled = compile_queries(queries, analyzer, vocabulary.equivalence_classes(analyzer)).cache()
        frequency = cover.feature_frequency(compiled)
        top = cover.Mask(tuple(mask if mask is not None else cover.top_mask(frequency)), theta)
        negative = (F.size("forbidden") > 0) | (F.size("forbidden_phrases") > 0)
        nothing = (F.size("required") == 0) & (F.size("anyof") == 0) & (F.size("required_phrases") == 0)
        refused = nothing & ~(negative & F.lit(accept_class_d))
        bad = compiled.where("error is not null").select("row_id", "query_id", "error.kind", "error.pos")
        empty = compiled.where("error is null").where(refused).select("row_id", "query_id", F.lit("ClassD").alias("kind"), F.lit(0).alias("pos"))
        rows = cover.classified(compiled.where("error is null").where(~refused), frequency, top).drop("error", "counted", "proxies").cache()
        return cls(rows, bad.unionByName(empty), analyzer, top, frequency, (rows, compiled))

    def release(self) -> None:
        """Lets go of what is kept; what is asked later is computed again."""
        for df in (*self.held, *self.kept.values()):
            df.unpersist()
        self.kept.clear()

    def visible(self, scope: str) -> DataFrame:
        """``standard``: without the broad lane's classes C and D; ``with_broad``: all."""
        if scope not in ("standard", "with_broad"):
            raise ValueError(f"scope {scope!r}")
        return self.rows if scope == "with_broad" else self.rows.where(~F.col("cost_class").isin("C", "D"))

    def filtered(self, tags: dict | None) -> QuerySet:
        return self if not tags else replace(self, rows=self.rows.where(C.tags_hold(F.col("tags"), tags)))

    def candidates(self, titles: DataFrame, scope: str = "standard") -> DataFrame:
        """``title_id, row_id``: what the signatures lead to, before the predicate."""
        return self._candidates(title_views(titles.select("title_id", "title"), self.analyzer), self.visible(scope)).select("title_id", "row_id")

    def _candidates(self, views: DataFrame, rows: DataFrame) -> DataFrame:
        """Narrow rows meet by signature.  The signature that every title has is there only if a query has it, and is then salted:
        titles are dealt to copies of those queries, so they do not gather."""
        sigs = cover.title_signatures(F.col("pos"), F.col("probe"), self.mask)
        posted = cover.postings(rows).select("sig", "row_id")
        narrow = views.select("title_id", F.explode(sigs).alias("sig"))
        found = narrow.join(posted.where(F.col("sig") != cover.UNIVERSAL), "sig").select("title_id", "row_id").distinct()
        every = posted.where(F.col("sig") == cover.UNIVERSAL).select("row_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        if every.limit(1).count():
            dealt = views.select("title_id", F.pmod(F.xxhash64("title_id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
            found = found.unionByName(dealt.join(every, "salt").select("title_id", "row_id"))
        return found

    def posting_bytes(self, rows: DataFrame) -> int:
        """About how much memory the postings take with all that stands beside them: each signature has a copy of its query."""
        arrays = [F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) for c in BODY] + [F.coalesce(F.octet_length(F.to_json("tags")), F.lit(0)), F.coalesce(F.octet_length("query"), F.lit(0))]
        row = arrays[0]
        for part in arrays[1:]:
            row = row + part
        return rows.agg(F.sum(F.size("signatures") * (2 * row + 256))).first()[0] or 0

    def pairs(self, titles: DataFrame, scope: str = "standard", strategy: str = "auto") -> DataFrame:
        """Matching pairs of a title and a live copy, with all columns of both.

        ``broadcast``: postings and queries go to the titles, which are not shuffled; of the signatures that a title shares
        with a query only the first yields the pair.  They must not be over ``BROADCAST_BYTES``, which is looked at first.
        ``shuffle``: titles and postings meet by signature, in narrow rows, and distinct pairs fetch the rest.  ``auto``: by
        the bytes of the postings.  ``brute``: every pair is tried; a check of the others, for tests only."""
        views, rows = title_views(titles, self.analyzer), self.visible(scope)
        if strategy in ("auto", "broadcast"):
            size = self.posting_bytes(rows)
            if strategy == "broadcast" and size > BROADCAST_BYTES:
                raise ValueError(f"postings of {size} bytes are not sent to all tasks")
            strategy = "broadcast" if size <= BROADCAST_BYTES else "shuffle"
        if strategy == "brute":
            met = views.join(F.broadcast(rows))
        elif strategy == "broadcast":
            sigs = cover.title_signatures(F.col("pos"), F.col("probe"), self.mask)
            known = [r.sig for r in rows.select(F.explode("signatures").alias("sig")).distinct().limit(FEW_SIGNATURES + 1).collect()]
            if len(known) <= FEW_SIGNATURES:  # a long title's other signatures need not be exploded with all its columns
                sigs = F.array_intersect(F.array_union(sigs, F.array(F.lit(cover.UNIVERSAL))), F.array(*map(F.lit, known)).cast("array<string>"))
            elif rows.where(F.array_contains("signatures", F.lit(cover.UNIVERSAL))).limit(1).count():
                sigs = F.array_union(sigs, F.array(F.lit(cover.UNIVERSAL)))
            views = computed(views, _sigs=sigs)
            posted = rows.withColumn("sig", F.explode("signatures"))
            met = views.withColumn("sig", F.explode("_sigs")).join(F.broadcast(posted), "sig")
            met = met.where((F.size("signatures") == 1) | (F.col("sig") == F.array_min(F.array_intersect("signatures", "_sigs")))).drop("sig", "_sigs")
        else:
            # views are many and wide: a file's size says nothing of theirs, so they are never sent to all tasks
            met = self._candidates(views, rows).join(views.hint("merge"), "title_id").join(rows, "row_id")
        return with_phrases(met.where(predicate(self.analyzer)), self.analyzer)

    def match(self, titles: DataFrame, scope: str = "standard", tags: dict | None = None, strategy: str = "auto") -> DataFrame:
        """``title_id, query_id``: each pair once, whatever copies of the query match.

        What several queries say alike is looked for and verified once a title, and told for each of them."""
        some = self.filtered(tags)
        return some._matched(titles, scope, strategy, once=not some.has_copies() and ids_differ(titles))

    def _matched(self, titles: DataFrame, scope: str, strategy: str, once: bool) -> DataFrame:
        """As ``match``; ``once``: no pair can come twice, so nothing has to be deduplicated."""
        ones, members = self.bodies()
        found = ones.pairs(titles.select("title_id", "title"), scope, strategy).select("title_id", "body")
        out = told(found, members.select("body", "query_id")).select("title_id", "query_id")
        return out if once else out.distinct()

    def match_lanes(self, titles: DataFrame, include_broad: bool = True, strategy: str = "auto", broad_strategy: str = "auto", broad_prefilter: bool = False, tags: dict | None = None) -> DataFrame:
        """As ``match``, with the broad lane's queries by a strategy of their own, and without those that nothing in the batch
        can match if ``broad_prefilter``."""
        some = self.filtered(tags)
        once = not some.has_copies() and ids_differ(titles)
        out = some._matched(titles, "standard", strategy, once)
        if not include_broad:
            return out
        broad = replace(some, rows=some.rows.where(F.col("cost_class").isin("C", "D")))
        broad = broad.prefiltered(titles) if broad_prefilter else broad
        out = out.unionByName(broad._matched(titles, "with_broad", broad_strategy, once))
        return out if once else out.distinct()

    def bodies(self) -> tuple[QuerySet, DataFrame]:
        """(one query for each different meaning, with its ``body``; ``row_id, body`` of all live copies)."""
        if not self.kept:
            named = self.rows.withColumn("body", F.sha2(F.to_json(F.struct(*BODY)), 256))
            first = F.row_number().over(Window.partitionBy("body").orderBy("row_id"))
            self.kept["ones"] = named.withColumn("_n", first).where("_n = 1").drop("_n").cache()
            self.kept["members"] = named.select("body", "row_id", "query_id", "tags").cache()
        return replace(self, rows=self.kept["ones"]), self.kept["members"]

    def match_bodies(self, titles: DataFrame, scope: str = "standard", tags: dict | None = None, strategy: str = "auto") -> DataFrame:
        """As ``match``, which does so as well."""
        return self.match(titles, scope, tags, strategy)

    def has_copies(self) -> bool:
        """Whether a query has several live copies."""
        return self.rows.groupBy("query_id").count().where("count > 1").limit(1).count() > 0

    def newest(self) -> DataFrame:
        """Of each query the newest live copy: what ranking reads."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("generation")))
        return self.rows.withColumn("_n", rank).where("_n = 1").drop("_n")

    def prefiltered(self, titles: DataFrame) -> QuerySet:
        """Without queries that no title of this batch can match: a required feature, or all of an any-of group, is in none.

        Kept like ``rows`` until ``release``: they are read several times, and each time would read the titles again."""
        here = title_views(titles.select("title").distinct(), self.analyzer).select(F.explode("pos").alias("feature")).distinct()
        need = self.rows.select("row_id", F.explode("required").alias("feature"))
        missing = need.join(here, "feature", "left_anti").select("row_id").distinct()
        groups = self.rows.select("row_id", F.posexplode("anyof").alias("g", "members")).select("row_id", "g", F.explode(F.flatten(F.flatten("members"))).alias("feature"))
        met = groups.join(here, "feature", "left_semi").select("row_id", "g").distinct()
        dead = groups.select("row_id", "g").distinct().join(met, ["row_id", "g"], "left_anti").select("row_id")
        left = self.rows.join(missing.unionByName(dead).distinct(), "row_id", "left_anti").cache()
        return replace(self, rows=left, held=(left,))


def owned(emissions: DataFrame, here: Column, placement: Column, route: Column) -> DataFrame:
    """Of emissions that several places make, the one of their owner: the first place that holds the query (``placement``) and
    that the title goes to (``route``).  Where no place does both, none is left."""
    return emissions.where(here == F.array_min(F.array_intersect(placement, route)))


def tag_pairs(tags: Column) -> Column:
    """``array<struct<key, value>>`` to the pairs that filters and boosts compare."""
    return F.transform(tags, lambda t: F.concat(t["key"], F.lit(C.SEP), t["value"]))
