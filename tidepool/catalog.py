"""Registered queries: each operator over the driver's tables, with SQL that says the same by hand."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import aliases
from tidepool.functions import columns as C
from tidepool.functions.analysis import FOLDS, Analyzer
from tidepool.functions.tasks import spread
from tidepool.functions.vocabulary import Vocabulary
from tidepool.operators import deliver, inspect, learn, rank
from tidepool.operators.match import QuerySet, owned, rejected
from tidepool.sources import loader
from tidepool.streaming import registry, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- titles, in both languages -------------------------------------------------------------------------------------------


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("title_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))


PART_SQL = "SELECT p_partkey AS title_id, concat_ws(' ', p_name, p_type, p_brand) AS title FROM part"
_FROM, _TO = "".join(FOLDS.values()), "".join(p * len(x) for p, x in FOLDS.items())


def tokens_sql(text: str) -> str:
    clean = f"lower(regexp_replace(regexp_replace(translate({text}, '{_FROM}', '{_TO}'), '[^A-Za-z0-9.#/]', ' ', 'g'), '([#/])', ' \\1 ', 'g'))"
    return f"list_filter(string_split({clean}, ' '), lambda x: x <> '')"


def views_sql(titles: str = PART_SQL) -> str:
    """CTEs up to v(title_id, title, tok, seq, pos)."""
    return f"""
    t AS ({titles}),
    k AS (SELECT *, {tokens_sql("coalesce(title, '')")} AS tok FROM t),
    s AS (SELECT *, list_transform(tok, lambda x, i: CASE WHEN regexp_full_match(x, '(19|20)[0-9][0-9]') AND NOT coalesce(tok[i - 1] IN ('#', '/'), false)
            AND NOT coalesce(tok[i + 1] = '/', false) THEN 'year:' || x ELSE 'term:' || x END) AS seq FROM k),
    v AS (SELECT *, list_sort(list_distinct(list_filter(seq, lambda x: x NOT IN ('term:#', 'term:/')))) AS pos FROM s)"""


def has(*words: str) -> str:
    return "(" + " AND ".join(f"list_contains(pos, 'term:{w}')" for w in words) + ")"


def run_of(*words: str) -> str:
    """The words stand together."""
    joined = " ".join(words)
    return f"contains(' ' || array_to_string(tok, ' ') || ' ', ' {joined} ')"


def inline(spark: SparkSession, queries: dict[int, str], tags: dict[int, list[str]] | None = None, priority: dict[int, int] | None = None) -> DataFrame:
    rows = [(i, q, [t.replace("=", C.SEP) for t in (tags or {}).get(i, [])], (priority or {}).get(i, 0)) for i, q in queries.items()]
    return spark.createDataFrame(rows, "query_id long, query string, tags array<string>, priority long")


def percolation(name: str, queries: dict[int, tuple[str, str]], vocabulary: Vocabulary | None = None, titles_sql: str = PART_SQL, titles=part_titles, accept_class_d: bool = False) -> None:
    """Registers a query that matches inline queries, each given with its predicate in SQL."""
    branches = "\n    UNION ALL ".join(f"SELECT title_id, CAST({i} AS BIGINT) AS query_id FROM v WHERE {sql}" for i, (_, sql) in queries.items())

    @query(name, f"WITH {views_sql(titles_sql)}\n    {branches}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = QuerySet.build(inline(spark, {i: q for i, (q, _) in queries.items()}), vocabulary, accept_class_d=accept_class_d)
        return built.match(titles(spark, sf_dir), "with_broad")


# --- analysis ------------------------------------------------------------------------------------------------------------


@query("title_tokens", f"SELECT title_id, array_to_string({tokens_sql('title')}, ' ') AS tokens FROM ({PART_SQL})")
def title_tokens(spark, sf_dir):
    return part_titles(spark, sf_dir).select("title_id", F.array_join(C.tokens(F.col("title")), " ").alias("tokens"))


DOC_SQL = "SELECT doc_id AS title_id, text AS title FROM documents"


@query("title_features", f"WITH {views_sql(DOC_SQL)} SELECT title_id, CAST(len(pos) AS INTEGER) AS n, md5(array_to_string(pos, ' ')) AS digest FROM v")
def title_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("title_id"), "text")
    docs = docs.withColumn("pos", C.features_of(C.sequence_of(F.col("text"), Analyzer())))
    return docs.select("title_id", F.size("pos").alias("n"), F.md5(F.array_join("pos", " ").cast("binary")).alias("digest"))


@query("title_rank_features", "SELECT doc_id AS title_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS BIGINT) AS title_tokens, CAST(strlen(text) AS BIGINT) AS title_bytes, CAST(len(regexp_extract_all(text, '\\p{N}')) AS BIGINT) AS title_digits FROM documents")
def title_rank_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("title_id"), *[c.alias(n) for n, c in C.title_features(F.col("text")).items()])


# --- predicates ------------------------------------------------------------------------------------------------------------

percolation("percolate_terms", {1: ("red bolt", has("red", "bolt")), 2: ("HOT plate", has("hot", "plate")), 3: ("promo", has("promo")), 4: ("brand #1", has("brand", "1")), 5: ("bolt,red", has("bolt", "red")), 6: ("nothing1999", "false")})
percolation("percolate_anyof", {1: ("(red,blue) bolt", f"{has('bolt')} AND ({has('red')} OR {has('blue')})"), 2: ("(gear,gizmo)", f"({has('gear')} OR {has('gizmo')})"), 3: ("(rod) anvil", has("rod", "anvil")), 4: ("(old,new) (ring,rod)", f"({has('old')} OR {has('new')}) AND ({has('ring')} OR {has('rod')})")})
percolation("percolate_negation", {1: ("widget -red", f"{has('widget')} AND NOT {has('red')}"), 2: ("gear -(old,new)", f"{has('gear')} AND NOT ({has('old')} OR {has('new')})"), 3: ("small -promo -large", f"{has('small')} AND NOT {has('promo')} AND NOT {has('large')}")})
percolation("percolate_compound_anyof", {1: ("(red bolt,blue ring)", f"({has('red', 'bolt')} OR {has('blue', 'ring')})"), 2: ("promo (hot plate,cold)", f"{has('promo')} AND ({has('hot', 'plate')} OR {has('cold')})")})
percolation("percolate_forbidden_conj", {1: ("widget -(red promo,blue)", f"{has('widget')} AND NOT {has('red', 'promo')} AND NOT {has('blue')}"), 2: ("bolt -small-economy", f"{has('bolt')} AND NOT {has('small', 'economy')}")})
percolation("percolate_phrase", {1: ('"red bolt"', run_of("red", "bolt")), 2: ('"plate standard" brand', f"{run_of('plate', 'standard')} AND {has('brand')}"), 3: ('"brand #1"', run_of("brand", "#", "1"))})
percolation("percolate_forbidden_phrase", {1: ('bolt -"red bolt"', f"{has('bolt')} AND NOT {run_of('red', 'bolt')}"), 2: ('promo -"gear promo" -old', f"{has('promo')} AND NOT {run_of('gear', 'promo')} AND NOT {has('old')}")})
percolation("percolate_class_d", {1: ("-red", f"NOT {has('red')}"), 2: ('-"red bolt" -(blue,old)', f"NOT {run_of('red', 'bolt')} AND NOT {has('blue')} AND NOT {has('old')}")}, accept_class_d=True)
percolation("percolate_documents", {1: ("the (idiot,moron)", f"{has('the')} AND ({has('idiot')} OR {has('moron')})"), 2: ('"of the"', run_of("of", "the")), 3: ("password", has("password")), 4: ("es -de", f"{has('es')} AND NOT {has('de')}")}, titles_sql=DOC_SQL, titles=lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("title_id"), F.col("text").alias("title")))
EQUIVALENT = Vocabulary(equivalences=[("red", "scarlet"), ("bolt", "screw"), ("scarlet", "crimson")])
percolation("equivalence_expansion", {1: ("crimson screw", has("red", "bolt")), 2: ("widget (scarlet,blue)", f"{has('widget')} AND ({has('red')} OR {has('blue')})"), 3: ("gear -crimson", has("gear")), 4: ('"crimson screw"', run_of("red", "bolt"))}, EQUIVALENT)
percolation("synonym_match", {1: ("plate hot", f"{has('plate')} AND ({has('hot')} OR {has('cold')})"), 2: ("cold", f"({has('hot')} OR {has('cold')})")}, Vocabulary(synonyms={"hot": "term:temperature", "cold": "term:temperature"}))
COLLAPSE = Vocabulary(phrases={("red", "bolt"): ("term:red_bolt", False)})
percolation("collapse_phrase_match", {1: ("red bolt", run_of("red", "bolt")), 2: ("bolt", f"{has('bolt')} AND NOT {run_of('red', 'bolt')}"), 3: ("bolt red", f"{has('red', 'bolt')} AND NOT {run_of('red', 'bolt')}")}, COLLAPSE)


def _alias() -> Vocabulary:
    out = Vocabulary()
    out.aliases.add(["red bolt", "rb"], "declared")
    return out


percolation("alias_two_view", {1: ("rb", run_of("red", "bolt")), 2: ("bolt", has("bolt")), 3: ("widget -rb", has("widget"))}, _alias())


# --- a stored corpus: each distinct p_name is a query ---------------------------------------------------------------------


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min(F.struct("p_partkey", "p_brand", "p_type", "p_size")).alias("p"))
    tags = F.array(F.concat(F.lit(f"brand{C.SEP}"), F.col("p.p_brand")), F.concat(F.lit(f"type{C.SEP}"), F.col("p.p_type")))
    return rows.select(F.col("p.p_partkey").alias("query_id"), F.col("p_name").alias("query"), tags.alias("tags"), F.col("p.p_size").cast("long").alias("priority"))


STORED_SQL = """
    q AS (SELECT query_id, p_name AS query, p_brand, p_type, CAST(p_size AS BIGINT) AS priority, list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: 'term:' || x))) AS need
          FROM (SELECT p_partkey AS query_id, p_name, p_brand, p_type, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1)"""
MATCHED_SQL = f"{views_sql()}, {STORED_SQL}, m AS (SELECT title_id, query_id, q.* EXCLUDE (query_id), title FROM v JOIN q ON list_has_all(v.pos, q.need))"


def stored(spark: SparkSession, sf_dir: str, **more) -> QuerySet:
    return QuerySet.build(part_queries(spark, sf_dir), **more)


@query("percolate_part_queries", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m")
def percolate_part_queries(spark, sf_dir):
    return stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad")


@query("percolate_shuffled", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m")
def percolate_shuffled(spark, sf_dir):
    return stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad", strategy="shuffle")


@query("percolate_standard_scope", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m WHERE len(need) >= 2")
def percolate_standard_scope(spark, sf_dir):
    return stored(spark, sf_dir).match(part_titles(spark, sf_dir), "standard")


@query("percolate_hot_lane", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m")
def percolate_hot_lane(spark, sf_dir):
    return stored(spark, sf_dir, mask=[], theta=2).match(part_titles(spark, sf_dir), "standard")


@query("percolate_filtered_tags", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m WHERE p_type IN ('PROMO', 'SMALL') AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#2', 'Brand#3')")
def percolate_filtered_tags(spark, sf_dir):
    wanted = loader.parse_filter({"type": ["PROMO", "SMALL"], "brand": ["Brand#1", "Brand#11", "Brand#12", "Brand#2", "Brand#3"]})
    return stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad", wanted)


@query("percolate_prefiltered", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m")
def percolate_prefiltered(spark, sf_dir):
    titles = part_titles(spark, sf_dir)
    return stored(spark, sf_dir).prefiltered(titles).match(titles, "with_broad")


@query("percolate_search_body", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m WHERE p_type = 'PROMO' AND p_brand IN ('Brand#1', 'Brand#11')")
def percolate_search_body(spark, sf_dir):
    clauses = [{"term": {"type": "PROMO"}}, {"terms": {"brand": ["Brand#1", "Brand#11"]}}]
    _, wanted = loader.parse_search({"query": {"bool": {"must": {"percolate": {"document": {"title": "any"}}}, "filter": clauses}}})
    return stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad", wanted)


@query("percolate_union_of_documents", f"WITH {MATCHED_SQL} SELECT query_id, count(DISTINCT title_id) AS slots, min(title_id) AS first_slot FROM m GROUP BY query_id")
def percolate_union_of_documents(spark, sf_dir):
    found = stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad")
    return found.groupBy("query_id").agg(F.countDistinct("title_id").alias("slots"), F.min("title_id").alias("first_slot"))


@query("feature_frequency", f"WITH {STORED_SQL.strip()} SELECT f AS feature, count(*) AS freq FROM (SELECT unnest(need) AS f FROM q) GROUP BY f")
def feature_frequency(spark, sf_dir):
    return stored(spark, sf_dir).frequency


@query("top64_mask", f"WITH {STORED_SQL.strip()}, c AS (SELECT f AS feature, count(*) AS freq FROM (SELECT unnest(need) AS f FROM q) GROUP BY f) SELECT feature, freq FROM c ORDER BY freq DESC, feature LIMIT 64")
def top64_mask(spark, sf_dir):
    return stored(spark, sf_dir).frequency.orderBy(F.desc("freq"), "feature").limit(64)


@query("cost_class_counts", f"WITH {STORED_SQL.strip()} SELECT CASE WHEN len(need) >= 2 THEN 'B' ELSE 'C' END AS cost_class, count(*) AS n FROM q GROUP BY 1")
def cost_class_counts(spark, sf_dir):
    return inspect.class_counts(stored(spark, sf_dir))


@query("candidate_recall", f"WITH {MATCHED_SQL} SELECT title_id, query_id FROM m")
def candidate_recall(spark, sf_dir):
    built, titles = stored(spark, sf_dir), part_titles(spark, sf_dir)
    found = built.candidates(titles, "with_broad").select("title_id", F.col("row_id").alias("query_id"))
    return built.match(titles, "with_broad", strategy="broadcast").join(found, ["title_id", "query_id"], "left_semi")


@query("posting_stats", f"""WITH {STORED_SQL.strip()}, p AS (SELECT CASE WHEN len(need) >= 2 THEN 'main' ELSE 'broad' END AS lane, array_to_string(need, '&') AS sig, count(*) AS n FROM q GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY n) AS r, count(*) OVER (PARTITION BY lane) AS c FROM p)
    SELECT lane, count(*) AS count, max(CASE WHEN r = greatest(ceil(c * 50 / 100), 1) THEN n END) AS p50, max(CASE WHEN r = greatest(ceil(c * 95 / 100), 1) THEN n END) AS p95,
           max(CASE WHEN r = greatest(ceil(c * 99 / 100), 1) THEN n END) AS p99, max(n) AS max FROM r GROUP BY lane""")
def posting_stats(spark, sf_dir):
    return inspect.posting_stats(stored(spark, sf_dir))


@query("candidate_counts", f"""WITH {MATCHED_SQL}, p AS (SELECT v.title_id, count(m.query_id) AS n FROM v LEFT JOIN m ON v.title_id = m.title_id GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM p)
    SELECT 'all' AS titles, count(*) AS count, max(CASE WHEN r = greatest(ceil(c * 50 / 100), 1) THEN n END) AS p50, max(CASE WHEN r = greatest(ceil(c * 95 / 100), 1) THEN n END) AS p95,
           max(CASE WHEN r = greatest(ceil(c * 99 / 100), 1) THEN n END) AS p99, max(n) AS max FROM r""")
def candidate_counts(spark, sf_dir):
    return inspect.candidate_stats(stored(spark, sf_dir), part_titles(spark, sf_dir), "with_broad")


@query("match_stats", f"WITH {MATCHED_SQL} SELECT (SELECT count(*) FROM v) AS titles, count(*) AS emissions, count(DISTINCT (title_id, query_id)) AS matches, CAST(0 AS BIGINT) AS duplicates FROM m")
def match_stats(spark, sf_dir):
    return inspect.match_stats(stored(spark, sf_dir), part_titles(spark, sf_dir), "with_broad").select("titles", "emissions", "matches", "duplicates")


@query("distinct_bodies", f"WITH {STORED_SQL.strip()} SELECT count(*) AS queries, count(DISTINCT need) AS bodies FROM q")
def distinct_bodies(spark, sf_dir):
    return inspect.distinct_bodies(stored(spark, sf_dir))


# --- a corpus of all kinds of queries: suppliers' queries against customers' titles ---------------------------------------

SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")
_SECOND = "list_extract(['automobile', 'building', 'furniture', 'household', 'machinery'], CAST({} % 5 AS INTEGER) + 1)"
CUSTOMER_SQL = f"SELECT c_custkey AS title_id, concat_ws(' ', 'id' || c_custkey, c_mktsegment, {_SECOND.format('c_custkey')}, 'n' || c_nationkey, 1950 + c_custkey % 60) AS title FROM customer"
MIXED_SQL = f"""
    s AS (SELECT s_suppkey AS query_id, s_suppkey % 8 AS kind, {_SECOND.format('s_suppkey // 8')} AS a, {_SECOND.format('(s_suppkey // 8 + 1 + s_suppkey % 3)')} AS b, 'n' || s_nationkey AS n, 'id' || (s_suppkey * 7) AS i, CAST(1950 + s_suppkey % 60 AS VARCHAR) AS y FROM supplier),
    q AS (SELECT query_id, kind,
            CASE kind WHEN 0 THEN ['term:' || i] WHEN 1 THEN ['term:' || a] WHEN 2 THEN ['term:' || a, 'term:' || b] WHEN 4 THEN ['year:' || y] WHEN 5 THEN ['term:' || n] WHEN 7 THEN ['term:' || b] ELSE [] END AS need,
            CASE kind WHEN 3 THEN ['term:' || a, 'term:' || i] WHEN 5 THEN ['term:' || a, 'term:' || b] ELSE [] END AS alt,
            CASE kind WHEN 3 THEN ['term:' || n] WHEN 4 THEN ['term:' || a] WHEN 6 THEN ['term:' || a] ELSE [] END AS bad,
            CASE kind WHEN 7 THEN b || ' ' || n END AS phrase FROM s)"""
MIXED_MATCH_SQL = f"{views_sql(CUSTOMER_SQL).replace('s AS (', 'sq AS (').replace('FROM s)', 'FROM sq)')}, {MIXED_SQL}, m AS (SELECT title_id, query_id, kind FROM v JOIN q ON list_has_all(pos, need) AND (len(alt) = 0 OR list_has_any(pos, alt)) AND NOT list_has_any(pos, bad) AND (phrase IS NULL OR contains(' ' || array_to_string(tok, ' ') || ' ', ' ' || phrase || ' ')))"


def pick(number) -> Column:
    return F.element_at(F.array(*map(F.lit, SEGMENTS)), (number % 5 + 1).cast("int"))


def customer_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    title = F.concat_ws(" ", F.concat(F.lit("id"), key), "c_mktsegment", pick(key), F.concat(F.lit("n"), "c_nationkey"), (key % 60 + 1950).cast("string"))
    return table(spark, sf_dir, "customer").select(key.alias("title_id"), title.alias("title"))


def mixed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words, hot words, pairs, any-of groups, years, negations without and with a positive clause, phrases."""
    key = F.col("s_suppkey")
    eighth = F.floor(key / 8)
    a, b, n = pick(eighth), pick(eighth + 1 + key % 3), F.concat(F.lit("n"), "s_nationkey")
    i, y = F.concat(F.lit("id"), key * 7), (key % 60 + 1950).cast("string")
    glue = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [i, a, glue(a, " ", b), glue("(", a, ",", i, ") -", n), glue(y, " -", a), glue(n, " (", a, ",", b, ")"), glue("-", a), glue('"', b, " ", n, '"')]
    text = F.coalesce(*[F.when(key % 8 == k, form) for k, form in enumerate(forms)])
    return table(spark, sf_dir, "supplier").select(key.alias("query_id"), text.alias("query"))


def mixed(spark: SparkSession, sf_dir: str, theta: int = 0) -> QuerySet:
    return QuerySet.build(mixed_queries(spark, sf_dir), mask=[f"term:{x}" for x in SEGMENTS], theta=theta, accept_class_d=True)


@query("percolate_mixed", f"WITH {MIXED_MATCH_SQL} SELECT title_id, query_id FROM m")
def percolate_mixed(spark, sf_dir):
    return mixed(spark, sf_dir).match(customer_titles(spark, sf_dir), "with_broad")


@query("percolate_mixed_shuffled", f"WITH {MIXED_MATCH_SQL} SELECT title_id, query_id FROM m")
def percolate_mixed_shuffled(spark, sf_dir):
    return mixed(spark, sf_dir).match(customer_titles(spark, sf_dir), "with_broad", strategy="shuffle")


@query("percolate_mixed_standard", f"WITH {MIXED_MATCH_SQL} SELECT title_id, query_id FROM m WHERE kind NOT IN (1, 3, 6)")
def percolate_mixed_standard(spark, sf_dir):
    """Without the broad lane: a hot word alone, a group with a hot member, no positive clause."""
    return mixed(spark, sf_dir).match(customer_titles(spark, sf_dir), "standard")


@query("percolate_mixed_lanes", f"WITH {MIXED_MATCH_SQL} SELECT title_id, query_id FROM m")
def percolate_mixed_lanes(spark, sf_dir):
    return mixed(spark, sf_dir).match_lanes(customer_titles(spark, sf_dir), strategy="shuffle", broad_strategy="broadcast", broad_prefilter=True)


@query("percolate_mixed_hot_lane", f"WITH {MIXED_MATCH_SQL} SELECT title_id, query_id FROM m")
def percolate_mixed_hot_lane(spark, sf_dir):
    return mixed(spark, sf_dir, theta=2).match(customer_titles(spark, sf_dir), "with_broad")


@query("percolate_bodies", f"WITH {MATCHED_SQL}, b AS (SELECT p_partkey AS query_id, p_name FROM part) SELECT title_id, b.query_id FROM m JOIN b ON b.p_name = m.query")
def percolate_bodies(spark, sf_dir):
    """Every part's name is a query here, so most say what others say."""
    queries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return QuerySet.build(queries).match_bodies(part_titles(spark, sf_dir), "with_broad")


@query("mixed_cost_classes", f"WITH {MIXED_SQL.strip()} SELECT CASE WHEN kind IN (0, 4, 5) THEN 'A' WHEN kind IN (2, 7) AND (kind = 7 OR len(list_distinct(need)) = 2) THEN 'B' WHEN kind = 6 THEN 'D' ELSE 'C' END AS cost_class, count(*) AS n FROM q GROUP BY 1")
def mixed_cost_classes(spark, sf_dir):
    return inspect.class_counts(mixed(spark, sf_dir))


@query("mixed_hot_classes", f"WITH {MIXED_SQL.strip()}, f AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_distinct(need)) AS f FROM q WHERE kind IN (0, 4, 5)) GROUP BY f) SELECT CASE WHEN n >= 2 THEN 'H' ELSE 'A' END AS cost_class, count(*) AS n FROM q JOIN f ON f.f = need[1] WHERE kind IN (0, 4) GROUP BY 1")
def mixed_hot_classes(spark, sf_dir):
    """Rare words and years alone: in the hot lane if two queries or more have them."""
    some = mixed_queries(spark, sf_dir).where("query_id % 8 in (0, 4)")
    return inspect.class_counts(QuerySet.build(some, mask=[], theta=2))


@query("percolate_copies", f"""WITH {views_sql()}, c AS (SELECT p_name, min(p_partkey) AS query_id, count(*) AS n FROM part GROUP BY p_name),
    w AS (SELECT query_id, list_transform(string_split(p_name, ' '), lambda x: 'term:' || x) AS need FROM c)
    SELECT DISTINCT title_id, query_id FROM v JOIN w ON list_has_all(pos, need) OR list_has_all(pos, ['term:promo', need[1]])""")
def percolate_copies(spark, sf_dir):
    """Two live copies of each query: a title matches the query if it matches one of them."""
    return copies(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad")


def copies(spark: SparkSession, sf_dir: str) -> QuerySet:
    one = part_queries(spark, sf_dir).select("query_id", "query", "tags", "priority")
    again = one.withColumn("query", F.concat(F.lit("promo "), F.split("query", " ")[0])).withColumn("priority", F.col("priority") + 1000)
    both = one.withColumn("generation", F.lit(1).cast("long")).unionByName(again.withColumn("generation", F.lit(2).cast("long")))
    return QuerySet.build(both.withColumn("row_id", F.col("query_id") * 2 + F.col("generation")))


@query("rank_copies", f"""WITH {views_sql()}, c AS (SELECT p_name, min(p_partkey) AS query_id, min_by(p_size, p_partkey) AS p_size FROM part GROUP BY p_name),
    w AS (SELECT query_id, p_size, list_transform(string_split(p_name, ' '), lambda x: 'term:' || x) AS need FROM c),
    z AS (SELECT DISTINCT title_id, query_id, CAST(p_size AS BIGINT) + 1000 AS score FROM v JOIN w ON list_has_all(pos, need) OR list_has_all(pos, ['term:promo', need[1]])),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY title_id ORDER BY score DESC, query_id) AS INTEGER) AS rank FROM z) SELECT title_id, query_id, score, rank FROM r WHERE rank <= 2""")
def rank_copies(spark, sf_dir):
    """A match of any copy counts, the newest copy is scored."""
    return rank.top_k(rank.scored(copies(spark, sf_dir), part_titles(spark, sf_dir), rank.RankSpec(), "with_broad"), 2)


# --- ranking ---------------------------------------------------------------------------------------------------------------

BOOSTS = (("type", "PROMO", 7), ("type", "PROMO", 100), ("brand", "Brand#11", 1000))
SCORE_SQL = "priority + CASE WHEN p_type = 'PROMO' THEN 100 ELSE 0 END + CASE WHEN p_brand = 'Brand#11' THEN 1000 ELSE 0 END"
RANKED_SQL = f"{MATCHED_SQL}, z AS (SELECT title_id, query_id, {{score}} AS score FROM m), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY title_id ORDER BY score DESC, query_id) AS INTEGER) AS rank FROM z)"


def scores(spark, sf_dir, spec=None) -> DataFrame:
    return rank.scored(stored(spark, sf_dir), part_titles(spark, sf_dir), spec if spec is not None else rank.RankSpec(boosts=BOOSTS), "with_broad")


@query("rank_static_topk", f"WITH {RANKED_SQL.format(score=SCORE_SQL)} SELECT title_id, query_id, score, rank FROM r WHERE rank <= 3")
def rank_static_topk(spark, sf_dir):
    return rank.top_k(scores(spark, sf_dir), 3)


@query("rank_batch_topk", f"WITH {RANKED_SQL.format(score=SCORE_SQL)} SELECT title_id, query_id, score, rank FROM r WHERE rank <= 2")
def rank_batch_topk(spark, sf_dir):
    """In batches, as one may hold 10,000 titles at most."""
    built, titles, spec = stored(spark, sf_dir), part_titles(spark, sf_dir), rank.RankSpec(boosts=BOOSTS)
    batches = -(-titles.count() // (rank.MAX_TITLES // 2))
    return rank.batches_top_k(built, titles, spec, 2, F.pmod(F.xxhash64("title_id"), F.lit(max(batches, 1))), "with_broad")


@query("rank_compat", f"WITH {RANKED_SQL.format(score='CASE WHEN p_type = ' + chr(39) + 'PROMO' + chr(39) + ' THEN 100 ELSE 0 END')} SELECT title_id, query_id, score, rank FROM r")
def rank_compat(spark, sf_dir):
    return rank.ranked(scores(spark, sf_dir, rank.compat_score((("type", "PROMO", 100),), "brand"))).withColumn("score", F.col("score").cast("int"))


@query("rank_from_size", f"WITH {RANKED_SQL.format(score=SCORE_SQL)} SELECT title_id, query_id, score, rank FROM r WHERE rank > 1 AND rank <= 3")
def rank_from_size(spark, sf_dir):
    return rank.page(scores(spark, sf_dir), 1, 2)


@query("rank_search_after", f"WITH {MATCHED_SQL}, z AS (SELECT title_id, query_id, {SCORE_SQL} AS score FROM m), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY title_id ORDER BY score DESC, query_id) AS INTEGER) AS rank FROM z WHERE score < 100 OR (score = 100 AND query_id > 5)) SELECT title_id, query_id, score, rank FROM r WHERE rank <= 2")
def rank_search_after(spark, sf_dir):
    return rank.top_k(scores(spark, sf_dir), 2, (100, 5))


PROFILES = json.dumps(
    {
        "version": 1,
        "profiles": {
            "lin": {"kind": "linear", "intercept": 5, "weights": [{"feature": "query_positive_terms", "weight": 120}, {"feature": "unmatched_title_tokens", "weight": -15}, {"feature": "title_bytes", "weight": 2}, {"feature": "query_tag_count", "weight": 1}]},
            "tree": {"kind": "tree_ensemble", "base_score": 1, "trees": [{"nodes": [{"kind": "split", "feature": "positive_coverage_milli", "threshold": 399, "left": 1, "right": 2}, {"kind": "leaf", "value": -80}, {"kind": "split", "feature": "title_digits", "threshold": 1, "left": 3, "right": 4}, {"kind": "leaf", "value": 80}, {"kind": "leaf", "value": 90}]}]},
        },
    }
)
_TOKENS = "len(regexp_extract_all(title, '[\\p{L}\\p{N}]+'))"


@query("rank_linear_topk", f"WITH {RANKED_SQL.format(score=f'CAST(priority + 5 + 120 * len(need) - 15 * greatest({_TOKENS} - len(need), 0) + 2 * strlen(title) + 2 AS BIGINT)')} SELECT title_id, query_id, score, rank FROM r WHERE rank <= 2")
def rank_linear_topk(spark, sf_dir):
    return rank.top_k(scores(spark, sf_dir, rank.RankSpec("lin", profiles=rank.load_profiles(PROFILES))), 2)


@query("rank_tree_topk", f"WITH {RANKED_SQL.format(score=f'CAST(priority + 1 + CASE WHEN len(need) * 1000 // greatest({_TOKENS}, 1) <= 399 THEN -80 WHEN len(regexp_extract_all(title, {chr(39)}[0-9]{chr(39)})) <= 1 THEN 80 ELSE 90 END AS BIGINT)')} SELECT title_id, query_id, score, rank FROM r WHERE rank <= 2")
def rank_tree_topk(spark, sf_dir):
    return rank.top_k(scores(spark, sf_dir, rank.RankSpec("tree", profiles=rank.load_profiles(PROFILES))), 2)


@query("rank_with_source", f"WITH {RANKED_SQL.format(score=SCORE_SQL)} SELECT title_id, r.query_id, q.query AS source FROM r JOIN q USING (query_id) WHERE rank <= 1")
def rank_with_source(spark, sf_dir):
    hits = rank.top_k(scores(spark, sf_dir), 1)
    return rank.with_source(hits, part_queries(spark, sf_dir), ("que*",)).select("title_id", "query_id", F.col("_source.query").alias("source"))


@query("total_hits", f"WITH {MATCHED_SQL} SELECT title_id, least(count(DISTINCT query_id), 1) AS value, CASE WHEN count(DISTINCT query_id) > 1 THEN 'gte' ELSE 'eq' END AS relation FROM m GROUP BY title_id")
def total_hits(spark, sf_dir):
    return rank.totals(stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad"), 1)


@query("exhaustive_chunks", f"WITH {MATCHED_SQL}, n AS (SELECT 0 AS title_id, query_id, row_number() OVER (ORDER BY query_id) - 1 AS n FROM (SELECT DISTINCT query_id FROM m)) SELECT title_id, query_id, CAST(n // 7 AS BIGINT) AS sequence, CAST(n % 7 AS BIGINT) AS position FROM n")
def exhaustive_chunks(spark, sf_dir):
    found = stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad").select(F.lit(0).alias("title_id"), "query_id").distinct()
    return deliver.chunks(found, 7)


@query("exhaustive_summary", f"WITH {MATCHED_SQL} SELECT title_id, count(*) AS exact_total, CAST(ceil(count(*) / 2.0) AS BIGINT) AS chunk_count FROM m GROUP BY title_id")
def exhaustive_summary(spark, sf_dir):
    return deliver.summary(stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad"), 2).select("title_id", "exact_total", "chunk_count")


@query("idempotency_keys", f"WITH {STORED_SQL.strip()} SELECT query_id, sha256('e-1' || chr(1) || '3' || chr(1) || query_id) AS key FROM q")
def idempotency_keys(spark, sf_dir):
    return part_queries(spark, sf_dir).select("query_id", deliver.idempotency_key("e-1", F.lit(3), F.col("query_id")).alias("key"))


@query("explain_failures", f"""WITH {views_sql()} SELECT title_id, CAST(1 AS BIGINT) AS query_id, {has('bolt')} AND NOT {has('red')} AND ({has('small')} OR {has('new')}) AS matched,
    array_to_string(list_filter([CASE WHEN NOT {has('bolt')} THEN 'missing required: term:bolt' END, CASE WHEN {has('red')} THEN 'forbidden present: term:red' END, CASE WHEN NOT ({has('small')} OR {has('new')}) THEN 'any-of groups unmet: 1' END], lambda x: x IS NOT NULL), '; ') AS failures FROM v""")
def explain_failures(spark, sf_dir):
    built = QuerySet.build(inline(spark, {1: "bolt -red (small,new)"}))
    out = inspect.explain(built, part_titles(spark, sf_dir).withColumn("query_id", F.lit(1).cast("long")))
    return out.select("title_id", "query_id", "matched", F.array_join("failures", "; ").alias("failures"))


# --- registry ----------------------------------------------------------------------------------------------------------------

OPS_SQL = """o AS (SELECT o_orderkey AS seq, o_custkey AS query_id, CASE o_orderstatus WHEN 'P' THEN 'delete' WHEN 'O' THEN {second} ELSE 'index' END AS op, 'bolt ' || o_orderkey AS query FROM orders)"""


def order_ops(spark, sf_dir, second: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "P", "delete").when(F.col("o_orderstatus") == "O", second).otherwise("index")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), op.alias("op"), F.col("o_custkey").alias("query_id"), F.concat(F.lit("bolt "), F.col("o_orderkey")).alias("query"), F.lit(1).alias("version"), F.array().cast("array<string>").alias("tags"), F.lit(0).cast("long").alias("priority"))
    return registry.accepted(rows)


@query("registry_latest", f"WITH {OPS_SQL.format(second=chr(39) + 'index' + chr(39))}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq DESC) AS n FROM o) SELECT query_id, query FROM n WHERE n = 1 AND op <> 'delete'")
def registry_latest(spark, sf_dir):
    return registry.live(order_ops(spark, sf_dir, "index")).select("query_id", "query")


@query("registry_additive", f"WITH {OPS_SQL.format(second=chr(39) + 'insert' + chr(39))}, l AS (SELECT *, max(CASE WHEN op <> 'insert' THEN seq END) OVER (PARTITION BY query_id) AS last FROM o) SELECT query_id, query FROM l WHERE op <> 'delete' AND (last IS NULL OR seq >= last)")
def registry_additive(spark, sf_dir):
    return registry.live(order_ops(spark, sf_dir, "insert")).select("query_id", "query")


_LIVE_SQL = "w AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER b AS d, max(CASE WHEN op <> 'delete' THEN seq END) OVER b AS u FROM o WINDOW b AS (PARTITION BY query_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), a AS (SELECT *, u IS NOT NULL AND (d IS NULL OR u > d) AS live FROM w)"


@query("registry_outcomes", f"WITH {OPS_SQL.format(second=chr(39) + 'create' + chr(39))}, {_LIVE_SQL} SELECT seq, query_id, CASE WHEN op = 'delete' AND live THEN 200 WHEN op = 'delete' THEN 404 WHEN op = 'create' AND live THEN 409 WHEN op = 'index' AND live THEN 200 ELSE 201 END AS status FROM a")
def registry_outcomes(spark, sf_dir):
    return registry.outcomes(order_ops(spark, sf_dir, "create"))


@query("registry_create_conflicts", f"WITH {OPS_SQL.format(second=chr(39) + 'create' + chr(39))}, {_LIVE_SQL}, g AS (SELECT *, max(CASE WHEN op IN ('index', 'delete') THEN seq END) OVER (PARTITION BY query_id) AS last FROM a WHERE NOT (op = 'create' AND live)) SELECT query_id, query FROM g WHERE op <> 'delete' AND (last IS NULL OR seq >= last)")
def registry_create_conflicts(spark, sf_dir):
    return registry.live(order_ops(spark, sf_dir, "create")).select("query_id", "query")


@query("ingest_report", f"WITH {OPS_SQL.format(second=chr(39) + 'create' + chr(39))}, {_LIVE_SQL}, c AS (SELECT CASE WHEN op = 'delete' AND live THEN 200 WHEN op = 'delete' THEN 404 WHEN op = 'create' AND live THEN 409 WHEN op = 'index' AND live THEN 200 ELSE 201 END AS status FROM a) SELECT status, count(*) AS n FROM c GROUP BY status")
def ingest_report(spark, sf_dir):
    return registry.ingest_report(order_ops(spark, sf_dir, "create"))


@query("registry_metrics", f"WITH {OPS_SQL.format(second=chr(39) + 'create' + chr(39))}, {_LIVE_SQL}, g AS (SELECT *, max(CASE WHEN op IN ('index', 'delete') THEN seq END) OVER (PARTITION BY query_id) AS last FROM a WHERE NOT (op = 'create' AND live)), l AS (SELECT * FROM g WHERE op <> 'delete' AND (last IS NULL OR seq >= last)), n AS (SELECT (SELECT count(*) FROM o WHERE op <> 'delete') AS writes, CAST(0 AS BIGINT) AS refused, (SELECT count(*) FROM l) AS live, (SELECT count(DISTINCT query_id) FROM l) AS queries) SELECT *, writes - live AS gone, (writes - live) / writes AS holes FROM n")
def registry_metrics(spark, sf_dir):
    return registry.measured(order_ops(spark, sf_dir, "create"))


# --- sources -----------------------------------------------------------------------------------------------------------------


@query("load_csv", "SELECT p_partkey AS query_id, p_name || ', \"' || p_brand || '\"' AS query FROM part")
def load_csv(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')), '"', '""'), F.lit('"'))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.concat_ws(",", F.col("p_partkey").cast("string"), quoted).alias("value"))
    return loader.parse_csv(lines).where("error is null").select("query_id", "query")


@query("load_jsonl", "SELECT p_partkey AS query_id, p_name || ' \"' || p_brand || '\"' AS query FROM part")
def load_jsonl(spark, sf_dir):
    body = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(' "'), "p_brand", F.lit('"')).alias("query")))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), body.alias("value"))
    return loader.parse_jsonl(lines).where("error is null").select("query_id", "query")


@query("load_bulk", "SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'index' ELSE 'create' END AS op, p_partkey AS query_id, p_name AS query, 'brand=' || p_brand || ',priority=' || p_size AS tags, CAST(p_size AS BIGINT) AS priority FROM part")
def load_bulk(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    action = F.concat(F.lit('{"'), F.when(F.col("p_partkey") % 2 == 0, "index").otherwise("create"), F.lit('":{"_id":'), F.col("p_partkey"), F.lit("}}"))
    source = F.to_json(F.struct(F.col("p_name").alias("query"), F.struct(F.col("p_brand").alias("brand")).alias("tags"), F.struct(F.col("p_size").alias("priority")).alias("rank_fields")))
    lines = part.select((F.col("p_partkey") * 2).alias("line_no"), action.alias("value")).unionByName(part.select((F.col("p_partkey") * 2 + 1).alias("line_no"), source.alias("value")))
    out = loader.parse_bulk_lines(lines).where("error is null")
    return out.select("seq", "op", "query_id", "query", F.translate(F.array_join("tags", ","), C.SEP, "=").alias("tags"), "priority")


@query("parse_errors", """SELECT * FROM (VALUES (1, 'TrailingDash', 4), (2, 'UnclosedQuote', 5), (3, 'UnclosedGroup', 0), (4, 'EmptyAnyOfGroup', 2), (5, 'ClassD', 0)) x(query_id, kind, pos)""")
def parse_errors(spark, sf_dir):
    rows = {1: "foo - bar", 2: 'abcd "ef', 3: "(a,b", 4: "a ( , )", 5: "-manual", 6: "fine"}
    return QuerySet.build(inline(spark, rows)).rejected.select(F.col("query_id").cast("int").alias("query_id"), "kind", "pos")


# --- learning ----------------------------------------------------------------------------------------------------------------

_TOK = "list_transform(regexp_extract_all(text, '[A-Za-z0-9.]+'), lambda x: lower(x))"
CHAT_SQL = f"d AS (SELECT conv_id * 1000 + turn AS id, {_TOK} AS w FROM conversations)"


def chat(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


@query("learn_bigrams_npmi", f"""WITH {CHAT_SQL}, u AS (SELECT unnest(w) AS w FROM d), s AS (SELECT w, count(*) AS k FROM u GROUP BY w), n AS (SELECT sum(k) AS n FROM s),
    b AS (SELECT id, unnest(list_zip(w[1:len(w) - 1], w[2:])) AS p FROM d), c AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n, count(DISTINCT id) AS texts FROM b WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT c.a, c.b, c.n, texts, ln((c.n / t.n) / ((sa.k / t.n) * (sb.k / t.n))) / -ln(c.n / t.n) AS npmi FROM c JOIN s sa ON sa.w = c.a JOIN s sb ON sb.w = c.b, n t WHERE c.n >= 3)
    SELECT a, b, CAST(n AS BIGINT) AS n, CAST(texts AS BIGINT) AS texts, round(npmi, 6) AS npmi FROM x WHERE npmi >= 0.3""")
def learn_bigrams_npmi(spark, sf_dir):
    return learn.npmi_phrases(chat(spark, sf_dir)).withColumn("npmi", F.round("npmi", 6))


ANYOF = {1: "(red,scarlet) bolt", 2: "(Red,scarlet,crimson) ring", 3: "(scarlet,red)", 4: "x -(red,scarlet)", 5: "(new york,ny) inventory", 6: "(ny,new york) (ny,new york)", 7: "(single)", 8: "(bad"}
_ANYOF_SQL = "g AS (SELECT * FROM (VALUES (1, 0, ['red', 'scarlet']), (2, 0, ['Red', 'crimson', 'scarlet']), (3, 0, ['red', 'scarlet']), (5, 0, ['new york', 'ny']), (6, 0, ['new york', 'ny']), (6, 1, ['new york', 'ny'])) x(query_id, clause, forms))"


@query("learn_anyof_groups", f"WITH {_ANYOF_SQL} SELECT array_to_string(forms, '|') AS forms, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2")
def learn_anyof_groups(spark, sf_dir):
    return learn.group_support(inline(spark, ANYOF)).select(F.array_join("forms", "|").alias("forms"), "n")


@query("learn_anyof_pairs", f"WITH {_ANYOF_SQL}, e AS (SELECT DISTINCT query_id, unnest(forms) AS a, forms FROM g), p AS (SELECT DISTINCT query_id, a, b FROM (SELECT query_id, a, unnest(forms) AS b FROM e) WHERE a < b) SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2")
def learn_anyof_pairs(spark, sf_dir):
    return learn.equivalence_pairs(inline(spark, ANYOF))


@query("learn_synonyms", "SELECT * FROM (VALUES ('ny', 'new_york', 2), ('red', 'scarlet', 2)) x(alias, canonical, n)")
def learn_synonyms(spark, sf_dir):
    return learn.synonym_pairs(inline(spark, ANYOF)).withColumn("n", F.col("n").cast("int"))


@query("distributional_pairs", """WITH d AS (SELECT p_partkey AS id, list_distinct(list_transform(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '[A-Za-z0-9.]+'), lambda x: lower(x))) AS w FROM part),
    n AS (SELECT count(*) AS total FROM d WHERE len(w) > 0), u AS (SELECT id, unnest(w) AS w FROM d), o AS (SELECT w, count(*) AS k FROM u GROUP BY w HAVING count(*) >= 10),
    r AS (SELECT u.id, u.w, o.k FROM u JOIN o USING (w)), c AS (SELECT x.w AS a, y.w AS b, x.k AS ka, y.k AS kb, count(*) AS c FROM r x JOIN r y ON x.id = y.id AND x.w <> y.w GROUP BY ALL),
    p AS (SELECT a, b, ln(c * total / (ka * kb)) AS ppmi FROM c, n WHERE ln(c * total / (ka * kb)) > 0), m AS (SELECT a, sqrt(sum(ppmi * ppmi)) AS norm FROM p GROUP BY a),
    t AS (SELECT x.a, y.a AS b, sum(x.ppmi * y.ppmi) AS dot FROM p x JOIN p y ON x.b = y.b AND x.a < y.a GROUP BY 1, 2),
    s AS (SELECT t.a, t.b, dot / (m1.norm * m2.norm) AS similarity, coalesce(c.c / least(c.ka, c.kb), 0.0) AS together FROM t JOIN m m1 ON m1.a = t.a JOIN m m2 ON m2.a = t.b LEFT JOIN c ON c.a = t.a AND c.b = t.b)
    SELECT a, b, round(similarity, 6) AS similarity, round(together, 6) AS together FROM s WHERE similarity >= 0.3 AND together <= 0.15""")
def distributional_pairs(spark, sf_dir):
    bags = part_titles(spark, sf_dir).select(F.col("title_id").alias("query_id"), F.array_distinct(learn.corpus_tokens(F.col("title"))).alias("w"))
    out = learn.discover_pairs(part_queries(spark, sf_dir), bags=bags, similarity=0.3, together=0.15, top=100_000)
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"), F.round("together", 6).alias("together"))


@query("feedback_jaccard", f"""WITH {MATCHED_SQL}, p AS (SELECT title_id, list_contains(tok, 'red') AS ha, list_contains(tok, 'blue') AS hb FROM v), f AS (SELECT DISTINCT query_id, ha FROM p JOIN m USING (title_id) WHERE ha <> hb), j AS (SELECT query_id, count(*) AS sides FROM f GROUP BY 1)
    SELECT 'red' AS a, 'blue' AS b, (SELECT count(*) FROM p WHERE ha AND NOT hb) AS titles_a, (SELECT count(*) FROM p WHERE hb AND NOT ha) AS titles_b, (SELECT count(*) FROM p WHERE ha AND hb) AS titles_both, count(*) AS queries_sampled, round(count(CASE WHEN sides = 2 THEN 1 END) / count(*), 6) AS overlap FROM j""")
def feedback_jaccard(spark, sf_dir):
    titles = part_titles(spark, sf_dir)
    out = learn.feedback(titles, stored(spark, sf_dir).match(titles, "with_broad"), [("red", "blue")])
    return out.withColumn("overlap", F.round("overlap", 6))


@query("feedback_report", f"""WITH {MATCHED_SQL}, p AS (SELECT title_id, list_contains(tok, 'gear') AS ha, list_contains(tok, 'ring') AS hb FROM v),
    f AS (SELECT DISTINCT query_id, ha, query FROM p JOIN m USING (title_id) WHERE ha <> hb), fk AS (SELECT * FROM f WHERE NOT list_has_any(string_split(query, ' '), ['gear', 'ring'])), fj AS (SELECT query_id, count(*) AS sides FROM fk GROUP BY 1),
    fr AS (SELECT (SELECT count(*) FROM p WHERE ha AND NOT hb) AS titles_a, (SELECT count(*) FROM p WHERE hb AND NOT ha) AS titles_b, (SELECT count(*) FROM p WHERE ha AND hb) AS titles_both, (SELECT count(*) FROM fk WHERE ha) AS sampled_a, (SELECT count(*) FROM fk WHERE NOT ha) AS sampled_b, (SELECT count(*) FROM f) - (SELECT count(*) FROM fk) AS excluded, (SELECT coalesce(round(count(CASE WHEN sides = 2 THEN 1 END) / count(*), 6), 0) FROM fj) AS overlap)
    SELECT 'gear' AS a, 'ring' AS b, titles_a, titles_b, titles_both, sampled_a, sampled_b, excluded, CASE WHEN sampled_a > 0 AND sampled_b > 0 THEN overlap ELSE 0.0 END AS overlap, overlap >= 0.1 AND least(titles_a, titles_b) >= 5 AND least(sampled_a, sampled_b) >= 1 AS validated FROM fr""")
def feedback_report(spark, sf_dir):
    """Two batches of titles, put together by their sketches."""
    titles, queries, pairs = part_titles(spark, sf_dir), part_queries(spark, sf_dir), [("gear", "ring")]
    built = QuerySet.build(queries)
    seen = None
    for side in (0, 1):
        batch = titles.where(F.pmod(F.xxhash64("title"), F.lit(2)) == side)
        seen = learn.merged(seen, learn.observe(batch, built.match(batch, "with_broad"), pairs))
    return learn.report(seen, queries, pairs, 0.1, 5, 1).withColumn("overlap", F.round("overlap", 6))


# --- streams -----------------------------------------------------------------------------------------------------------------


@query("stream_percolate", "SELECT event_id AS title_id, CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS BIGINT) AS query_id FROM events WHERE event_type IN ('error', 'click', 'view')")
def stream_percolate(spark, sf_dir):
    """The stream's plan over the events as one batch; the tests run it as a stream."""
    titles = table(spark, sf_dir, "events").select(F.col("event_id").alias("title_id"), F.col("event_type").alias("title"))
    built = QuerySet.build(inline(spark, {1: "error", 2: "click", 3: "view"}), mask=[])
    return stream.percolate_stream(titles, built).select("title_id", "query_id")


@query("stream_windows", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, CAST(CASE event_type WHEN 'error' THEN 1 ELSE 2 END AS BIGINT) AS query_id, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    titles = table(spark, sf_dir, "events").select(F.col("event_id").alias("title_id"), F.col("event_type").alias("title"), "ts")
    built = QuerySet.build(inline(spark, {1: "error", 2: "click"}), mask=[])
    out = stream.windowed_counts(stream.percolate_stream(titles, built), "ts", "1 hour")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "query_id", "n")


# --- parts, owners, checksums, files ---------------------------------------------------------------------------------------


def in_parts(spark: SparkSession, sf_dir: str, n: int = 3) -> list[QuerySet]:
    """The stored corpus, dealt to ``n`` sets of its own."""
    rows = part_queries(spark, sf_dir)
    return [QuerySet.build(rows.where(F.pmod("query_id", F.lit(n)) == k)) for k in range(n)]


@query("rank_merged_parts", f"WITH {RANKED_SQL.format(score=SCORE_SQL)} SELECT title_id, query_id, score, rank FROM r WHERE rank <= 2")
def rank_merged_parts(spark, sf_dir):
    titles, spec = part_titles(spark, sf_dir), rank.RankSpec(boosts=BOOSTS)
    return rank.merged_top_k([rank.top_k(rank.scored(part, titles, spec, "with_broad"), 2) for part in in_parts(spark, sf_dir)], 2)


@query("total_hits_merged", f"WITH {MATCHED_SQL} SELECT title_id, least(count(DISTINCT query_id), 2) AS value, CASE WHEN count(DISTINCT query_id) > 2 THEN 'gte' ELSE 'eq' END AS relation FROM m GROUP BY title_id")
def total_hits_merged(spark, sf_dir):
    titles = part_titles(spark, sf_dir)
    return rank.merged_totals([rank.totals(part.match(titles, "with_broad"), 2) for part in in_parts(spark, sf_dir)], 2)


@query("owned_emissions", f"WITH {MATCHED_SQL}, h AS (SELECT title_id, query_id, list_min(list_intersect([query_id % 3, 3 + query_id % 2], [title_id % 3, 3 + title_id % 2])) AS place FROM m) SELECT title_id, query_id, place FROM h WHERE place IS NOT NULL")
def owned_emissions(spark, sf_dir):
    """Each place that holds a query and gets a title emits the pair; the owner's emission is left."""
    placement, route = (F.array(F.col(c) % 3, F.col(c) % 2 + 3) for c in ("query_id", "title_id"))
    found = stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad")
    emitted = found.withColumn("place", F.explode(F.array_intersect(placement, route)))
    return owned(emitted, F.col("place"), placement, route)


@query("delivery_checksums", f"WITH {MATCHED_SQL} SELECT title_id, count(*) AS exact_total, true AS merges, true AS tells_scores_apart FROM m GROUP BY title_id")
def delivery_checksums(spark, sf_dir):
    """Checksums of two halves merge to that of the whole; with scores they differ from those without."""
    found = scores(spark, sf_dir)
    bare = found.select("title_id", "query_id")
    whole, scored = deliver.summary(bare), deliver.summary(found).select("title_id", F.col("xor").alias("x"), F.col("sum").alias("s"))
    halves = deliver.summary(bare.where("query_id % 2 = 0")).unionByName(deliver.summary(bare.where("query_id % 2 = 1")))
    modulus = F.lit(str(deliver.WORD)).cast("decimal(38,0)")
    halves = halves.groupBy("title_id").agg(F.bit_xor("xor").alias("hx"), F.sum(F.col("sum").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hs"))
    out = whole.join(halves, "title_id").join(scored, "title_id")
    merges = (F.col("xor") == F.col("hx")) & (F.col("sum") == F.pmod("hs", modulus))
    return out.select("title_id", "exact_total", merges.alias("merges"), ((F.col("xor") != F.col("x")) & (F.col("sum") != F.col("s"))).alias("tells_scores_apart"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors see, under ``spark.checkpoint.dir``; a local master without it gets a temporary
    one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='tidepool-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("delivery_files", f"WITH {MATCHED_SQL}, n AS (SELECT title_id, query_id, row_number() OVER (PARTITION BY title_id ORDER BY query_id) - 1 AS n FROM m) SELECT title_id, query_id, CAST(n // 2 AS BIGINT) AS sequence, sha256('e-7' || chr(1) || '4' || chr(1) || query_id) AS key, CAST(count(*) OVER (PARTITION BY title_id) AS BIGINT) AS exact_total FROM n")
def delivery_files(spark, sf_dir):
    """Chunks and completions as they stand in the files."""
    path = shared_folder(spark, "delivery")
    deliver.write_stream(stored(spark, sf_dir).match(part_titles(spark, sf_dir), "with_broad"), path, "e-7", generation=4, size=2)
    frames = spark.read.schema("type string, title_id long, sequence long, members array<struct<logical_id: long, idempotency_key: string>>").json(f"{path}/chunks")
    ends = spark.read.schema("type string, title_id long, exact_total long").json(f"{path}/completion").where("type = 'completion'")
    rows = frames.where("type = 'match_chunk'").select("title_id", "sequence", F.inline("members"))
    return rows.join(ends, "title_id").select("title_id", F.col("logical_id").alias("query_id"), "sequence", F.col("idempotency_key").alias("key"), "exact_total")


@query("load_files", "SELECT 'tsv' AS kind, p_partkey AS query_id, p_name || ', (red,' || p_brand || ')' AS query, CAST(NULL AS VARCHAR) AS error FROM part WHERE p_partkey % 5 > 1 UNION ALL SELECT 'tsv', NULL, NULL, CASE p_partkey % 5 WHEN 0 THEN 'no comma' ELSE 'empty query' END FROM part WHERE p_partkey % 5 < 2 UNION ALL SELECT 'ndjson', p_partkey, p_name, NULL FROM part WHERE p_partkey % 5 > 1 UNION ALL SELECT 'ndjson', NULL, NULL, CASE p_partkey % 5 WHEN 0 THEN 'not JSON' ELSE 'id is no 63-bit number' END FROM part WHERE p_partkey % 5 < 2")
def load_files(spark, sf_dir):
    """Files told apart by their names, with lines that are wrong among them."""
    path, key, part = shared_folder(spark, "files"), F.col("p_partkey").cast("string"), table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 5
    lines = {
        "tsv": F.when(kind == 0, key).when(kind == 1, F.concat(key, F.lit(', ""'))).otherwise(F.concat(key, F.lit(","), "p_name", F.lit(", (red,"), "p_brand", F.lit(")"))),
        "ndjson": F.when(kind == 0, F.lit("{nothing")).when(kind == 1, F.lit('{"id": -1, "query": "red"}')).otherwise(F.concat(F.lit('{"id": '), key, F.lit(', "query": "'), "p_name", F.lit('"}'))),
    }
    out = None
    for ending, line in lines.items():
        part.select(line.alias("value")).write.text(f"{path}/q.{ending}")
        good, bad = loader.load_file(spark, f"{path}/q.{ending}")
        rows = good.select(F.lit(ending).alias("kind"), "query_id", "query", F.lit(None).cast("string").alias("error")).unionByName(bad.select(F.lit(ending).alias("kind"), "error"), allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    return out


# --- profiles, limits, shapes of queries -----------------------------------------------------------------------------------

FINGERPRINTED = {
    "plain": {"kind": "static"},
    "weights": {"kind": "linear", "intercept": -5, "weights": [{"feature": "query_positive_terms", "weight": 120}, {"feature": "title_digits", "weight": -1 << 62}]},
    "tree": {"kind": "tree_ensemble", "base_score": 1, "trees": [{"nodes": [{"kind": "split", "feature": "title_bytes", "threshold": 30, "left": 1, "right": 2}, {"kind": "leaf", "value": -8}, {"kind": "leaf", "value": 9}]}]},
}
#: What is hashed, as (value, bytes).
_HASHED = {"plain": [(0, 1)], "static_v1": [(0, 1)], "weights": [(1, 1), (-5, 8), (2, 8), (0, 1), (120, 8), (6, 1), (-1 << 62, 8)], "tree": [(2, 1), (1, 8), (1, 8), (3, 8), (0, 1), (5, 1), (30, 8), (1, 8), (2, 8), (1, 1), (-8, 8), (1, 1), (9, 8)]}
_WORDS_SQL = ", ".join(f"('{name}', {place}, CAST({value} AS HUGEINT), {size})" for name, words in _HASHED.items() for place, (value, size) in enumerate(words))


@query("profile_fingerprints", f"""WITH w(name, place, value, size) AS (VALUES {_WORDS_SQL}),
    b AS (SELECT name, flatten(list(list_transform(range(0, size), lambda i: CAST(((value + (CAST(1 AS HUGEINT) << 64)) >> CAST(8 * i AS INTEGER)) & 255 AS HUGEINT)) ORDER BY place)) AS bytes FROM w GROUP BY name)
    SELECT name, 'fnv1a64:' || lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), bytes), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0') AS fingerprint FROM b""")
def profile_fingerprints(spark, sf_dir):
    """Profiles of a file that names the fingerprints it expects."""
    loaded = rank.load_profiles(json.dumps({"version": 1, "profiles": FINGERPRINTED}))
    expected = {n: p | {"expected_fingerprint": loaded[n].fingerprint()} for n, p in FINGERPRINTED.items()}
    again = rank.load_profiles(json.dumps({"version": 1, "profiles": expected}))
    return spark.createDataFrame([(n, p.fingerprint()) for n, p in again.items()], "name string, fingerprint string")


@query("rank_saturated", f"WITH {RANKED_SQL.format(score=f'CAST(least(CASE WHEN p_type = {chr(39)}PROMO{chr(39)} THEN 9223372036854775800 ELSE 0 END::HUGEINT + priority - CASE WHEN p_brand = {chr(39)}Brand#11{chr(39)} THEN 9223372036854775800 ELSE 0 END::HUGEINT, 9223372036854775807) AS BIGINT)')} SELECT title_id, query_id, score, rank FROM r")
def rank_saturated(spark, sf_dir):
    """Sums that leave 64 bits stay at their end."""
    edge = (1 << 63) - 8
    return rank.ranked(scores(spark, sf_dir, rank.RankSpec(boosts=(("type", "PROMO", edge), ("brand", "Brand#11", -edge)))))


@query("parse_limits", """WITH s AS (SELECT p_partkey AS query_id, p_partkey % 3 AS kind, CASE p_partkey % 3 WHEN 0 THEN 10230 + p_partkey % 20 WHEN 1 THEN 250 + p_partkey % 14 ELSE 60 + p_partkey % 10 END AS n FROM part)
    SELECT query_id, CASE kind WHEN 0 THEN 'QueryTooLong' WHEN 1 THEN 'TooManyClauses' ELSE 'AnyOfGroupTooLarge' END AS kind, 0 AS pos FROM s WHERE n > CASE kind WHEN 0 THEN 10240 WHEN 1 THEN 256 ELSE 64 END""")
def parse_limits(spark, sf_dir):
    """Queries at and beyond the bounds of bytes, clauses and members."""
    key = F.col("p_partkey")
    long, many = F.repeat(F.lit("x"), (key % 20 + 10_230).cast("int")), F.repeat(F.lit("-b a "), (F.floor((key % 14 + 250) / 2)).cast("int"))
    many = F.concat(many, F.when((key % 14) % 2 == 1, "a").otherwise(""))
    wide = F.concat(F.lit("("), F.repeat(F.lit("cd, ,"), (key % 10 + 60).cast("int")), F.lit(")"))
    rows = table(spark, sf_dir, "part").select(key.alias("query_id"), F.when(key % 3 == 0, long).when(key % 3 == 1, many).otherwise(wide).alias("query"))
    return rejected(rows)


@query("query_shapes", f"WITH {MIXED_SQL.strip()} SELECT query_id, CASE kind WHEN 2 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS positive, CASE WHEN kind IN (3, 4, 6) THEN 1 ELSE 0 END AS negative, CASE WHEN kind IN (3, 5) THEN 1 ELSE 0 END AS groups FROM q")
def query_shapes(spark, sf_dir):
    """What ranking knows of a query."""
    return mixed(spark, sf_dir).rows.select("query_id", F.col("n_positive_terms").alias("positive"), F.col("n_negative_terms").alias("negative"), F.col("n_anyof_groups").alias("groups"))


@query("explain_pairs", f"""WITH {views_sql()}, {STORED_SQL}, p AS (SELECT title_id, q.query_id, need, pos FROM v JOIN part ON p_partkey = title_id JOIN q ON q.query = split_part(p_name, ' ', 1) || ' bolt')
    SELECT title_id, query_id, len(list_filter(need, lambda x: NOT list_contains(pos, x))) = 0 AS matched,
           CASE WHEN list_has_all(pos, need) THEN '' ELSE 'missing required: ' || array_to_string(list_sort(list_filter(need, lambda x: NOT list_contains(pos, x))), ', ') END AS failures FROM p""")
def explain_pairs(spark, sf_dir):
    """A stored query explained for each title, by its id: that of the title's first word and of bolts."""
    queries = part_queries(spark, sf_dir)
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("title_id"), F.concat(F.substring_index("p_name", " ", 1), F.lit(" bolt")).alias("query"))
    pairs = part_titles(spark, sf_dir).join(asked, "title_id").join(queries.select("query", "query_id"), "query").select("title_id", "title", "query_id")
    return inspect.explain(QuerySet.build(queries), pairs).select("title_id", "query_id", "matched", F.array_join("failures", "; ").alias("failures"))


@query("match_stats_copies", f"""WITH {views_sql()}, c AS (SELECT p_name, min(p_partkey) AS query_id FROM part GROUP BY p_name),
    w AS (SELECT query_id, list_transform(string_split(p_name, ' '), lambda x: 'term:' || x) AS need FROM c), e AS (SELECT title_id, query_id FROM v JOIN w ON list_has_all(pos, need) UNION ALL SELECT title_id, query_id FROM v JOIN w ON list_has_all(pos, ['term:promo', need[1]]))
    SELECT (SELECT count(*) FROM v) AS titles, count(*) AS emissions, count(DISTINCT (title_id, query_id)) AS matches, count(*) - count(DISTINCT (title_id, query_id)) AS duplicates FROM e""")
def match_stats_copies(spark, sf_dir):
    """Where a query has several live copies a pair may be emitted for each of them."""
    return inspect.match_stats(copies(spark, sf_dir), part_titles(spark, sf_dir), "with_broad").select("titles", "emissions", "matches", "duplicates")


@query("sql_functions", f"WITH {views_sql()} SELECT title_id, CAST(len(pos) AS INTEGER) AS features, {has('bolt')} AND NOT {has('red')} AS matched FROM v")
def sql_functions(spark, sf_dir):
    from tidepool.functions import sql

    sql.register(spark)
    return spread(part_titles(spark, sf_dir)).select("title_id", F.expr("size(title_features(title))").alias("features"), F.expr("percolates('bolt -red', title)").alias("matched"))


# --- vocabularies ------------------------------------------------------------------------------------------------------------

percolation("percolate_punctuation", {1: ("brand11", "title LIKE '%Brand#11'"), 2: ("brand", "false"), 3: ("bolt -brand#2", f"{has('bolt')} AND title NOT LIKE '%Brand#2'")}, Vocabulary(punctuation={"#": "fold"}))
percolation("percolate_additive_phrase", {1: ("red bolt", run_of("red", "bolt")), 2: ("bolt", has("bolt")), 3: ("red -bolt", f"{has('red')} AND NOT {has('bolt')}")}, Vocabulary(phrases={("red", "bolt"): ("term:red_bolt", True)}))
_FIRST = Vocabulary(synonyms={"hot": "term:temperature", "gear": "term:wheel"}, equivalences=[("red", "blue")])
_SECOND_VOCABULARY = Vocabulary(synonyms={"hot": "term:red", "cold": "term:temperature"}, equivalences=[("blue", "old")])
percolation(
    "vocabulary_merged",
    {1: ("cold", f"({has('hot')} OR {has('cold')})"), 2: ("old plate", f"{has('plate')} AND ({has('old')} OR {has('blue')} OR {has('red')})"), 3: ("wheel", has("gear"))},
    Vocabulary.from_json(_FIRST.merge(_SECOND_VOCABULARY).to_json()),
)


@query("solr_aliases", """WITH n AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part),
    g AS (SELECT list_sort(w) AS forms, CASE WHEN left(w[1], 3) = left(w[2], 3) THEN 'single_token_variant' ELSE 'single_token_distinct' END AS kind FROM n UNION ALL SELECT list_sort([array_to_string(w, ' '), w[2] || w[1]]), 'multi_word' FROM n)
    SELECT array_to_string(forms, '|') AS forms, kind, CASE WHEN forms[1] LIKE 'b%' THEN 'rejected' ELSE 'active' END AS status, 'declared' AS provenance FROM g""")
def solr_aliases(spark, sf_dir):
    """A synonym file of all part names, taken in twice; what is rejected between stays rejected, a lower source changes
    nothing."""
    # one more than a file may hold, so that a larger one is refused
    names = [r.p_name.split(" ") for r in table(spark, sf_dir, "part").select("p_name").distinct().orderBy("p_name").limit(aliases.MAX_RULES // 2 + 1).collect()]
    text = "# names\n" + "".join(f"{a}, {b}\n\n{a} {b} => {b}{a}\n" for a, b in names)
    out = aliases.AliasRegistry()
    for group in out.import_solr(text):
        if group.forms[0].startswith("b"):
            out.reject(group.forms)
    out.import_solr(text)
    for a, b in names:
        out.add((a, b), "distributional", 0.5)
    return spark.createDataFrame([("|".join(e.forms), e.kind, e.status, e.provenance) for e in out.entries.values()], "forms string, kind string, status string, provenance string")


_NAMED_SQL = "g AS (SELECT p_partkey AS query_id, string_split(p_name, ' ') AS w FROM part)"


def named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("("), F.translate("p_name", " ", ","), F.lit(") -(x,y) "), "p_type").alias("query"))


@query("learned_aliases", f"WITH {_NAMED_SQL}, c AS (SELECT list_sort(w) AS forms, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 3) SELECT array_to_string(forms, '|') AS forms, CASE WHEN left(forms[1], 3) = left(forms[2], 3) THEN 'single_token_variant' ELSE 'single_token_distinct' END AS kind, CASE WHEN left(forms[1], 3) = left(forms[2], 3) THEN 'active' ELSE 'candidate' END AS status, round(n / (n + 3), 6) AS confidence FROM c")
def learned_aliases(spark, sf_dir):
    out = aliases.AliasRegistry()
    learn.learn_aliases(named_groups(spark, sf_dir), out, 3)
    return spark.createDataFrame([("|".join(e.forms), e.kind, e.status, round(e.confidence, 6)) for e in out.entries.values()], "forms string, kind string, status string, confidence double")


@query("learn_synonyms_part", f"WITH {_NAMED_SQL}, p AS (SELECT CASE WHEN length(w[1]) > length(w[2]) OR length(w[1]) = length(w[2]) AND w[1] < w[2] THEN [w[1], w[2]] ELSE [w[2], w[1]] END AS x FROM g), c AS (SELECT x[2] AS alias, x[1] AS canonical, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, canonical) AS r FROM c) SELECT alias, canonical, n FROM r WHERE r = 1")
def learn_synonyms_part(spark, sf_dir):
    return learn.synonym_pairs(named_groups(spark, sf_dir))


@query("learned_phrases", f"""WITH {CHAT_SQL}, u AS (SELECT unnest(w) AS w FROM d), s AS (SELECT w, count(*) AS k FROM u GROUP BY w), n AS (SELECT sum(k) AS n FROM s),
    b AS (SELECT w[i] AS a, w[i + 1] AS b, count(*) AS k FROM (SELECT w, unnest(range(1, len(w))) AS i FROM d) GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT b.a || ' ' || b.b AS tokens, 'term:' || b.a || '_' || b.b AS feature, true AS additive FROM b JOIN s p ON p.w = b.a JOIN s q ON q.w = b.b, n WHERE ln((b.k / n) / ((p.k / n) * (q.k / n))) / -ln(b.k / n) >= 0.3""")
def learned_phrases(spark, sf_dir):
    found = learn.learn_phrases(chat(spark, sf_dir), iterations=1)
    return spark.createDataFrame([(" ".join(t), f, a) for t, (f, a) in found.items()], "tokens string, feature string, additive boolean")


# --- a registry in a folder, pages over a pinned state --------------------------------------------------------------------

_CREATED_SQL = f"{OPS_SQL.format(second=chr(39) + 'create' + chr(39))}, {_LIVE_SQL}, g AS (SELECT *, max(CASE WHEN op IN ('index', 'delete') THEN seq END) OVER (PARTITION BY query_id) AS last FROM a WHERE NOT (op = 'create' AND live))"


@query("registry_durable", f"WITH {_CREATED_SQL} SELECT query_id, query FROM g WHERE op <> 'delete' AND (last IS NULL OR seq >= last)")
def registry_durable(spark, sf_dir):
    """A log of three batches, compacted after the second, read again from its copy as the published state."""
    path, ops = shared_folder(spark, "registry"), order_ops(spark, sf_dir, "create").drop("refused")
    first, last = ops.agg(F.min("seq"), F.max("seq")).first()
    log, step = registry.Registry(spark, path), (last - first) // 3 + 1
    for k in range(3):
        log.append(ops.where(F.col("seq").between(first + k * step, first + (k + 1) * step - 1)))
        if k == 1:
            log.publish()
            log.compact()
    registry.Registry(spark, path).append(ops, replay=True)  # all of it was there
    log.publish()
    log.backup(f"{path}-copy")
    return registry.Registry(spark, f"{path}-copy").snapshot().rows.select("query_id", "query")


_PAGED = "new old red blue small large bolt gear rod plate"


@query("rank_pages", f"WITH {STORED_SQL.strip()}, z AS (SELECT query_id, priority AS score FROM q WHERE list_has_all(list_transform(string_split('{_PAGED}', ' '), lambda x: 'term:' || x), need)), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, query_id) AS rank FROM z) SELECT CAST((rank - 1) // 5 AS BIGINT) AS page, query_id, score FROM r")
def rank_pages(spark, sf_dir):
    """Pages over a pinned state, which writes between them do not change."""
    from tidepool.session import Percolator

    engine = Percolator(spark, shared_folder(spark, "session"))
    engine.registry.build(part_queries(spark, sf_dir).select("query_id", "query", "tags", "priority"))
    pit, rows, cursor, number = engine.open_pit(), [], None, 0
    while number == 0 or cursor:
        found, cursor = engine.ranked_page(_PAGED, 5, None if cursor else pit, cursor, scope="with_broad")
        rows += [(number, r.query_id, r.score) for r in found]
        if number == 0:
            engine.put(10**9, "red bolt", priority=10**6)
        number += 1
    return spark.createDataFrame(rows, "page long, query_id long, score long")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name as a stored query against all part titles: each title's three best."""
    return rank_static_topk(spark, sf_dir)


