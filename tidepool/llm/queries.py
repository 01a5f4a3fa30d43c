"""The registered query of each operator: the operator over its whole table, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .ann import nearest
from .bpe import build_lexicon, encode_decode
from .common import table
from .counts import token_counts
from .packing import best_fit_packing
from .pii import KINDS, find_personal_data, train
from .secrets import counted, digest, secret_scan
from .simhash import hex_fingerprint, near_duplicates
from .topk import exact_top_k
from .warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


@register("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find_personal_data(docs, train(docs))
    counts = [counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


@register("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    out = toxicity.scores(docs, model, ["doc_id"])
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@register("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def _spans(kind: str, order: int, good: str) -> str:
    """DuckDB: a kind's matches as structs, by lengths of the pieces between marks."""
    return f"""
      list_transform(list_filter(list_transform(range(2, len({kind}) + 1, 2),
        lambda i: {{'s': CAST(list_sum(list_transform({kind}[1:i-1], lambda x: length(x))) AS BIGINT), 'o': {order}, 'm': {kind}[i]}}), lambda x: {good}),
        lambda x: {{'s': x.s, 'o': x.o, 'e': x.s + length(x.m)}})"""


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""


@register(
    "op7_secrets",
    f"""
    WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
    p AS (SELECT doc_id,
            string_split(regexp_replace(t, '({_ASSIGN})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS assign,
            string_split(regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS access,
            string_split(regexp_replace(t, '([0-9a-f]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS hex FROM t),
    s AS (SELECT doc_id, list_sort(list_concat(list_concat(
            {_spans('assign', 0, f"length(regexp_extract(x.m, '{_ASSIGN}', 1)) >= 12")},
            {_spans('access', 1, "length(x.m) >= 18")}),
            {_spans('hex', 2, "length(x.m) >= 16")})) AS a FROM p),
    n AS (SELECT doc_id, a, coalesce(list_aggregate(list_transform(a, lambda x: (['assign', 'access', 'hex'])[x.o + 1] || ':' || x.s || ':' || x.e), 'string_agg', ','), '') AS spans FROM s)
    SELECT doc_id, CAST(len(list_filter(a, lambda x: x.o = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(a, lambda x: x.o = 1)) AS BIGINT) AS n_access,
           CAST(len(list_filter(a, lambda x: x.o = 2)) AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans FROM n
    """,
)
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    kinds = [counted(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *kinds, F.sha2(digest(spans), 256).alias("base_sha256"), digest(spans).alias("spans"))


@register("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    out = encode_decode(docs, path, build_lexicon(docs, path))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@register(
    "op10_topk",
    """
    WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
               FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
