"""The engine's functions by name in SQL."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidepool.plans.lowering import Compiled, compile_query, explain_compiled

from .analysis import Analyzer, graph_occurs
from .dsl import QueryError, parse
from .vocabulary import Vocabulary

KNOWN_QUERIES = 1000


def matches(query: str, title: str, vocabulary: Vocabulary) -> bool:
    """One query against one title, without Spark."""
    analyzer = vocabulary.analyzer()
    return holds(compile_query(query, analyzer, vocabulary.equivalence_classes(analyzer)), title, analyzer)


def holds(c: Compiled, title: str, analyzer: Analyzer) -> bool:
    neg, pos = map(set, analyzer.title_sets(title))
    neg_arcs, pos_arcs, n = analyzer.title_arcs(title) if c.required_phrases or c.forbidden_phrases else ([], [], 0)
    return (
        set(c.required) <= pos
        and all(any(all(pos & set(alts) for alts in member) for member in group) for group in c.anyof)
        and not any(set(m) <= neg for m in c.forbidden)
        and all(graph_occurs(*g, pos_arcs, n) for g in c.required_phrases)
        and not any(graph_occurs(*g, neg_arcs, n) for g in c.forbidden_phrases)
    )


def register(spark: SparkSession, vocabulary: Vocabulary | None = None) -> None:
    """``title_features(title)``, ``dsl_error(query)``, ``dsl_explain(query)``, ``percolates(query, title)`` and the table
    function ``percolate(title, queries_json)``.  For ad hoc use; batches go through ``QuerySet``."""
    vocabulary = vocabulary or Vocabulary()
    analyzer = vocabulary.analyzer()

    classes = vocabulary.equivalence_classes(analyzer)
    known: dict[str, Compiled] = {}

    def percolates(query: str | None, title: str | None) -> bool:
        """A query is compiled once in a task's process, as long as there are not too many."""
        if (query or "") not in known:
            if len(known) >= KNOWN_QUERIES:
                known.clear()
            known[query or ""] = compile_query(query or "", analyzer, classes)
        return holds(known[query or ""], title or "", analyzer)

    def error(query: str) -> str | None:
        try:
            parse(query or "")
        except QueryError as e:
            return str(e)
        return None

    spark.udf.register("title_features", lambda t: analyzer.features(t or ""), "array<string>")
    spark.udf.register("dsl_error", error, "string")
    spark.udf.register("dsl_explain", lambda q: explain_compiled(q or "", analyzer), "string")
    spark.udf.register("percolates", percolates, "boolean")

    @udtf(returnType="query_id: bigint")
    class Percolate:
        def eval(self, title: str, queries: str):
            for query_id, query in json.loads(queries).items():
                if percolates(query, title):
                    yield (int(query_id),)

    spark.udtf.register("percolate", Percolate)
