"""Queries to compiled predicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepool.functions.analysis import Analyzer
from tidepool.functions.dsl import Limits, QueryError, parse
from tidepool.functions.tasks import spread

MAX_COLUMN = 65_535
Graph = tuple[int, list[tuple[int, int, list[str]]]]

STRINGS = T.ArrayType(T.StringType())
ARC = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("alts", STRINGS)])
GRAPHS = T.ArrayType(T.StructType([T.StructField("positions", T.IntegerType()), T.StructField("arcs", T.ArrayType(ARC))]))
COMPILED = T.StructType(
    [
        T.StructField("required", STRINGS),
        T.StructField("anyof", T.ArrayType(T.ArrayType(T.ArrayType(STRINGS)))),
        T.StructField("forbidden", T.ArrayType(STRINGS)),
        T.StructField("required_phrases", GRAPHS),
        T.StructField("forbidden_phrases", GRAPHS),
        T.StructField("n_positive_terms", T.IntegerType()),
        T.StructField("n_negative_terms", T.IntegerType()),
        T.StructField("n_anyof_groups", T.IntegerType()),
        T.StructField("counted", STRINGS),
        T.StructField("proxies", STRINGS),
        T.StructField("error", T.StructType([T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType())])),
    ]
)


@dataclass
class Compiled:
    """``required``: all in P(T).  ``anyof``: of each group some member, of whose requirements each has an alternative in
    P(T).  ``forbidden``: no inner list is wholly in N(T).  Phrases are graphs."""

    required: list[str] = field(default_factory=list)
    anyof: list[list[list[list[str]]]] = field(default_factory=list)
    forbidden: list[list[str]] = field(default_factory=list)
    required_phrases: list[Graph] = field(default_factory=list)
    forbidden_phrases: list[Graph] = field(default_factory=list)
    n_positive_terms: int = 0
    n_negative_terms: int = 0
    n_anyof_groups: int = 0
    counted: list[str] = field(default_factory=list)  # positive features outside groups, before widening
    proxies: list[str] = field(default_factory=list)  # the features of all groups, before widening

    @property
    def class_d(self) -> bool:
        return not (self.required or self.anyof or self.required_phrases)

    @property
    def accepted_without_positive(self) -> bool:
        return bool(self.forbidden or self.forbidden_phrases)


#: The analysis of so many texts of at most so many characters is kept within a batch.
KNOWN_TEXTS, KNOWN_LENGTH = 20_000, 64


def remembered(analyzer: Analyzer) -> Callable[[str], list[str]]:
    """The analysis of a query's words, which keeps that of short texts."""
    known = lru_cache(KNOWN_TEXTS)(lambda text: analyzer.features(text, "query"))
    return lambda text: known(text) if len(text) <= KNOWN_LENGTH else analyzer.features(text, "query")


def compile_query(query: str, analyzer: Analyzer, classes: dict[str, tuple[str, ...]] | None = None, limits: Limits = Limits(), features: Callable[[str], list[str]] | None = None) -> Compiled:
    """Runs of neighbouring positive words are analysed together; every other clause ends a run.  A group of one distinct
    member is required like plain words; groups and phrases of which nothing is left vanish.  At last every positive
    requirement is widened by its equivalence class; what is forbidden never is."""
    out, classes = Compiled(), classes or {}
    features = features or remembered(analyzer)
    required: set[str] = set()
    groups: list[list[list[str]]] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            required.update(features(" ".join(run)))
            run.clear()

    for c in parse(query, limits):
        if c.kind == "term" and not c.negated:
            run.append(c.text)
            continue
        flush()
        if c.kind == "phrase":
            graph = analyzer.phrase_graph(c.text)
            if graph[0]:
                (out.forbidden_phrases if c.negated else out.required_phrases).append(graph)
            continue
        sets = [fs for m in (c.members if c.kind == "anyof" else (c.text,)) if (fs := features(m))]
        if c.negated:
            out.forbidden += [s for s in sets if s not in out.forbidden]
            continue
        distinct = sorted({tuple(s) for s in sets})
        if len(distinct) == 1:
            required.update(distinct[0])
        elif distinct:
            groups.append([list(s) for s in distinct])
    flush()
    labels = sorted({f for _, arcs in out.required_phrases for _, _, alts in arcs for f in alts})
    out.counted = sorted(required | set(labels))
    out.proxies = sorted({f for g in groups for m in g for f in m})
    out.n_positive_terms = len(required) + sum(n for n, _ in out.required_phrases) + sum(min(map(len, g)) for g in groups)
    out.n_negative_terms = sum(map(len, out.forbidden)) + sum(n for n, _ in out.forbidden_phrases)
    widen = lambda f: list(classes.get(f, (f,)))
    out.required = sorted(f for f in required if f not in classes)
    out.anyof = [[[widen(f) for f in m] for m in g] for g in groups]
    out.anyof += [[[list(c)]] for c in sorted({classes[f] for f in required if f in classes})]
    out.n_anyof_groups = len(out.anyof)
    out.anyof = [g for i, g in enumerate(out.anyof) if g not in out.anyof[:i]]
    out.forbidden.sort()
    out.required_phrases = [(n, [(s, e, sorted({x for f in alts for x in widen(f)})) for s, e, alts in arcs]) for n, arcs in out.required_phrases]
    sizes = [out.required, out.anyof, out.forbidden, *[a for _, a in out.required_phrases + out.forbidden_phrases]]
    if max(map(len, sizes)) > MAX_COLUMN:
        raise QueryError("CompiledColumnTooLarge", 0)
    return out


def as_row(query: str | None, analyzer: Analyzer, classes: dict, limits: Limits, features: Callable[[str], list[str]] | None = None) -> tuple:
    try:
        c = compile_query(query or "", analyzer, classes, limits, features)
        error = None
    except QueryError as e:
        c, error = Compiled(), (e.kind, e.pos)
    return (c.required, c.anyof, c.forbidden, c.required_phrases, c.forbidden_phrases, c.n_positive_terms, c.n_negative_terms, c.n_anyof_groups, c.counted, c.proxies, error)


def compile_queries(queries: DataFrame, analyzer: Analyzer, classes: dict | None = None, limits: Limits = Limits(), column: str = "query") -> DataFrame:
    """``queries`` with the compiled columns; ``error`` is set where a query does not parse.  Parsing is a state machine over
    characters, so it runs in Python, in batches, on all cores; all that follows is DataFrame functions."""
    from pyspark.sql import functions as F

    @F.pandas_udf(COMPILED)
    def compiled(texts: pd.Series) -> pd.DataFrame:
        features = remembered(analyzer)
        known = {t: as_row(t, analyzer, classes or {}, limits, features) for t in set(texts)}
        frame = pd.DataFrame([known[t] for t in texts], columns=COMPILED.names)
        for name in ("required_phrases", "forbidden_phrases"):
            frame[name] = [[{"positions": n, "arcs": [{"start": s, "end": e, "alts": a} for s, e, a in arcs]} for n, arcs in v] for v in frame[name]]
        frame["error"] = [None if e is None else {"kind": e[0], "pos": e[1]} for e in frame["error"]]
        return frame

    return spread(queries).withColumn("_c", compiled(column)).select(*queries.columns, "_c.*")


ERROR = COMPILED["error"].dataType


def refused_queries(queries: DataFrame, analyzer: Analyzer, classes: dict | None = None, accept_class_d: bool = False, limits: Limits = Limits(), column: str = "query") -> DataFrame:
    """``queries`` with ``refusal``: why a query is not taken, or null.  Nothing else of what is compiled leaves Python."""
    from pyspark.sql import functions as F

    def why(text: str | None, features: Callable[[str], list[str]]) -> dict | None:
        try:
            c = compile_query(text or "", analyzer, classes, limits, features)
        except QueryError as e:
            return {"kind": e.kind, "pos": e.pos}
        return {"kind": "ClassD", "pos": 0} if c.class_d and not (accept_class_d and c.accepted_without_positive) else None

    @F.pandas_udf(ERROR)
    def refusals(texts: pd.Series) -> pd.DataFrame:
        features = remembered(analyzer)
        known = {t: why(t, features) for t in set(texts)}
        found = [known[t] or {"kind": None, "pos": None} for t in texts]
        return pd.DataFrame({"kind": [f["kind"] for f in found], "pos": pd.array([f["pos"] for f in found], dtype="Int32")})

    out = spread(queries).withColumn("_r", refusals(column))
    return out.select(*queries.columns, F.when(F.col("_r.kind").isNotNull(), F.col("_r")).alias("refusal"))


def explain_compiled(query: str, analyzer: Analyzer, classes: dict | None = None) -> str:
    """The compiled predicate in words."""
    c = compile_query(query, analyzer, classes)
    lines = [f"required: {', '.join(c.required) or '-'}"]
    lines += ["any of: " + " | ".join(" & ".join("/".join(r) for r in m) for m in g) for g in c.anyof]
    lines += ["forbidden: " + " & ".join(f) for f in c.forbidden]
    for name, graphs in (("phrase", c.required_phrases), ("forbidden phrase", c.forbidden_phrases)):
        lines += [f"{name}: " + " ".join(f"{s}-{e}:{'/'.join(a)}" for s, e, a in arcs) for _, arcs in graphs]
    return "\n".join(lines)


