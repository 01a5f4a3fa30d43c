"""Query corpora from CSV and JSON lines, bulk bodies, tags."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions.columns import SEP

TOP = (1 << 63) - 1


def detect(path: str | None, first_line: str) -> str:
    """By the extension, else by the first line that is not blank: ``jsonl`` if it begins with {, else ``csv``."""
    ending = (path or "").rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv"):
        return "csv"
    if ending in ("jsonl", "ndjson"):
        return "jsonl"
    return "jsonl" if first_line.lstrip().startswith("{") else "csv"


def parse_csv(lines: DataFrame) -> DataFrame:
    """``line_no, value`` to ``line_no, query_id, query, error``: the id up to the first comma (in .tsv files too), then the
    query, in quotes or not, with "" for a quote.  The first line is a header if its first field is no number.  A bad line has
    an error and stops nothing."""
    value = F.rtrim(F.regexp_replace("value", "\r$", ""))
    rows = lines.select("line_no", value.alias("v")).where(F.trim("v") != "")
    comma = F.instr("v", ",")
    head = F.trim(F.when(comma > 0, F.substring("v", F.lit(1), comma - 1)).otherwise(F.col("v")))
    rest = F.trim(F.substr("v", comma + 1))
    quoted = F.length(rest).__ge__(2) & F.startswith(rest, F.lit('"')) & F.endswith(rest, F.lit('"'))
    number = F.when(F.col("_head").rlike("^[0-9]+$"), F.col("_head").try_cast("bigint"))
    rows = rows.withColumn("_comma", comma).withColumn("_head", head).withColumn("_rest", rest).withColumn("_q", quoted)
    query = F.when(F.col("_q"), F.regexp_replace(F.expr("substring(_rest, 2, length(_rest) - 2)"), '""', '"')).otherwise(F.col("_rest"))
    first = rows.agg(F.min("line_no").alias("first"))
    rows = rows.join(F.broadcast(first)).where(~((F.col("line_no") == F.col("first")) & number.isNull() & ~F.col("_head").rlike("^[0-9]+$")))  # one row
    error = F.when(F.col("_comma") == 0, F.lit("no comma")).when(number.isNull(), F.lit("id is no 63-bit number")).when(F.trim(query) == "", F.lit("empty query"))
    return rows.select("line_no", number.alias("query_id"), query.alias("query"), error.alias("error"))


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """``line_no, value`` to ``line_no, query_id, query, error`` from lines like {"id": 1, "query": "..."}."""
    parsed = F.from_json("value", "id string, query string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("line_no", parsed.alias("j"))
    number = F.when(F.col("j.id").rlike("^[0-9]+$"), F.col("j.id").try_cast("bigint"))
    error = F.when(F.col("j._bad").isNotNull(), F.lit("not JSON")).when(number.isNull(), F.lit("id is no 63-bit number")).when(F.coalesce(F.trim("j.query"), F.lit("")) == "", F.lit("empty query"))
    return rows.select("line_no", number.alias("query_id"), F.col("j.query").alias("query"), error.alias("error"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with numbers that rise within a file: position in its partition, after the partition."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def load_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, errors) of a file."""
    lines = numbered_lines(spark, path)
    first = lines.where(F.trim("value") != "").select("value").head()
    return _sorted_out(lines, detect(path, first.value if first else ""))


def load_str(spark: SparkSession, content: str, hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    lines = spark.createDataFrame(list(enumerate(content.split("\n"))), "line_no long, value string")
    return _sorted_out(lines, hint or detect(None, next((x for x in content.split("\n") if x.strip()), "")))


def _sorted_out(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    rows = (parse_csv if kind == "csv" else parse_jsonl)(lines)
    return rows.where("error is null").select("query_id", "query"), rows.where("error is not null").select("line_no", "error")


# --- tags and bulk bodies ----------------------------------------------------------------------------------------------

RESERVED = ("query", "version", "tags", "rank_fields")


class BodyError(ValueError):
    pass


class _Number(str):
    """A number as it was written."""


def scalar_text(value) -> str | None:
    """A tag value as text: numbers as written, true and false; null: no tag."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise BodyError(f"not a tag value: {value!r}")


def tags_of(body: dict) -> list[str]:
    """The pairs of ``tags`` and of all fields that are not reserved; a list gives a pair each."""
    out = set()
    tags = body.get("tags") or {}
    if not isinstance(tags, dict):
        raise BodyError("tags is no object")
    for key, value in [*tags.items(), *((k, v) for k, v in body.items() if k not in RESERVED)]:
        if not key:
            raise BodyError("a tag without a name")
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, (dict, list)):
                raise BodyError(f"tag {key}: nested")
            if (text := scalar_text(v)) is not None:
                out.add(f"{key}{SEP}{text}")
    return sorted(out)


def priority_of(body: dict, tags: list[str]) -> tuple[int, list[str]]:
    """The typed priority, mirrored as a tag; a tag of that name must not say otherwise."""
    fields = body.get("rank_fields") or {}
    if set(fields) - {"priority"}:
        raise BodyError(f"rank_fields {sorted(fields)}")
    if fields.get("priority") is None:
        return 0, tags
    try:
        value = int(str(fields["priority"]))
    except ValueError:
        raise BodyError("priority is no whole number") from None
    if not -(1 << 63) <= value <= TOP or isinstance(fields["priority"], bool):
        raise BodyError("priority is no 64-bit number")
    there = [t for t in tags if t.startswith(f"priority{SEP}")]
    if there and there != [f"priority{SEP}{value}"]:
        raise BodyError("priority is given twice")
    return value, sorted({*tags, f"priority{SEP}{value}"})


def bulk_action(line: str) -> tuple[str, int]:
    """(op, id) of an action line."""
    try:
        ((op, meta),) = json.loads(line).items()
        query_id = int(meta["_id"])
    except (ValueError, KeyError, TypeError, AttributeError):
        raise BodyError(f"action {line!r}") from None
    if op not in ("index", "create") or set(meta) != {"_id"} or not 0 <= query_id <= TOP:
        raise BodyError(f"action {line!r}")
    return op, query_id


def bulk_source(line: str) -> dict:
    """``query, version, tags, priority, error`` of a source line."""
    row = {"query": None, "version": 1, "tags": [], "priority": 0, "error": None}
    try:
        source = json.loads(line, parse_float=_Number)
        if not isinstance(source, dict) or not isinstance(source.get("query"), str):
            raise BodyError("no query")
        version = source.get("version", 1)
        if not isinstance(version, int) or isinstance(version, bool) or not 0 <= version < 1 << 32:
            raise BodyError("version")
        priority, tags = priority_of(source, tags_of(source))
        row |= {"query": source["query"], "version": version, "tags": tags, "priority": priority}
    except ValueError as e:
        row["error"] = str(e)
    return row


def parse_bulk(body: str, first_seq: int = 0) -> list[dict]:
    """A bulk body's operations in order: an action line {"index"|"create": {"_id": n}} and a source line each.

    Wrong framing - no newline at the end, a blank line, an unknown action - refuses all; a wrong source refuses its
    item, with status 400 and why."""
    if not body.endswith("\n"):
        raise BodyError("no newline at the end")
    lines = body[:-1].split("\n")
    if len(lines) % 2 or any(not x.strip() for x in lines):
        raise BodyError("lines are blank or without a partner")
    out = []
    for k in range(0, len(lines), 2):
        op, query_id = bulk_action(lines[k])
        out.append({"seq": first_seq + k // 2, "op": op, "query_id": query_id} | bulk_source(lines[k + 1]))
    return out


def parse_bulk_lines(lines: DataFrame, first_seq: int = 0) -> DataFrame:
    """As ``parse_bulk``, of ``line_no, value`` with lines numbered from 0 without gaps: ``seq, op, query_id, query, version, tags,
    priority, error``, however many they are.  A wrong framing is an error when the rows are read."""
    halves = [F.max(F.when(F.col("line_no") % 2 == k, F.col("value"))).alias(n) for k, n in enumerate(("action", "source"))]
    pairs = lines.groupBy(F.floor(F.col("line_no") / 2).cast("long").alias("item")).agg(*halves)

    def run(frames):
        for frame in frames:
            rows = []
            for item, action, source in zip(frame["item"], frame["action"], frame["source"], strict=True):
                if action is None or source is None or not action.strip() or not source.strip():
                    raise BodyError("lines are blank or without a partner")
                op, query_id = bulk_action(action)
                rows.append({"seq": first_seq + item, "op": op, "query_id": query_id} | bulk_source(source))
            yield pd.DataFrame(rows, columns=["seq", "op", "query_id", "query", "version", "tags", "priority", "error"])

    return pairs.mapInPandas(run, "seq long, op string, query_id long, query string, version long, tags array<string>, priority long, error string")


def consecutive(lines: DataFrame) -> DataFrame:
    """``line_no, value`` of a file's lines, numbered from 0 without gaps: places within partitions, after the sizes of those
    before."""
    lines = lines.withColumn("_p", F.shiftright("line_no", 33)).withColumn("_at", F.col("line_no").bitwiseAND((1 << 33) - 1))
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = lines.groupBy("_p").count().select("_p", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a partition
    return lines.join(F.broadcast(sizes), "_p").select((F.col("_before") + F.col("_at")).alias("line_no"), "value")


def load_bulk(spark: SparkSession, path: str, first_seq: int = 0) -> DataFrame:
    """The operations of a file in the bulk form."""
    return parse_bulk_lines(consecutive(numbered_lines(spark, path)), first_seq)


# --- filters from requests -----------------------------------------------------------------------------------------------


def parse_filter(raw: dict) -> dict[str, list[str]]:
    """{key: value or list} as texts; null, objects and nested lists are errors."""
    out: dict[str, list[str]] = {}
    for key, value in raw.items():
        values = value if isinstance(value, list) else [value]
        texts = [None if isinstance(v, (dict, list)) else scalar_text(v) for v in values]
        if None in texts:
            raise BodyError(f"filter {key}")
        out[key] = texts
    return out


def parse_search(body: dict) -> tuple[list[str], dict[str, list[str]]]:
    """(titles, filter) of a search body: ``{"query": {"percolate": ...}}`` or a ``bool`` of one under ``must`` and
    term or terms under ``filter``; anything else is an error."""
    query = body.get("query")
    if not isinstance(query, dict) or len(query) != 1:
        raise BodyError("query")
    (kind, inner), wanted = next(iter(query.items())), {}
    if kind == "bool":
        if set(inner) - {"must", "filter"}:
            raise BodyError("bool")
        must = inner.get("must")
        must = must[0] if isinstance(must, list) and len(must) == 1 else must
        if not isinstance(must, dict) or set(must) != {"percolate"}:
            raise BodyError("must")
        clauses = inner.get("filter", [])
        for clause in clauses if isinstance(clauses, list) else [clauses]:
            ((op, fields),) = clause.items()
            ((key, value),) = fields.items()
            if op not in ("term", "terms") or isinstance(value, list) != (op == "terms") or key in wanted:
                raise BodyError(f"filter {clause!r}")
            wanted |= parse_filter({key: value})
        kind, inner = "percolate", must["percolate"]
    if kind != "percolate" or (("document" in inner) == ("documents" in inner)):
        raise BodyError("percolate")
    documents = inner["documents"] if "documents" in inner else [inner["document"]]
    if any(set(d) != {"title"} or not isinstance(d["title"], str) for d in documents):
        raise BodyError("document")
    return [d["title"] for d in documents], wanted

