"""Secret scans over a trigram inverted index, with DataFrame functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as regex_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_folder, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``pattern`` may use what Java's and Python's regexes share; a match counts if ``group`` of it has
    ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # runs are maximal, so the shorter ones need not match
)
MARK = "\x01"

#: An OR of ANDs of trigrams; None: any text may match.
Query = frozenset[frozenset[str]] | None
MOST_STRINGS = 64


def trigram_query(pattern: str) -> Query:
    """What trigrams, lower-cased, a text must hold for the pattern to match in it.

    Neighbouring parts of the pattern that stand for few strings are multiplied out; each string asks for all its
    trigrams.  What stands for many strings separates them.  Strings under three letters ask for nothing."""
    return sequence_query(list(regex_parser.parse(pattern)))


def strings(op, arg) -> set[str] | None:
    """The strings that a part of a pattern stands for, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and len(arg) <= 4 and all(o is sre.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is sre.SUBPATTERN:
        return sequence_strings(list(arg[3]))
    if op is sre.BRANCH:
        each = [sequence_strings(list(b)) for b in arg[1]]
        return None if None in each else set().union(*each)
    if op is sre.MAX_REPEAT and arg[:2] == (0, 1) and (one := sequence_strings(list(arg[2]))) is not None:
        return one | {""}
    return None


def sequence_strings(items: list) -> set[str] | None:
    out = {""}
    for op, arg in items:
        some = strings(op, arg)
        if some is None or len(out) * len(some) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, some)}
    return out


def sequence_query(items: list) -> Query:
    out: Query = None
    run = {""}
    for op, arg in items:
        some = strings(op, arg)
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, some)}
            continue
        out = both(out, of_strings(run))
        run = {""} if some is None else some
        if some is None:
            out = both(out, part_query(op, arg))
    return both(out, of_strings(run))


def part_query(op, arg) -> Query:
    if op is sre.SUBPATTERN:
        return sequence_query(list(arg[3]))
    if op is sre.BRANCH:
        each = [sequence_query(list(b)) for b in arg[1]]
        return None if None in each else fewest(frozenset().union(*each))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return sequence_query(list(arg[2]))
    return None


def of_strings(run: set[str]) -> Query:
    if any(len(s) < 3 for s in run):
        return None
    return fewest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run))


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return fewest(frozenset(x | y for x, y in product(a, b)))


def fewest(query: frozenset[frozenset[str]]) -> Query:
    """Without the ANDs that ask for more than another one does."""
    return frozenset(x for x in query if not any(y < x for y in query))


BUCKET = 1 << 15
SALTS = 16


def number(doc_id: Column, size: int) -> Column:
    """A document's number in an index of ``size`` numbers.  Two documents may share one; then both are candidates if one is."""
    return F.pmod(F.xxhash64(doc_id), F.lit(size))


def write_index(docs: DataFrame, trigrams: list[str], size: int) -> DataFrame:
    """The posting lists of these trigrams, written by trigram: ``trigram, bucket, list``.

    ``list`` holds the numbers, within the bucket, of the documents whose lower-cased text holds the trigram; a bucket has
    ``BUCKET`` numbers, so no list is longer."""
    low = docs.select(number(F.col("doc_id"), size).alias("number"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = low.select("number", F.explode(held).alias("trigram"))
    rows = rows.select("trigram", F.floor(F.col("number") / BUCKET).cast("int").alias("bucket"), (F.col("number") % BUCKET).cast("int").alias("at"))
    lists = rows.groupBy("trigram", "bucket").agg(F.collect_set("at").alias("list"))
    path = f"{shared_folder(docs.sparkSession)}/postings"
    lists.write.partitionBy("trigram").parquet(path)
    return docs.sparkSession.read.schema("trigram string, bucket int, list array<int>").parquet(path)


def look_up(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``number, rules``: the rules whose trigram queries the posting lists satisfy.  Within a bucket the lists of each AND are
    intersected and those of an OR united."""
    lists = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "list"))).alias("lists"))  # a list for each trigram asked for
    none = F.array().cast("array<int>")
    one = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
    hit = lambda kind: lambda at: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    hits = []
    for kind, query in queries.items():
        ands = [reduce(F.array_intersect, [one(t) for t in sorted(a)]) for a in sorted(query, key=sorted)]
        hits.append(F.transform(reduce(F.array_union, ands), hit(kind)))
    rows = lists.select("bucket", F.explode(F.concat(*hits)).alias("hit"))
    rows = rows.select((F.col("bucket").cast("long") * BUCKET + F.col("hit.at")).alias("number"), "hit.kind")
    return rows.groupBy("number").agg(F.collect_set("kind").alias("rules"))  # as many as there are rules at most


def candidates(docs: DataFrame, rules: tuple[Rule, ...], size: int) -> DataFrame | None:
    """``number, rules`` of the documents that the indexed rules have to be run on; None if no rule is indexed."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if not asked:
        return None
    trigrams = sorted(set().union(*(t for q in asked.values() for t in q)))
    return look_up(write_index(docs, trigrams, size), asked)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, rule: Rule, order: int, block: int = 128) -> Column:
    """``array<struct<start, order, end>>`` of a rule's matches, leftmost and not overlapping, in code points.

    Each match is put between marks, of which the text itself has none; the pieces between marks are then gaps and
    matches in turn, and their lengths give the places: sums of whole blocks of pieces, then sums within a block, so
    that a text of very many matches costs little more for each of them."""
    nothing = F.lit(0).cast("long")
    plus = lambda a, b: a + b

    def places(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(p).cast("long"))
        blocks = let(lengths, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")), lambda k: F.slice(all_, k * block + 1, F.lit(block))))
        return let(blocks, lambda bs: let(ends(bs), lambda before: F.flatten(F.transform(bs, lambda b, k: F.transform(b, lambda n, i: let(F.get(before, k) + F.aggregate(F.slice(b, F.lit(1), i), nothing, plus), lambda at: F.struct(at.alias("start"), F.lit(order).alias("order"), (at + n).alias("end"), (k * block + i).alias("i"))))))))

    def ends(blocks: Column) -> Column:
        """What stands before each block."""
        return F.aggregate(blocks, F.array(nothing), lambda out, b: F.concat(out, F.array(F.element_at(out, -1) + F.aggregate(b, nothing, plus))))

    def found(pieces: Column) -> Column:
        good = lambda s: (s["i"] % 2 == 1) & (F.length(F.regexp_extract(F.get(pieces, s["i"]), rule.pattern, rule.group)) >= rule.least)
        return F.transform(F.filter(places(pieces), good), lambda s: F.struct(s["start"], s["order"], s["end"]))

    return let(F.split(F.regexp_replace(text, f"(?:{rule.pattern})", f"{MARK}$0{MARK}"), MARK, -1), found)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: for each row the secrets in its whole text, ``array<struct<kind, start, end>>`` by start,
    then in the order of the rules.  Null texts count as empty.

    Texts are read twice: once for the index, once to verify.  The candidates go to the texts, not the texts to the
    candidates, unless there are too many of them to send to all tasks; then texts are salted, so that rows of one id do not
    gather.  A rule without mandatory trigrams is run on all texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = max(BUCKET, 8 * docs.count())
    found = candidates(docs, rules, size)
    if found is None:
        docs = docs.withColumn("rules", F.array().cast("array<string>"))
    else:
        found = written(found, "candidates")
        docs = docs.withColumn("number", number(F.col("doc_id"), size))
        if found.count() <= BROADCAST_ROWS:
            docs = docs.join(F.broadcast(found), "number", "left")
        else:
            found = found.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
            docs = docs.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(found, ["number", "salt"], "left")
    # A mark in the text becomes another character that no rule mentions: places stay.
    docs = docs.withColumn("text", F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, "\x02")).otherwise(F.col("text")))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    each = []
    for order, rule in enumerate(rules):
        go = F.array_contains("rules", rule.kind) if trigram_query(rule.pattern) is not None else F.rlike("text", F.lit(rule.pattern))
        each.append(F.when(go, matches(F.col("text"), rule, order)).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    docs = docs.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))
    named = F.transform("spans", lambda s: F.struct(F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return docs.select("doc_id", named.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
