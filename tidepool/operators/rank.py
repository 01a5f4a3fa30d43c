"""Scores, their order, and the best of them."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import columns as C

FEATURES = ("query_positive_terms", "query_negative_terms", "query_any_of_groups", "query_tag_count", "title_tokens", "title_bytes", "title_digits", "positive_coverage_milli", "unmatched_title_tokens")
MAX_FILE, MAX_PROFILES, MAX_TERMS, MAX_TREES, MAX_NODES, MAX_DEPTH, MAX_DEPTHS = 16 << 20, 64, 64, 256, 16_384, 16, 1024
MAX_K, MAX_TITLES, MAX_CELLS, MAX_THRESHOLD = 10_000, 10_000, 1 << 20, 10_000
I64 = range(C.BOTTOM, C.TOP + 1)


class ProfileError(ValueError):
    pass


def fnv1a64(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for b in data:
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def _whole(x) -> int:
    if not isinstance(x, int) or isinstance(x, bool) or x not in I64:
        raise ProfileError(f"not a 64-bit integer: {x!r}")
    return x


def _fields(item, required: set, optional: set = frozenset()) -> dict:
    if not isinstance(item, dict) or not required <= set(item) <= required | set(optional):
        raise ProfileError(f"fields of {item!r}")
    return item


@dataclass(frozen=True)
class Profile:
    """``static`` (zero), ``linear`` (base plus weights) or ``tree_ensemble`` (base plus each tree's leaf)."""

    kind: str
    base: int = 0
    weights: tuple[tuple[str, int], ...] = ()
    trees: tuple[tuple[dict, ...], ...] = ()

    def relevance(self, features: dict[str, Column]) -> Column:
        total = F.lit(self.base).cast("long")
        for name, weight in self.weights:
            total = C.saturating_add(total, C.saturating_multiply(features[name], F.lit(weight).cast("long")))
        for tree in self.trees:
            total = C.saturating_add(total, self._node(tree, 0, features))
        return total

    def _node(self, tree: tuple[dict, ...], at: int, features: dict[str, Column]) -> Column:
        node = tree[at]
        if node["kind"] == "leaf":
            return F.lit(node["value"]).cast("long")
        left, right = (self._node(tree, node[side], features) for side in ("left", "right"))
        return F.when(features[node["feature"]] <= F.lit(node["threshold"]), left).otherwise(right)

    def fingerprint(self) -> str:
        """Identifies what the profile computes, in a fixed format: a byte for the kind, then numbers as little-endian 64-bit words,
        features and kinds of nodes as bytes."""
        word = lambda x: struct.pack("<q", x)
        feature = lambda name: bytes([FEATURES.index(name)])
        if self.kind == "static":
            data = b"\0"
        elif self.kind == "linear":
            data = b"\1" + word(self.base) + word(len(self.weights)) + b"".join(feature(n) + word(w) for n, w in self.weights)
        else:
            node = lambda n: b"\1" + word(n["value"]) if n["kind"] == "leaf" else b"\0" + feature(n["feature"]) + word(n["threshold"]) + word(n["left"]) + word(n["right"])
            data = b"\2" + word(self.base) + word(len(self.trees)) + b"".join(word(len(t)) + b"".join(map(node, t)) for t in self.trees)
        return f"fnv1a64:{fnv1a64(data):016x}"


def _tree(raw) -> tuple[tuple[dict, ...], int]:
    """A checked tree and its depth: node 0 is the root, each other node has one parent."""
    nodes = _fields(raw, {"nodes"})["nodes"]
    for n in nodes:
        if n.get("kind") == "leaf":
            _whole(_fields(n, {"kind", "value"})["value"])
        else:
            _fields(n, {"kind", "feature", "threshold", "left", "right"})
            if n["kind"] != "split" or n["feature"] not in FEATURES:
                raise ProfileError(f"node {n!r}")
            _whole(n["threshold"])
    depth, todo, seen = 0, [(0, 0)], set()
    while todo:
        at, d = todo.pop()
        if not isinstance(at, int) or not 0 <= at < len(nodes) or at in seen:
            raise ProfileError("a node is missing or has two parents")
        seen.add(at)
        depth = max(depth, d)
        if nodes[at]["kind"] == "split":
            todo += [(nodes[at][side], d + 1) for side in ("left", "right")]
    if len(seen) < len(nodes) or depth > MAX_DEPTH:
        raise ProfileError("a node cannot be reached, or a tree is too deep")
    return tuple(nodes), depth


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ProfileError("a name is given twice")
    return out


def load_profiles(text: str) -> dict[str, Profile]:
    """Named profiles from strict JSON; ``static_v1`` is always there."""
    if len(text.encode()) > MAX_FILE:
        raise ProfileError("the file is too large")
    data = _fields(json.loads(text, object_pairs_hook=_no_repeats), {"version", "profiles"})
    if data["version"] != 1 or len(data["profiles"]) > MAX_PROFILES:
        raise ProfileError("version or number of profiles")
    out = {"static_v1": Profile("static")}
    for name, raw in data["profiles"].items():
        if not re.fullmatch("[a-z0-9_-]{1,64}", name):
            raise ProfileError(f"name {name!r}")
        kind = raw.get("kind")
        if kind == "static":
            _fields(raw, {"kind"}, {"expected_fingerprint"})
            profile = Profile("static")
        elif kind == "linear":
            _fields(raw, {"kind", "weights"}, {"intercept", "expected_fingerprint"})
            weights = tuple((_fields(w, {"feature", "weight"})["feature"], _whole(w["weight"])) for w in raw["weights"])
            if len(weights) > MAX_TERMS or len({n for n, _ in weights}) < len(weights) or any(n not in FEATURES for n, _ in weights):
                raise ProfileError(f"weights of {name}")
            profile = Profile("linear", _whole(raw.get("intercept", 0)), weights)
        elif kind == "tree_ensemble":
            _fields(raw, {"kind", "trees"}, {"base_score", "expected_fingerprint"})
            trees = [_tree(t) for t in raw["trees"]]
            if not 1 <= len(trees) <= MAX_TREES or sum(len(t) for t, _ in trees) > MAX_NODES or sum(d for _, d in trees) > MAX_DEPTHS:
                raise ProfileError(f"size of {name}")
            profile = Profile("tree_ensemble", _whole(raw.get("base_score", 0)), (), tuple(t for t, _ in trees))
        else:
            raise ProfileError(f"kind {kind!r}")
        told = raw.get("expected_fingerprint")
        if told is not None and told != profile.fingerprint():
            raise ProfileError(f"{name} has the fingerprint {profile.fingerprint()}, not {told}")
        if name == "static_v1" and profile != out["static_v1"]:
            raise ProfileError("static_v1 is fixed")
        out[name] = profile
    return out


@dataclass(frozen=True)
class RankSpec:
    """A profile's relevance, the priority, and boosts for tags: a later boost of a tag replaces an earlier one."""

    profile: str = "static_v1"
    priority_field: str | None = "priority"
    boosts: tuple[tuple[str, str, int], ...] = ()
    profiles: dict[str, Profile] = field(default_factory=lambda: {"static_v1": Profile("static")})

    def score(self, title: Column | None = None) -> Column:
        """Boosts, then priority, then relevance, each sum saturating."""
        if self.profile not in self.profiles:
            raise ProfileError(f"unknown_rank_profile: {self.profile}")
        if self.priority_field not in (None, "priority"):
            raise ProfileError(f"unsupported_rank_field: {self.priority_field}")
        total = boosted(self.boosts)
        if self.priority_field:
            total = C.saturating_add(total, F.coalesce(F.col("priority").cast("long"), F.lit(0).cast("long")))
        profile = self.profiles[self.profile]
        if profile.kind != "static":
            total = C.saturating_add(total, profile.relevance(C.rank_features(F.col("title") if title is None else title)))
        return total


def boosted(boosts: tuple[tuple[str, str, int], ...]) -> Column:
    last = {(k, v): b for k, v, b in boosts}
    total = F.lit(0).cast("long")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    for (key, value), boost in last.items():
        held = F.array_contains(tags, f"{key}{C.SEP}{value}")
        total = C.saturating_add(total, F.when(held, F.lit(boost).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


def compat_score(boosts: tuple[tuple[str, str, int], ...], priority_key: str = "") -> Column:
    """Boosts, and the number in the first tag of ``priority_key``, in the order of the tags; no number counts as 0."""
    total = boosted(boosts)
    if priority_key:
        first = F.get(F.filter("tags", lambda t: F.startswith(t, F.lit(f"{priority_key}{C.SEP}"))), F.lit(0))
        number = F.substring_index(first, C.SEP, -1).try_cast("long")
        total = C.saturating_add(total, F.coalesce(number, F.lit(0).cast("long")))
    return total


def scored(query_set, titles: DataFrame, spec: RankSpec | Column, scope: str = "standard", tags: dict | None = None, strategy: str = "auto") -> DataFrame:
    """``title_id, query_id, score`` of all matches.  A match of any copy counts; the newest copy is scored.

    Where no query has several copies, a pair comes once and with all that its score needs; else the distinct pairs fetch
    that."""
    score = (spec if isinstance(spec, Column) else spec.score()).alias("score")
    some = query_set.filtered(tags)
    if not query_set.has_copies():
        return some.pairs(titles.select("title_id", "title"), scope, strategy).select("title_id", "query_id", score)
    matches = query_set.match(titles, scope, tags, strategy)
    newest = query_set.newest().select("query_id", "tags", "priority", "n_positive_terms", "n_negative_terms", "n_anyof_groups")
    return matches.join(newest, "query_id").join(titles.select("title_id", "title").hint("merge"), "title_id").select("title_id", "query_id", score)


ORDER = ("score desc", "query_id asc")


def ranked(scores: DataFrame) -> DataFrame:
    """With ``rank`` from 1: higher scores first, ties to the smaller query_id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("title_id").orderBy(F.desc("score"), "query_id")))


def check_size(size: int, titles: int | None = None) -> None:
    if not 0 <= size <= MAX_K:
        raise ValueError(f"size {size}")
    if titles is not None and (titles > MAX_TITLES or size * titles > MAX_CELLS):
        raise ValueError(f"{titles} titles of {size}")


def top_k(scores: DataFrame, size: int, search_after: tuple[int, int] | None = None) -> DataFrame:
    """Each title's best ``size`` rows; ``search_after``: those behind this (score, query_id)."""
    check_size(size)
    if search_after:
        score, query_id = search_after
        scores = scores.where((F.col("score") < score) | (F.col("score") == score) & (F.col("query_id") > query_id))
    return ranked(scores).where(F.col("rank") <= size)


def batch_top_k(query_set, titles: DataFrame, spec: RankSpec | Column, size: int, scope: str = "standard", tags: dict | None = None) -> DataFrame:
    """Each title's best ``size``; a batch of too many titles or cells is refused before anything is matched."""
    check_size(size, titles.count())
    return top_k(scored(query_set, titles, spec, scope, tags), size)


def batches_top_k(query_set, titles: DataFrame, spec: RankSpec | Column, size: int, batch: Column, scope: str = "standard", tags: dict | None = None) -> DataFrame:
    """As ``batch_top_k`` for each of the batches that ``batch`` numbers: none is matched if one is refused.  A title's best do
    not depend on its batch, so all are matched and ranked together, however many batches there are."""
    largest = titles.groupBy(batch.alias("_batch")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    check_size(size, largest or 0)
    return top_k(scored(query_set, titles, spec, scope, tags), size)


def page(scores: DataFrame, start: int = 0, size: int = 1000) -> DataFrame:
    """Rows ``start`` to ``start + size`` of each title's order."""
    return ranked(scores).where((F.col("rank") > start) & (F.col("rank") <= start + size))


def totals(matches: DataFrame, up_to: int | None = None) -> DataFrame:
    """``title_id, value, relation``: the number of matches; beyond ``up_to`` only that there are more."""
    out = matches.groupBy("title_id").agg(F.countDistinct("query_id").alias("value"))
    if up_to is None:
        return out.withColumn("relation", F.lit("eq"))
    return out.select("title_id", F.least("value", F.lit(up_to)).cast("long").alias("value"), F.when(F.col("value") > up_to, "gte").otherwise("eq").alias("relation"))


def merged_top_k(parts: list[DataFrame], size: int) -> DataFrame:
    """Each title's best ``size`` from the best ``size`` of parts that share no query; a pair that two parts tell of is an error
    when the rows are read."""
    check_size(size)
    if not parts:
        raise ValueError("no parts")
    rows = parts[0].select("title_id", "query_id", "score")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("title_id", "query_id", "score"))
    once = rows.groupBy("title_id", "query_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("_n"))
    told = F.when(F.col("_n") == 1, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("two parts tell of query "), F.col("query_id").cast("string"))).cast("long"))
    return ranked(once.select("title_id", "query_id", told.alias("score"))).where(F.col("rank") <= size)


def merged_totals(parts: list[DataFrame], up_to: int) -> DataFrame:
    """The totals of parts that share no query, as ``totals`` tells them: exact only if every part is and all together do not
    exceed ``up_to``."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    out = rows.groupBy("title_id").agg(F.sum("value").alias("_n"), F.bool_and(F.col("relation") == "eq").alias("_exact"))
    exact = F.col("_exact") & (F.col("_n") <= up_to)
    return out.select("title_id", F.least("_n", F.lit(up_to)).cast("long").alias("value"), F.when(exact, "eq").otherwise("gte").alias("relation"))


def with_source(hits: DataFrame, registry: DataFrame, includes: tuple[str, ...] = ("*",), excludes: tuple[str, ...] = ()) -> DataFrame:
    """The stored columns of final hits only, those whose names pass the globs."""
    from fnmatch import fnmatchcase

    names = [c for c in registry.columns if c != "query_id" and any(fnmatchcase(c, g) for g in includes) and not any(fnmatchcase(c, g) for g in excludes)]
    return hits.join(registry.select("query_id", F.struct(*names).alias("_source") if names else F.lit(None).alias("_source")), "query_id", "left")


class TooLarge(RuntimeError):
    pass


def fetch_sources(hits: DataFrame, registry: DataFrame, includes: tuple[str, ...] = ("*",), excludes: tuple[str, ...] = (), most: int = 16 << 20) -> DataFrame:
    """As ``with_source``, for final hits; if the sources are over ``most`` bytes, an error and none of them."""
    out = with_source(hits, registry, includes, excludes)
    size = out.agg(F.sum(F.octet_length(F.to_json("_source")))).first()[0] or 0
    if size > most:
        raise TooLarge(f"sources of {size} bytes, over {most}")
    return out
