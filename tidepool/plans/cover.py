"""Signatures: for each query a set of keys of which every title that matches it has one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import SEP

UNIVERSAL = ""
MASK_SIZE = 64
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Mask:
    """The most frequent features of the query corpus, and the frequency from which an anchor is hot (0: never)."""

    hot: tuple[str, ...] = ()
    theta: int = 0


def feature_frequency(compiled: DataFrame) -> DataFrame:
    """``feature, freq``: in how many queries a feature can serve for retrieval - required, in a required phrase, or an
    any-of member's rarest feature - before equivalences widen anything.

    Which feature is a member's rarest is taken from the counts of all positive features."""
    usable = compiled.where("error is null")
    outside = usable.select("row_id", F.explode("counted").alias("feature"))
    inside = usable.select("row_id", F.explode("proxies").alias("feature"))
    every = outside.unionByName(inside).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    members = usable.select("row_id", F.posexplode("anyof").alias("g", "members")).select("row_id", "g", F.posexplode("members").alias("m", "needs"))
    needs = members.select("row_id", "g", "m", F.explode(F.flatten("needs")).alias("feature")).join(inside, ["row_id", "feature"]).join(every, "feature")
    rarest = needs.groupBy("row_id", "g", "m").agg(F.min(F.struct("n", "feature")).alias("least")).select("row_id", F.col("least.feature").alias("feature"))
    return outside.unionByName(rarest).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("freq"))


def top_mask(frequency: DataFrame, size: int = MASK_SIZE) -> list[str]:
    """The ``size`` most frequent features, ties by name.  At most ``size`` names come to the driver."""
    return [r.feature for r in frequency.orderBy(F.desc("freq"), "feature").limit(size).collect()]


def classified(compiled: DataFrame, frequency: DataFrame, mask: Mask) -> DataFrame:
    """``compiled`` with ``cost_class``, ``lane`` and ``signatures``.

    D: no positive clause.  A: one rare required feature.  B: a pair, a phrase's labels or an any-of group without hot
    features.  C: only hot features (the broad lane).  H: the anchor is as frequent as theta (the hot lane)."""
    used = compiled.select("row_id", F.explode(F.array_distinct(F.concat("required", F.flatten(F.flatten(F.flatten("anyof"))), F.flatten(F.transform("required_phrases", lambda g: F.flatten(F.transform(g["arcs"], lambda a: a["alts"]))))))).alias("feature"))
    known = used.join(frequency, "feature", "left").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.coalesce("freq", F.lit(0)).alias("freq")))).alias("freqs"))
    rows = compiled.join(known, "row_id", "left").withColumn("freqs", F.coalesce("freqs", F.create_map().cast("map<string,bigint>")))
    hot = F.array(*[F.lit(f) for f in mask.hot]).cast("array<string>")
    freq = lambda f: F.coalesce(F.try_element_at("freqs", f), F.lit(0).cast("long"))
    worst = lambda fs: F.coalesce(F.array_max(F.transform(fs, freq)), F.lit(0).cast("long"))

    by_rarity = F.transform(F.array_sort(F.transform("required", lambda f: F.struct(freq(f).alias("n"), f.alias("f")))), lambda s: s["f"])
    rows = rows.withColumn("_required", by_rarity)
    labels = F.transform("required_phrases", lambda g: F.array_sort(F.array_distinct(F.flatten(F.transform(g["arcs"], lambda a: a["alts"])))))
    phrase = F.array_min(F.transform(labels, lambda ls: F.struct(worst(ls).alias("n"), ls.alias("fs"))))["fs"]

    def member_cover(needs: Column) -> Column:
        return F.array_min(F.transform(needs, lambda alts: F.struct(worst(alts).alias("n"), alts.alias("fs"))))["fs"]

    covers = F.transform("anyof", lambda g: F.array_sort(F.array_distinct(F.flatten(F.transform(g, member_cover)))))
    group = F.array_min(F.transform(covers, lambda fs: F.struct(worst(fs).alias("n"), fs.alias("fs"))))
    rows = rows.withColumn("_phrase", phrase).withColumn("_group", group)
    first, second = F.get("_required", F.lit(0)), F.get("_required", F.lit(1))
    is_hot = F.array_contains(hot, first)
    theta = F.lit(mask.theta)
    pair = F.concat(F.least(first, second), F.lit(SEP), F.greatest(first, second))
    none = F.size("_required") == 0
    group_hot = F.arrays_overlap(F.col("_group.fs"), hot)
    rules = [
        (none & F.col("_group").isNull() & F.col("_phrase").isNull(), "D", "broad", F.array(F.lit(UNIVERSAL))),
        (none & F.col("_phrase").isNotNull(), "B", "main", F.col("_phrase")),
        (none & group_hot, "C", "broad", F.col("_group.fs")),
        (none & (theta > 0) & (F.col("_group.n") >= theta), "H", "hot", F.col("_group.fs")),
        (none, "B", "main", F.col("_group.fs")),
        (is_hot & second.isNotNull(), "B", "main", F.array(pair)),
        (is_hot & F.col("_phrase").isNotNull(), "B", "main", F.col("_phrase")),
        (is_hot, "C", "broad", F.array(first)),
        ((theta > 0) & (freq(first) >= theta), "H", "hot", F.array(first)),
        (F.lit(True), "A", "main", F.array(first)),
    ]
    pick = lambda k: F.coalesce(*[F.when(r[0], r[k] if isinstance(r[k], Column) else F.lit(r[k])) for r in rules])
    rows = rows.withColumn("cost_class", pick(1)).withColumn("lane", pick(2)).withColumn("signatures", pick(3))
    return rows.drop("freqs", "_required", "_phrase", "_group")


def postings(classed: DataFrame) -> DataFrame:
    return classed.select(F.explode("signatures").alias("sig"), "lane", "cost_class", "row_id")


def title_signatures(pos: Column, probe: Column, mask: Mask, pairs: bool = True) -> Column:
    """Every feature a title is probed with, and every pair of a hot feature and another."""
    hot = F.array_intersect(pos, F.array(*[F.lit(f) for f in mask.hot]).cast("array<string>"))
    both = F.flatten(F.transform(hot, lambda h: F.transform(F.filter(pos, lambda f: f != h), lambda f: F.concat(F.least(h, f), F.lit(SEP), F.greatest(h, f)))))
    return F.array_union(probe, F.array_distinct(both)) if pairs and mask.hot else probe
