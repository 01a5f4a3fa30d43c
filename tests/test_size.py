"""What must not depend on how large tables are or on how their files are cut."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidepool import catalog
from tidepool.functions import columns as C
from tidepool.functions import sql
from tidepool.functions.analysis import Analyzer, clean
from tidepool.functions.dsl import QueryError, parse
from tidepool.functions.vocabulary import Vocabulary
from tidepool.operators import deliver, match, rank
from tidepool.operators.match import QuerySet
from tidepool.plans.lowering import compile_queries
from tidepool.streaming import registry


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_of_one_file_are_checked_on_all_cores(spark):
    texts = ["red bolt", "-red", "-", '"x', "(", "(,)", "", None, "x" * 10_240, "x" * 10_241, "a " * 257, "a -b " * 128, "-(a,b)", f"({'a,' * 65})", "a b -c\x1cd"]
    one = spark.createDataFrame(list(enumerate(texts * 4)), "query_id long, query string").coalesce(1)
    assert tasks(compile_queries(one, Analyzer())) > 4
    for accept in (False, True):
        found = match.rejected(one, accept_class_d=accept)
        assert "Join" not in plan(found)
        assert sorted(found.collect()) == sorted(QuerySet.build(one, accept_class_d=accept).rejected.select("query_id", "kind", "pos").collect())
    assert [c.text for c in parse("a b -c\x1cd")] == ["a", "b", "c", "d"]
    with pytest.raises(QueryError):
        parse("a - ")
    assert clean("É#1 C++/x日", {"+": "keep"}) == "e # 1 c++ / x "


def test_batches_are_ranked_together(spark, monkeypatch):
    titles = spark.range(60).selectExpr("id as title_id", "concat('red bolt ', id % 3) as title")
    built = QuerySet.build(spark.createDataFrame([(1, "red", 3), (2, "bolt", 5), (3, "red 1", 4)], "query_id long, query string, priority long"))
    batch = F.col("title_id") % 20
    got = rank.batches_top_k(built, titles, rank.RankSpec(), 2, batch, "with_broad")
    together = rank.top_k(rank.scored(built, titles, rank.RankSpec(), "with_broad"), 2)
    assert plan(got).count("\n") == plan(together).count("\n")
    assert sorted(got.collect()) == sorted(together.collect())
    monkeypatch.setattr(rank, "MAX_TITLES", 2)
    with pytest.raises(ValueError):
        rank.batches_top_k(built, titles, rank.RankSpec(), 2, batch, "with_broad")


MANY = "query_id long, query string"


def test_titles_of_one_file_are_matched_on_all_cores(spark):
    titles = spark.range(400).selectExpr("id as title_id", "concat('red bolt w', id) as title").coalesce(1)
    for vocabulary in (Vocabulary(), Vocabulary(phrases={("red", "bolt"): ("term:red_bolt", False)})):
        assert tasks(match.title_views(titles, vocabulary.analyzer())) > 4
        built = QuerySet.build(spark.createDataFrame([(1, "red bolt"), (2, "bolt"), (3, '"red bolt" w7'), (4, "w9")], MANY), vocabulary)
        for strategy in ("broadcast", "shuffle"):
            assert sorted(built.match(titles, "with_broad", strategy=strategy).collect()) == sorted(built.match(titles, "with_broad", strategy="brute").collect())


def test_titles_are_never_sent_to_all_tasks_and_pairs_not_deduplicated(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id as title_id", "concat('red bolt ', id % 3) as title").write.parquet(str(tmp_path / "t"))
    titles = spark.read.parquet(str(tmp_path / "t"))
    rows = [(i, ("red", "bolt 1", "(red,w) -2", "-1", "bolt 1")[i % 5]) for i in range(60)]
    built = QuerySet.build(spark.createDataFrame(rows, MANY), accept_class_d=True)
    want = sorted((t, q) for t in range(300) for q in range(60) if (True, t % 3 == 1, t % 3 != 2, t % 3 != 1, t % 3 == 1)[q % 5])
    for most in (200_000, 10):
        monkeypatch.setattr(match.cover, "BROADCAST_ROWS", most)
        for strategy in ("broadcast", "shuffle"):
            found = built.match(titles, "with_broad", strategy=strategy)
            assert sorted(map(tuple, found.collect())) == want
            lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
            assert "Aggregate" not in lines[0] + lines[1]
    shuffled = built.pairs(titles, "with_broad", "shuffle")
    assert "rightHint=(strategy=merge)" in plan(shuffled)
    # ids that repeat, of titles and of queries, still give each pair once
    twice = titles.unionByName(titles.where("title_id < 5").withColumn("title", F.lit("red")))
    assert sorted(map(tuple, built.match(twice, "with_broad").collect())) == sorted(set(want) | {(t, q) for t in range(5) for q in range(60) if q % 5 in (0, 2, 3)})
    again = QuerySet.build(spark.createDataFrame([*rows, (0, "bolt 2"), (1, "red")], MANY), accept_class_d=True)
    assert sorted(map(tuple, again.match(titles, "with_broad").collect())) == sorted(set(want) | {(t, 1) for t in range(300)})


OPS = [(0, "index", 1, "red"), (1, "create", 1, "blue"), (2, "insert", 1, "a b"), (3, "delete", 2, None), (4, "create", 2, "x"), (5, "index", 3, "-"), (6, "index", 2, "y"), (7, "delete", 1, None), (8, "create", 1, "z"), (9, "create", 4, "-q")]


def ops_of(spark):
    return spark.createDataFrame([(*o, 1, [], 0) for o in OPS], registry.OPS)


def test_a_log_is_measured_in_one_reading(spark):
    ops = registry.accepted(ops_of(spark))
    found = registry.measured(ops)
    assert plan(found).count("ArrowEvalPython") == 1
    assert found.first()[:5] == (8, 2, 2, 2, 4)
    assert sorted(r.query_id for r in registry.live(ops).collect()) == [1, 2]


def test_publishing_keeps_nothing_in_memory(spark, tmp_path):
    log = registry.Registry(spark, str(tmp_path / "r"))
    log.append(ops_of(spark))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    log.publish()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_chunks_and_completion_tell_of_the_same_matches(spark, tmp_path):
    path, number = str(tmp_path / "d"), F.udf(lambda i: uuid.uuid4().int >> 70, "long").asNondeterministic()
    deliver.write_stream(spark.range(40).select((F.col("id") % 3).alias("title_id"), number("id").alias("query_id")), path, "e", size=4)
    rows = spark.read.schema("title_id long, members array<struct<logical_id: long>>").json(f"{path}/chunks").select("title_id", F.explode("members.logical_id").alias("query_id"))
    ends = spark.read.schema("title_id long, exact_total long, xor long").json(f"{path}/completion")
    assert sorted(ends.collect()) == sorted(deliver.summary(rows).select("title_id", "exact_total", "xor").collect())


def test_sql_functions_run_on_all_cores_and_compile_once(spark, tmp_path):
    spark.range(50).selectExpr("id as p_partkey", "'red bolt' as p_name", "'NEW' as p_type", "'Brand#1' as p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = catalog.QUERIES["sql_functions"](spark, str(tmp_path))
    assert tasks(found) > 4 and {r[1:] for r in found.collect()} == {(5, False)}
    assert sql.matches('bolt -"red x"', "red bolt", Vocabulary()) and not sql.matches('"bolt red"', "red bolt", Vocabulary())


def test_common_signs_are_translated_and_features_sorted_without_a_comparator(spark):
    kinds = [None, {"+": "keep", "-": "fold", "#": "split", "&": "marker", ".": "split"}, {" ": "keep", "é": "keep", "\0": "fold"}]
    text = "".join(chr(c) for c in range(1, 0x250)) + "a\0b x--y É#1 C++/x日 7&8 ..5 ,K \u2028 😀z  "
    one = spark.createDataFrame([(text,), ("",), (text[::-1],)], "t string")
    for kind in kinds:
        assert all(r.c == clean(r.t, kind) for r in one.select("t", C.cleaned(F.col("t"), kind).alias("c")).collect())
    seq = C.sequence_of(F.col("t"), Analyzer())
    out = one.select("t", C.features_of(seq).alias("f"))
    assert all(r.f == Analyzer().features(r.t) for r in out.collect())
    views = plan(match.title_views(one.select(F.lit(1).alias("title_id"), F.col("t").alias("title")), Analyzer()))
    assert "array_sort" not in plan(out) + views
    signs = plan(one.select(C.cleaned(F.col("t"))))
    assert "A-Z" not in signs and all(c in signs[signs.index("translate(") : signs.index("[^")] for c in ",;:-_()\"'!?@")


def test_a_prefilter_reads_its_titles_once(spark):
    titles = spark.createDataFrame([(1, "red bolt"), (2, "blue ring")], "title_id long, title string")
    built = QuerySet.build(spark.createDataFrame([(1, "red bolt"), (2, "red ring"), (3, "gear"), (4, "(gear,ring)")], "query_id long, query string"))
    some = built.prefiltered(titles)
    assert plan(some.rows).startswith("InMemoryRelation")
    assert sorted(r.query_id for r in some.rows.collect()) == [1, 2, 4]
    some.release()
    assert not some.rows.storageLevel.useMemory and built.rows.storageLevel.useMemory
