import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import naive
from tidepool.functions import columns as C
from tidepool.functions.analysis import Analyzer, graph_occurs
from tidepool.functions.vocabulary import Vocabulary
from tidepool.operators import inspect, match
from tidepool.operators.match import QuerySet, title_views
from tidepool.sources.generate import Shape, generate, messy_title, negative_queries


@pytest.fixture(scope="module")
def corpus(spark):
    queries, titles = generate(Shape(queries=300, titles=120, broad=0.06, seed=11, collections=40))
    queries += [(300 + i, q) for i, q in enumerate(negative_queries(3, 5))]
    queries += [(400, '"brass lantern" -replica'), (401, "(brass lantern,walnut clock) -(old sale,box)"), (402, "oops - x"), (403, "(lantern,kettle)")]
    titles = [(i, messy_title(t, i) if i % 3 else t) for i, t in titles] + [(900, ""), (901, None), (902, "lantern " * 3000)]
    return queries, titles, spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(titles, "title_id long, title string")


def pairs(df):
    return sorted((r.title_id, r.query_id) for r in df.collect())


def test_columns_equal_the_analyzer(spark, corpus):
    extra = ["1999 # 1999", "1999/2000", "a / 2001", "12. .5 1.2.3", "ß Ā Ø K ﬁ", "x y\tz", "٣ ½", "model 1995", "c++ it's"]
    rows = [(i, t) for i, t in enumerate([*extra, *[t for _, t in corpus[1]]])]
    for analyzer in (Analyzer(), Analyzer({"c++": "term:cpp", "brass": "term:metal"}, [], {"+": "keep", "'": "fold", "&": "marker"}, ("model",))):
        df = spark.createDataFrame(rows, "i int, t string").withColumn("seq", C.sequence_of(F.col("t"), analyzer))
        for r in df.withColumn("pos", C.features_of(F.col("seq"))).collect():
            assert r.pos == analyzer.features(r.t or ""), r.t
            arcs, n = analyzer.filled(r.t or "", "title")
            assert r.seq == [f for f, s, _ in sorted(arcs, key=lambda a: a[1])] and n == len(r.seq)


def test_all_strategies_equal_the_naive_matcher(corpus):
    queries, titles, query_df, title_df = corpus
    want = sorted((t, q) for t, title in titles for q, text in queries if naive.matches(text, title or "", keep_negative=True))
    built = QuerySet.build(query_df, accept_class_d=True)
    for strategy in ("broadcast", "shuffle", "brute"):
        assert pairs(built.match(title_df, "with_broad", strategy=strategy)) == want
    assert [r.query_id for r in built.rejected.collect()] == [402]
    hot = QuerySet.build(query_df, accept_class_d=True, mask=[], theta=20)
    assert pairs(hot.match(title_df, "with_broad", strategy="shuffle")) == want
    assert {r.cost_class for r in hot.rows.select("cost_class").distinct().collect()} >= {"A", "D", "H"}
    standard = pairs(built.match(title_df))
    broad = {r.query_id for r in built.rows.where("cost_class in ('C', 'D')").collect()}
    assert standard == [p for p in want if p[1] not in broad] and broad
    assert pairs(built.prefiltered(title_df).match(title_df, "with_broad")) == want


def test_lanes_bodies_and_bounds(corpus, monkeypatch):
    queries, titles, query_df, title_df = corpus
    more = query_df.unionByName(query_df.where("query_id % 3 = 0").selectExpr("query_id + 1000 as query_id", "query"))  # the same said again
    built = QuerySet.build(more, accept_class_d=True)
    want = pairs(built.match(title_df, "with_broad", strategy="brute"))
    assert pairs(built.match_bodies(title_df, "with_broad")) == want == pairs(built.match_bodies(title_df, "with_broad", strategy="shuffle"))
    ones, members = built.bodies()
    assert ones.rows.count() < built.rows.count() == members.count()
    for prefilter in (False, True):
        for lane in ("broadcast", "shuffle"):
            assert pairs(built.match_lanes(title_df, True, "shuffle", lane, prefilter)) == want
    assert pairs(built.match_lanes(title_df, False)) == pairs(built.match(title_df, "standard"))
    monkeypatch.setattr(match, "BROADCAST_BYTES", 1000)
    assert pairs(built.match(title_df, "with_broad")) == want
    with pytest.raises(ValueError, match="bytes"):
        built.match(title_df, "with_broad", strategy="broadcast")
    built.release()
    assert pairs(built.match(title_df, "standard")) == pairs(QuerySet.build(more).match(title_df, "standard"))


def test_the_signature_of_all_titles_is_dealt_out(spark):
    queries = spark.createDataFrame([(1, "-old"), (2, "lamp")], "query_id long, query string")
    titles = spark.range(2000).selectExpr("id as title_id", "if(id % 100 = 0, 'old lamp', 'lamp') as title")
    built = QuerySet.build(queries, accept_class_d=True)
    got = built.match(titles, "with_broad", strategy="shuffle")
    assert got.count() == 2000 + 1980
    only = QuerySet.build(queries.where("query_id = 2"))
    assert "salt" not in only.candidates(titles, "with_broad")._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_that_take_too_much_work_reject_nothing():
    arcs = [(0, 1, ["x"]), (1, 2, ["x"])]
    title = [("x", i, i + 1) for i in range(50)]
    assert graph_occurs(2, arcs, title, 50) is True and graph_occurs(2, arcs, title[:1], 1) is False
    assert graph_occurs(3, [*arcs, (2, 3, ["y"])], title, 50) is False
    assert graph_occurs(3, [*arcs, (2, 3, ["y"])], title, 50, most_work=20) is None
    assert graph_occurs(3, [*arcs, (2, 3, ["y"])], title, 50, most_states=20) is None
    row = lambda graph: pd.Series([[graph]])
    graph = {"positions": 3, "arcs": [{"start": s, "end": e, "alts": a} for s, e, a in [*arcs, (2, 3, ["y"])]]}
    held = [{"feature": "x", "start": i, "end": i + 1} for i in range(40_000)]
    none = pd.Series([None])
    check = match.phrases_hold.func
    assert check(row(graph), none, pd.Series([held]), pd.Series([held]), pd.Series([40_000])).tolist() == [True]
    assert check(none, row(graph), pd.Series([held]), pd.Series([held]), pd.Series([40_000])).tolist() == [True]


def test_candidates_reach_every_match(corpus):
    built = QuerySet.build(corpus[2])
    found = set(pairs(built.candidates(corpus[3], "with_broad").withColumnRenamed("row_id", "query_id")))
    assert set(pairs(built.match(corpus[3], "with_broad", strategy="brute"))) <= found


def test_vocabulary_with_phrases(spark, corpus):
    v = Vocabulary(phrases={("quill", "ridge"): ("brand:quill", False)}, equivalences=[("lantern", "lamp")])
    v.aliases.add(["kestrel bay", "kb"], "declared")
    rows = [(1, "quill ridge"), (2, "ridge"), (3, "lamp"), (4, '"kb lantern"'), (5, "bay -kb"), (6, "clock -lamp")]
    titles = [(1, "Quill Ridge lamp"), (2, "kestrel bay lantern"), (3, "bay"), (4, "kb lamp ridge"), (5, "clock lantern"), (6, "kestrel clock lantern bay")]
    built = QuerySet.build(spark.createDataFrame(rows, "query_id long, query string"), v)
    want = [(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (2, 5), (3, 5), (4, 2), (4, 3), (4, 4), (5, 3), (5, 6), (6, 3), (6, 5), (6, 6)]
    for strategy in ("broadcast", "shuffle", "brute"):
        assert pairs(built.match(spark.createDataFrame(titles, "title_id long, title string"), "with_broad", strategy=strategy)) == want


def test_classes(spark):
    rows = [(1, "hot rare"), (2, "hot"), (3, "rare"), (4, "hot warm"), (5, '"some phrase"'), (6, "(hot,x)"), (7, "(x,y)"), (8, "-x"), (9, 'hot "some phrase"')]
    built = QuerySet.build(spark.createDataFrame(rows, "query_id long, query string"), mask=["term:hot", "term:warm"], accept_class_d=True)
    got = {r.query_id: (r.cost_class, r.signatures) for r in built.rows.collect()}
    assert got[1] == ("A", ["term:rare"]) and got[2] == ("C", ["term:hot"]) and got[3] == ("A", ["term:rare"])
    assert got[4] == ("B", ["term:hot\x01term:warm"]) and got[5] == ("B", ["term:phrase", "term:some"]) and got[6] == ("C", ["term:hot", "term:x"])
    assert got[7] == ("B", ["term:x", "term:y"]) and got[8] == ("D", [""]) and got[9] == ("B", ["term:phrase", "term:some"])


def test_tags(spark):
    rows = [(1, "lantern", ["a\x01x", "b\x01y"]), (2, "lantern", ["a\x01z"]), (3, "lantern", None)]
    built = QuerySet.build(spark.createDataFrame(rows, "query_id long, query string, tags array<string>"), mask=[])
    title = spark.createDataFrame([(1, "lantern")], "title_id long, title string")
    ids = lambda tags: [q for _, q in pairs(built.match(title, tags=tags))]
    assert ids({"a": ["x", "z"]}) == [1, 2] and ids({"a": ["x"], "b": ["y"]}) == [1] and ids({"a": ["q"]}) == [] and ids({"a": []}) == [] and ids({}) == [1, 2, 3]


def test_copies_of_a_query(spark):
    rows = [(10, 1, "lantern"), (11, 1, "kettle"), (12, 2, "kettle")]
    built = QuerySet.build(spark.createDataFrame(rows, "row_id long, query_id long, query string").withColumn("generation", F.col("row_id")), mask=[])
    titles = spark.createDataFrame([(1, "lantern"), (2, "kettle lantern")], "title_id long, title string")
    assert pairs(built.match(titles)) == [(1, 1), (2, 1), (2, 2)]
    assert sorted((r.query_id, r.row_id) for r in built.newest().collect()) == [(1, 11), (2, 12)]
    stats = inspect.match_stats(built, titles).first()
    assert (stats.titles, stats.emissions, stats.matches, stats.duplicates) == (2, 4, 3, 1)


def test_explain(spark):
    built = QuerySet.build(spark.createDataFrame([(1, 'brass -old "blue lamp" (a,b)')], "query_id long, query string"), mask=[])
    titles = spark.createDataFrame([(1, "old lamp blue"), (2, "brass blue lamp a")], "title_id long, title string")
    got = {r.title_id: (r.matched, r.candidate, r.failures) for r in inspect.explain(built, titles.withColumn("query_id", F.lit(1))).collect()}
    assert got[2] == (True, True, [])
    assert got[1] == (False, False, ["missing required: term:brass", "forbidden present: term:old", "any-of groups unmet: 1", "required phrase absent"])


def test_plans(spark, corpus):
    """Short titles are not shuffled when the queries can be sent to them, and no plan of theirs runs Python."""
    built = QuerySet.build(corpus[2])
    plan = built.pairs(corpus[3], "standard", "broadcast")._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in title_views(corpus[3], Analyzer())._jdf.queryExecution().executedPlan().toString()
    assert "rightHint" in plan or "broadcast" in plan.lower()


def test_empty(spark):
    none = spark.createDataFrame([], "query_id long, query string")
    title = spark.createDataFrame([(1, "lantern")], "title_id long, title string")
    assert pairs(QuerySet.build(none).match(title, "with_broad")) == []
    assert pairs(QuerySet.build(none.union(spark.createDataFrame([(1, "x")], none.schema))).match(title.where("title_id > 1"))) == []
