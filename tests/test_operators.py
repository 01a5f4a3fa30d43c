import json

import pytest
from pyspark.sql import functions as F

from tidepool.functions import columns as C
from tidepool.functions.aliases import AliasRegistry
from tidepool.functions.sql import register
from tidepool.functions.vocabulary import Vocabulary
from tidepool.operators import deliver, learn, rank
from tidepool.operators.match import QuerySet, owned
from tidepool.session import Percolator, Settings, seconds
from tidepool.sources import loader
from tidepool.sources.generate import Shape, SplitMix, generate
from tidepool.streaming import registry, stream

PROFILES = {"version": 1, "profiles": {"lin": {"kind": "linear", "intercept": -1, "weights": [{"feature": "title_tokens", "weight": 10}]}}}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_saturation(spark):
    top, bottom = C.TOP, C.BOTTOM
    rows = [(top, 1, top), (bottom, -1, bottom), (5, -7, -2), (top, bottom, -1)]
    df = frame(spark, rows, "a long, b long, c long")
    assert all(r.s == r.c for r in df.select("c", C.saturating_add(F.col("a"), F.col("b")).alias("s")).collect())
    got = [r[0] for r in frame(spark, [(top, 2), (top, -2), (bottom, 2), (3, 4)], "a long, b long").select(C.saturating_multiply(F.col("a"), F.col("b"))).collect()]
    assert got == [top, bottom, bottom, 12]


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(1, "lantern", -5, ["tier\x01silver"]), (2, "lantern", 50, ["tier\x01gold"]), (3, "lantern", 50, ["tier\x01silver"]), (4, "lantern", 0, ["tier\x01gold"]), (5, "lantern", C.TOP, ["tier\x01gold"])]
    rows = [(i, *r) for i, r in enumerate(rows)] + [(9, 2, "lantern", 75, ["tier\x01gold"])]
    df = frame(spark, rows, "row_id long, query_id long, query string, priority long, tags array<string>").withColumn("generation", F.col("row_id"))
    return QuerySet.build(df, mask=[]), frame(spark, [(1, "lantern")], "title_id long, title string")


def test_top_k(shop):
    built, titles = shop
    scores = rank.scored(built, titles, rank.RankSpec(boosts=(("tier", "gold", 1), ("tier", "gold", 100)))).cache()
    order = [(5, C.TOP), (2, 175), (4, 100), (3, 50), (1, -5)]
    assert [(r.query_id, r.score) for r in rank.top_k(scores, 3).orderBy("rank").collect()] == order[:3]
    assert [(r.query_id, r.score) for r in rank.top_k(scores, 2, (175, 2)).orderBy("rank").collect()] == order[2:4]
    assert [r.query_id for r in rank.page(scores, 1, 2).orderBy("rank").collect()] == [2, 4]
    assert rank.top_k(scores, 0).collect() == []
    assert [tuple(r) for r in rank.totals(scores, 4).collect()] == [(1, 4, "gte")] and [tuple(r) for r in rank.totals(scores, 5).collect()] == [(1, 5, "eq")]
    for bad in (lambda: rank.top_k(scores, -1), lambda: rank.check_size(10_000, 200)):
        with pytest.raises(ValueError):
            bad()


def test_profiles(shop):
    profiles = rank.load_profiles(json.dumps(PROFILES))
    built, titles = shop
    got = {r.query_id: r.score for r in rank.scored(built, titles, rank.RankSpec("lin", profiles=profiles)).collect()}
    assert got == {1: 4, 2: 84, 3: 59, 4: 9, 5: C.TOP}
    assert profiles["lin"].fingerprint() != profiles["static_v1"].fingerprint() == f"fnv1a64:{rank.fnv1a64(bytes(1)):016x}"
    told = json.loads(json.dumps(PROFILES))
    told["profiles"]["lin"]["expected_fingerprint"] = profiles["lin"].fingerprint()
    assert rank.load_profiles(json.dumps(told)) == profiles
    told["profiles"]["lin"]["intercept"] = 4
    with pytest.raises(rank.ProfileError, match="fingerprint"):
        rank.load_profiles(json.dumps(told))
    with pytest.raises(rank.ProfileError, match="unknown_rank_profile"):
        rank.RankSpec("none", profiles=profiles).score()
    with pytest.raises(rank.ProfileError, match="unsupported_rank_field"):
        rank.RankSpec(priority_field="price").score()


def leaf(v):
    return {"kind": "leaf", "value": v}


def split(left, right):
    return {"kind": "split", "feature": "title_bytes", "threshold": 3, "left": left, "right": right}


@pytest.mark.parametrize(
    "profile",
    [{"kind": "other"}, {"kind": "linear", "weights": [{"feature": "nope", "weight": 1}]}, {"kind": "linear", "weights": [{"feature": "title_bytes", "weight": 1}] * 2}, {"kind": "linear", "weights": [{"feature": "title_bytes", "weight": 1 << 64}]}]
    + [{"kind": "tree_ensemble", "trees": t} for t in ([], [{"nodes": [split(1, 1), leaf(1)]}], [{"nodes": [split(0, 1), leaf(1)]}], [{"nodes": [leaf(1), leaf(2)]}], [{"nodes": [split(1, 5), leaf(1)]}])],
)
def test_bad_profiles(profile):
    with pytest.raises(rank.ProfileError):
        rank.load_profiles(json.dumps({"version": 1, "profiles": {"x": profile}}))


def test_delivery(spark, tmp_path):
    found = frame(spark, [(1, i) for i in range(11)] + [(2, 5)], "title_id long, query_id long")
    cut = deliver.chunks(found, 4).collect()
    assert sorted((r.title_id, r.sequence, r.position, r.query_id) for r in cut) == sorted([(1, i // 4, i % 4, i) for i in range(11)] + [(2, 0, 0, 5)])
    one, other = (sorted(map(tuple, deliver.summary(x, 4).collect())) for x in (found, found.repartition(3)))
    assert one == other and [r[1:3] for r in one] == [(11, 3), (1, 1)]
    sent = []
    deliver.deliver(found, lambda t, s, rows: sent.append((t, s, len(rows))), size=4)
    assert sent == [(1, 0, 4), (1, 1, 4), (1, 2, 3), (2, 0, 1)]
    with pytest.raises(deliver.Cancelled):
        deliver.deliver(found, lambda *a: None, lambda: True)
    deliver.write_stream(found, str(tmp_path / "out"), "e", size=4)
    assert spark.read.json(str(tmp_path / "out/chunks")).count() == 4
    calls = []

    def flaky(key, payload):
        calls.append(payload)
        if len(calls) < 3:
            raise OSError

    assert deliver.publish_at_least_once(flaky, "k", b"x") == 3 and set(calls) == {b"x"}
    with pytest.raises(ZeroDivisionError):
        deliver.publish_at_least_once(lambda *a: 1 / 0, "k", b"x", 2)
    assert deliver.splitmix64(0) == SplitMix(0).next() == 0xE220A8397B1DCDAF


def test_pit_and_cursor():
    now = [0.0]
    pits, cursors = deliver.PointInTime(clock=lambda: now[0], most=2), deliver.Cursors(b"secret")
    name = pits.open("state")
    token = cursors.make(name, {"q": 1}, 7, 3)
    now[0] = 59
    assert cursors.read(token, {"q": 1}, pits) == ("state", (7, 3))
    now[0] = 110  # renewed by its use
    assert pits.touch(name) == "state"
    with pytest.raises(deliver.CursorError, match="mismatch"):
        cursors.read(token, {"q": 2}, pits)
    now[0] = 999
    with pytest.raises(deliver.CursorError, match="stale"):
        cursors.read(token, {"q": 1}, pits)
    with pytest.raises(deliver.CursorError, match="forged"):
        deliver.Cursors(b"other").read(token, {"q": 1}, pits)
    pits.open(1), pits.open(2)
    with pytest.raises(RuntimeError):
        pits.open(3)


def test_sources(spark, tmp_path):
    text = 'id,query\n1,red, (a,b)\n2,"say ""hi"""\nx,bad\n4,\n5\n99999999999999999999,big\n\n'
    good, bad = loader.load_str(spark, text)
    assert sorted(map(tuple, good.collect())) == [(1, "red, (a,b)"), (2, 'say "hi"')]
    assert sorted(r.error for r in bad.collect()) == ["empty query", "id is no 63-bit number", "id is no 63-bit number", "no comma"]
    (tmp_path / "q.ndjson").write_text('{"id": 1, "query": "a"}\nnot\n{"id": "x", "query": "b"}\n{"id": 3}\n')
    good, bad = loader.load_file(spark, str(tmp_path / "q.ndjson"))
    assert [tuple(r) for r in good.collect()] == [(1, "a")] and bad.count() == 3
    assert loader.detect("a.tsv", "{") == "csv" and loader.detect("a.txt", ' {"id"') == "jsonl" and loader.detect(None, "") == "csv"


def test_a_number_without_a_comma_is_no_header(spark):
    good, bad = loader.load_str(spark, "7\n8,red\n", "csv")
    assert [tuple(r) for r in good.collect()] == [(8, "red")]
    assert [tuple(r) for r in bad.collect()] == [(0, "no comma")]
    good, bad = loader.load_str(spark, "header\n8,red\n", "csv")
    assert good.count() == 1 and bad.count() == 0


def test_merged_parts_and_owners(spark):
    schema = "title_id long, query_id long, score long"
    parts = [frame(spark, rows, schema) for rows in ([(1, 4, 9), (1, 2, 7)], [(1, 3, 9), (2, 5, 1)], [])]
    assert sorted(tuple(r) for r in rank.merged_top_k(parts, 2).select("title_id", "query_id", "score", "rank").collect()) == [(1, 3, 9, 1), (1, 4, 9, 2), (2, 5, 1, 1)]
    with pytest.raises(Exception, match="two parts tell of query 4"):
        rank.merged_top_k([parts[0], parts[0].where("query_id = 4")], 2).collect()
    counts = [frame(spark, rows, "title_id long, value long, relation string") for rows in ([(1, 2, "eq"), (2, 3, "gte")], [(1, 1, "eq")])]
    assert sorted(tuple(r) for r in rank.merged_totals(counts, 3).collect()) == [(1, 3, "eq"), (2, 3, "gte")]
    assert sorted(tuple(r) for r in rank.merged_totals(counts, 2).collect()) == [(1, 2, "gte"), (2, 2, "gte")]
    emitted = frame(spark, [(1, [1, 2], [2, 1]), (2, [1, 2], [2, 1]), (2, [2, 3], [2]), (1, [1], [2])], "here long, placement array<long>, route array<long>")
    assert [r.here for r in owned(emitted, F.col("here"), F.col("placement"), F.col("route")).collect()] == [1, 2]


def test_bulk_bodies():
    body = '{"index":{"_id":1}}\n{"query":"a","tags":{"n":7.0,"b":true,"l":["x",null]},"shop":"s","rank_fields":{"priority":"-3"}}\n{"create":{"_id":2}}\n{"query":"b","tags":{"o":{}}}\n'
    one, two = loader.parse_bulk(body, 5)
    assert one["tags"] == ["b\x01true", "l\x01x", "n\x017.0", "priority\x01-3", "shop\x01s"] and one["priority"] == -3 and one["seq"] == 5
    assert two["error"] and two["query"] is None
    for bad in (body[:-1], body + "\n", body + '{"index":{"_id":3}}\n', '{"drop":{"_id":1}}\n{}\n'):
        with pytest.raises(loader.BodyError):
            loader.parse_bulk(bad)
    search = {"query": {"bool": {"must": {"percolate": {"document": {"title": "t"}}}, "filter": [{"term": {"a": 1}}, {"terms": {"b": ["x", "y"]}}]}}}
    assert loader.parse_search(search) == (["t"], {"a": ["1"], "b": ["x", "y"]})
    with pytest.raises(loader.BodyError):
        loader.parse_search({"query": {"match_all": {}}})


OPS = [(0, "index", 1, "a"), (1, "create", 1, "b"), (2, "index", 1, "oops -"), (3, "delete", 2, None), (4, "create", 2, "c"), (5, "insert", 2, "d"), (6, "delete", 1, None), (7, "delete", 1, None), (8, "create", 1, "e"), (9, "create", 1, "f"), (10, "insert", 3, "-x"), (11, "index", 2, "g"), (12, "insert", 2, "h")]


def brute_registry(ops):
    live, status = {}, {}
    for seq, op, query_id, text in ops:
        if op != "delete" and (text.startswith("-") or text.endswith("-")):
            status[seq] = 400
        elif op == "delete":
            status[seq] = 200 if live.pop(query_id, None) else 404
        elif op == "create" and live.get(query_id):
            status[seq] = 409
        else:
            status[seq] = 200 if op == "index" and live.get(query_id) else 201
            live[query_id] = ([] if op == "index" else live.get(query_id, [])) + [text]
    return live, status


def test_registry_equals_a_walk_through_the_log(spark):
    ops = frame(spark, [(*o, 1, [], 0) for o in OPS], registry.OPS)
    good = registry.accepted(ops).cache()
    live, status = brute_registry(OPS)
    assert sorted((r.query_id, r.query) for r in registry.live(good).collect()) == sorted((i, q) for i, qs in live.items() for q in qs)
    assert {r.seq: r.status for r in registry.outcomes(good).collect()} == status


def test_registry_on_disk(spark, tmp_path):
    p = Percolator(spark, str(tmp_path / "reg"))
    assert [x["status"] for x in p.bulk('{"index":{"_id":1}}\n{"query":"lantern -old"}\n{"create":{"_id":1}}\n{"query":"x"}\n{"index":{"_id":2}}\n{"query":"brass (lamp,lantern)","tier":"gold"}\n')] == [201, 409, 201]
    old = p.state()
    titles = p.titles(["brass lantern", "old lantern"])
    assert sorted((r.title_id, r.query_id) for r in p.match(titles, "with_broad").collect()) == [(0, 1), (0, 2)]
    assert p.put(1, "kettle - ") == 400 and p.put(1, "kettle") == 200 and p.delete(7) == 404
    assert sorted((r.title_id, r.query_id) for r in p.match(titles, "with_broad").collect()) == [(0, 2)]
    assert sorted((r.title_id, r.query_id) for r in old.match(titles, "with_broad").collect()) == [(0, 1), (0, 2)]  # a pinned state stays
    before = sorted(map(str, p.registry.rows().collect()))
    p.registry.compact()
    assert sorted(map(str, p.registry.rows().collect())) == before
    assert p.put(9, "spare") == 201 and p.delete(9) == 200
    seq = p.registry.next_seq()
    p.registry.compact()
    assert p.registry.next_seq() == seq and p.registry.get(9) is None and not p.registry.has_live(9) and p.registry.has_live(2)
    p.registry.append(frame(spark, [(seq - 2, "index", 9, "spare", 1, [], 0)], registry.OPS), replay=True)  # had already
    with pytest.raises(ValueError, match="does not continue"):
        p.registry.append(frame(spark, [(seq - 2, "index", 9, "spare", 1, [], 0)], registry.OPS))
    assert sorted(map(str, p.registry.rows().collect())) == before
    assert p.registry.segments().select("operations").first()[0] == 2
    p.registry.backup(str(tmp_path / "copy"))
    assert sorted(map(str, registry.Registry(spark, str(tmp_path / "copy")).rows().collect())) == before
    found = p.search({"query": {"bool": {"must": {"percolate": {"document": {"title": "brass lamp"}}}, "filter": {"term": {"tier": "gold"}}}}}, True).collect()
    assert [r.query_id for r in found] == [2]
    assert p.explain(2, "lamp")["failures"] == ["missing required: term:brass"] and p.health()["live"] == 2 and "tidepool_live 2" in p.metrics_text()
    assert registry.should_compact([5] * 9, 0) and registry.should_compact([10], 4) and not registry.should_compact([10], 1)
    assert registry.compaction_range([10_000, 10, 10, 10]) == (1, 4)


def test_registry_survives_a_stop_between_any_two_steps(spark, tmp_path, monkeypatch):
    class Stopped(Exception):
        pass

    reg = registry.Registry(spark, str(tmp_path / "reg"))
    assert reg.upsert(1, "lantern") == 201 and reg.upsert(2, "kettle") == 201 and reg.delete(2) == 200
    number, before = reg.publish(), sorted(map(str, reg.rows().collect()))
    steps = {"append": lambda: reg.upsert(3, "clock"), "publish": reg.publish, "compact": reg.compact}
    for name, step in steps.items():
        for at in ("_write", "_commit"):
            with monkeypatch.context() as m:
                real = registry.Registry._write

                def stop(self, *a, real=real, at=at, **k):
                    if at == "_write":  # written whole, but the writer stops then
                        real(self, *a, **k)
                    raise Stopped

                m.setattr(registry.Registry, at, stop)
                with pytest.raises(Stopped):
                    step()
            other = registry.Registry(spark, reg.path)
            assert sorted(map(str, other.rows().collect())) == before, (name, at)
            assert other.states() == [number] and other.snapshot().rows.count() == 1 and other.next_seq() == 3
    assert reg.upsert(3, "clock") == 201 and reg.publish() == number + 1 and reg.snapshot().rows.count() == 2
    reg.compact()
    after = sorted(map(str, reg.rows().collect()))
    assert reg.vacuum() > 4 and sorted(map(str, reg.rows().collect())) == after and reg.snapshot().rows.count() == 2
    assert reg.next_seq() == 4 and reg.create(2, "again") == 201


def test_of_two_writers_one_is_told(spark, tmp_path):
    one, two = (registry.Registry(spark, str(tmp_path / "reg")) for _ in range(2))
    old = one.manifest()
    one.upsert(1, "lantern")
    with pytest.raises(registry.Conflict):
        two._commit(old, next_seq=99)
    assert two.upsert(1, "kettle") == 200 and [r.query for r in one.rows().collect()] == ["kettle"] and one.next_seq() == 2


def test_the_hot_features_are_those_of_the_first_state_with_rows(spark, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    reg.set_vocabulary(Vocabulary(synonyms={"lamp": "term:light"}))
    assert reg.manifest()["mask"] is None
    reg.build(frame(spark, [(i, "lantern") for i in range(3)], "query_id long, query string"))
    reg.publish()
    assert reg.manifest()["mask"] == ["term:lantern"] and {r.cost_class for r in reg.snapshot().rows.collect()} == {"C"}
    reg.upsert(9, "kettle")
    reg.publish()
    assert reg.manifest()["mask"] == ["term:lantern"]  # frozen


def test_pages_over_a_pinned_state(spark, tmp_path):
    p = Percolator(spark, str(tmp_path / "reg"))
    p.bulk("".join(f'{{"index":{{"_id":{i}}}}}\n{{"query":"lantern","rank_fields":{{"priority":{i % 4}}}}}\n' for i in range(11)))
    once = [(r.query_id, r.score) for r in p.top(p.titles(["brass lantern"]), 100, scope="with_broad").orderBy("rank").collect()]
    pit = p.open_pit()
    p.put(50, "lantern")
    pages, cursor = [], None
    while True:
        rows, cursor = p.ranked_page("brass lantern", 4, None if cursor else pit, cursor, scope="with_broad")
        pages += [(r.query_id, r.score) for r in rows]
        if cursor is None:
            break
    assert pages == once and len(once) == 11
    _, cursor = p.ranked_page("brass lantern", 4, pit, scope="with_broad")
    with pytest.raises(deliver.CursorError, match="mismatch"):
        p.ranked_page("brass lantern", 5, cursor=cursor, scope="with_broad")
    p.pits.close(pit)
    with pytest.raises(deliver.CursorError, match="stale"):
        p.ranked_page("brass lantern", 4, cursor=cursor, scope="with_broad")
    assert p.match(p.titles(["lantern"]), "with_broad").count() == 12
    assert p.health()["status"] == "green" and p.put(51, "x") == 201 and p.health()["status"] == "yellow"
    with pytest.raises(ValueError):
        p.batch_top(p.titles(["a"] * 200), 10_000)
    assert p.batch_top(p.titles(["lantern", "x"]), 1, scope="with_broad").count() == 2


def test_jobs_and_deadlines(spark, tmp_path):
    jobs = deliver.Jobs(most=3)

    def slow(cancelled):
        return spark.range(0, 400, 1, 400).rdd.map(lambda x: __import__("time").sleep(0.2)).count()

    assert jobs.create("a", spark, lambda cancelled: 7)["id"] == "a" and jobs.wait("a", 30)["status"] == "completed"
    assert jobs.create("a", spark, lambda cancelled: 8)["status"] == "completed" and jobs.result("a") == 7
    with pytest.raises(RuntimeError, match="handed out"):
        jobs.result("a")
    jobs.create("b", spark, slow)
    with pytest.raises(RuntimeError, match="running"):
        jobs.delete("b")
    jobs.cancel("b", spark)
    assert jobs.wait("b", 60)["status"] == "cancelled"
    jobs.create("c", spark, lambda cancelled: 1 / 0)
    assert jobs.wait("c", 30)["status"] == "failed" and "zero" in jobs.status("c")["error"]
    with pytest.raises(RuntimeError, match="too many"):
        jobs.create("d", spark, slow)
    assert jobs.delete("b")["status"] == "cancelled"
    assert deliver.within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(deliver.DeadlineError):
        deliver.within(spark, 1, lambda: slow(None))
    p = Percolator(spark, str(tmp_path / "reg"))
    p.put(1, "lantern")
    assert [tuple(r) for r in p.match_within(p.titles(["lantern"]), 60, "with_broad")] == [(0, 1)]
    p.start_delivery("e", p.titles(["lantern", "x"]), str(tmp_path / "out"))
    assert p.jobs.wait("e", 60)["status"] == "completed" and spark.read.json(str(tmp_path / "out/chunks")).count() == 1


def test_alias_governance(spark, tmp_path):
    p = Percolator(spark, str(tmp_path / "reg"))
    rows = ["(colour,colours) x", "(colours,colour)", "(colour,colours)", "colours chart", "old chart"]
    p.bulk("".join(f'{{"index":{{"_id":{i}}}}}\n{{"query":"{q}"}}\n' for i, q in enumerate(rows)))
    titles = p.titles(["colour chart"])
    assert [r.query_id for r in p.match(titles, "with_broad").orderBy("query_id").collect()] == [1, 2]
    assert p.learn_aliases() == 1
    assert [r.query_id for r in p.match(titles, "with_broad").orderBy("query_id").collect()] == [1, 2, 3]
    assert p.import_solr("aged, old") == 1
    assert [r.query_id for r in p.match(p.titles(["aged chart"]), "with_broad").collect()] == [4]
    p.registry.vocabulary.aliases.add(("gear", "cog"), "distributional", 0.7)
    p.put(10, "box"), p.put(11, "box oak")
    p.observe(frame(spark, [(1, "gear box oak"), (2, "cog box"), (3, "cog box oak")], "title_id long, title string"))
    p.observe(frame(spark, [(4, "gear box"), (5, "gear cog")], "title_id long, title string"))
    (row,) = p.alias_feedback(0.5, 2, 2)
    assert row == {"a": "cog", "b": "gear", "titles_a": 2, "titles_b": 2, "titles_both": 1, "sampled_a": 2, "sampled_b": 2, "excluded": 0, "overlap": 1.0, "validated": True}
    assert p.apply_feedback(True, min_titles=2, min_queries=2) == (1, 1)
    assert p.registry.vocabulary.aliases.entries["cog", "gear"].status == "active" and p.apply_feedback(True) == (1, 0)  # known, and active already


def test_sketches_of_batches_merge_as_one(spark, monkeypatch):
    monkeypatch.setattr(learn, "RAW", 12), monkeypatch.setattr(learn, "SAMPLE", 8)
    titles = frame(spark, [(i, f"{'ny' if i % 2 else 'new york'} loft {i}") for i in range(40)], "title_id long, title string")
    matches = frame(spark, [(i, q) for i in range(40) for q in range(i % 7, 60, 7)], "title_id long, query_id long")
    queries = frame(spark, [(q, "ny flat" if q % 5 == 0 else "loft") for q in range(55)], "query_id long, query string")
    pairs = [("ny", "new york")]
    whole = learn.observe(titles, matches, pairs)
    parts = None
    for k in range(4):
        parts = learn.merged(parts, learn.observe(titles.where(f"title_id % 4 = {k}"), matches, pairs))
    for one, other in zip(whole, parts, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    (row,) = learn.report(parts, queries, pairs, 0.1, 5, 2).collect()
    sides = [sorted(r.hash for r in whole[1].where(f"side = '{x}'").join(queries.where("query_id % 5 <> 0"), "query_id").collect())[:8] for x in "ab"]
    union = sorted(set(sides[0]) | set(sides[1]))[:8]
    assert abs(row.overlap - len([h for h in union if h in sides[0] and h in sides[1]]) / len(union)) < 1e-12
    assert (row.titles_a, row.titles_b, row.titles_both) == (20, 20, 0) and row.sampled_a == len(sides[0])


def test_glued_pairs_share_no_word(spark):
    things = ["loft", "flat", "house", "yard", "shop", "barn"]
    texts = [f"{city} {x}" for x in things for city in ("new york", "new york", "ny", "old york", "ny", "old york")] + ["pear", "plum"] * 40
    queries = frame(spark, list(enumerate(texts)), "query_id long, query string")
    plain, glued = (learn.discover_pairs(queries, min_count=6, similarity=0.3, together=0.2, tau=0.2, glue=g).collect() for g in (False, True))
    assert ("new_york", "ny") in {(r.a, r.b) for r in glued} and not any("_" in r.a + r.b for r in plain)
    assert all(not set(r.a.split("_")) & set(r.b.split("_")) for r in glued)


def test_bulk_lines_equal_a_bulk_body(spark, tmp_path):
    body = "".join(f'{{"{"index" if i % 2 else "create"}":{{"_id":{i}}}}}\n{{"query":"q {i}","tags":{{"n":{i}.50}},"shop":"s"{"" if i % 5 else ",x"}}}\n' for i in range(300))
    (tmp_path / "b.ndjson").write_text(body)
    got = sorted((r.asDict() for r in loader.load_bulk(spark, str(tmp_path / "b.ndjson"), 7).collect()), key=lambda r: r["seq"])
    assert got == loader.parse_bulk(body, 7) and sum(r["error"] is not None for r in got) == 60
    with pytest.raises(Exception, match="without a partner"):
        loader.parse_bulk_lines(frame(spark, [(0, '{"index":{"_id":1}}')], "line_no long, value string")).collect()


def test_sources_within_a_budget(spark):
    hits, kept = frame(spark, [(1, 1)], "title_id long, query_id long"), frame(spark, [(1, "x" * 100)], "query_id long, query string")
    assert rank.fetch_sources(hits, kept).first()._source.query == "x" * 100
    with pytest.raises(rank.TooLarge):
        rank.fetch_sources(hits, kept, most=50)


def test_all_that_is_learned_is_kept(spark):
    groups = spark.range(2 * 10_001).selectExpr("id AS query_id", "concat('(a', id div 2, ',b', id div 2, ')') AS query")
    assert len(learn.learn_vocabulary(groups, equivalences=True).equivalences) == 10_001
    assert len(learn.learn_vocabulary(groups).synonyms) == 10_001
    texts = spark.range(3 * 10_001).selectExpr("id AS query_id", "concat('a', id div 3, ' b', id div 3) AS query")
    assert len(learn.learn_phrases(texts, iterations=1, column="query", id_column="query_id")) == 10_001
    with pytest.raises(ValueError):
        learn.learn_vocabulary(groups.limit(40), min_count=1, equivalences=True, most=3)


def test_aliases_from_groups_and_pairs(spark):
    rows = [(i, q) for i, q in enumerate(["(colour,colours) x", "(colours,colour)", "(colour,colours)", "(red,scarlet)", "(red,scarlet) y", "(once,twice)"])]
    aliases = AliasRegistry()
    queries = frame(spark, rows, "query_id long, query string")
    assert learn.learn_aliases(queries, aliases) == 1 and learn.learn_aliases(queries, aliases) == 0
    got = {k: (a.provenance, a.status, a.confidence) for k, a in aliases.entries.items()}
    assert got == {("colour", "colours"): ("learned", "active", 0.6), ("red", "scarlet"): ("learned", "candidate", 0.5)}
    aliases.add(("up", "down"), "distributional")
    aliases.reject(("up", "down"))
    pairs = frame(spark, [("down", "up", 0.9), ("red", "scarlet", 1.5), ("gear", "cog", float("nan"))], "a string, b string, similarity double")
    assert learn.record_candidates(pairs, aliases) == (1, 1, 1)
    assert [(aliases.entries[k].status, aliases.entries[k].confidence) for k in (("cog", "gear"), ("red", "scarlet"), ("down", "up"))] == [("candidate", 0.0), ("candidate", 1.0), ("rejected", 0.9)]


def test_learning(spark):
    rows = [(i, q) for i, q in enumerate(["(tv,television) set", "(television,tv)", "red lamp shade", "red lamp shade old", "red lamp oil", "(ny,new york)", "x (new york,ny)"])]
    v = learn.learn_vocabulary(frame(spark, rows, "query_id long, query string"), phrases=True, npmi_min=3)
    assert v.synonyms["tv"] == "term:television" and v.synonyms["ny"] == "term:new_york"
    assert v.phrases[("red", "lamp")] == ("term:red_lamp", True)
    w = learn.learn_vocabulary(frame(spark, rows, "query_id long, query string"), equivalences=True)
    assert ("television", "tv") in w.equivalences
    glued = frame(spark, [(["a", "b", "c", "a", "b"],)], "w array<string>").select(learn.glued(F.col("w"), F.array(F.lit("a_b"), F.lit("b_c"))))
    assert glued.first()[0] == ["a_b", "c", "a_b"]
    titles = frame(spark, [(1, "ny loft"), (2, "new york loft"), (3, "ny new york")], "title_id long, title string")
    matches = frame(spark, [(1, 10), (2, 10), (2, 11), (1, 12)], "title_id long, query_id long")
    row = learn.feedback(titles, matches, [("ny", "new york")], frame(spark, [(12, "ny loft"), (10, "loft"), (11, "loft")], "query_id long, query string")).first()
    assert (row.titles_a, row.titles_b, row.titles_both, row.queries_sampled, row.overlap) == (1, 1, 1, 2, 0.5)


def test_streams(spark, tmp_path):
    built = QuerySet.build(frame(spark, [(1, "lantern"), (2, "brass lantern")], "query_id long, query string"), mask=[])
    rows = [(1, "brass lantern", "2024-01-01 00:10:00"), (2, "lantern", "2024-01-01 01:10:00"), (3, "x", "2024-01-01 01:20:00")]
    titles = frame(spark, rows, "title_id long, title string, ts string").withColumn("ts", F.to_timestamp("ts"))
    titles.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(titles.schema).parquet(str(tmp_path / "in"))
    q = stream.percolate_stream(live, built).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.title_id, r.query_id) for r in spark.table("hits").collect()) == [(1, 1), (1, 2), (2, 1)]
    got = []
    q = stream.percolate_batches(live, lambda: built, lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.title_id, r.query_id) for r in got) == [(1, 1), (1, 2), (2, 1)]
    reg = registry.Registry(spark, str(tmp_path / "reg"))
    ops = frame(spark, [(0, "index", 1, "a", 1, [], 0), (1, "index", 1, "b", 1, [], 0)], registry.OPS)
    ops.write.parquet(str(tmp_path / "ops"))
    for n in (3, 4):  # the second run brings the same operations again
        q = stream.apply_operations(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops")), reg).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.query for r in reg.rows().collect()] == ["b"] and reg.ops().count() == 2


def test_settings_generator_and_sql(spark):
    assert Settings().updated({"theta": 5}).theta == 5 and seconds("250ms") == 0.25
    for bad in ({"theta": "5"}, {"none": 1}):
        with pytest.raises(ValueError):
            Settings().updated(bad)
    assert generate(Shape(50, 10)) == generate(Shape(50, 10)) and len(generate(Shape(50, 10))[0]) == 50
    register(spark)
    assert spark.sql("SELECT percolates('red -old', 'red lamp') a, title_features('Red 1999') b, dsl_error('x - y') c").first()[:] == (True, ["term:red", "year:1999"], "TrailingDash at 2")
    assert [r.query_id for r in spark.sql("""SELECT query_id FROM percolate('red lamp', '{"1": "lamp", "2": "old", "3": "-old red"}') ORDER BY 1""").collect()] == [1, 3]
