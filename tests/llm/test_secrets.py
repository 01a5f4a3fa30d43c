import random
import re

from pyspark.sql import functions as F

from tidepool.llm import secrets
from tidepool.llm.secrets import RULES, Rule, look_up, number, secret_scan, trigram_query, write_index

BRUTE = {
    "assign": (re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, (pattern, good)) in enumerate(BRUTE.items()) for m in pattern.finditer(text or "") if good(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_trigram_queries():
    assign, access, none = (trigram_query(r.pattern) for r in RULES)
    assert frozenset({"sec", "ecr", "cre", "ret"}) in assign and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in assign
    assert len(assign) == 6
    assert access == {frozenset({"aki", "kia"})}
    assert none is None
    assert trigram_query("(abc|de)f+ghij") == {frozenset({"ghi", "hij"})}
    assert trigram_query("x?y?") is None


def test_spans_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef0123", "AKIA", "ABCDEFGH12345678", "é😀", "\x01", "\x02", "\n", "$0", "\\1", "xy.z/", "K", "K"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(1200)]
    texts += [None, "", "secret=token:abcdefghijklmnop", "f" * 50_000 + " " + "secret = '" + "x" * 40_000, "password: short token=abcdefghijkl"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(5, texts[5], "a", 2), (6, "secret=abcdefghijklm", "a", 2), (None, "token=abcdefghijklm", "a", 2)]
    want = sorted(((d, brute(t)) for d, t, *_ in rows), key=str)
    for few in (100_000, 0):
        monkeypatch.setattr(secrets, "BROADCAST_ROWS", few)
        got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string, rules string, low int")).collect()
        assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=str) == want


def test_posting_lists_are_intersected(spark):
    texts = ["a secret here", "sec cre", "PASSWORD", "AKIA1", "aki kia", "", "ecr ret sec cre", "the token"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = {r.kind: q for r in RULES if (q := trigram_query(r.pattern))}
    trigrams = sorted(set().union(*(t for q in queries.values() for t in q)))
    index = write_index(docs, trigrams, 1 << 40)
    lists = {r.trigram: r.n for r in index.groupBy("trigram").agg(F.sum(F.size("list")).alias("n")).collect()}
    assert lists == {t: n for t in trigrams if (n := sum(t in x.lower() for x in texts))}
    assert sorted(r.trigram for r in index.select("trigram").distinct().collect()) == sorted(lists)
    got = {r.number: sorted(r.rules) for r in look_up(index, queries).collect()}
    numbers = {r.doc_id: r.n for r in docs.select("doc_id", number(F.col("doc_id"), 1 << 40).alias("n")).collect()}
    want = {}
    for doc_id, text in enumerate(texts):
        rules = sorted(k for k, q in queries.items() if any(all(t in text.lower() for t in a) for a in q))
        if rules:
            want[numbers[doc_id]] = rules
    assert got == want


def test_very_many_matches_in_one_text(spark):
    text = "0123456789abcdef " * 30_000
    (row,) = secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(s) for s in row.spans] == brute(text)


def test_only_rules_without_trigrams_and_an_empty_table(spark):
    rules = (Rule("hex", "[0-9a-f]{4,}", 4),)
    df = spark.createDataFrame([(1, "zz beef")], "doc_id long, text string")
    assert [tuple(s) for s in secret_scan(df, rules).first().spans] == [("hex", 3, 7)]
    assert secret_scan(df.where("doc_id = 2")).collect() == []
