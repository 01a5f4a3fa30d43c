import random

import pytest

from tests import naive
from tidepool.functions.aliases import AliasRegistry, SynonymFileError, classify, parse_solr
from tidepool.functions.analysis import Analyzer, Phrase, clean, graph_occurs
from tidepool.functions.dsl import Limits, QueryError, parse
from tidepool.functions.sql import matches
from tidepool.functions.vocabulary import Vocabulary, VocabularyError
from tidepool.plans.lowering import compile_query, explain_compiled


def ok(query, title, vocabulary=None):
    return matches(query, title, vocabulary or Vocabulary())


@pytest.mark.parametrize(
    ("query", "kind", "pos"),
    [("foo - bar", "TrailingDash", 4), ("product gamma -", "TrailingDash", 14), ("product gamma ()", "EmptyAnyOfGroup", 14), ('a "b', "UnclosedQuote", 2), ("(a", "UnclosedGroup", 0), ("a" * 10_241, "QueryTooLong", 0), ("a " * 257, "TooManyClauses", 0), (f"({','.join('abcdefghijklm' * 5)})", "AnyOfGroupTooLarge", 0)],
)
def test_errors(query, kind, pos):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert (e.value.kind, e.value.pos) == (kind, pos)


def test_clauses():
    got = parse('a-b,c --x "p  q" -(r s, ,t)é')
    assert [(c.kind, c.negated, c.text, c.members) for c in got] == [("term", False, "a-b,c", ()), ("term", True, "-x", ()), ("phrase", False, "p  q", ()), ("anyof", True, "", ("r s", "t")), ("term", False, "é", ())]
    assert parse("") == [] and len(parse("a a", Limits(clauses=2))) == 2


CASES = [
    ("foo -bar", "foo baz", "foo bar"),
    ("widget #2", "widget #2", "widget 2002"),
    ("widget /1999", "widget /1999", "widget 1999"),
    ("widget", "widget # 2", "gadget"),
    ("jalapeno", "JALAPEÑO", "product gamma"),
    ("9.5", "widget 9.5", "widget 9 5"),
    ("(red,blue) car", "blue car", "green car"),
    ("(north star,ns)", "star north", "north"),
    ("marker -(red shoe,boot)", "marker red hat", "marker red shoe"),
    ('"red shoe" marker', "red-shoe marker", "red leather shoe marker"),
    ('marker -"for parts"', "marker parts for", "marker for parts"),
    ("1899", "1899", "1900"),
    ("2099", "x 2099", "2100"),
    ("new -used york", "new something york", "new used york"),
    ('vintage (leather,suede) "bomber jacket" (brown,tan) -womens', "Vintage tan LEATHER bomber  jacket", "vintage tan leather bomber jacket womens"),
]


@pytest.mark.parametrize(("query", "yes", "no"), CASES)
def test_truth_table(query, yes, no):
    assert ok(query, yes) and not ok(query, no)
    assert naive.matches(query, yes) and not naive.matches(query, no)


def test_number_context_and_punctuation():
    v = Vocabulary(number_context=["model"], punctuation={"+": "keep", "'": "fold", "&": "marker"})
    assert ok("model 1995", "model 1995", v) and not ok("model 1995", "1995 model", v) and ok("1995 widget", "1995 widget", v)
    assert clean("C++ it's a&b", v.punctuation).split() == ["c++", "its", "a", "&", "b"]


def test_phrase_modes():
    collapse = Vocabulary(phrases={("new", "york"): ("term:nyc", False)})
    assert ok("new york", "New York city", collapse) and not ok("york", "new york", collapse) and ok("york", "york new", collapse)
    assert not ok("new york", "new  york", collapse)  # flat titles keep their blanks
    additive = Vocabulary(phrases={("new", "york"): ("term:nyc", True)})
    assert ok("york", "new york", additive)
    longest = Analyzer(phrases=[Phrase(("a", "b"), "term:ab"), Phrase(("a", "b", "c"), "term:abc")])
    assert longest.features("a b c a b") == ["term:ab", "term:abc"]


def test_aliases_and_equivalences():
    v = Vocabulary()
    v.aliases.add(["new york", "ny"], "declared", analyzer=Analyzer())
    assert ok('"new york" inventory', "ny inventory", v) and not ok('"new york" inventory', "new vintage york inventory", v)
    assert ok("york", "new york", v)
    w = Vocabulary(equivalences=[("pkg", "new")])
    assert ok("1994 vertex pkg", "1994 vertex new pro", w) and not ok("1994 vertex pkg", "1994 vertex new pro")
    assert not ok("vertex -pkg", "vertex pkg", w) and ok("vertex -pkg", "vertex new", w)
    assert v.equivalence_classes() == {"term:new_york": ("term:new_york", "term:ny"), "term:ny": ("term:new_york", "term:ny")}


def test_graphs():
    arcs = [(0, 2, ["x"]), (0, 1, ["a"]), (1, 2, ["b", "c"])]
    assert graph_occurs(2, arcs, [("q", 0, 1), ("a", 1, 2), ("c", 2, 3)], 3)
    assert graph_occurs(2, arcs, [("x", 1, 2)], 2)
    assert not graph_occurs(2, arcs, [("a", 0, 1), ("b", 2, 3)], 3)
    assert not graph_occurs(0, [], [], 0)


def test_engine_and_naive_matcher_agree():
    rnd = random.Random(6)
    bits = ["red", "bolt", "BLUE", "gear", "1999", "#", "/", "2.5", "é", "č", "ß", "-", "  ", ",", "18", "x.y"]
    for _ in range(4000):
        title = " ".join(rnd.choice(bits) for _ in range(rnd.randrange(8)))
        query = "".join(rnd.choice([*bits, " ", " ", "(", ")", '"', " -", "red bolt", '"red bolt"', "(red,blue gear)", '-"gear 1999"']) + rnd.choice(["", " "]) for _ in range(rnd.randrange(7)))
        try:
            got = ok(query, title) and not compile_query(query, Analyzer()).class_d
        except QueryError:
            got = False
        assert got == naive.matches(query, title), (query, title)


def test_compiled_counts():
    c = compile_query('red bolt (a b,c) "x y z" -q -(m n) -"o p"', Analyzer())
    assert (c.n_positive_terms, c.n_negative_terms, c.n_anyof_groups) == (6, 5, 1)
    assert c.required == ["term:bolt", "term:red"] and "forbidden: term:q" in explain_compiled("a -q", Analyzer())
    assert compile_query("(a,A)", Analyzer()).required == ["term:a"]
    assert compile_query('"" (!!,?)', Analyzer()).class_d


def test_vocabulary_json_and_merge(tmp_path):
    v = Vocabulary({"hue": "term:color"}, {("a", "b"): ("term:ab", True)}, [("x", "y")], {"+": "keep"}, ["no"])
    v.aliases.add(["tv", "television"], "learned", 0.7)
    v.save(str(tmp_path / "v.json"))
    assert Vocabulary.load(str(tmp_path / "v.json")) == v
    with pytest.raises(VocabularyError):
        Vocabulary.from_json('{"synonym": []}')
    merged = Vocabulary({"hue": "term:shade"}).merge(v)
    assert merged.synonyms == {"hue": "term:shade"} and merged.number_context == ["no"] and merged.phrases == v.phrases


def test_alias_registry():
    r = AliasRegistry()
    assert r.add(["grey", "greyish"], "learned").status == "active" and r.add(["tv", "telly set"], "learned").status == "candidate"
    assert r.add(["a"], "declared") is None
    r.reject(["grey", "greyish"])
    assert r.add(["greyish", "grey"], "declared").status == "rejected"
    r.add(["red", "blue"], "distributional", 0.8)
    r.record_feedback(["blue", "red"], 0.6, 60, 70, 25)
    assert [a.forms for a in r.activate_validated()] == [("blue", "red")]
    assert classify(["1999", "old"], Analyzer()) == "mixed_kind" and classify(["colour", "color"]) == "single_token_variant"
    assert AliasRegistry.from_dict(r.to_dict()).entries == r.entries


def test_solr():
    assert parse_solr("# c\nny, new york\n\na\\,b => c # d\n") == [("new york", "ny"), ("a,b", "c # d")]
    for bad, line in (("a,b\nalone", 2), ("a => b => c", 1), ("x\\", 1)):
        with pytest.raises(SynonymFileError) as e:
            parse_solr(bad)
        assert e.value.line == line
