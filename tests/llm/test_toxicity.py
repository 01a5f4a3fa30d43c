import random
from itertools import product

import numpy as np
import pytest

from tidepool.llm.toxicity import LETTERS, Language, Model, cheapest, decode, features_of, held_out, lattice, letter, letter_counts, regress, restore, scores, spaced_lattice, train

WORDS = "the river stone walks under morning light idiot moron stupid garden open window slow train reads paper".split()


def text_of(rnd, n, bad=()):
    out = [rnd.choice(WORDS[:6] + WORDS[9:]) for _ in range(n)]
    for b in bad:
        out[rnd.randrange(n)] = b
    return " ".join(out)


@pytest.fixture(scope="module")
def language():
    return Language(letter_counts([" ".join(WORDS) + " "] * 50))


def test_counts():
    texts = ["ab cAb", "", "é1 x"]
    want = np.zeros(LETTERS**3, int)
    codes = [letter(" " if c.isspace() else c) for c in "  " + "  ".join(texts).lower() + "  "]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        want[a * LETTERS**2 + b * LETTERS + c] += 1
    assert letter_counts(texts).tolist() == want.tolist()
    split = letter_counts(texts, at_once=1)
    split[0] = want[0]  # blanks alone, which no word holds, depend on the split
    assert split.tolist() == want.tolist()
    assert letter_counts([]).sum() == 0


def test_viterbi_equals_all_paths(language):
    cases = [(lattice(w), decode(w, language)) for w in ("1d10t", "st00pppid", "m0r0n", "4$")]
    cases += [(spaced_lattice(r), cheapest(spaced_lattice(r), language)) for r in ("s l o w", "i d 1 0 t  a", "r.e.a.d s", "t t t h e")]
    for places, got in cases:
        best = None
        for path in product(*places):
            total, a, b = sum(c for _, c in path), 0, 0
            for c in "".join(x for x, _ in path) + " ":
                total, a, b = total + language.cost[a][b][letter(c)], b, letter(c)
            best = min(best or (9e9, ""), (total, "".join(x for x, _ in path)))
        assert got == best[1]


def test_disguises(language):
    assert restore("You 1d10t, m0r0n! sTuuuupid s t u p i d  m.o.r.o.n", language) == "you idiot, moron! stupid stupid moron"  # a gap between words is one blank
    clean = "the 12 rivers, 4.0 and 2024-01-02 cost 5 $ or +1 (743) 555-3824 i a m"
    assert restore(clean, language).startswith("the 12 rivers, 4.0 and 2024-01-02 cost 5 $ or +1 (743) 555-3824")
    assert restore("", language) == ""


def test_spaced_letters_become_words(language):
    assert restore("s  t  u  p  i  d", language) == "stupid" == restore("s\tt\tu\tp\ti\td", language)
    assert restore("you s t u p i d   m o r o n", language) == "you stupid moron"
    assert restore("1 d 1 0 t", language) == "idiot" and restore("s t u u u u p i d", language) == "stupid"
    assert restore("d é b i l", language) == "débil"
    assert restore("1 2 3 4 5", language) == "1 2 3 4 5"
    assert restore("m o r o n " * 700, language).count("moron") > 600  # as long as it gets


def test_a_score_is_what_its_definition_says(spark, language):
    texts = ["You 1d10t, s t u p i d m0r0n", "the garden", "", None, "idiot/garden/moron idiot", "idiot " * 3000]
    model = Model(language, {"=idiot": 2.5, "idio": -0.5, "^stup": 1.25, "moron": 0.75, "=garden": -2.0}, -0.4)
    got = {r.doc_id: r.score for r in scores(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    for k, text in enumerate(texts):
        held = {f for w in restore(text or "", language).split() for f in features_of(w)}
        assert abs(got[k] - 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0) for f in held))))) < 1e-12


def test_regression_separates():
    rows = [[0, 2], [0], [0, 3], [1, 2], [1], [1, 3]] * 20
    w, b = regress(rows, np.array([1, 1, 1, 0, 0, 0] * 20, float), 4, {0: 1.0, 1: 1.0})
    assert w[0] + b > 1 and w[1] + b < -1 and abs(w[2]) < 1 and abs(w[3]) < 1


def test_features():
    assert features_of("it") == [] and "=river" in features_of("river,") and "^riv" in features_of("River".lower())


def test_long_disguises(language):
    assert restore("stu" + "u" * 70 + "pid", language) == "stupid"
    for mark in "./_":
        phrase = mark.join(["stone"] * 12)
        assert restore(f"{phrase}{mark}1d10t{mark}m0r0n", language) == f"{phrase}{mark}idiot{mark}moron"


def test_features_of_every_letter():
    run = "/".join(["river"] * 9 + ["idiot"])
    assert "idiot" in features_of(run) and "idio" in features_of("河" * 5000 + "idiot")
    assert len(max(features_of("河" * 5000), key=len)) < 80  # names stay short
    assert set(features_of("a" * 45 + "b")).isdisjoint(f for f in features_of("a" * 45 + "c") if f.startswith("="))


def corpus(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        bad = rnd.sample(["idiot", "moron", "stupid", "1d10t", "m0r0n", "stuuupid"], 2) if toxic else ()
        rows.append((i, text_of(rnd, 30, bad), 0.5, "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, 0.5, "x"), (9001, "", 0.5, "x"), (9002, "long " * 50_000, 0.5, "x"), (5, rows[5][1], 0.1, "y"), (None, "idiot moron", 0.1, "y")]
    labels += [(5, 0, None), (None, 0, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_rows(spark):
    docs, labels = corpus(spark)
    model = train(docs, labels, ~held_out(), features=400)
    got = scores(docs.withColumn("held_out", held_out()), model).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    apart = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(apart) > 60
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in apart) / len(apart) > 0.95
    assert {r.score >= 0.5 for r in got if r.doc_id in (9000, 9001, 9002)} == {False}
    assert next(r.score for r in got if r.doc_id is None) >= 0.5


def test_toxic_words_late_in_an_unbroken_run(spark):
    docs, labels = corpus(spark)
    model = train(docs, labels, ~held_out(), features=400)
    runs = [(1, "/".join(["garden"] * 9 + ["idiot", "moron"])), (2, "/".join(["garden"] * 11))]
    got = {r.doc_id: r.score for r in scores(spark.createDataFrame(runs, "doc_id long, text string"), model).collect()}
    assert got[1] >= 0.5 > got[2]


def test_labels_that_are_held_out_have_no_effect(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    one, two = (train(docs, x, ~held_out(), features=100) for x in (labels, turned))
    assert one.weights == two.weights and one.bias == two.bias


def test_no_labels_and_an_empty_table(spark):
    docs, labels = corpus(spark)
    model = train(docs, labels.where("toxic > 1"), ~held_out())
    assert {r.score for r in scores(docs.limit(3), model).collect()} == {0.5}
    none = docs.where("doc_id < 0")
    assert scores(none, train(none, labels.where("toxic > 1"), ~held_out())).collect() == []
