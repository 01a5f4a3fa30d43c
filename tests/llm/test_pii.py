import random
import re

import numpy as np
import pytest

from tidepool.llm.pii import KINDS, STRIDE, TAGS, WINDOW, Tagger, all_spans, base_spans, find_personal_data, fitted, found_by_model, invented_text, luhn, masked, plausible, reconciled, train, training_windows, window_count, windows_to_decode

BRUTE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.findall("[0-9]", m)) <= 15),
}


def brute(text):
    found = [(m.start(), k, m.end()) for k, (pattern, good) in enumerate(BRUTE.values()) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(found)


def test_base_spans_equal_brute_force():
    rnd = random.Random(8)
    bits = ["a.b", "@", "x-1", ".", "com", " ", "+1", "(555)", "4547370017580761", "4547 3700 1758 0761", "-", "0", "12", "255", "256", "000255", "1.2.3.4", "é", "😀", "%", "\n", "٣", "+", ")"]
    for _ in range(6000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))
        assert base_spans(text) == brute(text), text
    assert base_spans("7" * 200_000 + " " + "a" * 200_000 + "@") == []


def test_gradients():
    rng = np.random.default_rng(0)
    model = Tagger(5, kind=np.float64)
    x, tags, mask = rng.integers(1, 17, (3, 7)), np.zeros((3, 7), int), np.ones((3, 7))
    tags[0, 2:5], tags[1, :2], mask[2, 5:] = [3, 4, 4], [1, 2], 0
    _, grads = model.loss(x, tags, mask)
    for name, grad in grads.items():
        at = (0, 1) if name == "move" else tuple(rng.integers(0, n) for n in grad.shape)
        kept, eps = model.p[name][at], 1e-5
        model.p[name][at] = kept + eps
        up = model.loss(x, tags, mask)[0]
        model.p[name][at] = kept - eps
        down = model.loss(x, tags, mask)[0]
        model.p[name][at] = kept
        assert abs((up - down) / (2 * eps) - grad[at]) < 1e-6


def test_decoding_takes_the_best_path_of_each_window():
    rng = np.random.default_rng(1)
    model = Tagger(4, kind=np.float64)
    x, mask = rng.integers(0, 20, (3, 4)), np.ones((3, 4))
    mask[2, 3:] = 0
    emit = model.emissions(x)

    def score(path, row, first, n):
        if first and path[0] and path[0] % 2 == 0 or any(path[n:]):
            return -1e9
        total = emit[row, 0, path[0]]
        for t in range(1, 4):
            a, b = path[t - 1], path[t]
            if b and b % 2 == 0 and a not in (b, b - 1):
                return -1e9
            total += model.p["move"][a, b] + (emit[row, t, b] if t < n else 0)
        return total

    paths = np.stack(np.meshgrid(*[range(TAGS)] * 4), -1).reshape(-1, 4).tolist()
    tags, over = model.decode(x, mask, np.array([0]))
    for row, (first, n) in enumerate([(True, 4), (False, 4), (False, 3)]):
        best = max(paths, key=lambda p: score(p, row, first, n))
        assert tags[row].tolist() == best
        assert abs(over[row].sum() - score(best, row, first, n) + score([0] * 4, row, first, n)) < 1e-9


def test_windows_overlap_by_half_and_cover_the_text():
    for length in (0, 1, 95, 96, 97, 144, 145, 500):
        n = window_count(length)
        covered = {i for k in range(n) for i in range(k * STRIDE, min(k * STRIDE + WINDOW, length))}
        assert covered == set(range(length)) and (n - 1) * STRIDE < max(1, length)
    assert windows_to_decode("x" * 100 + "1" + "y" * 100) == [1, 2]
    assert windows_to_decode("nothing here at all " * 20) == []


def test_spans_are_reconciled_over_the_whole_text():
    rnd = random.Random(4)
    for _ in range(300):
        spans = {}
        for _ in range(rnd.randrange(9)):
            s = rnd.randrange(20)
            spans[s, rnd.randrange(4), s + rnd.randint(1, 8)] = rnd.choice([-1.0, 1.0, 2.0, 3.5])
        got = reconciled(spans)
        assert all(a[2] <= b[0] for a, b in zip(got, got[1:], strict=False))

        def best(left, floor):
            return max((spans[s] + best(left[i + 1 :], s[2]) for i, s in enumerate(left) if s[0] >= floor), default=0.0) if left else 0.0

        assert sum(spans[s] for s in got) == max(0.0, best(sorted((s for s in spans if spans[s] > 0), key=lambda s: s[0]), 0))


@pytest.fixture(scope="module")
def model():
    return fitted([], 8, 16)


def test_planted_spans_that_no_rule_sees_are_found(model):
    rnd = random.Random(999)
    hit = wanted = wrong = found = 0
    for _ in range(400):
        text, spans = invented_text(rnd, ["other", "words", "Than", "those", "it", "learned"])
        base, both = all_spans(model, [text])[0]
        new = set(both) - set(base)
        want = {s for s in spans if plausible(s[1], text[s[0] : s[2]]) and not any(s[0] < b[2] and b[0] < s[2] for b in base)}
        hit, wanted, wrong, found = hit + len(want & new), wanted + len(want), wrong + len(new - want), found + len(new)
    assert hit / wanted > 0.75 and wrong / found < 0.1, (hit, wanted, wrong, found)


def test_windows_that_are_left_out_hold_nothing(model):
    rnd = random.Random(6)
    texts = [(" plain words stand here " * rnd.randrange(12) + invented_text(rnd, ["a", "dot", "at"])[0]) * rnd.randrange(3) for _ in range(40)]
    assert found_by_model(model, texts) == found_by_model(model, texts, needed=False) == found_by_model(model, texts, at_once=7)


def test_long_runs_stay_cheap(model):
    assert all_spans(model, ["7" * 100_000])[0][0] == []
    text = "1.2.3.4 " * 20_000
    base, both = all_spans(model, [text])[0]
    assert len(base) == 20_000 and set(base) <= set(both)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "mail to jo.doe@mail.example.com, or +1 (743) 555-3824", "é 10.1.2.3 x", "none here", "long " * 20_000 + "a@b.co", "4547370017580761"]
    rows = [(i, t, "a", "x") for i, t in enumerate(texts)] + [(2, texts[2], "b", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, spans string")


def test_rows_and_masking(docs):
    model = train(docs, epochs=1, hidden=4)
    got = find_personal_data(docs, model).collect()
    want = [(d, [(s, KINDS[k], e) for s, k, e in brute(t or "")]) for d, t, *_ in docs.collect()]
    assert sorted((r.doc_id, [tuple(x) for x in r.base]) for r in got) == sorted(want)
    assert all({tuple(x) for x in r.base} <= {tuple(x) for x in r.spans} for r in got)
    hidden = masked(docs, None)
    assert hidden.columns == docs.columns
    assert {r.text for r in hidden.collect() if r.doc_id in (0, 2, 3)} == {None, "mail to [EMAIL], or [PHONE]", "é [IP] x"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_personal_data(none, train(none, epochs=1, hidden=4)).collect() == []
