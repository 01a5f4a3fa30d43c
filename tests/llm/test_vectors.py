import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm.ann import nearest, probe_sets
from tidepool.llm.topk import LOWEST, ball_tree, exact_top_k, products, rounds, search_tree

NAN, INF = float("nan"), float("inf")


def rows_of(n, dim, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)]  # a common vector, and so ties
    odd = [(2000, None), (2001, []), (2002, [NAN] * dim), (2003, [INF] + [0.0] * (dim - 1)), (2004, [None] + [1.0] * (dim - 1)), (None, rows[1][1]), (2010, [1.0, 2.0])]
    return rows, rows + odd + [(2020, [0.0] * dim), rows[3]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 9, 1.5) for i, v in rows], "vec_id long, embedding array<double>, id int, score double")


def brute(vectors, is_query, k):
    """(query id, rank, id, score) by all pairs; every row counts, and each query row is ranked by itself."""
    out = []
    for q, v in vectors:
        if is_query(q):
            best = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(v) == len(w))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def whole_of(rows):
    return [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]


@pytest.mark.parametrize(("shard", "wave"), [(3000, 1000), (1 << 20, 1 << 20)])
def test_exact_top_k_equals_brute_force(spark, shard, wave):
    rows, all_rows = rows_of(300, 5, 1)
    extra = [(10, [9.0, 0.0, 1.0, 0.0, 0.0]), (11, [8.0, 1.0, 0.0, 0.0, 0.0]), (11, [8.0, 1.0, 0.0, 0.0, 0.0])]  # ids that occur again
    got = exact_top_k(frame(spark, all_rows + extra), F.col("id") % 10 == 0, 6, shard=shard, wave=wave, leaf=8).collect()
    want = brute(whole_of([*rows, (2010, [1.0, 2.0]), (2020, [0.0] * 5), rows[3], *extra]), lambda i: i % 10 == 0, 6)
    assert sorted(tuple(r) for r in got) == want  # 2010 has no other vector of its length


def test_repeated_ids_lose_no_row(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.1, 0.2]), (2, [0.5, 0.5])])
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 3648), (0, 2, 2, 2048), (0, 3, 1, 384)]
    assert sorted((r["rank"], r.vec_id) for r in nearest(df, F.col("id") == 0, 5).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_numbers_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        exact_top_k(frame(spark, [(0, [1e18, 0.0]), (1, [1.0, 1.0])]), F.col("id") == 0, 2).collect()
    with pytest.raises(OverflowError):
        products(np.array([[1 << 40]]), np.array([[1 << 40]]))
    assert products(np.array([[1 << 31, 1 << 31]]), np.array([[1 << 31, -(1 << 31)]])).tolist() == [[0]]


def test_trees_are_opened_best_first_and_skip_what_cannot_win():
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(c, 3, (400, 6)) for c in (np.eye(6) * 100)]).astype(np.int64)
    nodes, order = ball_tree(data, 16)
    ids = np.arange(len(data))
    queries = data[:40]
    none = np.full(40, LOWEST)
    who, near, scores, scored = search_tree(nodes, data[order], ids[order], queries, np.full(40, -1), 5, none)
    assert scored < 0.2 * 40 * len(data)
    products_ = queries @ data.T
    for q in range(40):
        want = sorted((-int(s), i) for i, s in enumerate(products_[q]))[:5]
        assert [(-int(s), int(i)) for s, i in sorted(zip(-scores[who == q], near[who == q], strict=True))] == [(-s, i) for s, i in want]
    kth = np.array([np.sort(scores[who == q])[0] for q in range(40)])
    again = search_tree(nodes, data[order], ids[order], queries, np.full(40, -1), 5, kth)
    assert again[3] <= scored and sorted(again[2]) == sorted(scores)
    assert rounds(100) == [(0, 6), (6, 25), (25, 100)] and rounds(1) == [(0, 1)]


def test_fewer_candidates_than_k(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [-1.0, 0.0])])
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 20, 2048), (0, 2, 21, -4096), (20, 1, 0, 2048), (20, 2, 21, -2048)]
    near = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(df, F.col("id") % 20 == 0, 5).collect())
    assert near == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]


@pytest.mark.parametrize("search", [exact_top_k, nearest])
def test_empty_table(spark, search):
    assert search(frame(spark, []), F.col("id") % 20 == 0).collect() == []


def test_large_integers_stay_exact():
    a = np.array([[2**31 + 1, 3], [5, 2**30]], np.int64)
    assert products(a, a).tolist() == [[int(x) for x in r] for r in a.astype(object) @ a.astype(object).T]


def test_probe_sets_come_in_order_and_never_take_both_sides():
    sets = probe_sets(4, 40)
    assert len({tuple(s) for s in sets.tolist()}) == 40
    assert not (sets & sets[:, ::-1]).any()
    assert sets[0].tolist() == [1, 0, 0, 0, 0, 0, 0, 0]


def test_neighbours_have_recall_and_exact_scores(spark):
    rows, all_rows = rows_of(2000, 24, 4)
    got = nearest(frame(spark, all_rows[:-1]), F.col("id") % 50 == 0, 5, shard=500 * 25 * 8, wave=16 * 25 * 8).collect()
    vectors = dict(rows)

    def cosine(a, b):
        return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    by = {}
    for r in got:
        assert math.isclose(r.score, cosine(vectors[r.query_id], vectors[r.vec_id]), rel_tol=1e-12, abs_tol=1e-15)
        by.setdefault(r.query_id, []).append(r)
    hit = n = 0
    for q in [i for i in vectors if i % 50 == 0]:
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [(r.score, -r.vec_id) for r in mine] == sorted(((r.score, -r.vec_id) for r in mine), reverse=True)
        best = sorted((-round(cosine(vectors[q], v), 12), i) for i, v in vectors.items() if i != q)[:5]
        hit, n = hit + len({i for _, i in best} & {r.vec_id for r in mine}), n + 5
    assert hit / n >= 0.9
    assert [r.vec_id for r in sorted(by[5000], key=lambda r: r["rank"])] == [7, 5001, 5002, 5003, 5004]
