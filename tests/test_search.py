"""Weight searches against brute force in numpy on the same small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paddock.operators import search as se
from paddock.sources.laps import oof

SMALL = "/root/testdata/sf0.001"
DAC = ["oof_d", "oof_a", "oof_c"]


def np_auc(y, s):
    order = np.argsort(s, kind="mergesort")
    s, y = s[order], y[order]
    _, start, n = np.unique(s, return_index=True, return_counts=True)
    ranks = np.repeat(start + (n + 1) / 2, n)
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def data(spark):
    d = oof(spark, SMALL).toPandas().sort_values("id")
    return d[DAC].to_numpy(), d["target"].to_numpy()


def test_scores_match_brute_force(spark, data):
    x, y = data
    t = se.prepare(oof(spark, SMALL), DAC, "target")
    moves = [(0, w) for _, w in se.coordinate_moves(np.array([0.5, 0.3, 0.2]))]
    got = se.score_moves(t, DAC, "target", moves)
    want = [np_auc(y, w[0] * x[:, 0] + w[1] * x[:, 1] + w[2] * x[:, 2]) for _, w in moves]
    assert got == pytest.approx(want, abs=1e-12)
    for bins in (16, 4096):
        bounds = se.bound_moves(t, DAC, "target", moves, bins)
        assert (bounds[:, 0] <= want).all() and (bounds[:, 1] >= want).all()
        assert (bounds[:, 1] - bounds[:, 0]).max() < 3 / bins + 1e-3 * (bins > 1000)


def test_moves_are_all_single_changes():
    w = np.array([0.98, 0.02, 0.0])
    got = dict(se.coordinate_moves(w))
    assert list(got) == [f"{i}:{d}" for i in range(3) for d in se.STEPS]
    for i in range(3):
        for d in se.STEPS:
            t = w.copy()
            t[i] = max(0.0, t[i] + d)
            assert got[f"{i}:{d}"] == pytest.approx(t / t.sum())
    assert se.coordinate_moves(np.array([0.01]), [-0.03]) == []


def test_coordinate_descent_ends_where_no_move_gains(spark, data):
    x, y = data
    t = se.prepare(oof(spark, SMALL), DAC, "target")
    found, = se.coordinate_descent(t, DAC, "target", [[1, 1, 1]])
    score = lambda u: np_auc(y, u[0] * x[:, 0] + u[1] * x[:, 1] + u[2] * x[:, 2])
    v = np.ones(3) / 3
    best = score(v)
    while True:
        top, u = max(((score(np.array(m)), m) for _, m in se.coordinate_moves(v)), key=lambda z: z[0])
        if top <= best + se.TOLERANCE:
            break
        best, v = top, np.array(u)
    assert found.converged
    assert found.auc == pytest.approx(best, abs=1e-9)
    assert found.weights == pytest.approx(v)
    first, = se.coordinate_descent(t, DAC, "target", [[1, 1, 1]], limit=1)
    assert not first.converged and first.auc < found.auc


def test_greedy_matches_brute_force(spark, data):
    x, y = data
    t = se.prepare(oof(spark, SMALL), DAC, "target")
    found, = se.greedy(t, DAC, "target", [[0, 1, 2]], init=1)
    singles = [np_auc(y, x[:, j]) for j in range(3)]
    counts = np.eye(3)[int(np.argmax(singles))]
    best = max(singles)
    while True:
        trial = [np_auc(y, ((counts + e) / (counts.sum() + 1) * x).sum(1)) for e in np.eye(3)]
        if max(trial) <= best + se.TOLERANCE:
            break
        best, counts = max(trial), counts + np.eye(3)[int(np.argmax(trial))]
    assert found.converged
    assert found.auc == pytest.approx(best, abs=1e-9)
    assert found.weights == pytest.approx(counts / counts.sum())


def test_searches_on_several_row_sets_are_independent(spark):
    d = oof(spark, SMALL)
    both = se.prepare(d, DAC, "target", [F.col("id") % 2, F.lit(1)])
    one = se.prepare(d.where("id % 2 = 1"), DAC, "target")
    w = [0.2, 0.5, 0.3]
    assert se.score_moves(both, DAC, "target", [(0, w)]) == se.score_moves(one, DAC, "target", [(0, w)])


def test_nnls_is_optimal(data):
    x, y = data
    rng = np.random.default_rng(0)
    cases = [(x, y)] + [(rng.normal(size=(80, k)), rng.normal(size=80)) for k in (1, 4, 12, 25) for _ in range(5)]
    cases.append((np.column_stack([x, x[:, 0]]), y))
    for a, b in cases:
        w = se.nnls_from_gram(a.T @ a, a.T @ b)
        assert (w >= 0).all()
        grad = a.T @ (a @ w - b)
        assert (grad[w == 0] >= -1e-6).all() and np.abs(grad[w > 0]).max(initial=0) < 1e-6


def test_bags_are_drawn_as_poisson(spark):
    from paddock.operators.folds import poisson_weight

    n = spark.range(40000).select(poisson_weight(3, 0.5).alias("m")).groupBy("m").count().collect()
    share = {r["m"]: r["count"] / 40000 for r in n}
    for k in range(4):
        assert share[k] == pytest.approx(np.exp(-0.5) * 0.5**k / [1, 1, 2, 6][k], abs=0.01)


@pytest.mark.parametrize("name", ["B15_coarse_to_fine", "B17_coordinate_descent", "B18_nested_blend", "B19_bagged_weights",
                                  "B20_greedy_selection", "B21_nested_greedy", "B21_bagged_greedy", "B22_crossfit_nnls"])
def test_search_queries_give_rows(spark, name):
    rows = entry.queries()[name](spark, SMALL).collect()
    assert rows
    if "weight" in rows[0].asDict():
        totals = {}
        for r in rows:
            totals[r["search"]] = totals.get(r["search"], 0) + r["weight"]
        assert all(t == pytest.approx(1, abs=1e-4) for t in totals.values())
    elif "score" in rows[0].asDict():
        assert len(rows) == oof(spark, SMALL).count() and all(r["score"] is not None for r in rows)
