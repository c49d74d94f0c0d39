"""Winners by bounded histograms against exact scoring of every candidate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.operators import contest as co
from paddock.operators.auc import auc, with_candidates

GRID = [round(0.05 * i, 3) for i in range(9)]


def table(spark, n=6000, seed=3, digits=5):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    a = np.clip(rng.normal(0.45 + 0.1 * y, 0.15), 0, 1).round(digits)
    b = np.clip(rng.normal(0.4 + 0.12 * y, 0.2), 0, 1).round(digits)
    group = rng.choice(["x", "y", None], n)
    rows = [(i, int(y[i]), float(a[i]), float(b[i]), None if group[i] is None else str(group[i]), i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "id long, target int, a double, b double, grp string, fold int").repartition(12)


def long_of(t):
    w = F.col("cand.w")
    return with_candidates(t, [{"w": x} for x in GRID]).select("grp", "fold", w.alias("w"), "target", ((1 - w) * F.col("a") + w * F.col("b")).alias("s"))


@pytest.mark.parametrize("bins", [16, co.BINS])
def test_bounds_hold_the_exact_auc(spark, bins):
    long = long_of(table(spark))
    exact = {(r.grp, r.w): r for r in auc(long, ["grp", "w"], "s", "target").collect()}
    found = co.bounds(co.histograms(long, ["grp", "w"], "s", "target", bins), ["grp", "w"]).collect()
    assert len(found) == len(exact) == 3 * len(GRID)
    for r in found:
        e = exact[r.grp, r.w]
        assert r._low <= e.auc <= r._high and (r.n, r.n_pos) == (e.n, e.n_pos)
        assert r._high - r._low < 4 / bins + 1e-6


@pytest.mark.parametrize("bins", [16, co.BINS])
def test_winners_equal_exact_scoring(spark, bins):
    t = table(spark)
    long = long_of(t)
    want = {}
    for o in range(4):
        e = auc(long.where(F.col("fold") != o), ["grp", "w"], "s", "target")
        for r in e.groupBy("grp").agg(F.max_by("w", F.struct("auc", -F.col("w"))).alias("w")).collect():
            want[o, r.grp] = r.w
    got = {(r[co.OUTER], r.grp): r.w for r in co.best(long, ["grp"], "w", "s", "target", "fold", 4, bins).collect()}
    assert got == want and len(got) == 12
    plain = {r.grp: r.w for r in co.best(long, ["grp"], "w", "s", "target", bins=bins).collect()}
    every = auc(long, ["grp", "w"], "s", "target").groupBy("grp").agg(F.max_by("w", F.struct("auc", -F.col("w"))).alias("w"))
    assert plain == {r.grp: r.w for r in every.collect()}


def test_only_contenders_are_scored_exactly(spark):
    long = long_of(table(spark))
    rated = co.bounds(co.histograms(long, ["grp", "w"], "s", "target"), ["grp", "w"])
    left = co.contenders(rated, ["grp"]).count()
    assert 3 <= left < 3 * len(GRID) / 2
    scored = co.best_scored(long, ["grp"], "w", "s", "target", always=F.col("w") == 0).collect()
    assert left <= len(scored) <= left + 3 and {r.grp for r in scored if r.w == 0} == {"x", "y", None}
    # what leaves the tasks depends on bins and candidates, not on rows
    many = long.unionByName(long).unionByName(long)
    assert co.histograms(many, ["grp", "w"], "s", "target", 64).count() <= 64 * 3 * len(GRID)


def test_odd_scores(spark):
    rows = [(1, 0.5), (0, 0.5), (1, None), (None, 0.7), (1, float("nan")), (0, -3.0), (1, 8.0), (0, 1.0)]
    t = spark.createDataFrame(rows, "target int, s double").withColumn("w", F.explode(F.array(F.lit(0.1), F.lit(0.2))))
    e = auc(t, ["w"], "s", "target").collect()
    for r in co.bounds(co.histograms(t, ["w"], "s", "target", 8), ["w"]).collect():
        assert all(r._low <= x.auc <= r._high for x in e)
    assert [r.w for r in co.best(t, [], "w", "s", "target").collect()] == [0.1]  # the smallest of equals
    one = t.where("target = 1")
    assert co.best(one, [], "w", "s", "target").collect() == []  # a class is missing
    assert co.best(t.limit(0), [], "w", "s", "target").collect() == []
