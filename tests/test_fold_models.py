"""Models of all folds in one scan, racing search, boosted trees."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from paddock.ml import boosting as bo
from paddock.ml import fold_models as fm
from paddock.ml import race as rc
from paddock.ml.oof import probability
from paddock.operators.auc import auc
from paddock.plans import q_models

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    """Rows with four features (one constant), a label, five folds and a second dealing of a part of the rows."""
    rng = np.random.default_rng(3)
    n = 600
    x = np.column_stack([rng.normal(size=n), rng.normal(5, 30, n), rng.exponential(0.01, n), np.ones(n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.02 * x[:, 1] + 50 * x[:, 2] - 1)))).astype(float)
    rows = [(i, float(y[i]), i % 5, i % 3 if i < 400 else None, Vectors.dense(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "label", "fold", "part", "features"]).cache()


def engine(rows, reg, l1):
    m = LogisticRegression(labelCol="label", maxIter=2000, tol=1e-14, regParam=reg, elasticNetParam=l1).fit(rows)
    return np.array([*m.coefficients.toArray(), m.intercept])


@pytest.mark.parametrize("reg,l1", [(0.0, 0.0), (1e-4, 0.0), (0.1, 0.0), (0.02, 1.0), (0.05, 0.5)])
def test_all_folds_equal_the_engines_own_models(made, reg, l1):
    jobs = [fm.Job(held=f, reg=reg, l1=l1) for f in range(5)]
    fit = fm.fit_jobs(fm.job_table(made), jobs)
    assert fit.converged.all() and fit.scans < 30
    for f in (0, 3):
        assert fit.weights[f] == pytest.approx(engine(made.where(F.col("fold") != f), reg, l1), abs=2e-5 if l1 else 1e-6)


def test_out_of_fold_scores_equal_the_engines_at_small_scale(spark):
    train, _, ext = q_models.model_rows(spark, SMALL, scale=True)
    mine, _, fit = fm.out_of_fold_logistic(train, 5, ext)
    assert fit.converged.all()
    part = train.where("fold <> 2").select("label", "features").unionByName(ext.select("label", "features"))
    model = LogisticRegression(labelCol="label", maxIter=2000, tol=1e-14, regParam=1e-4).fit(part)
    want = probability(model, train.where("fold = 2")).select("id", F.col("score").alias("want"))
    assert mine.join(want, "id").agg(F.max(F.abs(F.col("score") - F.col("want")))).first()[0] < 1e-6


def test_scans_do_not_depend_on_the_number_of_models(made):
    table = fm.job_table(made, ["fold", "part"])
    few = fm.fit_jobs(table, [fm.Job(held=0)])
    many = fm.fit_jobs(table, [fm.Job(held=f, reg=r) for f in range(5) for r in (1e-4, 1e-2)] + [fm.Job(held=f, folds=1) for f in range(3)])
    assert abs(many.scans - few.scans) <= 2 and many.converged.all()
    own = fm.fit_jobs(fm.job_table(made.where("part IS NOT NULL"), ["part"]), [fm.Job(held=1)])
    assert many.weights[11] == pytest.approx(own.weights[0], abs=1e-8)


def test_jobs_with_few_columns_extra_rows_and_one_class(made, spark):
    extra = made.where("id < 100").withColumn("label", 1 - F.col("label"))
    fit = fm.fit_jobs(fm.job_table(made, ["fold"], extra), [fm.Job(held=0, extra=False), fm.Job(held=0), fm.Job(held=0, columns=(0,))])
    both = made.where("fold <> 0").select("label", "features").unionByName(extra.select("label", "features"))
    assert fit.weights[0] == pytest.approx(engine(made.where("fold <> 0"), 1e-4, 0.0), abs=1e-6)
    assert fit.weights[1] == pytest.approx(engine(both, 1e-4, 0.0), abs=1e-6)
    assert (fit.weights[2][1:4] == 0).all() and fit.weights[2][0] != 0 and (fit.weights[:, 3] == 0).all()
    ones = fm.fit_jobs(fm.job_table(made.withColumn("label", F.lit(1.0))), [fm.Job(held=0)])
    assert (ones.weights[0][:4] == 0).all() and ones.weights[0][4] > 5
    nothing = fm.fit_jobs(fm.job_table(made.limit(0)), [fm.Job(held=0)])
    assert nothing.weights.shape == (1, 1)


def test_points_fill_every_range():
    space = {"a": rc.Log(1e-6, 1.0), "b": rc.Choice((0.0, 0.5, 1.0)), "c": rc.Whole(5, 9), "d": rc.Linear(-1, 1)}
    got = rc.points(space, 120, seed=1)
    assert got == rc.points(space, 200, seed=1)[:120] and got != rc.points(space, 120, seed=2)
    assert all(1e-6 <= p["a"] <= 1 and -1 <= p["d"] <= 1 for p in got)
    for name, values in (("b", (0.0, 0.5, 1.0)), ("c", range(5, 10))):
        n = [sum(p[name] == v for p in got) for v in values]
        assert min(n) > 0.8 * len(got) / len(n)
    decades = np.histogram(np.log10([p["a"] for p in got]), bins=6, range=(-6, 0))[0]
    assert decades.min() >= 15


def test_a_race_stops_points_below_the_median_and_keeps_the_winner(made):
    rate = q_models.rate_logistic(made)
    candidates = [{"regParam": r, "elasticNetParam": l1, "n_columns": n} for r in (1e-4, 1.0) for l1 in (0.0, 1.0) for n in (1, 3)]
    trials = rc.race(candidates, 5, rate)
    full = [np.mean([rate([c], f)[0] for f in range(5)]) for c in candidates[:2]] + [np.mean([rate(candidates[2:], f) for f in range(5)], axis=0)]
    full = [*full[:2], *full[2]]
    assert rc.best(trials).mean == pytest.approx(max(full), abs=1e-9)
    assert rc.best(trials).point["regParam"] == candidates[int(np.argmax(full))]["regParam"]
    for t in trials:
        assert len(t.folds) == (5 if t.stopped is None else t.stopped + 1)
    assert any(t.stopped is not None for t in trials)


def test_trees_stop_early_and_beat_a_line_where_columns_interact(spark):
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.1)).astype(float)
    rows = spark.createDataFrame([(i, float(y[i]), i % 2, Vectors.dense(x[i]), [[float(x[i, 2])]] * 2) for i in range(n)], ["id", "label", "fold", "features", "te"])
    sizes = bo.Boosting(rounds=12, depth=3, step=0.3, min_rows=10, seeds=(1, 2))
    oof, test, rounds = bo.out_of_fold_trees(rows.cache(), 2, sizes, rows.drop("label", "fold"), "te")
    line, _, _ = fm.out_of_fold_logistic(rows, 2)
    score = lambda d: auc(d, [], "score", "label").first()["auc"]
    assert score(oof) > 0.8 > 0.6 > score(line)
    assert set(rounds) == {(f, s) for f in range(2) for s in (1, 2)} and all(1 <= r <= 12 for r in rounds.values())
    assert {r["members"] for r in oof.select("members").distinct().collect()} == {2} and test.count() == n
    noise = rows.withColumn("label", F.rand(5).cast("int").cast("double") + (F.rand(6) > 0.5).cast("double"))
    assert bo.fit_one(noise, bo.Boosting(depth=3, min_rows=10, step=0.3)).getNumTrees < 50  # of 5,000


def test_default_sizes_are_the_full_ones():
    d = bo.Boosting()
    assert (d.rounds, d.depth, d.step, d.min_rows) == (5000, 6, 0.05, 100) and len(q_models.SIX_SEEDS) == 6
