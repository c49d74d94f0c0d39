"""Model jobs: every row scored once, and better than chance where there is signal."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paddock.operators.auc import auc
from paddock.sources.laps import oof, split_of
from tests.conftest import SF

Q = entry.queries()


def score_auc(spark, df):
    y = split_of(spark, SF, "train").select("id", F.col("PitNextLap").alias("y"))
    return auc(df.join(y, "id"), [], "score", "y").first()["auc"]


def test_out_of_fold_scores_every_row_once(spark):
    d = Q["M1_out_of_fold"](spark, SF).cache()
    n = {r["part"]: (r["n"], r["d"]) for r in d.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()}
    assert n["oof"] == (split_of(spark, SF, "train").count(),) * 2
    assert n["test"] == (split_of(spark, SF, "test").count(),) * 2


@pytest.mark.parametrize("name", ["three", "four"])
def test_stack_keeps_the_strong_base(spark, name):
    d = Q["M4_stacking_logits"](spark, SF).where(F.col("part") == name)
    assert score_auc(spark, d) > 0.8
    assert d.count() == oof(spark, SF).count()


def test_shallow_meta_model_keeps_the_strong_base(spark):
    d = Q["M6_shallow_meta_model"](spark, SF).where(F.col("part") == "predictions")
    assert score_auc(spark, d) > 0.8


def test_importance_sums_to_one(spark):
    rows = Q["M7_importance_by_family"](spark, SF).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1, abs=1e-4)
    assert sum(r["n_features"] for r in rows) == 15


def test_adversarial_and_density_weights(spark):
    rows = {(r["measure"], r["feature"]): r["value"] for r in Q["M5_adversarial_validation"](spark, SF).collect()}
    # a perfect separator or one weight for all rows is a leak, not a result
    assert 0.4 < rows[("auc", "all")] < 0.99
    w = Q["C9_density_ratio_weights"](spark, SF).agg(F.min("weight"), F.max("weight"), F.count("*"), F.count_distinct("weight")).first()
    assert w[0] >= 0.1 and w[1] <= 10 and w[2] == split_of(spark, SF, "ext").count() and w[3] > 20


def test_specialist_replaces_only_its_year(spark):
    d = Q["M9_year_specialist"](spark, SF)
    assert d.count() == split_of(spark, SF, "train").count()
    assert d.where(F.col("score").isNull()).count() == 0


def test_search_reports_every_point_and_where_it_stopped(spark):
    rows = Q["M10_grid_search"](spark, SF).collect()
    assert len(rows) == 12 and all(0 < r["mean_auc"] < 1 for r in rows)
    assert all(len(r["fold_aucs"]) == (5 if r["stopped_after"] < 0 else r["stopped_after"] + 1) for r in rows)
    assert any(r["stopped_after"] < 0 for r in rows)


@pytest.mark.parametrize("name,n", [("M11_group_fold_stress", 2), ("C12_external_ablation", 2)])
def test_comparisons_have_both_sides(spark, name, n):
    rows = Q[name](spark, SF).collect()
    assert len(rows) == n and all(0 < r["auc"] < 1 for r in rows)
