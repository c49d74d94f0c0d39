"""Small hand-made frames for the corner cases."""

import math

import pytest
from pyspark.sql import functions as F

from paddock.functions import exprs as ex
from paddock.operators import diagnostics as dg
from paddock.operators import encoders as en
from paddock.operators import field as fl
from paddock.operators import folds as fo
from paddock.operators import target_stats as ts
from paddock.operators.auc import auc
from paddock.operators.spread import quantiles, search, with_avg_rank, with_position
from paddock.operators.timeline import neighbours
from paddock.session import staged
from paddock.sources import scans


def test_lone_lap_has_zero_share(spark):
    d = spark.createDataFrame([(1, "A", 1), (2, "B", 1), (3, "B", 0)], "id int, k string, pit int")
    out = {r["id"]: r["s"] for r in fl.add_leave_one_out_share(d, ["k"], "pit", "s").collect()}
    assert out == {1: 0.0, 2: 0.0, 3: 1.0}


def test_race_without_a_stop_has_no_pit_cost(spark):
    d = spark.createDataFrame([("A", 0, 80.0), ("B", 0, 80.0), ("B", 1, 95.0)], "Race string, PitStop int, LapTime double")
    out = {r["Race"]: r["pit_cost_seconds"] for r in fl.pit_cost(d).collect()}
    assert out == {"A": None, "B": 15.0}


def test_all_ties_rank_the_same(spark):
    d = spark.range(5).withColumn("v", F.lit(1.0))
    assert {r["p"] for r in with_avg_rank(d, [], {"v": "p"}).collect()} == {3 / 5}
    assert auc(d.withColumn("y", (F.col("id") < 2).cast("int")), [], "v", "y").first()["auc"] == 0.5


def test_one_class_group_has_no_auc(spark):
    d = spark.createDataFrame([("A", 0.1, 1), ("A", 0.2, 1), ("B", 0.1, 0), ("B", 0.2, 1)], "k string, s double, y int")
    assert {r["k"]: r["auc"] for r in auc(d, ["k"], "s", "y").collect()} == {"A": None, "B": 1.0}


def test_weighted_auc_counts_copies(spark):
    d = spark.createDataFrame([(0.1, 0, 2), (0.2, 1, 3), (0.3, 0, 1)], "s double, y int, w int")
    row = auc(d, [], "s", "y", "w").first()
    assert row["auc"] == pytest.approx(2 / 3) and row["n"] == 6 and row["n_pos"] == 3


def test_unseen_values(spark):
    fit = spark.createDataFrame([(5, "b"), (1, "a"), (9, "b")], "id long, c string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "id long, c string")
    codes = en.apply_codes(new, en.first_seen_codes(fit, "c", "code"), "c", "code")
    assert {r["id"]: r["code"] for r in codes.collect()} == {1: 0, 2: 1, 3: -1, 4: -1}
    counts = en.frequency(new, fit, ["c"])
    assert {r["id"]: r["c_count"] for r in counts.collect()} == {1: 1, 2: 2, 3: 0, 4: 0}
    holes = fit.unionByName(spark.createDataFrame([(20, None), (21, None)], "id long, c string"))
    for count_null, n in ((True, 2), (False, 0)):
        counts = en.frequency(new, holes, ["c"], count_null=count_null)
        assert {r["id"]: r["c_count"] for r in counts.collect()} == {1: 1, 2: 2, 3: 0, 4: n}


def test_null_groups_keep_their_rows(spark):
    d = spark.createDataFrame([(i, None if i < 4 else "ab"[i % 2], 2022, i % 3) for i in range(12)], "id long, g string, Year int, y int")
    for out in (fo.group_folds(d, "g"), fo.group_stratified_folds(d, ["g"], "Year", "y")):
        rows = {r["id"]: r["fold"] for r in out.collect()}
        assert len(rows) == 12 and len({rows[i] for i in range(4)}) == 1


def test_cross_keys_do_not_run_together(spark):
    d = spark.createDataFrame([("a", None), (None, "a"), ("a", "a")], "p string, q string")
    assert len({r["k"] for r in d.select(ex.crosses({"k": ["p", "q"]})["k"].alias("k")).collect()}) == 3


def test_a_changed_source_is_staged_again(spark, tmp_path):
    source = f"{tmp_path}/source"
    read = lambda: staged(spark, "t", source, lambda: spark.read.parquet(f"{source}/a.parquet")).count()
    spark.range(3).write.parquet(f"{source}/a.parquet")
    assert read() == read() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{source}/a.parquet")
    assert read() == 5


def test_zero_divisor_gives_null(spark):
    row = spark.createDataFrame([(1.0, -1e-6)], "a double, b double").select(ex.safe_div(F.col("a"), F.col("b")).alias("x")).first()
    assert row["x"] is None


def test_bins_are_right_closed_and_fitted_bins_left_closed(spark):
    d = spark.createDataFrame([(0.2,), (0.2000001,)], "x double")
    assert [r[0] for r in d.select(ex.right_closed(F.col("x"), [0.2], ["lo", "hi"])).collect()] == ["lo", "hi"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate([-5.0, 1.0, 1.5, 2.0, 99.0])], "i int, x double")
    got = {r["i"]: r["b"] for r in d.select("i", en.apply_bins("x", [1.0, 2.0]).alias("b")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}


def test_constant_column_collapses_its_bins(spark):
    d = spark.range(50).withColumn("x", F.lit(3.0))
    assert en.fit_bins(d, ["x"], 10) == {"x": [3.0]}


def test_cardinality_cap(spark):
    d = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), ("d",)], "c string")
    kept = {r["o"] for r in en.cap_cardinality(d, d, "c", 3, "o").collect()}
    assert kept == {"a", "b", "__OTHER__"}
    assert {r["o"] for r in en.cap_cardinality(d, d, "c", 4, "o").collect()} == {"a", "b", "c", "d"}


def test_quantile_flavours(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert quantiles(d, [], "x", {"q": 0.25}).first()["q"] == 1.75
    assert quantiles(d, [], "x", {"q": 0.25}, method="nearest").first()["q"] == 2.0
    empty = quantiles(d.where("x > 9"), [], "x", {"q": 0.5}).collect()
    assert len(empty) == 0 or empty[0]["q"] is None


def test_weighted_quantile(spark):
    d = spark.createDataFrame([(1.0, 3), (5.0, 1)], "x double, w long")
    assert quantiles(d, [], "x", {"q": 0.5}, weight="w").first()["q"] == 1.0


def test_gaps_in_laps_are_skipped_not_counted(spark):
    d = spark.createDataFrame([("a", 3, 1.0), ("a", 7, 5.0), ("a", 8, 6.0)], "k string, lap int, v double")
    d = neighbours(with_position(d, ["k"], ["lap"], "p"), ["k"], "p", lambda w: {"d": F.col("v") - F.lag("v").over(w)}, back=1)
    assert {r["lap"]: r["d"] for r in d.collect()} == {3: None, 7: 4.0, 8: 1.0}


def test_sequences_keep_every_lap(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(1, 12)], "k string, lap int, v double")
    out = en.sequences(d, ["k"], "lap", ["v"], 4).orderBy("segment").collect()
    assert [r["n"] for r in out] == [4, 4, 3]
    assert all(len(r["seq"]) == 4 and len(r["mask"]) == 4 for r in out)
    assert [x["v"] for r in out for x, m in zip(r["seq"], r["mask"]) if m] == [float(i) for i in range(1, 12)]


def test_oof_sink_refuses_a_wrong_schema(spark, tmp_path):
    d = spark.createDataFrame([(1, 2022, 1, 0.5, 0)], "id long, Year int, target int, oof double, fold int")
    with pytest.raises(ValueError):
        scans.write_oof(d, str(tmp_path / "x"))


def test_log_loss_is_clipped(spark):
    row = spark.range(1).select(ex.log_loss_row(F.lit(1.0), F.lit(0.0)).alias("l")).first()
    assert row["l"] == pytest.approx(-math.log(1e-7))


def test_gate_verdicts(spark):
    def verdict(cand):
        d = spark.createDataFrame([(i, 0.9, 0.9 + c) for i, c in enumerate(cand)], "fold int, base_auc double, cand_auc double")
        return dg.gate(d).first()["verdict"]
    assert verdict([0.001] * 5) == "KEEP"
    assert verdict([-0.001] * 5) == "DISCARD"
    assert verdict([0.0001] * 5) == "INCONCLUSIVE"
    assert verdict([0.01, 0.01, -0.001, -0.001, -0.001]) == "INCONCLUSIVE"


def test_cross_fit_never_uses_the_own_fold(spark):
    # one key; the encoding of a row must not move when the labels of its own fold are flipped
    rows = [(i, "k", i % 3, i % 2, (i * 7 % 5) % 2) for i in range(60)]
    def encode(rs):
        d = spark.createDataFrame(rs, "id int, k string, fold int, inner int, y int")
        out = ts.nested_target_encode(d, {"k": "te"}, "y", "fold", "inner", 3, 2, ts.fixed_weight(20.0))
        return {(r["id"], r["outer"]): r["te"] for r in out.collect()}
    a = encode(rows)
    b = encode([(i, k, f, n, 1 - y if f == 0 else y) for i, k, f, n, y in rows])
    assert len(a) == 60 * 3
    assert all(a[x] == b[x] for x in a if x[1] == 0 and rows[x[0]][2] == 0)
    assert any(a[x] != b[x] for x in a if x[1] == 1)
    # brute force for one training row
    i, o = 4, 0
    ys = [y for j, k, f, n, y in rows if f != o and n != rows[i][3]]
    assert a[(i, o)] == pytest.approx((sum(ys) + sum(ys) / len(ys) * 20) / (len(ys) + 20))


def test_folds_partition_and_balance(spark):
    d = spark.range(503).withColumn("s", F.col("id") % 3)
    f = fo.stratified_folds(d, ["s"], 5)
    assert f.count() == 503
    for s in range(3):
        sizes = [r["count"] for r in f.where(F.col("s") == s).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1
    g = fo.group_folds(d.withColumn("g", F.col("id") % 40), "g", 4)
    assert g.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1


def test_rank_sum_and_auc_symmetry(spark):
    d = spark.range(400).select("id", (F.xxhash64("id") % 97).cast("double").alias("s"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    total = with_avg_rank(d, [], {"s": "r"}, "raw").agg(F.sum("r")).first()[0]
    assert total == 400 * 401 / 2
    a = auc(d, [], "s", "y").first()["auc"]
    b = auc(d.withColumn("s", -F.col("s")), [], "s", "y").first()["auc"]
    assert a + b == pytest.approx(1.0)


def test_null_compound_rows_keep_their_features(spark):
    d = spark.createDataFrame([(1, None, 5.0), (2, "SOFT", 6.0)], "id int, Compound string, TyreLife double").withColumn("RaceProgress", F.lit(0.5))
    out = {r["id"]: r["NormTyreLife"] for r in d.withColumns(ex.compound_age()).collect()}
    assert out == {1: 5.0 / 17, 2: 6.0 / 14}


@pytest.mark.parametrize("n", [3, 128, 129, 144, 200, 256])
def test_edge_search_of_any_length(spark, n):
    edges = [float(2 * i) for i in range(n)]
    d = spark.range(-1, 2 * n + 1).select(F.col("id").cast("double").alias("x"))
    rows = d.select("x", search("x", edges).alias("a"), search("x", edges, strict=True).alias("b")).collect()
    for r in rows:
        assert r["a"] == sum(e <= r["x"] for e in edges)
        assert r["b"] == sum(e < r["x"] for e in edges)


def test_correlation_with_a_constant_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.0, 5.0), (None, 9.0, 5.0)], "a double, b double, c double")
    row = d.agg(ex.correlation(F.col("a"), F.col("b")).alias("ab"), ex.correlation(F.col("a"), F.col("c")).alias("ac")).first()
    assert row["ab"] == pytest.approx(0.9332565252573828) and row["ac"] is None
