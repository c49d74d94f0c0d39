"""Target encodings and group folds against plain definitions, bags, sequences, bases that must be refused."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paddock.functions import exprs as ex
from paddock.operators import encoders as en
from paddock.operators import folds as fo
from paddock.operators import rows as ro
from paddock.operators import target_stats as ts
from paddock.sources import scans as sc


def plain_bayes(ys, every):
    prior, t = np.mean(every), np.var(every)
    if not ys:
        return prior
    signal = len(ys) * t
    w = signal / (np.var(ys) + signal) if np.var(ys) + signal > 0 else 0
    return w * np.mean(ys) + (1 - w) * prior


def test_empirical_bayes_of_one_row_constant_unseen_and_null_keys(spark):
    fit = [("one", 3.0), ("same", 2.0), ("same", 2.0), ("mixed", 0.0), ("mixed", 5.0), ("mixed", 1.0), (None, 4.0), (None, 1.0)]
    every = [y for _, y in fit]
    new = spark.createDataFrame([Row(k=k) for k in ("one", "same", "mixed", None, "unseen")], "k string")
    got = {r.k: r.te for r in ts.target_encode(new, spark.createDataFrame(fit, "k string, y double"), "k", "y", "te").collect()}
    want = {k: plain_bayes([y for q, y in fit if q == k], every) for k in got}
    assert got == pytest.approx(want) and got["one"] == 3.0 and got["same"] == 2.0 and got["unseen"] == np.mean(every)
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, y double")
    assert {r.te for r in ts.target_encode(flat, flat, "k", "y", "te").collect()} == {1.0}


@pytest.mark.parametrize("shrink", ["bayes", "fixed"])
def test_crossfit_sees_other_folds_only(spark, shrink):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0.0, 1.0, 2.5]), rng.randrange(3), rng.randrange(2)) for i in range(90)] + [(90, "lone", 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "id long, k string, y double, fold int, inner int")
    new = spark.createDataFrame([(200, "a"), (201, "zzz")], "id long, k string").withColumns({"y": F.lit(None).cast("double"), "fold": F.lit(None).cast("int"), "inner": F.lit(None).cast("int")})
    how = ts.EMPIRICAL_BAYES if shrink == "bayes" else ts.fixed_weight(20.0)
    got = {(r.id, r.outer): r.te for r in ts.nested_target_encode(df.unionByName(new), {"k": "te"}, "y", "fold", "inner", 3, 2, how).collect()}
    plain = plain_bayes if shrink == "bayes" else (lambda ys, every: (sum(ys) + 20 * np.mean(every)) / (len(ys) + 20))
    for i, k, fold, inner in [*[(r[0], r[1], r[3], r[4]) for r in rows], (200, "a", None, None), (201, "zzz", None, None)]:
        for outer in range(3):
            seen = [r for r in rows if r[3] != outer and (fold in (None, outer) or r[4] != inner)]
            assert got[i, outer] == pytest.approx(plain([r[2] for r in seen if r[1] == k], [r[2] for r in seen]))
    assert len(got) == 3 * 93


def test_target_stats_have_the_sample_deviation(spark):
    rows = [(i, "k", float(v), f, 0) for i, (v, f) in enumerate([(1, 0), (4, 1), (2, 1), (9, 2)])]
    df = spark.createDataFrame(rows, "id long, k string, y double, fold int, inner int")
    got = {(r.id, r.outer): (r.ts_k_cnt, r.ts_k_std) for r in ts.add_target_stats(df, ["k"], "y", "fold", "inner", 3, 1).collect()}
    assert got[0, 0] == (3, pytest.approx(np.std([4, 2, 9], ddof=1))) and got[1, 2][0] == 0 and got[3, 2] == (3, pytest.approx(np.std([1, 4, 2], ddof=1)))


def plain_greedy(sizes, k):
    heap = [(0, f) for f in range(k)]
    out = {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or "")):
        load, f = heapq.heappop(heap)
        out[g] = f
        heapq.heappush(heap, (load + n, f))
    return out


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 5), (3, 7), (4, 5)])
def test_group_folds_are_greedy(spark, seed, k):
    rng = random.Random(seed)
    sizes = {f"g{i:03}": rng.choice([1, 1, 2, 3, 7, rng.randrange(1, 40)]) for i in range(60)} | {"big": 150, None: 4}
    df = spark.createDataFrame([(i, g) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))], "id long, g string")
    got = {r.g: r.fold for r in fo.group_folds(df, "g", k).select("g", "fold").distinct().collect()}
    assert got == plain_greedy(sizes, k)


def test_runs_of_equal_groups_are_dealt_as_one_by_one():
    rng = random.Random(9)
    for _ in range(300):
        k, size, n = rng.randrange(1, 6), rng.randrange(1, 5), rng.randrange(1, 60)
        loads = [rng.randrange(0, 40) for _ in range(k)]
        plain, want = list(loads), []
        for _ in range(n):
            f = plain.index(min(plain))
            want.append(f)
            plain[f] += size
        dealt = fo.deal_run(loads, size, n)
        got = [turn[(i - at) % len(turn)] for i in range(n) for at, turn in [max((d for d in dealt if d[0] <= i), key=lambda d: d[0])]]
        assert got == want and loads == plain and len(dealt) <= 3 * k * k + k


def test_bags_have_an_exact_size_whatever_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(fo, "_LEAF_ROWS", 100)
    monkeypatch.setattr(fo, "_LEVEL_BITS", 3)
    df = spark.range(5001).withColumn("v", F.col("id") * 2)
    seeds = [1, 2, 3, 4]
    got = {r.id: r.bags for r in fo.exact_bags(df.repartition(3), 0.5, seeds).collect()}
    again = {r.id: r.bags for r in fo.exact_bags(df.repartition(30), 0.5, seeds).collect()}
    assert got == again and len(got) == 5001
    x = np.array(list(got.values()))
    assert (x.sum(axis=0) == 2500).all()
    # draws with replacement: close to Poisson(0.5), and bags differ
    assert x.var(axis=0) == pytest.approx(np.full(4, 0.5), abs=0.06) and np.abs(np.corrcoef(x.T)[0, 1:]).max() < 0.06
    share = Counter(x.ravel().tolist())
    assert share[0] / x.size == pytest.approx(np.exp(-0.5), abs=0.02) and share[2] / x.size == pytest.approx(np.exp(-0.5) / 8, abs=0.01)
    assert fo.exact_bags(df.limit(0), 0.5, seeds).count() == 0


def test_sequences_with_roles(spark):
    rows = [  # the same lap from both sources, test laps before training laps, augmentation rows apart
        (1, "A", 1, 1, 1.0, 10.0), (2, "A", 2, 0, None, 20.0), (3, "A", 3, 1, 0.0, None), (9, "A", 1, 2, 1.0, 11.0), (10, "A", 2, 2, 7.0, 12.0), (11, "B", 1, 0, None, 5.0)]
    df = spark.createDataFrame(rows, "id long, k string, lap int, role int, y double, v double")
    got = {(r.k, r.source, r.segment): r.asDict() for r in en.role_sequences(df, ["k"], "lap", "role", "id", "y", ["v"], 4).collect()}
    a = got["A", 0, 0]
    assert (a["laps"], a["roles"], a["ids"], a["mask"]) == ([2, 1, 3, 0], [0, 1, 1, -1], [2, 1, 3, -1], [1, 1, 1, 0])
    assert (a["fit_mask"], a["score_mask"], a["new_mask"], a["target"], a["v"]) == ([0, 1, 1, 0], [0, 1, 1, 0], [1, 0, 0, 0], [0, 1, 0, 0], [20, 10, 0, 0])
    b = got["A", 1, 0]
    assert (b["ids"], b["fit_mask"], b["score_mask"], b["target"], b["n"]) == ([-1] * 4, [1, 1, 0, 0], [0] * 4, [1, 1, 0, 0], 2)
    assert a["has_train"] and a["has_positive"] and not b["has_train"] and not got["B", 0, 0]["has_positive"]
    cut = en.role_sequences(df, ["k"], "lap", "role", "id", "y", ["v"], 2).where("k = 'A' AND source = 0").orderBy("segment").collect()
    assert [r.ids for r in cut] == [[2, 1], [3, -1]]


def test_null_slot_and_fallback_of_an_unseen_compound(spark):
    d = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0)], "id long, x double")
    assert [r.b for r in d.select(en.apply_bins("x", [2.0, 5.0], 7).alias("b")).collect()] == [0, 7, 2]
    fit = spark.createDataFrame([("SOFT", 10.0), ("SOFT", 20.0), ("HARD", 40.0)], "Compound string, TyreLife double")
    new = spark.createDataFrame([("SOFT", 16.0), ("WET", 16.0)], "Compound string, TyreLife double")
    got = {r.Compound: r for r in en.add_tyre_overdue_inductive(new, fit).collect()}
    assert got["SOFT"].tyre_overdue_p75 == 16 - 17.5 and got["WET"].tyre_overdue_p75 == 16 - 30.0
    assert got["WET"].tyre_life_ratio_p50 == pytest.approx(16 / 20, abs=1e-5)
    holes = spark.createDataFrame([(1, None), (2, "x")], "id long, c string")
    assert [r.c for r in holes.withColumns(ex.no_nulls(["c"])).collect()] == ["__NA__", "x"]


def test_shared_columns(spark):
    a, b, c = (spark.createDataFrame([(1,) * len(n)], n) for n in (["id", "x", "y", "z"], ["z", "x", "id"], ["x", "z", "w"]))
    assert ro.shared_columns(a, b, c) == ["x", "z"] and ro.shared_columns(a, b, leave_out=("id",)) == ["x", "z"] and ro.shared_columns(a) == ["id", "x", "y", "z"]


def test_pool_refuses_bases_that_do_not_fit(spark, tmp_path):
    ref = spark.range(60).withColumns({"Year": F.lit(2022), "target": (F.col("id") % 2).cast("double"), "fold": (F.col("id") % 5).cast("int")})
    good = ref.withColumn("oof", F.col("id") / 60)
    bases = {
        "good": good, "unsubmitted": good, "short": good.where("id <> 7"), "holes": good.withColumn("oof", F.when(F.col("id") != 7, F.col("oof"))),
        "nan": good.withColumn("oof", F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("oof"))), "twice": good.withColumn("id", F.greatest("id", F.lit(1))),
        "foreign": good.withColumn("id", F.col("id") + 1), "blend_old": good, "stacked": good, "tyre_rankblend": good}
    for name, d in bases.items():
        sc.write_oof(d, f"{tmp_path}/oof_{name}.parquet")
        if name != "unsubmitted":
            sc.write_submission(ref.select("id", F.lit(0.5).alias("PitNextLap")), f"{tmp_path}/submission_{name}.csv")
    got = sc.load_pool(spark, str(tmp_path), ref)
    assert {r.base for r in got.select("base").distinct().collect()} == {"good"} and got.count() == 60
    with pytest.raises(ValueError):
        sc.write_oof(good.withColumn("oof", F.lit("x")), f"{tmp_path}/oof_bad.parquet")


def test_external_scan_and_alignment(spark, tmp_path):
    names = [f.name for f in sc.LAP_SCHEMA.fields if f.name != "id"]
    cell = {"Driver": "D001", "Compound": "SOFT"}
    lines = [",".join([*names, "leak"])] + [",".join([*[("" if n == "Compound" and i == 1 else cell.get(n, "1")) for n in names], "0.5"]) for i in range(3)]
    (tmp_path / "ext.csv").write_text("\n".join(lines) + "\n")
    d = sc.scan_external(spark, str(tmp_path / "ext.csv"), "leak")
    assert "leak" not in d.columns and d.count() == 2 and {r.id for r in d.collect()} == {-1}
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.0)], "id long, target double")
    b = spark.createDataFrame([(2, 0.0), (3, 1.0), (4, 1.0), (5, 1.0)], "id long, target double")
    assert tuple(sc.alignment(a, b).first()) == (2, 1, 2, 1)
