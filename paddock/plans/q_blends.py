"""Blend operators, sweeps and weight searches."""

import random

import numpy as np
from pyspark.sql import functions as F

from ..functions import exprs as ex
from ..operators import blends as bl
from ..operators import diagnostics as dg
from ..operators import folds as fo
from ..operators import search as se
from ..operators.auc import auc, batched_auc, blend_expr, with_candidates
from ..operators.contest import best_scored
from ..operators.spread import with_avg_rank, with_position
from ..sources import scans as sc
from ..sources.laps import oof, split_of, with_test
from .q_folds import OOF_FOLDED, oof_folded
from .q_metrics import BASES, auc_sql, efbin_sql, long_sql, rank_sql
from .q_sources import folder
from .registry import on_laps, query, r, r_all, rounded

ADC = {"oof_d": 0.6, "oof_a": 0.3, "oof_c": 0.1}
D = lambda x: f"CAST({x} AS DOUBLE)"


def wsum(cols: dict[str, float], t=lambda c: c) -> str:
    return "(" + " + ".join(f"{D(w)} * {t(c)}" for c, w in cols.items()) + f") / {D(sum(cols.values()))}"


def clip_sql(x: str, lo="0.000001", hi="0.999999") -> str:
    return f"least(greatest({x}, {D(lo)}), {D(hi)})"


def submitted(spark, sf, d, name):
    """A blend of both parts: the out-of-fold rows, and the test rows as the submission file holds them."""
    path = folder(spark, sf, f"submission_{name}.csv")
    test = d.where("part = 'test'").select("id", F.col("score").alias("PitNextLap"))
    sc.write_submission(test, path)
    back = spark.read.schema("id long, PitNextLap double").csv(path, header=True)
    return rounded(d.where("part = 'oof'").select("part", "id", "score").unionByName(back.select(F.lit("test").alias("part"), "id", F.col("PitNextLap").alias("score"))))


@query("B1_weighted_linear", on_laps(f"SELECT part, id, {r(wsum(ADC), 'score')} FROM both_parts"))
def b1(spark, sf):
    # aligned by key, one table per base, never by row position
    d = with_test(spark, sf)
    wide = d.select("part", "id", "oof_d")
    for b in ("oof_a", "oof_c"):
        wide = wide.join(d.select("part", "id", b), ["part", "id"])
    return submitted(spark, sf, wide.withColumn("score", bl.weighted(ADC)), "linear")


@query("B2_weighted_geometric", on_laps(
    f"SELECT part, id, {r(wsum(ADC, lambda c: f'ln({clip_sql(c, 1e-6, 1 - 1e-6)})'), 'score')} FROM both_parts"))
def b2(spark, sf):
    return submitted(spark, sf, with_test(spark, sf).withColumn("score", bl.geometric(ADC)), "geometric")


RANKED = ("ranked", "SELECT *, " + ", ".join(f"{rank_sql(b)} AS r_{b}" for b in BASES) + ", count(*) OVER () AS nn FROM oof")
RANKED_PARTS = ("ranked_parts", "SELECT *, " + ", ".join(f"{rank_sql(b, 'part')} AS r_{b}" for b in BASES)
                + ", count(*) OVER (PARTITION BY part) AS nn FROM both_parts")


@query("B3_rank_percentile", on_laps(f"SELECT part, id, {r(wsum(ADC, lambda c: f'(r_{c} / nn)'), 'score')} FROM ranked_parts", RANKED_PARTS))
def b3(spark, sf):
    return submitted(spark, sf, bl.rank_percentile(with_test(spark, sf), ADC, "score", ["part"]), "rank")


@query("B4_multi_seed_mean", on_laps(
    f"SELECT part, id, {r('avg(score)', 'score')}, count(*) AS members FROM ({long_sql('both_parts', 'part, id')}) GROUP BY part, id HAVING count(*) >= 2"))
def b4(spark, sf):
    d = dg.long_scores(with_test(spark, sf), BASES, ["part", "id"])
    g = d.groupBy("part", "id").agg(F.avg("score").alias("score"), F.count("*").alias("members"))
    return rounded(g.where(F.col("members") >= 2))


def two_sql(a: str, s: str, w) -> str:
    return clip_sql(f"(1 - {D(w)}) * {a} + {D(w)} * {s}")


@query("B5_two_model_linear", on_laps(f"SELECT id, {r(two_sql('oof_d', 'oof_a', 0.25), 'score')} FROM oof"))
def b5(spark, sf):
    return rounded(oof(spark, sf).select("id", bl.two_model(F.col("oof_d"), F.col("oof_a"), 0.25).alias("score")))


UNIT = ("unit", "SELECT *, " + ", ".join(f"(r_{b} - 1) / greatest(nn - 1, 1) AS u_{b}" for b in BASES) + " FROM ranked")


def mix_sql(kind: str, w) -> str:
    if kind == "rank":
        return f"(1 - {D(w)}) * u_oof_d + {D(w)} * u_oof_a"
    x = lambda c: f"ln({clip_sql(c)} / (1.0 - {clip_sql(c)}))"
    return f"round((1 - {D(w)}) * {x('u_oof_d')} + {D(w)} * {x('u_oof_a')}, 9)"


def remap_sql(kind: str, w) -> str:
    return f"""SELECT a.id, a.target, {clip_sql('b.oof_d')} AS score
      FROM (SELECT *, row_number() OVER (ORDER BY {mix_sql(kind, w)}, id) AS p FROM unit) a
      JOIN (SELECT oof_d, row_number() OVER (ORDER BY oof_d, id) AS p FROM oof) b ON a.p = b.p"""


@query("B6_rank_blend_remapped", on_laps(f"SELECT id, {r_all('score')} FROM ({remap_sql('rank', 0.3)})", RANKED, UNIT))
def b6(spark, sf):
    return rounded(bl.rank_blend(oof(spark, sf), "oof_d", "oof_a", 0.3, "score").select("id", "score"))


@query("B7_logit_rank_blend", on_laps(f"SELECT id, {r_all('score')} FROM ({remap_sql('logit', 0.3)})", RANKED, UNIT))
def b7(spark, sf):
    return rounded(bl.rank_blend(oof(spark, sf), "oof_d", "oof_a", 0.3, "score", bl.logit_mix).select("id", "score"))


def gated_sql(w) -> str:
    return f"CASE WHEN oof_d BETWEEN 0.05 AND 0.95 THEN {two_sql('oof_d', 'oof_a', w)} ELSE {clip_sql('oof_d')} END"


@query("B8_confidence_gated", on_laps(f"SELECT id, {r(gated_sql(0.3), 'score')} FROM oof"))
def b8(spark, sf):
    return rounded(oof(spark, sf).select("id", bl.gated(F.col("oof_d"), F.col("oof_a"), 0.3).alias("score")))


def piece_sql(clip_scale: bool) -> str:
    scale = f"(avg(oof_a) OVER (PARTITION BY b) + {D(1e-9)}) / (avg(oof_d) OVER (PARTITION BY b) + {D(1e-9)})"
    if clip_scale:
        scale = f"least(greatest({scale}, {D(0.8)}), {D(1.25)})"
    return f"SELECT id, target, {clip_sql(f'oof_d * ({scale})')} AS score FROM ({efbin_sql('oof', 'oof_d', 20)})"


@query("B9_piecewise_rescale", on_laps(
    f"SELECT id, {r('a.score', 'score')}, {r('b.score', 'clipped')} FROM ({piece_sql(False)}) a JOIN ({piece_sql(True)}) b USING (id)"))
def b9(spark, sf):
    d = bl.piecewise(oof(spark, sf), "oof_d", "oof_a", "score")
    return rounded(bl.piecewise(d, "oof_d", "oof_a", "clipped", scale_clip=(0.8, 1.25)).select("id", "score", "clipped"))


@query("B10_remap_by_rank", on_laps(f"""
    SELECT a.id, {r('b.oof_d', 'score')} FROM ranked a
    JOIN (SELECT oof_d, row_number() OVER (ORDER BY oof_d, id) AS p FROM oof) b ON b.p = CAST(floor(a.r_oof_a) AS BIGINT)""", RANKED))
def b10(spark, sf):
    return rounded(bl.remap_by_rank(oof(spark, sf).drop("score"), "oof_a", "oof_d", "score").select("id", "score"))


def logit_rank_sql(c: str) -> str:
    x = clip_sql(f"r_{c} / (nn - 1)")
    return f"ln({x} / (1.0 - {x}))"


@query("B11_logit_of_rank", on_laps(f"SELECT id, {r(wsum(ADC, logit_rank_sql), 'score')} FROM ranked", RANKED))
def b11(spark, sf):
    return rounded(bl.logit_of_rank(oof(spark, sf), ADC, "score").select("id", "score"))


@query("B12_tail_rank_blend", on_laps(f"""
    SELECT id, {r('''CASE WHEN ra >= (SELECT quantile_cont(r_oof_d / nn, 0.9) FROM ranked)
      THEN (1 - 0.3::DOUBLE) * ra + 0.3::DOUBLE * rs ELSE ra END''', 'score')}
    FROM (SELECT id, r_oof_d / nn AS ra, r_oof_a / nn AS rs FROM ranked)""", RANKED))
def b12(spark, sf):
    return rounded(bl.tail_rank_blend(oof(spark, sf), "oof_d", "oof_a", 0.3, 0.9, "score").select("id", "score"))


SLICE_GRID = [round(0.05 * i, 3) for i in range(9)]
BUCKET_GRID = [round(0.025 * i, 3) for i in range(17)]


def sliced_sql(source: str, grid) -> str:
    ws = ", ".join(D(w) for w in grid)
    exploded = f"""(SELECT o.k AS ko, w.w AS w, t.slice, t.target, (1 - w.w) * t.oof_d + w.w * t.oof_a AS s
      FROM {source} t JOIN (SELECT unnest(range(5)) AS k) o ON o.k <> t.fold CROSS JOIN (SELECT unnest([{ws}]) AS w) w)"""
    return f"""SELECT t.id, t.slice, {r('coalesce(b.w, 0.2)', 'w')},
        {r('(1 - coalesce(b.w, 0.2::DOUBLE)) * oof_d + coalesce(b.w, 0.2::DOUBLE) * oof_a', 'score')}
      FROM {source} t LEFT JOIN (SELECT ko, slice, w FROM (
        SELECT *, row_number() OVER (PARTITION BY ko, slice ORDER BY auc DESC, w) AS best
        FROM ({auc_sql(exploded, 'ko, slice, w', 's', 'target')}) WHERE n >= 100 AND n_pos >= 5 AND n_pos <= n - 5)
        WHERE best = 1) b ON b.ko = t.fold AND b.slice = t.slice"""


@query("B13_slice_weights", on_laps(sliced_sql("sl", SLICE_GRID), OOF_FOLDED, ("sl", """
    SELECT o.*, concat(t.Year, '_', CASE WHEN Position_Change < 0 THEN 'neg' WHEN Position_Change > 0 THEN 'pos' ELSE 'zero' END,
      '_', CASE WHEN PitStop <= 0.5 THEN 'lo' ELSE 'hi' END) AS slice FROM oof_folded o JOIN train t ON t.id = o.id""")))
def b13(spark, sf):
    sign = F.when(F.col("Position_Change") < 0, "neg").when(F.col("Position_Change") > 0, "pos").otherwise("zero")
    pit = F.when(F.col("PitStop") <= 0.5, "lo").otherwise("hi")
    s = split_of(spark, sf, "train").select("id", F.concat_ws("_", "Year", sign, pit).alias("slice"))
    d = bl.sliced_weights(oof_folded(spark, sf).join(s, "id"), "slice", "fold", SLICE_GRID, "oof_d", "oof_a", "score")
    return rounded(d.select("id", "slice", "w", "score"))


@query("B14_bucket_weights", on_laps(sliced_sql("bk", BUCKET_GRID), OOF_FOLDED, ("bk", """
    SELECT *, CAST(least(floor((row_number() OVER (ORDER BY oof_d, id) - 1) / (count(*) OVER () / CAST(5 AS DOUBLE))), 4) AS INT)
      AS slice FROM oof_folded""")))
def b14(spark, sf):
    d = with_position(oof_folded(spark, sf), [], ["oof_d", "id"], "_p")
    size = d.agg(F.count("*")).scalar() / F.lit(5.0)
    d = d.withColumn("slice", F.least(F.floor((F.col("_p") - 1) / size), F.lit(4)).cast("int")).drop("_p")
    d = bl.sliced_weights(d, "slice", "fold", BUCKET_GRID, "oof_d", "oof_a", "score")
    return rounded(d.select("id", "slice", "w", "score"))


def cands_sql(bases, cands) -> str:
    """AUC per labelled weight vector: (cand, auc, n, n_pos)."""
    rows = ", ".join("('" + c["id"] + "', [" + ", ".join(D(x) for x in c["w"]) + "])" for c in cands)
    score = " + ".join(f"w[{i + 1}] * {b}" for i, b in enumerate(bases))
    return auc_sql(f"(SELECT cand, target, {score} AS s FROM oof CROSS JOIN (VALUES {rows}) c(cand, w))", "cand", "s", "target")


LINE = [{"id": f"{i * 0.05:.2f}", "w": [round(1 - i * 0.05, 2), round(i * 0.05, 2)]} for i in range(21)]
DAC = ["oof_d", "oof_a", "oof_c"]
DAC3 = ["oof_d", "oof_c", "oof_a"]
SIMPLEX = [{"id": f"{i}|{j}|{10 - i - j}", "w": [i / 10, j / 10, (10 - i - j) / 10]}
           for i in range(11) for j in range(11 - i)]


def sweep_query(bases, cands):
    def run(spark, sf):
        a = batched_auc(oof(spark, sf), bases, cands)
        anchor = auc(oof(spark, sf), [], bases[0], "target").select("auc").scalar()
        return rounded(a.select("cand", "auc", (F.col("auc") - anchor).alias("delta")))
    return run


def sweep_sql(bases, cands):
    base = f"(SELECT auc FROM ({auc_sql('oof', '', bases[0], 'target')}))"
    return on_laps(f"SELECT cand, {r('auc', 'auc')}, {r(f'auc - {base}', 'delta')} FROM ({cands_sql(bases, cands)})")


query("B15_weight_line", sweep_sql(["oof_d", "oof_a"], LINE))(sweep_query(["oof_d", "oof_a"], LINE))
query("B15_weight_simplex", sweep_sql(DAC, SIMPLEX))(sweep_query(DAC, SIMPLEX))


COARSE = [(c, l) for c in (0.1, 0.15, 0.2) for l in (0.0, 0.025, 0.05, 0.075, 0.1)]
OFFSETS = (-0.025, -0.0125, 0.0, 0.0125, 0.025)
THREE = "(1 - w_c - w_a) * oof_d + w_c * oof_c + w_a * oof_a"


def stage_auc_sql(points: str) -> str:
    return auc_sql(f"(SELECT w_c, w_a, target, {THREE} AS s FROM oof CROSS JOIN {points})", "w_c, w_a", "s", "target")


@query("B15_coarse_to_fine", on_laps(
    " UNION ALL ".join(f"SELECT '{n}' AS stage, {r_all('w_c', 'w_a', 'auc')} FROM {n}" for n in ("coarse", "fine")),
    ("coarse", stage_auc_sql("(VALUES " + ", ".join(f"({D(c)}, {D(l)})" for c, l in COARSE) + ") g(w_c, w_a)")),
    ("top", "SELECT w_c AS c0, w_a AS a0 FROM coarse ORDER BY auc DESC, w_c, w_a LIMIT 1"),
    ("points", f"""SELECT DISTINCT round(greatest(c0 + x.o, 0), 6) AS w_c, round(greatest(a0 + y.o, 0), 6) AS w_a
      FROM top CROSS JOIN (SELECT unnest([{', '.join(D(o) for o in OFFSETS)}]) AS o) x
      CROSS JOIN (SELECT unnest([{', '.join(D(o) for o in OFFSETS)}]) AS o) y"""),
    ("fine", stage_auc_sql("points"))))
def b15_fine(spark, sf):
    """A coarse grid of two support weights beside the anchor's, then a finer grid around its best point."""
    d = oof(spark, sf)
    stage = lambda points: batched_auc(d, DAC3, [{"id": f"{c:.6f}|{a:.6f}", "w": [1 - c - a, c, a]} for c, a in points])
    coarse = stage(COARSE)
    rows = sorted((-x["auc"], *map(float, x["cand"].split("|"))) for x in coarse.collect())  # one row per grid point
    _, c0, a0 = rows[0]
    fine = stage(sorted({(round(max(c0 + x, 0), 6), round(max(a0 + y, 0), 6)) for x in OFFSETS for y in OFFSETS}))
    at = lambda i: F.split("cand", r"\|")[i].cast("double")
    name = lambda t, n: t.select(F.lit(n).alias("stage"), at(0).alias("w_c"), at(1).alias("w_a"), "auc")
    return rounded(name(coarse, "coarse").unionByName(name(fine, "fine")))


OP_W = [0.1, 0.2, 0.3]


@query("B16_operator_sweep", on_laps(
    f"SELECT op, w, {r_all('auc')} FROM ({auc_sql('ops', 'op, w', 's', 'target')})", RANKED, UNIT,
    ("ops", " UNION ALL ".join(
        [f"SELECT 'linear' AS op, {D(w)} AS w, target, {two_sql('oof_d', 'oof_a', w)} AS s FROM oof" for w in OP_W]
        + [f"SELECT 'gated', {D(w)}, target, {gated_sql(w)} FROM oof" for w in OP_W]
        + [f"SELECT 'rank', {D(w)}, target, score FROM ({remap_sql('rank', w)})" for w in OP_W]
        + [f"SELECT 'logit_rank', {D(w)}, target, score FROM ({remap_sql('logit', w)})" for w in OP_W]
        + [f"SELECT 'piecewise', {D(0)}, target, score FROM ({piece_sql(False)})"]))))
def b16(spark, sf):
    d = oof(spark, sf).select("id", "target", "oof_d", "oof_a")
    a, s, w = F.col("oof_d"), F.col("oof_a"), F.col("cand.w")
    plain = with_candidates(d, [{"op": op, "w": x} for op in ("linear", "gated") for x in OP_W])
    plain = plain.select("cand.op", "cand.w", "target",
                         F.when(F.col("cand.op") == "linear", bl.two_model(a, s, w)).otherwise(bl.gated(a, s, w)).alias("s"))
    u = bl.add_unit_ranks(d, ["oof_d", "oof_a"])
    ranked = with_candidates(u, [{"op": op, "w": x} for op in ("rank", "logit_rank") for x in OP_W])
    mix = F.when(F.col("cand.op") == "rank", bl.rank_mix("oof_d", "oof_a", w)).otherwise(bl.logit_mix("oof_d", "oof_a", w))
    ranked = ranked.select("id", "cand.op", "cand.w", "target", mix.alias("_mix"))
    placed = with_position(ranked, ["op", "w"], ["_mix", "id"], "_pos").join(bl.sorted_values(d, "oof_d", "s"), "_pos")
    placed = placed.select("op", "w", "target", ex.clip(F.col("s"), bl.LOW, bl.HIGH).alias("s"))
    piece = bl.piecewise(d, "oof_d", "oof_a", "s").select(F.lit("piecewise").alias("op"), F.lit(0.0).alias("w"), "target", "s")
    long = plain.unionByName(placed).unionByName(piece)
    return rounded(auc(long, ["op", "w"], "s", "target").select("op", "w", "auc"))


MOVES = [{"id": m, "w": w} for m, w in se.coordinate_moves(np.array([0.6, 0.3, 0.1]))]
query("B17_coordinate_pass", sweep_sql(DAC, MOVES))(sweep_query(DAC, MOVES))


def weights_frame(spark, rows):
    """One row per (search, base) of fitted weights."""
    return spark.createDataFrame(rows, "search string, base string, weight double, auc double")


def rows_of(found, bases, names):
    return [(n, b, round(float(x), 6), round(f.auc, 6)) for n, f in zip(names, found) for b, x in zip(bases, f.weights)]


def with_mean(spark, sf, bases, found, names):
    """The weights of every bag, and their mean with its AUC on all rows."""
    mean = sum(f.weights for f in found)
    mean = mean / mean.sum()
    top = se.score_moves(se.prepare(oof(spark, sf), bases, "target"), bases, "target", [(0, mean.tolist())])
    return weights_frame(spark, rows_of([*found, se.Found(mean, top[0], True)], bases, [*names, "mean"]))


EQUAL = [1, 1, 1]
BAGS = 20


@query("B17_coordinate_descent")
def b17(spark, sf):
    t = se.prepare(oof(spark, sf), DAC, "target")
    return weights_frame(spark, rows_of(se.coordinate_descent(t, DAC, "target", [EQUAL]), DAC, ["all"]))


@query("B18_nested_blend")
def b18(spark, sf):
    d = oof_folded(spark, sf)
    t = se.prepare(d, DAC, "target", [F.col("fold") != k for k in range(5)])
    found = se.coordinate_descent(t, DAC, "target", [EQUAL] * 5)
    return rounded(se.apply_fold_weights(d, DAC, "fold", {k: f.weights for k, f in enumerate(found)}, "score").select(
        "id", "fold", "target", "score"))


@query("B19_bagged_weights")
def b19(spark, sf):
    """Bags of half as many rows as there are, drawn with replacement."""
    t = se.prepare(fo.exact_bags(oof(spark, sf).select("id", *DAC, "target"), 0.5, list(range(100, 100 + BAGS))), DAC, "target", "bags")
    found = se.coordinate_descent(t, DAC, "target", [EQUAL] * BAGS)
    return with_mean(spark, sf, DAC, found, [f"bag{b}" for b in range(BAGS)])


GREEDY_FIRST = [{"id": f"{b}", "w": [(int(i < 3) + int(i == j)) / 4 for i in range(4)]} for j, b in enumerate(BASES)]
query("B20_greedy_first_step", sweep_sql(BASES, GREEDY_FIRST))(sweep_query(BASES, GREEDY_FIRST))


@query("B20_greedy_selection")
def b20(spark, sf):
    t = se.prepare(oof(spark, sf), BASES, "target")
    return weights_frame(spark, rows_of(se.greedy(t, BASES, "target", [[0, 1, 2, 3]]), BASES, ["all"]))


@query("B21_nested_greedy")
def b21(spark, sf):
    d = oof_folded(spark, sf)
    t = se.prepare(d, BASES, "target", [F.col("fold") != k for k in range(5)])
    found = se.greedy(t, BASES, "target", [[0, 1, 2, 3]] * 5)
    return rounded(se.apply_fold_weights(d, BASES, "fold", {k: f.weights for k, f in enumerate(found)}, "score").select(
        "id", "fold", "target", "score"))


@query("B21_bagged_greedy")
def b21_bagged(spark, sf):
    """Bags of 0.6 of the models, three at least."""
    rng = random.Random(0)
    allowed = [sorted(rng.sample(range(4), max(3, int(0.6 * 4)))) for _ in range(BAGS)]
    t = se.prepare(oof(spark, sf), BASES, "target")
    return with_mean(spark, sf, BASES, se.greedy(t, BASES, "target", allowed, on=[0] * BAGS), [f"bag{i}" for i in range(BAGS)])


@query("B22_gram_matrix", on_laps(" UNION ALL ".join(
    f"SELECT fold, {i} AS i, {j} AS j, {r(f'sum({a} * {b})', 'v')} FROM oof_folded GROUP BY fold"
    for i, a in enumerate(DAC) for j, b in [*[(j, b) for j, b in enumerate(DAC) if j >= i], (-1, "target")]), OOF_FOLDED))
def b22_gram(spark, sf):
    return rounded(se.gram(oof_folded(spark, sf), DAC, "target", ["fold"]))


@query("B22_crossfit_nnls")
def b22(spark, sf):
    return rounded(se.crossfit_nnls(oof_folded(spark, sf), DAC, "target", "fold", "score").select("id", "fold", "target", "score"))


MEMBERS = ["s1", "s2", "s3"]
SUB_GRID = [round(0.05 * i, 3) for i in range(9)]
SUBSETS = se.subsets(MEMBERS, "oof_a", SUB_GRID)
SEEDS_SQL = ("seeds", "SELECT id, target, oof_a, " + ", ".join(
    f"0.9::DOUBLE * oof_d + 0.1::DOUBLE * (CAST((id * {p}) % 1009 AS DOUBLE) / 1009::DOUBLE) AS s{i + 1}"
    for i, p in enumerate((7919, 104729, 1299709))) + " FROM oof")


def subset_rows() -> str:
    rows = ", ".join("('" + c["subset"] + f"', {c['k']}, {D(c['grid_w'])}, [" + ", ".join(D(x) for x in c["w"]) + "])" for c in SUBSETS)
    return f"(VALUES {rows}) c(subset, k, grid_w, w)"


@query("B23_subset_enumeration", on_laps(f"""
    SELECT a.subset, a.k, {r('a.m0', 'member_auc')}, {r('rho', 'rank_corr')}, {r('a.bw', 'best_w')}, {r('a.ba', 'best_auc')},
      {r('a.ba - f.ba', 'delta')}
    FROM (SELECT subset, k, max(auc) FILTER (WHERE grid_w = 0) AS m0, max(auc) AS ba, arg_max(grid_w, (auc, -grid_w)) AS bw
      FROM ({auc_sql('expanded', 'subset, k, grid_w', 's', 'target')}) GROUP BY subset, k) a
    JOIN (SELECT subset, corr(rs, ra) AS rho FROM (SELECT subset, {rank_sql('s', 'subset')} AS rs, {rank_sql('oof_a', 'subset')} AS ra
      FROM expanded WHERE grid_w = 0) GROUP BY subset) c ON c.subset = a.subset
    CROSS JOIN (SELECT max(auc) AS ba FROM ({auc_sql('expanded', 'subset, grid_w', 's', 'target')}) WHERE subset = 's1+s2+s3') f""",
    SEEDS_SQL, ("expanded", f"""SELECT subset, k, grid_w, target, oof_a, w[1] * s1 + w[2] * s2 + w[3] * s3 + w[4] * oof_a AS s
      FROM seeds CROSS JOIN {subset_rows()}""")))
def b23(spark, sf):
    noise = lambda p: (F.col("id") * p % 1009).cast("double") / 1009.0
    d = oof(spark, sf).withColumns({f"s{i + 1}": 0.9 * F.col("oof_d") + 0.1 * noise(p)
                                    for i, p in enumerate((7919, 104729, 1299709))})
    x = with_candidates(d.select("id", "target", "oof_a", *MEMBERS), SUBSETS)
    x = x.select("target", "oof_a", "cand.subset", "cand.k", "cand.grid_w", blend_expr([*MEMBERS, "oof_a"], F.col("cand.w")).alias("s"))
    # the members alone (weight 0) are reported, and of the rest only what can be a subset's best
    a = best_scored(x, ["subset", "k"], "grid_w", "s", "target", always=F.col("grid_w") == 0, sized_on=(d, []))
    best = a.groupBy("subset", "k").agg(
        F.max(F.when(F.col("grid_w") == 0, F.col("auc"))).alias("member_auc"),
        F.max_by("grid_w", F.struct("auc", -F.col("grid_w"))).alias("best_w"), F.max("auc").alias("best_auc"))
    alone = x.where(F.col("grid_w") == 0)
    ranks = with_avg_rank(alone, ["subset"], {"s": "_rs", "oof_a": "_ra"}, "raw")
    rho = ranks.groupBy("subset").agg(ex.correlation(F.col("_rs"), F.col("_ra")).alias("rank_corr"))
    whole = a.where(F.col("subset") == "+".join(MEMBERS)).agg(F.max("auc")).scalar()
    return rounded(best.join(rho, "subset").withColumn("delta", F.col("best_auc") - whole))


NAMED = [
    ("all", "lin", {"oof_a": 0.2, "oof_b": 0.1, "oof_c": 0.2, "oof_d": 0.5}), ("drop_noise", "lin", {"oof_a": 0.2, "oof_c": 0.2, "oof_d": 0.5}),
    ("drop_pace", "lin", {"oof_a": 0.2, "oof_b": 0.1, "oof_d": 0.5}), ("strong_only", "lin", {"oof_d": 1.0}),
    ("weak_only", "lin", {"oof_a": 0.4, "oof_b": 0.2, "oof_c": 0.4}), ("all_geo", "geo", {"oof_a": 0.2, "oof_b": 0.1, "oof_c": 0.2, "oof_d": 0.5}),
    ("all_rank", "rank", {"oof_a": 0.2, "oof_b": 0.1, "oof_c": 0.2, "oof_d": 0.5}),
]
MODE_SQL = {"lin": lambda c: c, "geo": lambda c: f"ln({clip_sql(c, 1e-6, 1 - 1e-6)})", "rank": lambda c: f"(r_{c} / nn)"}


@query("B24_named_candidates", on_laps(
    f"""SELECT a.cand, {r('a.auc', 'auc')}, {r('t.score', 'test_mean')}, t.n AS n_test
    FROM ({auc_sql("(SELECT * FROM named WHERE part = 'oof')", 'cand', 'score', 'target')}) a
    JOIN (SELECT cand, avg(score) AS score, count(*) AS n FROM named WHERE part = 'test' GROUP BY cand) t ON t.cand = a.cand""",
    RANKED_PARTS, ("named", " UNION ALL ".join(
        f"SELECT '{n}' AS cand, part, target, {wsum(w, MODE_SQL[m])} AS score FROM ranked_parts" for n, m, w in NAMED))))
def b24(spark, sf):
    """Named candidates, each blended its own way on both parts: AUC of the first, mean of the second."""
    d = with_avg_rank(with_test(spark, sf), ["part"], {b: f"r_{b}" for b in BASES})
    how = {"lin": bl.weighted, "geo": bl.geometric, "rank": lambda w: bl.weighted({f"r_{c}": x for c, x in w.items()})}
    cands = F.array(*[F.struct(F.lit(n).alias("cand"), how[m](w).alias("score")) for n, m, w in NAMED])
    long = d.select("part", "target", F.explode(cands).alias("x")).select("part", "target", "x.*")
    tops = auc(long.where("part = 'oof'"), ["cand"], "score", "target", sized_on=(d.where("part = 'oof'"), []))
    means = long.where("part = 'test'").groupBy("cand").agg(F.avg("score").alias("test_mean"), F.count("*").alias("n_test"))
    return rounded(tops.select("cand", "auc").join(means, "cand"))


@query("B25_rank_normalise", on_laps(f"""
    SELECT base, id, outside AS normalised, {r('CASE WHEN outside THEN pct ELSE score END', 'score')} FROM (
      SELECT *, {rank_sql('score', 'base')} / count(*) OVER (PARTITION BY base) AS pct,
        min(score) OVER (PARTITION BY base) < -0.000001 OR max(score) OVER (PARTITION BY base) > 1.000001 AS outside
      FROM ({long_sql('(SELECT o.*, LapTime AS raw_pace FROM oof o JOIN train t ON t.id = o.id)', 'id', [*BASES, 'raw_pace'])}))"""))
def b25(spark, sf):
    d = oof(spark, sf).join(split_of(spark, sf, "train").select("id", F.col("LapTime").alias("raw_pace")), "id")
    return rounded(bl.normalise_scores(dg.long_scores(d, [*BASES, "raw_pace"], ["id"])))
