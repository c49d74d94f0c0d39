"""Metrics and diagnostics over the prediction table."""

import re

from pyspark.sql import functions as F

from ..functions import exprs as ex
from ..operators import diagnostics as dg
from ..operators.auc import auc
from ..operators.reports import tie_clusters
from ..sources.laps import CATS, NUMS, laps, oof, split_of, table
from .features import features
from .q_features import FEATURE_CTES
from .q_folds import OOF_FOLDED, oof_folded
from .registry import on_laps, query, r, r_all, rounded

BASES = ["oof_a", "oof_b", "oof_c", "oof_d"]


def auc_sql(source: str, by: str, score: str, label: str) -> str:
    """Tie-aware AUC per group; `by` may be several columns or empty."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {g}sum(pos * (cum - neg + neg / CAST(2 AS DOUBLE))) / nullif(sum(pos) * sum(neg), 0) AS auc,
        CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos
      FROM (SELECT *, sum(neg) OVER ({part}ORDER BY sc_) AS cum FROM (
        SELECT {g}{score} AS sc_, CAST(sum({label}) AS DOUBLE) AS pos, CAST(sum(1 - {label}) AS DOUBLE) AS neg
        FROM {source} WHERE {score} IS NOT NULL GROUP BY {g}{score}))
      {f'GROUP BY {by}' if by else ''}"""


def long_sql(source: str, keep: str, bases=BASES) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{b}' AS base, {b} AS score FROM {source}" for b in bases)


LONG = ("longp", long_sql("oof_folded", "id, fold, Year, Race, Compound, target"))
LL = "-(target * ln(p) + (1 - target) * ln(1 - p))"
CLIP = "least(greatest(score, 0.0000001::DOUBLE), 1 - 0.0000001::DOUBLE)"
BLEND = "0.8::DOUBLE * oof_d + 0.2::DOUBLE * oof_a"


def blend(d):
    return d.withColumn("score", 0.8 * F.col("oof_d") + 0.2 * F.col("oof_a"))


@query("A1_roc_auc", on_laps(f"SELECT base, {r_all('auc')}, n, n_pos FROM ({auc_sql('longp', 'base', 'score', 'target')})",
                             OOF_FOLDED, LONG))
def a1(spark, sf):
    return rounded(auc(dg.long_scores(oof(spark, sf), BASES, ["target"]), ["base"], "score", "target"))


@query("A1_roc_auc_documents", """
    SELECT lang, round(CAST(auc AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) AS auc, n, n_pos FROM (%s)""" % auc_sql(
    "(SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id))", "lang", "n_chars", "quality"))
def a1_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(auc(d, ["lang"], "n_chars", "quality"))


@query("A2_log_loss", on_laps(f"""SELECT base, {r(f'avg({LL})', 'logloss')}
    FROM (SELECT *, {CLIP} AS p FROM longp) GROUP BY base""", OOF_FOLDED, LONG))
def a2(spark, sf):
    d = dg.long_scores(oof(spark, sf), BASES, ["target"])
    return rounded(d.groupBy("base").agg(F.avg(ex.log_loss_row(F.col("target"), F.col("score"))).alias("logloss")))


FOLD_AUC = ("fold_auc", auc_sql("longp", "base, fold", "score", "target"))


@query("A3_fold_auc", on_laps(f"""SELECT base, {r('avg(auc)', 'mean_auc')}, {r('stddev_pop(auc)', 'std_auc')},
    {r('min(auc)', 'min_auc')}, {r('max(auc)', 'max_auc')} FROM fold_auc GROUP BY base""", OOF_FOLDED, LONG, FOLD_AUC))
def a3(spark, sf):
    a = auc(dg.long_scores(oof_folded(spark, sf), BASES, ["fold", "target"]), ["base", "fold"], "score", "target")
    return rounded(a.groupBy("base").agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
        F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc")))


def slice_sql(source: str, by: str, min_n: int) -> str:
    on = " AND ".join(f"l.{c} = a.{c}" for c in by.split(", "))
    cols = ", ".join(f"a.{c}" for c in by.split(", "))
    return f"""SELECT {cols}, n, n_pos / CAST(n AS DOUBLE) AS pos_rate, auc, logloss
      FROM ({auc_sql(source, by, 'score', 'target')}) a
      JOIN (SELECT {by}, avg({LL}) AS logloss FROM (SELECT *, {CLIP} AS p FROM {source}) GROUP BY {by}) l ON {on}
      WHERE n >= {min_n} AND auc IS NOT NULL"""


@query("A4_slice_auc", on_laps(
    f"SELECT base, Year, Compound, n, {r_all('pos_rate', 'auc', 'logloss')} FROM ({slice_sql('longp', 'base, Year, Compound', 50)})",
    OOF_FOLDED, LONG))
def a4(spark, sf):
    d = dg.long_scores(oof(spark, sf), BASES, ["Year", "Compound", "target"])
    return rounded(dg.slice_table(d, ["base", "Year", "Compound"]))


# slice edges, fixed values
EDGES = {
    "TyreLife": [5, 10, 15, 20, 30, 50], "Position": [3, 6, 10, 15],
    "LapsRemaining": [5, 10, 20, 30, 50], "Stint": [1, 2, 3],
}


def bucket(x):
    edges = EDGES[x]
    return ex.right_closed(F.col(x), edges, [f"le{e}" for e in edges] + ["more"])


def bucket_sql(x):
    return "CASE " + " ".join(f"WHEN {x} <= {e} THEN 'le{e}'" for e in EDGES[x]) + " ELSE 'more' END"


def qbin_sql(x: str, bins: int, source: str) -> str:
    qs = ", ".join(str(i / bins) for i in range(1, bins))
    return f"(SELECT count(*) FROM (SELECT DISTINCT unnest(quantile_cont({x}, [{qs}])) AS e FROM {source}) WHERE e < {x})"


SCAN_SQL = {
    "year_compound": "concat(Year, '_', Compound)", "race": "Race",
    "tyrelife_compound": f"concat({bucket_sql('TyreLife')}, '_', Compound)",
    "stint": bucket_sql("Stint"), "position": bucket_sql("Position"), "laps_remaining": bucket_sql("LapsRemaining"),
    "field_pit_share_q": "concat('q', share_bin + 1)",
    **{x: f"CAST({x} AS VARCHAR)" for x in ("is_synthetic_driver", "is_2023", "is_pre_season", "is_wet_race", "sc_likely")},
}
SLICED = [*FEATURE_CTES, ("sliced0", f"""
    SELECT f.*, target, {BLEND} AS score FROM feat f JOIN oof USING (id)"""),
    ("sliced", f"SELECT *, {qbin_sql('field_pit_share', 5, 'sliced0')} AS share_bin FROM sliced0"),
    ("scans", " UNION ALL ".join(
        f"SELECT '{k}' AS scan, {v} AS slice, score, target FROM sliced" for k, v in SCAN_SQL.items()))]


@query("A5_slice_leverage", on_laps(f"""
    SELECT scan, slice, n, {r_all('pos_rate', 'auc', 'logloss', 'lift')} FROM (
      SELECT t.*, n * (w.auc - t.auc) AS lift FROM ({slice_sql('scans', 'scan, slice', 50)}) t
      CROSS JOIN ({auc_sql('sliced', '', 'score', 'target')}) w(auc, wn, wp))
    ORDER BY lift DESC, scan, slice LIMIT 15""", *SLICED))
def a5(spark, sf):
    f = features(spark, sf).where(F.col("split") == "train")
    d = blend(f.join(oof(spark, sf).select("id", "target", "oof_a", "oof_d"), "id"))
    scans = {
        "year_compound": F.concat_ws("_", "Year", "Compound"), "race": F.col("Race"),
        "tyrelife_compound": F.concat_ws("_", bucket("TyreLife"), "Compound"),
        "stint": bucket("Stint"), "position": bucket("Position"), "laps_remaining": bucket("LapsRemaining"),
        "field_pit_share_q": F.concat(F.lit("q"), dg.quantile_bin(d, "field_pit_share", 5) + 1),
        **{x: F.col(x) for x in ("is_synthetic_driver", "is_2023", "is_pre_season", "is_wet_race", "sc_likely")},
    }
    return rounded(dg.leverage(d, scans).orderBy(F.desc("lift"), "scan", "slice").limit(15))


def rank_sql(x: str, part: str = "") -> str:
    p, q = (f"PARTITION BY {part} ", f"PARTITION BY {part}, {x}") if part else ("", f"PARTITION BY {x}")
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / CAST(2 AS DOUBLE))"


PAIRS = [(a, b) for i, a in enumerate(BASES) for b in BASES[i + 1:]]


@query("A6_spearman", on_laps(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr(r_{a}, r_{b})', 'rho')} FROM ranked" for a, b in PAIRS),
    ("ranked", "SELECT " + ", ".join(f"{rank_sql(b)} AS r_{b}" for b in BASES) + " FROM oof")))
def a6(spark, sf):
    return rounded(dg.spearman(oof(spark, sf), BASES))


def efbin_sql(source: str, score: str, bins: int) -> str:
    return f"""SELECT *, CAST(least((row_number() OVER (ORDER BY {score}, id) - 1) //
      greatest((count(*) OVER ()) // {bins}, 1), {bins - 1}) AS INT) AS b FROM {source}"""


@query("A7_calibration", on_laps(f"""
    SELECT b + 1 AS bin, count(*) AS n, {r('avg(score)', 'pred_mean')}, {r('avg(target)', 'actual_rate')},
      {r('avg(score) - avg(target)', 'bias')} FROM ({efbin_sql(f'(SELECT *, {BLEND} AS score FROM oof)', 'score', 10)}) GROUP BY b"""))
def a7(spark, sf):
    return rounded(dg.calibration(blend(oof(spark, sf))))


@query("A8_decile_calibration", on_laps(f"""
    SELECT CAST(d + 1 AS INT) AS decile, count(*) AS n, {r('avg(score)', 'mean_pred')}, {r('avg(target)', 'obs_rate')},
      {r(f'CASE WHEN avg(target) > 0 AND avg(target) < 1 THEN avg({LL}) END', 'logloss')},
      {r('avg(score) - avg(target)', 'bias')}
    FROM (SELECT *, {CLIP} AS p, {qbin_sql('score', 10, 'bl')} AS d FROM bl) GROUP BY d""",
    ("bl", f"SELECT *, {BLEND} AS score FROM oof")))
def a8(spark, sf):
    return rounded(dg.decile_calibration(blend(oof(spark, sf))))


PROFILE_NUM = NUMS
GAPS = ["base_mean", "group_mean", "abs_gap", "rel_gap_pct"]


def profile_sql(source: str, group: str) -> str:
    num = " UNION ALL ".join(
        f"""SELECT '{x}' AS feature, 'numeric' AS kind, b AS base_mean, g AS group_mean, g - b AS abs_gap,
          (g - b) / (abs(b) + 0.000001::DOUBLE) * 100 AS rel_gap_pct FROM (SELECT
          avg({x}) FILTER (WHERE {group} = 0) AS b, avg({x}) FILTER (WHERE {group} = 1) AS g FROM {source})"""
        for x in PROFILE_NUM)
    cat = " UNION ALL ".join(
        f"""SELECT '{x}', 'categorical', NULL, NULL, NULL, 0.5 * sum(abs(c0 / n0 - c1 / n1)) * 100 FROM (
          SELECT CAST(count(*) FILTER (WHERE {group} = 0) AS DOUBLE) AS c0, CAST(count(*) FILTER (WHERE {group} = 1) AS DOUBLE) AS c1,
            (SELECT count(*) FROM {source} WHERE {group} = 0) AS n0, (SELECT count(*) FROM {source} WHERE {group} = 1) AS n1
          FROM {source} WHERE {group} IS NOT NULL GROUP BY {x})""" for x in CATS)
    return f"SELECT feature, kind, {r_all(*GAPS)} FROM ({num} UNION ALL {cat})"


SCORED = ("scored", f"SELECT t.*, target, oof_a, oof_d, {BLEND} AS score FROM train t JOIN oof o ON o.id = t.id")


def scored(spark, sf):
    d = split_of(spark, sf, "train").join(oof(spark, sf).select("id", "target", "oof_a", "oof_d"), "id")
    return blend(d)


@query("A9_residual_profile", on_laps(
    profile_sql("worst", "w"), SCORED,
    ("lossy", f"SELECT *, {LL} AS loss FROM (SELECT *, {CLIP} AS p FROM scored)"),
    ("worst", """SELECT *, CASE WHEN loss <= (SELECT quantile_cont(loss, 0.25) FROM lossy) THEN 0
      WHEN loss > (SELECT quantile_cont(loss, 0.75) FROM lossy) THEN 1 END AS w FROM lossy""")))
def a9(spark, sf):
    return rounded(dg.gap_profile(dg.residual_groups(scored(spark, sf)), "worst", PROFILE_NUM, CATS))


@query("A10_disagreement_profile", on_laps(
    profile_sql("dis", "w"), SCORED,
    ("diffs", f"SELECT *, abs({rank_sql('oof_d')} / count(*) OVER () - {rank_sql('oof_a')} / count(*) OVER ()) AS rd FROM scored"),
    ("dis", "SELECT *, CASE WHEN rd >= (SELECT quantile_cont(rd, 0.95) FROM diffs) THEN 1 ELSE 0 END AS w FROM diffs")))
def a10(spark, sf):
    d = dg.disagreement_groups(scored(spark, sf), "oof_d", "oof_a")
    return rounded(dg.gap_profile(d, "disagree", PROFILE_NUM, CATS))


A11 = {
    **{x: x for x in NUMS},
    "TyreLife_x_Degradation": "TyreLife * Cumulative_Degradation", "LapTime_x_TyreLife": "LapTime * TyreLife",
    "Position_x_RaceProgress": "Position * RaceProgress", "TyreLife_sq": "TyreLife * TyreLife",
    "RaceProgress_sq": "RaceProgress * RaceProgress",
}


@query("A11_residual_correlation", on_laps(" UNION ALL ".join(
    f"SELECT '{k}' AS feature, {r(f'corr({v}, target - score)', 'corr')} FROM scored" for k, v in A11.items()), SCORED))
def a11(spark, sf):
    d = scored(spark, sf)
    c = F.col
    made = {
        "TyreLife_x_Degradation": c("TyreLife") * c("Cumulative_Degradation"), "LapTime_x_TyreLife": c("LapTime") * c("TyreLife"),
        "Position_x_RaceProgress": c("Position") * c("RaceProgress"), "TyreLife_sq": c("TyreLife") * c("TyreLife"),
        "RaceProgress_sq": c("RaceProgress") * c("RaceProgress"),
    }
    return rounded(dg.residual_correlations(d.withColumns(made), list(A11)))


# scores that both splits have, so that a train AUC and a test AUC can be paired
PAIRED = ("paired", """
  SELECT split, Race, base, PitNextLap AS target, score FROM (
    SELECT split, Race, PitNextLap, 'tyre' AS base, TyreLife / (TyreLife + 10::DOUBLE) AS score FROM comb
    UNION ALL SELECT split, Race, PitNextLap, 'pace', LapTime FROM comb
    UNION ALL SELECT split, Race, PitNextLap, 'progress', RaceProgress FROM comb)""")


@query("A12_transfer_fit", on_laps(f"""
    SELECT base, {r('slope', 'slope')}, {r('intercept', 'intercept')}, {r('rstd', 'residual_std')},
      {r('avg(test_auc - (slope * train_auc + intercept))', 'mean_residual')}
    FROM pairs CROSS JOIN fit GROUP BY base, slope, intercept, rstd""", PAIRED,
    ("aucs", auc_sql("paired", "split, Race, base", "score", "target")),
    ("pairs", """SELECT Race, base, max(auc) FILTER (WHERE split = 'train') AS train_auc,
       max(auc) FILTER (WHERE split = 'test') AS test_auc FROM aucs GROUP BY Race, base"""),
    ("line", "SELECT regr_slope(test_auc, train_auc) AS slope, regr_intercept(test_auc, train_auc) AS intercept FROM pairs"),
    ("fit", """SELECT slope, intercept, stddev_pop(test_auc - (slope * train_auc + intercept)) AS rstd
       FROM pairs CROSS JOIN line GROUP BY slope, intercept""")))
def a12(spark, sf):
    d = laps(spark, sf).where(F.col("split") != "ext").select(
        "split", "Race", F.col("PitNextLap").alias("target"), (F.col("TyreLife") / (F.col("TyreLife") + 10.0)).alias("tyre"),
        F.col("LapTime").alias("pace"), F.col("RaceProgress").alias("progress"))
    a = auc(dg.long_scores(d, ["tyre", "pace", "progress"], ["split", "Race", "target"]), ["split", "Race", "base"], "score", "target")
    side = lambda s: F.max(F.when(F.col("split") == s, F.col("auc"))).alias(f"{s}_auc")
    pairs = a.groupBy("Race", "base").agg(side("train"), side("test"))
    slope = F.try_divide(F.covar_pop("test_auc", "train_auc"), F.var_pop("train_auc"))
    line = pairs.dropna().agg(slope.alias("slope"), (F.avg("test_auc") - slope * F.avg("train_auc")).alias("b")).first()
    res = F.col("test_auc") - (line["slope"] * F.col("train_auc") + line["b"])
    spread_of = pairs.agg(F.stddev_pop(res)).scalar()
    return rounded(pairs.groupBy("base").agg(F.avg(res).alias("mean_residual")).select(
        "base", F.lit(line["slope"]).alias("slope"), F.lit(line["b"]).alias("intercept"),
        spread_of.alias("residual_std"), "mean_residual"))


SEED_PRIMES = {1: 7919, 2: 104729, 3: 1299709, 4: 15485863, 5: 32452843}
SEED_MODELS = {
    "comp_a": ("0.9 * oof_a + 0.1 * z", lambda a, c, d, z: 0.9 * a + 0.1 * z),
    "comp_d": ("0.9 * oof_d + 0.1 * z", lambda a, c, d, z: 0.9 * d + 0.1 * z),
    "three": ("0.5 * oof_d + 0.3 * oof_a + 0.2 * z", lambda a, c, d, z: 0.5 * d + 0.3 * a + 0.2 * z),
    "four": ("0.6 * oof_d + 0.2 * oof_a + 0.1 * oof_c + 0.1 * z", lambda a, c, d, z: 0.6 * d + 0.2 * a + 0.1 * c + 0.1 * z),
}


def as_double(sql: str) -> str:
    return re.sub(r"(\d\.\d+)", r"CAST(\1 AS DOUBLE)", sql)


@query("A13_seed_summary", on_laps(f"""
    SELECT {r('quantile_cont(three, 0.5)', 'median_three')}, {r('quantile_cont(four, 0.5)', 'median_four')},
      {r('quantile_cont(four - three, 0.5)', 'median_delta')}, count(*) FILTER (WHERE four >= 0.9) AS n_above_bar,
      count(*) FILTER (WHERE four > three) AS n_improved, count(*) AS n_seeds,
      CASE WHEN quantile_cont(four, 0.5) >= 0.9 THEN 'KEEP' WHEN quantile_cont(four, 0.5) <= 0.8 THEN 'DISCARD'
        ELSE 'INCONCLUSIVE' END AS verdict
    FROM (SELECT seed, max(auc) FILTER (WHERE model = 'three') AS three, max(auc) FILTER (WHERE model = 'four') AS four
      FROM ({auc_sql('seeded', 'seed, model', 'score', 'target')}) GROUP BY seed)""",
    ("seeded", " UNION ALL ".join(
        f"SELECT {s} AS seed, '{m}' AS model, target, {as_double(e)} AS score FROM "
        f"(SELECT *, CAST((id * {p}) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS z FROM oof)"
        for s, p in SEED_PRIMES.items() for m, (e, _) in SEED_MODELS.items()))))
def a13(spark, sf):
    seeds = F.explode(F.create_map(*[F.lit(x) for kv in SEED_PRIMES.items() for x in kv])).alias("seed", "p")
    d = oof(spark, sf).select("*", seeds)
    z = (F.col("id") * F.col("p") % 1009).cast("double") / 1009.0
    a_, c_, d_ = F.col("oof_a"), F.col("oof_c"), F.col("oof_d")
    d = d.select("seed", "target", *[fn(a_, c_, d_, z).alias(m) for m, (_, fn) in SEED_MODELS.items()])
    t = auc(dg.long_scores(d, list(SEED_MODELS), ["seed", "target"]), ["seed", "base"], "score", "target")
    one = lambda m: F.max(F.when(F.col("base") == m, F.col("auc"))).alias(m)
    per_seed = t.groupBy("seed").agg(*[one(m) for m in SEED_MODELS])
    four = F.median("four")
    return rounded(per_seed.agg(
        F.median("three").alias("median_three"), four.alias("median_four"),
        F.median(F.col("four") - F.col("three")).alias("median_delta"),
        F.count_if(F.col("four") >= 0.9).alias("n_above_bar"),
        F.count_if(F.col("four") > F.col("three")).alias("n_improved"), F.count("*").alias("n_seeds"),
        F.when(four >= 0.9, "KEEP").when(four <= 0.8, "DISCARD").otherwise("INCONCLUSIVE").alias("verdict")))


BOTH = ("both2", f"""SELECT fold, Year, Compound, target, 'base' AS base, oof_d AS score FROM oof_folded
  UNION ALL SELECT fold, Year, Compound, target, 'cand', {BLEND} FROM oof_folded""")


def both(spark, sf):
    d = blend(oof_folded(spark, sf)).withColumnsRenamed({"score": "cand", "oof_d": "base_"})
    return d.select("fold", "Year", "Compound", "target", F.col("base_").alias("base"), "cand")


def side_by_side(a, keys):
    pick = lambda m, c="auc": F.max(F.when(F.col("base") == m, F.col(c)))
    return a.groupBy(*keys).agg(pick("base").alias("base_auc"), pick("cand").alias("cand_auc"), F.max("n").alias("n"))


@query("A14_acceptance_gate", on_laps(f"""
    SELECT {r_all('base_mean', 'cand_mean', 'base_std')}, folds_up, {r_all('delta', 'floor')},
      CASE WHEN delta >= floor AND folds_up >= 3 THEN 'KEEP' WHEN delta <= 0 THEN 'DISCARD' ELSE 'INCONCLUSIVE' END AS verdict
    FROM (SELECT *, cand_mean - base_mean AS delta, greatest(0.5 * base_std, 0.0002) AS floor FROM (
      SELECT avg(b) AS base_mean, avg(c) AS cand_mean, stddev_pop(b) AS base_std, count(*) FILTER (WHERE c > b) AS folds_up
      FROM (SELECT fold, max(auc) FILTER (WHERE base = 'base') AS b, max(auc) FILTER (WHERE base = 'cand') AS c
        FROM ({auc_sql('both2', 'base, fold', 'score', 'target')}) GROUP BY fold)))""", OOF_FOLDED, BOTH))
def a14(spark, sf):
    d = dg.long_scores(both(spark, sf), ["base", "cand"], ["fold", "target"])
    return rounded(dg.gate(side_by_side(auc(d, ["base", "fold"], "score", "target"), ["fold"])))


@query("A15_cell_guard", on_laps(f"""
    SELECT Year, Compound, n, {r('b', 'base_auc')}, {r('c', 'cand_auc')}, {r('b - c', 'regression')},
      b - c > 0.001 AS violated
    FROM (SELECT Year, Compound, max(n) AS n, max(auc) FILTER (WHERE base = 'base') AS b, max(auc) FILTER (WHERE base = 'cand') AS c
      FROM ({auc_sql('both2', 'base, Year, Compound', 'score', 'target')}) GROUP BY Year, Compound) WHERE n >= 100""",
    OOF_FOLDED, BOTH))
def a15(spark, sf):
    d = dg.long_scores(both(spark, sf), ["base", "cand"], ["Year", "Compound", "target"])
    t = side_by_side(auc(d, ["base", "Year", "Compound"], "score", "target"), ["Year", "Compound"]).where(F.col("n") >= 100)
    gap = F.col("base_auc") - F.col("cand_auc")
    return rounded(t.withColumns({"regression": gap, "violated": gap > 0.001}))


@query("A16_orientation", on_laps(f"""
    SELECT id, base, {r('CASE WHEN a.auc < 0.5 THEN 1 - score ELSE score END', 'score')} FROM longp
    JOIN ({auc_sql('longp', 'base', 'score', 'target')}) a USING (base)""", OOF_FOLDED, LONG))
def a16(spark, sf):
    d = dg.long_scores(oof(spark, sf), BASES, ["id", "target"])
    d = d.join(F.broadcast(auc(d, ["base"], "score", "target").select("base", "auc")), "base")
    return rounded(d.select("id", "base", F.when(F.col("auc") < 0.5, 1 - F.col("score")).otherwise(F.col("score")).alias("score")))


@query("A17_drift_test", on_laps(f"""
    SELECT {r("max(auc) FILTER (WHERE base = 'matched')", 'matched_auc')}, {r("max(auc) FILTER (WHERE base = 'swapped')", 'swapped_auc')},
      {r("max(auc) FILTER (WHERE base = 'matched') - max(auc) FILTER (WHERE base = 'swapped')", 'auc_gap')}
    FROM ({auc_sql('drift', 'base', 'score', 'target')})""",
    ("drift", """SELECT target, 'matched' AS base, 0.7::DOUBLE * oof_d + 0.3::DOUBLE * oof_a AS score FROM oof
      UNION ALL SELECT target, 'swapped', 0.7::DOUBLE * oof_d + 0.3::DOUBLE * oof_c FROM oof""")))
def a17(spark, sf):
    d = oof(spark, sf).select("target", (0.7 * F.col("oof_d") + 0.3 * F.col("oof_a")).alias("matched"),
                              (0.7 * F.col("oof_d") + 0.3 * F.col("oof_c")).alias("swapped"))
    a = auc(dg.long_scores(d, ["matched", "swapped"], ["target"]), ["base"], "score", "target")
    pick = lambda m: F.max(F.when(F.col("base") == m, F.col("auc")))
    return rounded(a.agg(pick("matched").alias("matched_auc"), pick("swapped").alias("swapped_auc"),
                         (pick("matched") - pick("swapped")).alias("auc_gap")))


MEAN4 = "(oof_a + oof_b + oof_c + oof_d) / 4"


@query("A18_best_single_vs_average", on_laps(f"""
    SELECT arg_max(base, auc) FILTER (WHERE base <> 'mean') AS best, {r("max(auc) FILTER (WHERE base <> 'mean')", 'best_auc')},
      {r("max(auc) FILTER (WHERE base = 'mean')", 'mean_auc')},
      {r("max(auc) FILTER (WHERE base = 'mean') - max(auc) FILTER (WHERE base <> 'mean')", 'delta')}
    FROM ({auc_sql('lm', 'base', 'score', 'target')})""",
    ("lm", long_sql(f"(SELECT *, {MEAN4} AS mean FROM oof)", "target", [*BASES, "mean"]))))
def a18(spark, sf):
    d = oof(spark, sf).withColumn("mean", (F.col("oof_a") + F.col("oof_b") + F.col("oof_c") + F.col("oof_d")) / 4)
    a = auc(dg.long_scores(d, [*BASES, "mean"], ["target"]), ["base"], "score", "target")
    single = F.when(F.col("base") != "mean", F.col("auc"))
    mean = F.max(F.when(F.col("base") == "mean", F.col("auc")))
    return rounded(a.agg(F.max_by("base", single).alias("best"), F.max(single).alias("best_auc"),
                         mean.alias("mean_auc"), (mean - F.max(single)).alias("delta")))


@query("A19_tie_clusters", """
    WITH b AS (SELECT c_name, round(c_acctbal / 1000 + CAST(1e-9 AS DOUBLE), 0) + CAST(0 AS DOUBLE) AS score FROM customer),
    ranked AS (SELECT *, rank() OVER (ORDER BY score DESC) AS rk, row_number() OVER (PARTITION BY score ORDER BY c_name) AS i FROM b)
    SELECT score, count(*) AS n, min(rk) AS best_rank, string_agg(c_name, ',' ORDER BY c_name) FILTER (WHERE i <= 5) AS first_names
    FROM ranked GROUP BY score HAVING count(*) > 1""")
def a19(spark, sf):
    d = table(spark, sf, "customer").select("c_name", (F.round(F.col("c_acctbal") / 1000 + 1e-9, 0) + F.lit(0.0)).alias("score"))
    return tie_clusters(d, "c_name", "score")
