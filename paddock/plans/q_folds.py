"""Folds, sampling, pseudo-labels and weights."""

import math

from pyspark.sql import functions as F

from ..operators import folds as fo
from ..operators import observations as ob
from ..session import cut
from ..sources.laps import RYD, TARGET, laps, oof, split_of
from .registry import on_laps, query, r, rounded


def hash_sql(seed, key="id") -> str:
    return f"substr(md5(concat('{seed}-', CAST({key} AS VARCHAR))), 1, 13)"


def unit_sql(seed) -> str:
    return f"(CAST(('0x' || {hash_sql(seed)}) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def fold_sql(strata: str, source: str, k=5, seed=42, key="id", out="fold") -> str:
    return (f"SELECT *, CAST((row_number() OVER (PARTITION BY {strata} ORDER BY {hash_sql(seed, key)}, {key}) - 1)"
            f" % {k} AS INT) AS {out} FROM {source}")


FOLDED = ("folded", fold_sql("Year, PitNextLap", "train"))
OOF_FOLDED = ("oof_folded", fold_sql("Year, target", "oof"))


def folded(spark, sf):
    return fo.stratified_folds(split_of(spark, sf, "train"), ["Year", TARGET], reread=True)


def oof_folded(spark, sf):
    return fo.stratified_folds(oof(spark, sf), ["Year", "target"], reread=True)


@query("C1_stratified_folds", on_laps("SELECT id, fold FROM folded", FOLDED))
def c1(spark, sf):
    return folded(spark, sf).select("id", "fold")


#: Each group, largest first, into the fold with the fewest rows so far.
GREEDY = (
    "sized", "SELECT Driver, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, Driver) AS i FROM train GROUP BY Driver"), (
    "dealt", """SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS Driver, CAST(NULL AS INT) AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
    SELECT g.i, g.Driver, CAST(list_position(loads, list_min(loads)) - 1 AS INT),
      list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END)
    FROM dealt s JOIN sized g ON g.i = s.i + 1""")


@query("C2_group_folds", on_laps("SELECT id, fold FROM train JOIN dealt USING (Driver)", *GREEDY).replace("WITH", "WITH RECURSIVE", 1))
def c2(spark, sf):
    return fo.group_folds(split_of(spark, sf, "train"), "Driver").select("id", "fold")


@query("C3_group_stratified_folds", on_laps(
    "SELECT t.id, fold FROM train t JOIN gf USING (Race, Year, Driver)",
    ("g", """SELECT Race, Year, Driver, min(id) AS gid, max(Year) AS gy, max(CAST(PitNextLap > 0 AS INT)) AS anyp
             FROM train GROUP BY Race, Year, Driver"""),
    ("gf", fold_sql("gy, anyp", "g", key="gid"))))
def c3(spark, sf):
    return fo.group_stratified_folds(split_of(spark, sf, "train"), RYD, "Year", TARGET).select("id", "fold")


@query("C4_shuffled_split", on_laps(f"SELECT id, CAST({unit_sql(7)} < 0.2 AS INT) AS is_holdout FROM laps"))
def c4(spark, sf):
    return laps(spark, sf).select("id", fo.is_holdout().alias("is_holdout"))


@query("C5_nested_folds", on_laps(
    "SELECT id, fold, inner_fold FROM nested", FOLDED,
    ("nested", fold_sql("fold, Year, PitNextLap", "folded", seed=43, out="inner_fold"))))
def c5(spark, sf):
    d = fo.stratified_folds(folded(spark, sf), ["fold", "Year", TARGET], seed=43, out="inner_fold")
    return d.select("id", "fold", "inner_fold")


@query("C6_pseudo_labels", on_laps("""
    SELECT id, CASE WHEN oof_d >= 0.8 THEN 1 ELSE 0 END AS pseudo FROM oof WHERE oof_d >= 0.8 OR oof_d <= 0.2"""))
def c6(spark, sf):
    return fo.pseudo_labels(oof(spark, sf), "oof_d", hi=0.8, lo=0.2).select("id", "pseudo")


@query("C7_subsample_flagged", on_laps(f"""
    SELECT id, fold, noisy AS flagged FROM (
      SELECT *, row_number() OVER (PARTITION BY fold, noisy ORDER BY {hash_sql(42)}, id) AS p,
        count(*) OVER (PARTITION BY fold, noisy) AS n
      FROM (SELECT *, CAST((PitNextLap = 1 AND inc = 0) OR (PitNextLap = 0 AND inc >= 1) AS INT) AS noisy FROM (
        SELECT *, coalesce((lead(Stint) OVER (PARTITION BY Race, Year, Driver ORDER BY LapNumber)) - Stint, 0) AS inc FROM folded)))
    WHERE noisy = 0 OR p <= floor(n * CAST(0.3 AS DOUBLE))""", FOLDED))
def c7(spark, sf):
    d = cut(ob.add_label_noise(folded(spark, sf)).select("id", "fold", F.col("noisy").alias("flagged")))
    return fo.subsample_flagged(d, "fold", "flagged", 0.3)


@query("C8_source_weights", on_laps("""
    SELECT id, CAST(CASE WHEN split = 'ext' THEN 0.7 ELSE 1 END AS DOUBLE) AS w_source,
      CAST(CASE WHEN Year = 2022 THEN 1.6 ELSE 1 END AS DOUBLE) AS w_year FROM laps WHERE split <> 'test'"""))
def c8(spark, sf):
    d = laps(spark, sf).where(F.col("split") != "test")
    return d.select("id", F.when(F.col("split") == "ext", 0.7).otherwise(1.0).alias("w_source"),
                    F.when(F.col("Year") == 2022, 1.6).otherwise(1.0).alias("w_year"))


def poisson_cdf(k: int) -> float:
    return sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))


@query("C10_bootstrap_counts", on_laps(f"""
    SELECT id, CASE {' '.join(f'WHEN u < {poisson_cdf(k)!r}::DOUBLE THEN {k}' for k in range(18))} ELSE 18 END AS copies
    FROM (SELECT id, {unit_sql(11)} AS u FROM train)"""))
def c10(spark, sf):
    return split_of(spark, sf, "train").select("id", fo.poisson_weight(11).alias("copies"))


@query("C11_teacher_labels", on_laps(
    f"SELECT id, {r('oof_d', 'teacher')}, {r('0.5 * PitNextLap + 0.5 * oof_d', 'soft_target')} FROM train JOIN oof USING (id)"))
def c11(spark, sf):
    teacher = oof(spark, sf).select("id", F.col("oof_d").alias("teacher"))
    d = split_of(spark, sf, "train").join(teacher, "id")
    return rounded(d.select("id", "teacher", (0.5 * F.col(TARGET) + 0.5 * F.col("teacher")).alias("soft_target")))
