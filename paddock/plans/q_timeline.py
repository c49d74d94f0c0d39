"""Timeline research operators."""

from pyspark.sql import functions as F

from ..operators import observations as ob
from ..operators.auc import auc
from ..sources.laps import combined, split_of
from .q_metrics import auc_sql
from .registry import on_laps, query, r, r_all, rounded

W = "WINDOW w AS (PARTITION BY Race, Year, Driver ORDER BY LapNumber)"
T1 = ["next_PitStop", "next_TyreLife", "next_LapNumber", "next_Compound", "next_TyreLife_drop",
      "next_Compound_changed", "laps_until_next_observation", "prev_PitStop"]


@query("T1_forward_features", on_laps(f"""
    SELECT id, next_PitStop, {r_all('next_TyreLife')}, next_LapNumber, coalesce(nc, '__NA__') AS next_Compound,
      CAST(coalesce(next_TyreLife, TyreLife) < TyreLife AS INT) AS next_TyreLife_drop,
      CAST(coalesce(nc, Compound) <> Compound AS INT) AS next_Compound_changed,
      next_LapNumber - LapNumber AS laps_until_next_observation, prev_PitStop
    FROM (SELECT *, lead(PitStop) OVER w AS next_PitStop, lead(TyreLife) OVER w AS next_TyreLife,
      lead(LapNumber) OVER w AS next_LapNumber, lead(Compound) OVER w AS nc, lag(PitStop) OVER w AS prev_PitStop
      FROM comb {W})"""))
def t1(spark, sf):
    return rounded(ob.add_forward(combined(spark, sf)).select("id", *T1))


LAGGED = ["LapTime", "LapTime_Delta", "Cumulative_Degradation", "Position"]
WS = "(PARTITION BY Race, Year, Driver, Stint ORDER BY LapNumber)"


@query("T2_stint_lags", on_laps("SELECT id, " + ", ".join(
    f"{r(f'lag({x}, 1) OVER {WS}', f'{x}_lag1')}, {r(f'lag({x}, 2) OVER {WS}', f'{x}_lag2')}, "
    f"{r(f'{x} - (lag({x}, 1) OVER {WS})', f'{x}_d1')}" for x in LAGGED)
    + f", row_number() OVER {WS} - 1 AS laps_in_stint FROM comb"))
def t2(spark, sf):
    d = combined(spark, sf).withColumn("Position", F.col("Position").cast("double"))
    d = ob.add_stint_lags(d, LAGGED)
    return rounded(d.select("id", *[f"{x}_{s}" for x in LAGGED for s in ("lag1", "lag2", "d1")], "laps_in_stint"))


T3 = ["driver_avg_LapTime", "driver_std_LapTime", "driver_avg_TyreLife", "driver_avg_Position",
      "driver_avg_AbsPositionChange", "driver_avg_RaceProgress", *[f"driver_pct_{x}" for x in ob.COMPOUNDS],
      "driver_race_avg_LapTime", "driver_race_avg_Position", "driver_year_avg_Position"]
T3N = ["driver_n_rows", "driver_race_n_rows", "driver_year_n_rows"]


@query("T3_driver_history", on_laps(f"""
    SELECT id, {r('avg(LapTime) OVER d', T3[0])}, {r('coalesce(stddev_samp(LapTime) OVER d, 0)', T3[1])},
      {r('avg(TyreLife) OVER d', T3[2])}, {r('avg(Position) OVER d', T3[3])},
      {r('avg(abs(Position_Change)) OVER d', T3[4])}, {r('avg(RaceProgress) OVER d', T3[5])},
      {', '.join(r(f"avg(CASE WHEN Compound = '{x}' THEN 1.0::DOUBLE ELSE 0 END) OVER d", f'driver_pct_{x}') for x in ob.COMPOUNDS)},
      {r('avg(LapTime) OVER dr', T3[-3])}, {r('avg(Position) OVER dr', T3[-2])}, {r('avg(Position) OVER dy', T3[-1])},
      count(*) OVER d AS {T3N[0]}, count(*) OVER dr AS {T3N[1]}, count(*) OVER dy AS {T3N[2]}
    FROM comb WINDOW d AS (PARTITION BY Driver), dr AS (PARTITION BY Driver, Race), dy AS (PARTITION BY Driver, Year)"""))
def t3(spark, sf):
    return rounded(ob.add_history(combined(spark, sf)).select("id", *T3, *T3N))


@query("T4_next_event_target", on_laps(f"""
    SELECT id, laps_to_next_pit, censored, {r('''(rank() OVER (PARTITION BY Race, Year ORDER BY laps_to_next_pit)
      + (count(*) OVER (PARTITION BY Race, Year, laps_to_next_pit) - 1) / CAST(2 AS DOUBLE))
      / count(*) OVER (PARTITION BY Race, Year)''', 'rank_pct')}
    FROM (SELECT *, CAST(nx IS NULL AS INT) AS censored,
        coalesce(nx - LapNumber, greatest(max(LapNumber) OVER (PARTITION BY Race, Year) - LapNumber + 1, 1)) AS laps_to_next_pit
      FROM (SELECT *, min(CASE WHEN PitStop = 1 THEN LapNumber END) OVER (PARTITION BY Race, Year, Driver
        ORDER BY LapNumber ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM comb))"""))
def t4(spark, sf):
    return rounded(ob.next_event(combined(spark, sf)).select("id", "laps_to_next_pit", "rank_pct", "censored"))


@query("T5_label_noise", on_laps(f"""
    SELECT id, CAST((PitNextLap = 1 AND inc = 0) OR (PitNextLap = 0 AND inc >= 1) AS INT) AS noisy
    FROM (SELECT *, coalesce((lead(Stint) OVER w) - Stint, 0) AS inc FROM train {W})"""))
def t5(spark, sf):
    return ob.add_label_noise(split_of(spark, sf, "train")).select("id", "noisy")


ADJ = ("adj", f"""
  SELECT *, coalesce(LapNumber - pl = 1, false) AS has_prev, coalesce(nl - LapNumber = 1, false) AS has_next,
    abs(LapTime_Delta - (LapTime - plt)) AS d1, abs(Position_Change - (pp - Position)) AS d2
  FROM (SELECT *, lag(LapNumber) OVER w AS pl, lead(LapNumber) OVER w AS nl, lag(LapTime) OVER w AS plt,
    lag(Position) OVER w AS pp, lead(PitStop) OVER w AS next_PitStop, lead(Stint) OVER w AS next_Stint FROM comb {W})""")
MEASURES = {
    "delta_eligible": "has_prev AND PitStop <> 1", "delta_within_1ms": "has_prev AND PitStop <> 1 AND d1 < 0.001",
    "delta_within_1s": "has_prev AND PitStop <> 1 AND d1 < 1", "delta_over_5s": "has_prev AND PitStop <> 1 AND d1 > 5",
    "position_eligible": "has_prev", "position_exact": "has_prev AND d2 = 0",
    "label_eligible": "split = 'train' AND has_next",
    "label_agree": "split = 'train' AND has_next AND PitNextLap = next_PitStop",
    **{f"label_{a}_next_{b}": f"split = 'train' AND has_next AND PitNextLap = {a} AND next_PitStop = {b}"
       for a in (0, 1) for b in (0, 1)},
}


@query("T6_identity_audit", on_laps(" UNION ALL ".join(
    f"SELECT '{k}' AS measure, count(*) AS n FROM adj WHERE {v}" for k, v in MEASURES.items()), ADJ))
def t6(spark, sf):
    return ob.identity_audit(combined(spark, sf))


@query("T7_observation_only_auc", on_laps(
    "SELECT predictor, " + r("auc", "auc") + f" FROM ({auc_sql('obs', 'predictor', 's', 'PitNextLap')})", ADJ,
    ("obs", """SELECT 'stint' AS predictor, next_Stint - Stint AS s, PitNextLap FROM adj WHERE split = 'train' AND has_next
      UNION ALL SELECT 'pit', next_PitStop, PitNextLap FROM adj WHERE split = 'train' AND has_next""")))
def t7(spark, sf):
    d = ob.add_adjacent(combined(spark, sf)).where((F.col("split") == "train") & F.col("has_next"))
    d = d.select("PitNextLap", (F.col("next_Stint") - F.col("Stint")).alias("stint"), F.col("next_PitStop").alias("pit"))
    long = d.unpivot(["PitNextLap"], ["stint", "pit"], "predictor", "score")
    return rounded(auc(long, ["predictor"], "score", "PitNextLap").select("predictor", "auc"))
