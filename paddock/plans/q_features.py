"""Race, field, timeline, stint and peer features."""

from pyspark.sql import functions as F

from ..operators import field as fl
from ..operators import laps_features as lf
from ..sources.laps import R, RY, RYL, combined
from .features import FEATURES, features
from .registry import on_laps, query, r, r_all, rounded

FIELD = ("field", """
  SELECT Race, Year, LapNumber, quantile_cont(LapTime, 0.5) AS field_median_laptime,
    max(LapTime) AS field_max_laptime,
    avg(CASE WHEN Compound IN ('INTERMEDIATE', 'WET') THEN CAST(1 AS DOUBLE) ELSE 0 END) AS wet_compound_share,
    CAST(sum(PitStop) AS BIGINT) AS pit_sum, count(*) AS n_lap
  FROM comb GROUP BY Race, Year, LapNumber""")


def nearest(x: str, q: float) -> str:
    """SQL of the order statistic closest to a quantile."""
    return f"list_sort(list({x}))[CAST(round((count(*) - 1) * CAST({q} AS DOUBLE)) AS INT) + 1]"


PACE = ("pace", f"""
  SELECT f.*, f.field_median_laptime / b.q AS field_pace_ratio,
    CAST(f.field_median_laptime > b.q * 1.15 AS INT) AS sc_likely,
    CAST(f.pit_sum AS DOUBLE) / f.n_lap AS share
  FROM field f JOIN (
    SELECT Race, Year, {nearest('field_median_laptime', 0.25)} AS q
    FROM comb JOIN field USING (Race, Year, LapNumber) GROUP BY Race, Year) b USING (Race, Year)""")
SC = ("sc", """
  SELECT *, CASE WHEN epoch = 0 THEN NULL ELSE
      row_number() OVER (PARTITION BY Race, Year, epoch ORDER BY LapNumber) - 1 END AS laps_since_sc
  FROM (SELECT *,
      lag(sc_likely, 1) OVER w AS sc_prev_lap, lag(sc_likely, 2) OVER w AS sc_lap_minus2,
      sum(sc_likely) OVER w AS epoch,
      lag(share, 1) OVER w AS field_pit_share_prev_lap, lag(share, 2) OVER w AS field_pit_share_lap_minus_2,
      avg(share) OVER (PARTITION BY Race, Year ORDER BY LapNumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
        AS field_pit_share_window_3,
      lag(share, 5) OVER w AS field_pit_share_lag_5, share - (lag(share, 1) OVER w) AS field_pit_share_diff_1,
      LapNumber - (first_value(LapNumber) OVER (PARTITION BY Race, Year ORDER BY share DESC, LapNumber
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS peak_pit_window_distance
    FROM pace WINDOW w AS (PARTITION BY Race, Year ORDER BY LapNumber))""")
FRAME3 = "(PARTITION BY Race, Year, Driver ORDER BY LapNumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
FRAME5 = "(PARTITION BY Race, Year, Driver ORDER BY LapNumber ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
TL = ("tl", f"""
  SELECT *, CASE WHEN count(laptime_accel_3) OVER {FRAME3} >= 2 THEN avg(laptime_accel_3) OVER {FRAME3} END
      AS laptime_accel_roll_3
  FROM (SELECT *,
      CAST(sum(PitStop) OVER w AS BIGINT) AS pits_so_far_this_race,
      CAST(sum(PitStop) OVER {FRAME3} AS BIGINT) AS pit_stops_last_3,
      CAST(sum(PitStop) OVER {FRAME5} AS BIGINT) AS pit_stops_last_5,
      avg(LapTime) OVER {FRAME3} AS laptime_roll_mean_3, avg(LapTime) OVER {FRAME5} AS laptime_roll_mean_5,
      stddev_samp(LapTime) OVER {FRAME3} AS laptime_roll_std_3,
      stddev_samp(LapTime) OVER {FRAME5} AS laptime_roll_std_5,
      LapTime - (lag(LapTime, 1) OVER w) AS laptime_diff_1, LapTime - (lag(LapTime, 3) OVER w) AS laptime_diff_3,
      Position - (lag(Position, 3) OVER w) AS position_change_3,
      Position - (lag(Position, 5) OVER w) AS position_change_5,
      stddev_samp(CAST(Position AS DOUBLE)) OVER {FRAME5} AS position_roll_std_5,
      Cumulative_Degradation - (lag(Cumulative_Degradation, 1) OVER w) AS cum_deg_diff_1,
      (LapTime - (lag(LapTime, 1) OVER w)) - ((lag(LapTime, 1) OVER w) - (lag(LapTime, 2) OVER w)) AS laptime_accel_3
    FROM comb WINDOW w AS (PARTITION BY Race, Year, Driver ORDER BY LapNumber))""")
STINTS = ("stints", """
  SELECT Driver, Race, Year, Stint, count(*) AS stint_length, CAST(sum(PitStop) AS BIGINT) AS stint_pits,
    arg_min(Compound, LapNumber) AS stint_compound
  FROM comb GROUP BY Driver, Race, Year, Stint HAVING sum(PitStop) >= 1""")
RYSTAT = ("ry", """
  SELECT Race, Year, max(LapNumber) AS total_laps_year,
    CAST(bool_or(Compound IN ('INTERMEDIATE', 'WET')) AS INT) AS is_wet_race
  FROM comb GROUP BY Race, Year""")
STOPS = ("stops", """
  SELECT Race, Year, quantile_cont(n, 0.5) AS expected_stops_for_race
  FROM (SELECT Race, Year, Driver, CAST(sum(PitStop) AS BIGINT) AS n FROM comb GROUP BY Race, Year, Driver)
  GROUP BY Race, Year""")
COST = ("cost", """
  SELECT Race, quantile_cont(LapTime, 0.5) FILTER (WHERE PitStop = 1)
    - quantile_cont(LapTime, 0.5) FILTER (WHERE PitStop = 0) AS pit_cost_seconds
  FROM comb GROUP BY Race""")
WINDOW = ("pw", f"""
  SELECT Race, {nearest('LapNumber', 0.05)} AS pit_window_start, {nearest('LapNumber', 0.95)} AS pit_window_end
  FROM comb WHERE PitStop = 1 GROUP BY Race""")
CELLS = ("cells", """
  SELECT Race, Year, LapNumber, Position, avg(pit_stops_last_3) AS m3, avg(pit_stops_last_5) AS m5
  FROM tl GROUP BY Race, Year, LapNumber, Position""")
TYPICAL = ("typical", """
  SELECT stint_compound AS Compound, Race, quantile_cont(stint_length, 0.5) AS typical_stint_length
  FROM stints GROUP BY stint_compound, Race""")
LIFE = ("life", f"""
  SELECT stint_compound AS Compound, {nearest('stint_length', 0.95)} AS compound_max_life
  FROM stints GROUP BY stint_compound""")
START = ("startpace", """
  SELECT Race, Year, Driver, Stint, avg(LapTime) AS stint_start_pace
  FROM (SELECT *, row_number() OVER (PARTITION BY Race, Year, Driver, Stint ORDER BY LapNumber) AS i FROM comb)
  WHERE i <= 3 GROUP BY Race, Year, Driver, Stint""")
LOO = ("loo", """
  SELECT id, CASE WHEN n_lap > 1 THEN CAST(pit_sum - PitStop AS DOUBLE) / (n_lap - 1) ELSE 0 END AS field_pit_share
  FROM comb JOIN field USING (Race, Year, LapNumber)""")


def peer_rank_sql(value: str) -> str:
    return (f"(rank() OVER (PARTITION BY Race, Year, LapNumber, Compound ORDER BY {value})"
            f" + (count(*) OVER (PARTITION BY Race, Year, LapNumber, Compound, {value}) - 1) / CAST(2 AS DOUBLE))"
            f" / count(*) OVER (PARTITION BY Race, Year, LapNumber, Compound)")


ALL = ("feat", f"""
  SELECT tl.*, pit_cost_seconds, total_laps_year, total_laps_year - tl.LapNumber AS LapsRemaining, is_wet_race,
    field_median_laptime, field_max_laptime, wet_compound_share, field_pace_ratio, sc_likely, sc_prev_lap,
    sc_lap_minus2, laps_since_sc, field_pit_share, field_pit_share_prev_lap, field_pit_share_lap_minus_2,
    field_pit_share_window_3, expected_stops_for_race,
    expected_stops_for_race - pits_so_far_this_race AS stops_remaining_proxy,
    a.m3 AS ahead_pitted_last_3, a.m5 AS ahead_pitted_last_5,
    b.m3 AS behind_pitted_last_3, b.m5 AS behind_pitted_last_5,
    typical_stint_length, compound_max_life, tl.TyreLife / typical_stint_length AS tyre_life_norm,
    compound_max_life - tl.TyreLife AS tyre_life_remaining,
    CAST(total_laps_year - tl.LapNumber > compound_max_life - tl.TyreLife AS INT) AS cant_finish_on_current_tyres,
    prev.stint_length AS prev_stint_length, pit_window_start, pit_window_end,
    CAST(tl.LapNumber BETWEEN pit_window_start AND pit_window_end AS INT) AS in_pit_window,
    tl.LapTime / field_median_laptime AS driver_pace_ratio,
    stint_start_pace, tl.LapTime - stint_start_pace AS laptime_vs_stint_start,
    {peer_rank_sql('tl.TyreLife').replace('Race, Year, LapNumber, Compound', 'tl.Race, tl.Year, tl.LapNumber, tl.Compound')}
      AS tyre_age_pct_among_compound_peers,
    CAST(tl.Race = 'Pre-Season Testing' AS INT) AS is_pre_season,
    CAST(tl.Driver LIKE 'D%' AND length(tl.Driver) = 4 AS INT) AS is_synthetic_driver,
    CAST(tl.Year = 2023 AS INT) AS is_2023,
    CAST(tl.LapTime > field_median_laptime * 1.5 AS INT) AS lap_is_anomalous
  FROM tl
  JOIN sc ON sc.Race = tl.Race AND sc.Year = tl.Year AND sc.LapNumber = tl.LapNumber
  JOIN loo ON loo.id = tl.id
  JOIN ry ON ry.Race = tl.Race AND ry.Year = tl.Year
  JOIN stops ON stops.Race = tl.Race AND stops.Year = tl.Year
  LEFT JOIN cost ON cost.Race = tl.Race
  LEFT JOIN pw ON pw.Race = tl.Race
  LEFT JOIN cells a ON a.Race = tl.Race AND a.Year = tl.Year AND a.LapNumber = tl.LapNumber AND a.Position + 1 = tl.Position
  LEFT JOIN cells b ON b.Race = tl.Race AND b.Year = tl.Year AND b.LapNumber = tl.LapNumber AND b.Position - 1 = tl.Position
  LEFT JOIN startpace s ON s.Race = tl.Race AND s.Year = tl.Year AND s.Driver = tl.Driver AND s.Stint = tl.Stint
  LEFT JOIN stints prev ON prev.Race = tl.Race AND prev.Year = tl.Year AND prev.Driver = tl.Driver AND prev.Stint + 1 = tl.Stint
  LEFT JOIN typical t ON t.Compound = tl.Compound AND t.Race = tl.Race
  LEFT JOIN life l ON l.Compound = tl.Compound""")
FEATURE_CTES = [FIELD, PACE, SC, TL, STINTS, RYSTAT, STOPS, COST, WINDOW, CELLS, TYPICAL, LIFE, START, LOO, ALL]
DOUBLES = {
    "pit_cost_seconds", "field_median_laptime", "field_max_laptime", "wet_compound_share", "field_pace_ratio",
    "field_pit_share", "field_pit_share_prev_lap", "field_pit_share_lap_minus_2", "field_pit_share_window_3",
    "expected_stops_for_race", "stops_remaining_proxy", "ahead_pitted_last_3", "ahead_pitted_last_5",
    "behind_pitted_last_3", "behind_pitted_last_5", "typical_stint_length", "compound_max_life", "tyre_life_norm",
    "tyre_life_remaining", "pit_window_start", "pit_window_end", "driver_pace_ratio", "laptime_roll_mean_3",
    "laptime_roll_mean_5", "laptime_roll_std_3", "laptime_roll_std_5", "laptime_diff_1", "laptime_diff_3",
    "position_roll_std_5", "cum_deg_diff_1", "laptime_accel_3", "laptime_accel_roll_3", "stint_start_pace",
    "laptime_vs_stint_start", "tyre_age_pct_among_compound_peers",
}


def cols(*names: str) -> str:
    """SQL select list with the floating feature columns rounded."""
    return ", ".join(r(n, n) if n in DOUBLES else n for n in names)


def from_features(*names: str) -> str:
    return on_laps(f"SELECT id, {cols(*names)} FROM feat", *FEATURE_CTES)


def on_lap(df, table, *names):
    """Bring lap-level columns back to the rows."""
    return rounded(df.join(table, RYL).select("id", *names))


@query("F1_pit_cost", on_laps("SELECT Race, " + r("pit_cost_seconds", "pit_cost_seconds") + " FROM cost", COST))
def f1(spark, sf):
    return rounded(fl.pit_cost(combined(spark, sf)))


@query("F2_race_length", from_features("total_laps_year", "LapsRemaining"))
def f2(spark, sf):
    d = combined(spark, sf)
    return d.join(fl.race_level(d), RY).select(
        "id", "total_laps_year", (F.col("total_laps_year") - F.col("LapNumber")).alias("LapsRemaining"))


@query("F3_wet_race", on_laps("SELECT id, is_wet_race FROM comb JOIN ry USING (Race, Year)", RYSTAT))
def f3(spark, sf):
    d = combined(spark, sf)
    return d.join(fl.race_level(d), RY).select("id", "is_wet_race")


F4 = ["field_median_laptime", "field_max_laptime", "wet_compound_share"]


@query("F4_field_lap_stats", on_laps(f"SELECT id, {cols(*F4)} FROM comb JOIN field USING (Race, Year, LapNumber)", FIELD))
def f4(spark, sf):
    d = combined(spark, sf)
    return on_lap(d, fl.lap_table(d), *F4)


@query("F5_field_pace_ratio", on_laps(
    f"SELECT id, {cols('field_pace_ratio', 'sc_likely')} FROM comb JOIN pace USING (Race, Year, LapNumber)", FIELD, PACE))
def f5(spark, sf):
    d = combined(spark, sf)
    return on_lap(d, fl.add_pace_ratio(fl.lap_table(d)), "field_pace_ratio", "sc_likely")


def lap_query(*names):
    return on_laps(f"SELECT id, {cols(*names)} FROM comb JOIN sc USING (Race, Year, LapNumber)", FIELD, PACE, SC)


@query("F6_sc_lags", lap_query("sc_prev_lap", "sc_lap_minus2"))
def f6(spark, sf):
    d = combined(spark, sf)
    lap = fl.lap_table(d).transform(fl.add_pace_ratio).transform(fl.add_sc_history)
    return on_lap(d, lap, "sc_prev_lap", "sc_lap_minus2")


@query("F7_laps_since_sc", lap_query("laps_since_sc"))
def f7(spark, sf):
    d = combined(spark, sf)
    lap = fl.lap_table(d).transform(fl.add_pace_ratio).transform(fl.add_sc_history)
    return on_lap(d, lap, "laps_since_sc")


@query("F8_field_pit_share", on_laps(f"SELECT id, {cols('field_pit_share')} FROM loo", FIELD, LOO))
def f8(spark, sf):
    d = combined(spark, sf)
    return rounded(fl.add_leave_one_out_share(d, RYL, "PitStop", "field_pit_share").select("id", "field_pit_share"))


F9 = ["field_pit_share_prev_lap", "field_pit_share_lap_minus_2", "field_pit_share_window_3"]


def pit_counts(d):
    return d.groupBy(*RYL).agg(F.sum("PitStop").alias("pit_sum"), F.count("*").alias("n_lap"))


@query("F9_field_pit_share_history", lap_query(*F9))
def f9(spark, sf):
    d = combined(spark, sf)
    return on_lap(d, fl.add_pit_share_history(pit_counts(d)), *F9)


@query("F10_pits_so_far", on_laps("SELECT id, pits_so_far_this_race FROM tl", TL))
def f10(spark, sf):
    return lf.add_pits_so_far(combined(spark, sf)).select("id", "pits_so_far_this_race")


F11 = ["expected_stops_for_race", "stops_remaining_proxy"]


@query("F11_expected_stops", from_features(*F11))
def f11(spark, sf):
    d = combined(spark, sf)
    out = lf.add_pits_so_far(d).join(fl.expected_stops(d), RY)
    out = out.withColumn(F11[1], F.col(F11[0]) - F.col("pits_so_far_this_race"))
    return rounded(out.select("id", *F11))


def timeline_query(*names):
    def run(spark, sf):
        return rounded(lf.add_timeline(combined(spark, sf), list(names)).select("id", *names))
    return run


for name, names in {
    "F12_rolling_pits": ["pit_stops_last_3", "pit_stops_last_5"],
    "F20_rolling_laptime": ["laptime_roll_mean_3", "laptime_roll_mean_5", "laptime_roll_std_3", "laptime_roll_std_5"],
    "F21_lagged_differences": ["laptime_diff_1", "laptime_diff_3", "position_change_3", "position_change_5"],
    "F22_position_volatility": ["position_roll_std_5"],
    "F23_degradation_step": ["cum_deg_diff_1"],
    "F25_pace_acceleration": ["laptime_accel_3", "laptime_accel_roll_3"],
}.items():
    query(name, on_laps(f"SELECT id, {cols(*names)} FROM tl", TL))(timeline_query(*names))

F13 = ["ahead_pitted_last_3", "ahead_pitted_last_5", "behind_pitted_last_3", "behind_pitted_last_5"]


@query("F13_neighbour_pits", from_features(*F13))
def f13(spark, sf):
    d = lf.add_timeline(combined(spark, sf), ["pit_stops_last_3", "pit_stops_last_5"])
    return rounded(d.join(lf.neighbour_pits(d), [*RYL, "Position"], "left").select("id", *F13))


@query("F14_completed_stints", on_laps("SELECT * FROM stints", STINTS))
def f14(spark, sf):
    return lf.completed_stints(combined(spark, sf))


@query("F15_typical_stint", on_laps(f"SELECT Compound, Race, {cols('typical_stint_length')} FROM typical", STINTS, TYPICAL))
def f15(spark, sf):
    return rounded(lf.typical_stint(lf.completed_stints(combined(spark, sf))))


F16 = ["compound_max_life", "tyre_life_norm", "tyre_life_remaining", "cant_finish_on_current_tyres"]


@query("F16_tyre_life", from_features(*F16))
def f16(spark, sf):
    d = combined(spark, sf)
    stints = lf.completed_stints(d)
    out = d.join(lf.typical_stint(stints), ["Compound", "Race"], "left")
    out = out.join(lf.compound_life(stints), ["Compound"], "left").join(fl.race_level(d), RY)
    out = out.withColumn("LapsRemaining", F.col("total_laps_year") - F.col("LapNumber"))
    return rounded(out.withColumns(lf.tyre_life_columns()).select("id", *F16))


@query("F17_previous_stint", from_features("prev_stint_length"))
def f17(spark, sf):
    d = combined(spark, sf)
    prev = lf.previous_stint(lf.completed_stints(d))
    return d.join(prev, lf.STINT, "left").select("id", "prev_stint_length")


F18 = ["pit_window_start", "pit_window_end", "in_pit_window"]


@query("F18_pit_window", from_features(*F18))
def f18(spark, sf):
    d = combined(spark, sf)
    out = d.join(fl.pit_window(d), R, "left")
    inside = F.col("LapNumber").between(F.col(F18[0]), F.col(F18[1])).cast("int")
    return rounded(out.withColumn(F18[2], inside).select("id", *F18))


@query("F19_driver_pace_ratio", from_features("driver_pace_ratio"))
def f19(spark, sf):
    d = combined(spark, sf)
    out = d.join(fl.quantiles(d, RYL, "LapTime", {"m": 0.5}), RYL)
    return rounded(out.select("id", F.try_divide("LapTime", "m").alias("driver_pace_ratio")))


F24 = ["stint_start_pace", "laptime_vs_stint_start"]


@query("F24_stint_start_pace", from_features(*F24))
def f24(spark, sf):
    d = combined(spark, sf)
    out = d.join(lf.stint_start_pace(d), lf.STINT, "left")
    return rounded(out.withColumn(F24[1], F.col("LapTime") - F.col(F24[0])).select("id", *F24))


@query("F26_tyre_age_peer_rank", from_features("tyre_age_pct_among_compound_peers"))
def f26(spark, sf):
    out = lf.add_peer_rank(combined(spark, sf), [*RYL, "Compound"], {"TyreLife": "tyre_age_pct_among_compound_peers"})
    return rounded(out.select("id", "tyre_age_pct_among_compound_peers"))


F27 = ["is_pre_season", "is_synthetic_driver", "is_2023", "lap_is_anomalous"]


@query("F27_flags", from_features(*F27))
def f27(spark, sf):
    d = combined(spark, sf)
    med = fl.quantiles(d, RYL, "LapTime", {"field_median_laptime": 0.5})
    return d.join(med, RYL).withColumns(lf.flag_columns()).select("id", *F27)


F28 = {"Position": "position_pct", "LapTime": "laptime_pct", "Cumulative_Degradation": "cum_deg_pct"}


@query("F28_peer_ranks", on_laps(
    "SELECT id, " + ", ".join(r(peer_rank_sql(c), n) for c, n in F28.items()) + " FROM comb"))
def f28(spark, sf):
    return rounded(lf.add_peer_rank(combined(spark, sf), [*RYL, "Compound"], F28).select("id", *F28.values()))


F29 = ["field_pit_share_diff_1", "field_pit_share_lag_5", "peak_pit_window_distance", "post_sc_pit_cluster"]


@query("F29_pit_wave", on_laps(
    f"""SELECT id, {r_all(*F29[:2])}, {F29[2]}, {r('sc_lap_minus2 * share', F29[3])}
    FROM comb JOIN sc USING (Race, Year, LapNumber)""", FIELD, PACE, SC))
def f29(spark, sf):
    d = combined(spark, sf)
    lap = fl.lap_table(d).transform(fl.add_pace_ratio).transform(fl.add_sc_history).transform(fl.add_pit_wave)
    return on_lap(d, lap, *F29)


# the same three features on their own, with the nearest order statistic (the default) and with interpolated quantiles
@query("F5_pace_ratio_nearest", on_laps(f"""
    SELECT id, {r('field_median_laptime / q', 'field_pace_ratio')}, CAST(field_median_laptime > q * 1.15 AS INT) AS sc_likely
    FROM comb JOIN field USING (Race, Year, LapNumber) JOIN (SELECT Race, Year, {nearest('field_median_laptime', 0.25)} AS q
      FROM comb JOIN field USING (Race, Year, LapNumber) GROUP BY Race, Year) USING (Race, Year)""", FIELD))
def f5_nearest(spark, sf):
    d = combined(spark, sf)
    return on_lap(d, fl.add_pace_ratio(fl.lap_table(d), method="nearest"), "field_pace_ratio", "sc_likely")


@query("F16_compound_life_nearest", on_laps(f"""
    SELECT stint_compound AS Compound, {r(nearest('stint_length', 0.95), 'compound_max_life')} FROM stints GROUP BY 1""", STINTS))
def f16_nearest(spark, sf):
    return rounded(lf.compound_life(lf.completed_stints(combined(spark, sf)), method="nearest"))


@query("F18_pit_window_nearest", on_laps(f"""
    SELECT Race, {r(nearest('LapNumber', 0.05), 'pit_window_start')}, {r(nearest('LapNumber', 0.95), 'pit_window_end')}
    FROM comb WHERE PitStop = 1 GROUP BY Race"""))
def f18_nearest(spark, sf):
    return rounded(fl.pit_window(combined(spark, sf), method="nearest"))


@query("F5_pace_ratio_linear", on_laps(f"""
    SELECT id, {r('field_median_laptime / q', 'field_pace_ratio')}, CAST(field_median_laptime > q * 1.15 AS INT) AS sc_likely
    FROM comb JOIN field USING (Race, Year, LapNumber) JOIN (SELECT Race, Year, quantile_cont(field_median_laptime, 0.25) AS q
      FROM comb JOIN field USING (Race, Year, LapNumber) GROUP BY Race, Year) USING (Race, Year)""", FIELD))
def f5_linear(spark, sf):
    d = combined(spark, sf)
    return on_lap(d, fl.add_pace_ratio(fl.lap_table(d), method="linear"), "field_pace_ratio", "sc_likely")


@query("F16_compound_life_linear", on_laps(f"""
    SELECT stint_compound AS Compound, {r('quantile_cont(stint_length, 0.95)', 'compound_max_life')} FROM stints GROUP BY 1""", STINTS))
def f16_linear(spark, sf):
    return rounded(lf.compound_life(lf.completed_stints(combined(spark, sf)), method="linear"))


@query("F18_pit_window_linear", on_laps(f"""
    SELECT Race, {r('quantile_cont(LapNumber, 0.05)', 'pit_window_start')}, {r('quantile_cont(LapNumber, 0.95)', 'pit_window_end')}
    FROM comb WHERE PitStop = 1 GROUP BY Race"""))
def f18_linear(spark, sf):
    return rounded(fl.pit_window(combined(spark, sf), method="linear"))


RAW = ["id", "Driver", "Compound", "Race", "Year", "PitStop", "LapNumber", "Stint", "TyreLife", "Position", "split"]


@query("F30_feature_table", on_laps(
    f"SELECT {', '.join(RAW)}, {cols(*FEATURES)}, CASE WHEN split = 'train' THEN PitNextLap END AS PitNextLap FROM feat",
    *FEATURE_CTES))
def f30(spark, sf):
    d = features(spark, sf).withColumn("PitNextLap", F.when(F.col("split") == "train", F.col("PitNextLap")))
    return rounded(d.select(*RAW, *FEATURES, "PitNextLap"))
