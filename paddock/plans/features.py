"""The full engineered lap table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import field as fl
from ..operators import laps_features as lf
from ..session import staged
from ..sources.laps import R, RY, RYL, combined

TIMELINE = [
    "pit_stops_last_3", "pit_stops_last_5", "laptime_roll_mean_3", "laptime_roll_mean_5",
    "laptime_roll_std_3", "laptime_roll_std_5", "laptime_diff_1", "laptime_diff_3", "position_change_3",
    "position_change_5", "position_roll_std_5", "cum_deg_diff_1", "laptime_accel_3", "laptime_accel_roll_3",
]
FEATURES = [
    "pit_cost_seconds", "total_laps_year", "LapsRemaining", "is_wet_race",
    "field_median_laptime", "field_max_laptime", "wet_compound_share",
    "field_pace_ratio", "sc_likely", "sc_prev_lap", "sc_lap_minus2", "laps_since_sc",
    "field_pit_share", "field_pit_share_prev_lap", "field_pit_share_lap_minus_2", "field_pit_share_window_3",
    "pits_so_far_this_race", "expected_stops_for_race", "stops_remaining_proxy",
    "ahead_pitted_last_3", "ahead_pitted_last_5", "behind_pitted_last_3", "behind_pitted_last_5",
    "typical_stint_length", "compound_max_life", "tyre_life_norm", "tyre_life_remaining",
    "cant_finish_on_current_tyres", "prev_stint_length",
    "pit_window_start", "pit_window_end", "in_pit_window", "driver_pace_ratio",
    *TIMELINE[2:], "stint_start_pace", "laptime_vs_stint_start",
    "tyre_age_pct_among_compound_peers",
    "is_pre_season", "is_synthetic_driver", "is_2023", "lap_is_anomalous",
]


def build_features(laps: DataFrame, cut, method: str = "nearest") -> DataFrame:
    """Engineer every feature; `cut(name, build)` stages the tables that are read more than once.

    `method` is the quantile flavour of the pace baseline, tyre life and pit window. Everything that
    is constant on a lap is computed on the lap table (one row per race lap) and reaches the rows in
    a single join; everything along a driver's timeline shares one window.
    """
    field = cut("lap_field", lambda: fl.lap_table(laps))
    lap = cut("lap_level", lambda: fl.add_sc_history(fl.add_pace_ratio(field, method=method)))
    lap = lap.transform(fl.add_pit_share_history)
    lap = lap.join(fl.race_level(laps), RY).join(fl.expected_stops(laps), RY)
    lap = lap.join(fl.pit_cost(laps), R, "left").join(fl.pit_window(laps, method=method), R, "left")

    peers = {"TyreLife": "tyre_age_pct_among_compound_peers"}
    ranked = lf.add_peer_rank(lf.add_pits_so_far(laps), [*RYL, "Compound"], peers)
    timeline = cut("lap_timeline", lambda: lf.add_timeline(ranked, TIMELINE))
    stints = cut("completed_stints", lambda: lf.completed_stints(laps))
    d = timeline.join(lap, RYL)
    d = fl.add_leave_one_out_share(d, RYL, "PitStop", "field_pit_share")
    d = d.join(lf.neighbour_pits(timeline), [*RYL, "Position"], "left")
    per_stint = lf.stint_start_pace(laps).join(lf.previous_stint(stints), lf.STINT, "left")
    d = d.join(per_stint, lf.STINT, "left")
    d = d.join(lf.typical_stint(stints), ["Compound", "Race"], "left")
    d = d.join(lf.compound_life(stints, method=method), ["Compound"], "left")
    d = d.withColumn("LapsRemaining", F.col("total_laps_year") - F.col("LapNumber"))
    d = d.withColumns({
        **lf.tyre_life_columns(),
        **lf.flag_columns(),
        "stops_remaining_proxy": F.col("expected_stops_for_race") - F.col("pits_so_far_this_race"),
        "in_pit_window": F.col("LapNumber").between(F.col("pit_window_start"), F.col("pit_window_end")).cast("int"),
        "driver_pace_ratio": F.try_divide(F.col("LapTime"), F.col("field_median_laptime")),
        "laptime_vs_stint_start": F.col("LapTime") - F.col("stint_start_pace"),
    })
    return d.select(*laps.columns, *FEATURES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engineered table, written once and partitioned by split."""
    cut = lambda name, build: staged(spark, name, sf_dir, build)
    build = lambda: build_features(combined(spark, sf_dir), cut)
    return staged(spark, "features", sf_dir, build, ["split"])
