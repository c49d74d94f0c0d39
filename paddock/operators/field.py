"""Race-wide and lap-wide features: one small table per level, joined back once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.laps import R, RY, RYL
from .spread import quantiles, with_position
from .timeline import neighbours, rolling, running

WET = ["INTERMEDIATE", "WET"]  # fixed values
SC_THRESHOLD = 1.15
SCRATCH = "_pos"


def pit_cost(df: DataFrame, keys=R, time="LapTime", pit="PitStop") -> DataFrame:
    """Median pit-lap time minus median normal-lap time; null without a pit lap."""
    m = quantiles(df, [*keys, pit], time, {"_med": 0.5})
    at = lambda v: F.max(F.when(F.col(pit) == v, F.col("_med")))
    return m.groupBy(*keys).agg((at(1) - at(0)).alias("pit_cost_seconds"))


def race_level(df: DataFrame, keys=RY) -> DataFrame:
    """Race length and whether any wet tyre was used."""
    return df.groupBy(*keys).agg(
        F.max("LapNumber").alias("total_laps_year"),
        F.bool_or(F.col("Compound").isin(WET)).cast("int").alias("is_wet_race"),
    )


def pit_window(df: DataFrame, keys=R, lo=0.05, hi=0.95, method="nearest") -> DataFrame:
    """The lap band in which a race's stops happen."""
    return quantiles(
        df.where(F.col("PitStop") == 1), keys, "LapNumber", {"pit_window_start": lo, "pit_window_end": hi}, method=method
    )


def expected_stops(df: DataFrame) -> DataFrame:
    """Median over drivers of their total stops in the race."""
    per_driver = df.groupBy(*RY, "Driver").agg(F.sum("PitStop").alias("_stops"))
    return quantiles(per_driver, RY, "_stops", {"expected_stops_for_race": 0.5})


def lap_table(df: DataFrame, time="LapTime") -> DataFrame:
    """One row per lap of a race: field pace, wet share, stops and field size."""
    stats = df.groupBy(*RYL).agg(
        F.max(time).alias("field_max_laptime"),
        F.avg(F.col("Compound").isin(WET).cast("double")).alias("wet_compound_share"),
        F.sum("PitStop").alias("pit_sum"),
        F.count("*").alias("n_lap"),
    )
    return stats.join(quantiles(df, RYL, time, {"field_median_laptime": 0.5}), RYL)


def baseline_pace(lap: DataFrame, method="nearest") -> DataFrame:
    """Lower-quartile field pace per race, every row of a lap counting once."""
    return quantiles(lap, RY, "field_median_laptime", {"_baseline": 0.25}, weight="n_lap", method=method)


def add_pace_ratio(lap: DataFrame, threshold=SC_THRESHOLD, method="nearest") -> DataFrame:
    """Field pace against the race's baseline; well above it a safety car is likely."""
    m = F.col("field_median_laptime")
    return lap.join(baseline_pace(lap, method), RY).withColumns({
        "field_pace_ratio": F.try_divide(m, F.col("_baseline")),
        "sc_likely": (m > F.col("_baseline") * threshold).cast("int"),
    }).drop("_baseline")


def add_sc_history(lap: DataFrame) -> DataFrame:
    """Safety-car flag on the previous two observed laps, and laps since the last one."""
    d = with_position(lap, RY, ["LapNumber"], SCRATCH)
    d = neighbours(d, RY, SCRATCH, lambda w: {
        "sc_prev_lap": F.lag("sc_likely", 1).over(w),
        "sc_lap_minus2": F.lag("sc_likely", 2).over(w),
    }, back=2)
    d = running(d, RY, SCRATCH, {"_last_sc": ("max", F.when(F.col("sc_likely") == 1, F.col(SCRATCH)))})
    return d.withColumn("laps_since_sc", F.col(SCRATCH) - F.col("_last_sc")).drop(SCRATCH, "_last_sc")


def add_pit_share_history(lap: DataFrame) -> DataFrame:
    """Share of the field that stopped on the previous laps and over a 3-lap window."""
    d = with_position(lap.withColumn("_share", F.col("pit_sum") / F.col("n_lap")), RY, ["LapNumber"], SCRATCH)
    return neighbours(d, RY, SCRATCH, lambda w: {
        "field_pit_share_prev_lap": F.lag("_share", 1).over(w),
        "field_pit_share_lap_minus_2": F.lag("_share", 2).over(w),
        "field_pit_share_window_3": F.avg("_share").over(rolling(w, 3)),
    }, back=2).drop(SCRATCH, "_share")


def add_pit_wave(lap: DataFrame) -> DataFrame:
    """Shape of the pit wave: change of the share, its 5-lap lag, distance to the peak lap."""
    d = with_position(lap.withColumn("_share", F.col("pit_sum") / F.col("n_lap")), RY, ["LapNumber"], SCRATCH)
    d = neighbours(d, RY, SCRATCH, lambda w: {
        "field_pit_share_diff_1": F.col("_share") - F.lag("_share", 1).over(w),
        "field_pit_share_lag_5": F.lag("_share", 5).over(w),
    }, back=5)
    # the earliest lap wins a tie
    peak = d.groupBy(*RY).agg(F.max_by("LapNumber", F.struct("_share", -F.col("LapNumber"))).alias("_peak"))
    d = d.join(peak, RY).withColumns({
        "peak_pit_window_distance": F.col("LapNumber") - F.col("_peak"),
        "post_sc_pit_cluster": F.col("sc_lap_minus2") * F.col("_share"),
    })
    return d.drop(SCRATCH, "_share", "_peak")


def add_leave_one_out_share(df: DataFrame, keys, flag: str, out: str, total="pit_sum", n="n_lap") -> DataFrame:
    """Share of the other rows of the group with the flag; 0 for a group of one."""
    if total not in df.columns:
        df = df.join(df.groupBy(*keys).agg(F.sum(flag).alias(total), F.count("*").alias(n)), keys)
    others = F.col(n) - 1
    share = (F.col(total) - F.col(flag)) / others.cast("double")
    return df.withColumn(out, F.when(others > 0, share).otherwise(0.0))
