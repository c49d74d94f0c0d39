"""Per-driver timeline, neighbour, stint and peer features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.laps import RYD, RYL
from .spread import quantiles, with_avg_rank, with_position
from .timeline import at_least, neighbours, rolling, running

STINT = [*RYD, "Stint"]


def timeline_columns(w) -> list[dict]:
    """Rolling, lagged and differenced columns that share one window order."""
    r3, r5 = rolling(w, 3), rolling(w, 5)
    t, p, d = F.col("LapTime"), F.col("Position"), F.col("Cumulative_Degradation")
    lag = lambda c, n: F.lag(c, n).over(w)
    return [
        {
            "pit_stops_last_3": F.sum("PitStop").over(r3),
            "pit_stops_last_5": F.sum("PitStop").over(r5),
            "laptime_roll_mean_3": F.avg(t).over(r3),
            "laptime_roll_mean_5": F.avg(t).over(r5),
            "laptime_roll_std_3": at_least(t, r3, 2, F.stddev_samp(t).over(r3)),
            "laptime_roll_std_5": at_least(t, r5, 2, F.stddev_samp(t).over(r5)),
            "laptime_diff_1": t - lag("LapTime", 1),
            "laptime_diff_3": t - lag("LapTime", 3),
            "position_change_3": p - lag("Position", 3),
            "position_change_5": p - lag("Position", 5),
            "position_roll_std_5": at_least(p, r5, 2, F.stddev_samp(p).over(r5)),
            "cum_deg_diff_1": d - lag("Cumulative_Degradation", 1),
            "laptime_accel_3": (t - lag("LapTime", 1)) - (lag("LapTime", 1) - lag("LapTime", 2)),
        },
        {
            "laptime_accel_roll_3": at_least(
                F.col("laptime_accel_3"), r3, 2, F.avg("laptime_accel_3").over(r3)
            ),
        },
    ]


def add_timeline(df: DataFrame, names: list[str], keys=RYD, pos="LapNumber") -> DataFrame:
    """Add the named timeline columns; `pos` must be dense per key."""
    def make(w):
        first, second = timeline_columns(w)
        need = set(names) | ({"laptime_accel_3"} if "laptime_accel_roll_3" in names else set())
        return [s for s in ({k: v for k, v in part.items() if k in need} for part in (first, second)) if s]

    out = neighbours(df, keys, pos, make, back=5)
    return out if "laptime_accel_3" in names else out.drop("laptime_accel_3")


def add_pits_so_far(df: DataFrame, keys=RYD, pos="LapNumber", reread=True) -> DataFrame:
    return running(df, keys, pos, {"pits_so_far_this_race": ("sum", F.col("PitStop"))}, reread=reread)


def neighbour_pits(df: DataFrame, cells=(*RYL, "Position")) -> DataFrame:
    """Mean recent stops one position ahead and behind, keyed by the cell that looks them up.

    Averages per cell first, so the lookup cannot multiply rows when a position is shared.
    """
    *lap, pos = cells
    means = df.groupBy(*cells).agg(
        F.avg("pit_stops_last_3").alias("m3"), F.avg("pit_stops_last_5").alias("m5")
    )
    # each cell answers for two others: it is ahead of pos+1 and behind pos-1
    both = means.select(*lap, F.explode(F.array(
        F.struct((F.col(pos) + 1).alias(pos), F.col("m3").alias("a3"), F.col("m5").alias("a5"),
                 F.lit(None).cast("double").alias("b3"), F.lit(None).cast("double").alias("b5")),
        F.struct((F.col(pos) - 1).alias(pos), F.lit(None).cast("double").alias("a3"),
                 F.lit(None).cast("double").alias("a5"), F.col("m3").alias("b3"), F.col("m5").alias("b5")),
    )).alias("x")).select(*lap, "x.*")
    return both.groupBy(*cells).agg(
        F.max("a3").alias("ahead_pitted_last_3"), F.max("a5").alias("ahead_pitted_last_5"),
        F.max("b3").alias("behind_pitted_last_3"), F.max("b5").alias("behind_pitted_last_5"),
    )


def completed_stints(df: DataFrame) -> DataFrame:
    """One row per stint that ended in a stop."""
    return df.groupBy(*STINT).agg(
        F.count("*").alias("stint_length"),
        F.sum("PitStop").alias("stint_pits"),
        F.min_by("Compound", "LapNumber").alias("stint_compound"),
    ).where(F.col("stint_pits") >= 1)


def typical_stint(stints: DataFrame) -> DataFrame:
    return quantiles(
        stints.withColumnRenamed("stint_compound", "Compound"), ["Compound", "Race"], "stint_length",
        {"typical_stint_length": 0.5},
    )


def compound_life(stints: DataFrame, p=0.95, method="nearest") -> DataFrame:
    return quantiles(
        stints.withColumnRenamed("stint_compound", "Compound"), ["Compound"], "stint_length",
        {"compound_max_life": p}, method=method,
    )


def previous_stint(stints: DataFrame) -> DataFrame:
    return stints.select(*RYD, (F.col("Stint") + 1).cast("int").alias("Stint"),
                         F.col("stint_length").alias("prev_stint_length"))


def tyre_life_columns() -> dict:
    left = F.col("compound_max_life") - F.col("TyreLife")
    return {
        "tyre_life_norm": F.try_divide(F.col("TyreLife"), F.col("typical_stint_length")),
        "tyre_life_remaining": left,
        "cant_finish_on_current_tyres": (F.col("LapsRemaining") > left).cast("int"),
    }


def stint_start_pace(df: DataFrame, first=3) -> DataFrame:
    """Mean lap time of a stint's first observed laps."""
    pos = with_position(df.select(*STINT, "LapNumber", "LapTime"), STINT, ["LapNumber"], "_i", reread=True)
    return pos.where(F.col("_i") <= first).groupBy(*STINT).agg(F.avg("LapTime").alias("stint_start_pace"))


def add_peer_rank(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Average-method percentile rank among the peers of the group, per column."""
    return with_avg_rank(df, keys, columns)


def flag_columns() -> dict:
    return {
        "is_pre_season": (F.col("Race") == "Pre-Season Testing").cast("int"),
        "is_synthetic_driver": (F.col("Driver").startswith("D") & (F.length("Driver") == 4)).cast("int"),
        "is_2023": (F.col("Year") == 2023).cast("int"),
        "lap_is_anomalous": (F.col("LapTime") > F.col("field_median_laptime") * 1.5).cast("int"),
    }
