"""Timeline research operators: what comes next, what came before, and label audits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.laps import RY, RYD, TARGET
from .spread import with_avg_rank, with_position
from .timeline import neighbours, running


def add_forward(df: DataFrame, keys=RYD, pos="LapNumber") -> DataFrame:
    """The next observed row's values, changes towards it, and the previous pit flag."""
    d = neighbours(df, keys, pos, lambda w: {
        **{f"next_{x}": F.lead(x).over(w) for x in ("PitStop", "TyreLife", "LapNumber", "Compound")},
        "prev_PitStop": F.lag("PitStop").over(w),
    }, back=1, ahead=1)
    changed = lambda a, b: F.coalesce(F.col(a), F.col(b)) != F.col(b)
    return d.withColumns({
        "next_TyreLife_drop": (F.coalesce("next_TyreLife", "TyreLife") < F.col("TyreLife")).cast("int"),
        "next_Compound_changed": changed("next_Compound", "Compound").cast("int"),
        "laps_until_next_observation": F.col("next_LapNumber") - F.col("LapNumber"),
        "next_Compound": F.coalesce("next_Compound", F.lit("__NA__")),
    })


def add_stint_lags(df: DataFrame, columns: list[str], keys=(*RYD, "Stint"), order="LapNumber") -> DataFrame:
    """Previous two values, change to the previous one, and laps done, inside one stint only."""
    keys = list(keys)
    d = with_position(df, keys, [order], "_pos", reread=True)
    def make(w):
        out = {}
        for x in columns:
            out[f"{x}_lag1"] = F.lag(x, 1).over(w)
            out[f"{x}_lag2"] = F.lag(x, 2).over(w)
            out[f"{x}_d1"] = F.col(x) - F.lag(x, 1).over(w)
        return out
    d = neighbours(d, keys, "_pos", make, back=2)
    return d.withColumn("laps_in_stint", F.col("_pos") - 1).drop("_pos")


COMPOUNDS = ["SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET"]  # fixed values


def add_history(df: DataFrame) -> DataFrame:
    """Per-driver, per-driver-and-race and per-driver-and-year averages and row counts."""
    mean = lambda x, name: F.avg(x).alias(name)
    driver = df.groupBy("Driver").agg(
        mean("LapTime", "driver_avg_LapTime"),
        F.coalesce(F.stddev_samp("LapTime"), F.lit(0.0)).alias("driver_std_LapTime"),
        mean("TyreLife", "driver_avg_TyreLife"),
        mean("Position", "driver_avg_Position"),
        mean(F.abs("Position_Change"), "driver_avg_AbsPositionChange"),
        mean("RaceProgress", "driver_avg_RaceProgress"),
        F.count("*").alias("driver_n_rows"),
        *[mean((F.col("Compound") == x).cast("double"), f"driver_pct_{x}") for x in COMPOUNDS],
    )
    race = df.groupBy("Driver", "Race").agg(
        mean("LapTime", "driver_race_avg_LapTime"), mean("Position", "driver_race_avg_Position"),
        F.count("*").alias("driver_race_n_rows"))
    year = df.groupBy("Driver", "Year").agg(
        mean("Position", "driver_year_avg_Position"), F.count("*").alias("driver_year_n_rows"))
    return df.join(driver, "Driver").join(race, ["Driver", "Race"]).join(year, ["Driver", "Year"])


def next_event(df: DataFrame, keys=RYD, race=RY, pos="LapNumber", event="PitStop") -> DataFrame:
    """Laps to the next strictly later event, censored at the end of the race, and its rank."""
    d = running(df, keys, pos, {"next_pit_lap": ("min", F.when(F.col(event) == 1, F.col(pos)))},
                include_current=False, reverse=True, reread=True)
    d = d.join(df.groupBy(*race).agg(F.max(pos).alias("_last")), race)
    censor = F.greatest(F.col("_last") - F.col(pos) + 1, F.lit(1))
    d = d.withColumns({
        "censored": F.col("next_pit_lap").isNull().cast("int"),
        "laps_to_next_pit": F.coalesce(F.col("next_pit_lap") - F.col(pos), censor),
    }).drop("_last")
    return with_avg_rank(d, race, {"laps_to_next_pit": "rank_pct"})


def add_label_noise(df: DataFrame, keys=RYD, order="LapNumber", target=TARGET) -> DataFrame:
    """Flag rows whose label disagrees with the stint change on the next sampled row."""
    d = with_position(df, keys, [order], "_pos", reread=True)
    d = neighbours(d, keys, "_pos", lambda w: {"_inc": F.lead("Stint").over(w) - F.col("Stint")}, ahead=1)
    inc, y = F.coalesce("_inc", F.lit(0)), F.col(target)
    noisy = ((y == 1) & (inc == 0)) | ((y == 0) & (inc >= 1))
    return d.withColumn("noisy", noisy.cast("int")).drop("_inc", "_pos")


def add_adjacent(df: DataFrame, keys=RYD, pos="LapNumber") -> DataFrame:
    """Previous and next values, only where the neighbouring row is exactly one lap away."""
    d = neighbours(df, keys, pos, lambda w: {
        "_pl": F.lag("LapNumber").over(w), "_nl": F.lead("LapNumber").over(w),
        "prev_LapTime": F.lag("LapTime").over(w), "prev_Position": F.lag("Position").over(w),
        "next_PitStop": F.lead("PitStop").over(w), "next_Stint": F.lead("Stint").over(w),
    }, back=1, ahead=1)
    return d.withColumns({
        "has_prev": F.coalesce(F.col("LapNumber") - F.col("_pl") == 1, F.lit(False)),
        "has_next": F.coalesce(F.col("_nl") - F.col("LapNumber") == 1, F.lit(False)),
    }).drop("_pl", "_nl")


def identity_audit(df: DataFrame) -> DataFrame:
    """How often three documented identities hold, as (claim, measure, n) counts."""
    d = add_adjacent(df)
    n = lambda cond, name: F.count_if(cond).alias(name)
    c1 = F.col("has_prev") & (F.col("PitStop") != 1)
    d1 = F.abs(F.col("LapTime_Delta") - (F.col("LapTime") - F.col("prev_LapTime")))
    d2 = F.abs(F.col("Position_Change") - (F.col("prev_Position") - F.col("Position")))
    c3 = (F.col("split") == "train") & F.col("has_next")
    same = F.col(TARGET) == F.col("next_PitStop")
    pair = lambda a, b: c3 & (F.col(TARGET) == a) & (F.col("next_PitStop") == b)
    row = d.agg(
        n(c1, "delta_eligible"), n(c1 & (d1 < 1e-3), "delta_within_1ms"), n(c1 & (d1 < 1.0), "delta_within_1s"),
        n(c1 & (d1 > 5.0), "delta_over_5s"),
        n(F.col("has_prev"), "position_eligible"), n(F.col("has_prev") & (d2 == 0), "position_exact"),
        n(c3, "label_eligible"), n(c3 & same, "label_agree"),
        *[n(pair(a, b), f"label_{a}_next_{b}") for a in (0, 1) for b in (0, 1)],
    )
    return row.unpivot([], row.columns, "measure", "n")
