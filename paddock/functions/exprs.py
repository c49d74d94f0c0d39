"""Row-level column expressions."""

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
c = F.col


def safe_div(a: Column, b: Column, eps=EPS) -> Column:
    return F.try_divide(a.cast("double"), b + F.lit(eps))


def flag(cond: Column) -> Column:
    return cond.cast("int")


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (previous edge, edge] holding x; the last label is open-ended."""
    out = F.when(x <= edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:]):
        out = out.when(x <= e, label)
    return out.otherwise(labels[-1])


def geometry() -> dict[str, Column]:
    total = F.least(F.greatest(c("LapNumber") / F.greatest(c("RaceProgress"), F.lit(EPS)), F.lit(1.0)), F.lit(120.0))
    return {
        "EstimatedTotalLaps": total,
        "LapsRemaining": F.greatest(total - c("LapNumber"), F.lit(0.0)),
        "RemainingRaceProgress": 1.0 - c("RaceProgress"),
        "LapProgress_x_LapNumber": c("LapNumber") * c("RaceProgress"),
    }


# bin edges and labels, fixed values
BINS = {
    "RacePhase": ("RaceProgress", [0.20, 0.40, 0.60, 0.80], ["P1", "P2", "P3", "P4", "P5"]),
    "LapBin": ("LapNumber", [5, 10, 20, 35, 50], ["L005", "L010", "L020", "L035", "L050", "Lplus"]),
    "TyreLifeBin": ("TyreLife", [3, 7, 12, 20, 30], ["T003", "T007", "T012", "T020", "T030", "Tplus"]),
    "PositionBin": ("Position", [3, 8, 14], ["front", "upper_mid", "lower_mid", "back"]),
}


def bins() -> dict[str, Column]:
    return {name: right_closed(c(x), e, labels) for name, (x, e, labels) in BINS.items()}


def tyre_ratios() -> dict[str, Column]:
    g = geometry()
    one = F.lit(1)
    return {
        "TyreAgeRatio": safe_div(c("TyreLife"), F.greatest(c("LapNumber"), one)),
        "LapPerTyreLife": safe_div(c("LapNumber"), c("TyreLife") + 1),
        "TyreLife_x_RaceProgress": c("TyreLife") * c("RaceProgress"),
        "PitWindowPressure": c("TyreLife") * c("RaceProgress"),
        "TyreAgeVsRace": safe_div(c("TyreLife"), F.greatest(g["EstimatedTotalLaps"], F.lit(1.0))),
        "TyreLife_to_LapsRemaining": safe_div(c("TyreLife"), g["LapsRemaining"] + 1),
        "LapMinusTyreLife": c("LapNumber") - c("TyreLife"),
    }


def stint() -> dict[str, Column]:
    return {
        "StintPressure": c("Stint") * c("TyreLife"),
        "Is_First_Stint": flag(c("Stint") == 1),
        "Is_Late_Stint": flag(c("Stint") >= 3),
    }


def position_pressure() -> dict[str, Column]:
    return {"PositionPressure": c("Position") * c("RaceProgress")}


def degradation() -> dict[str, Column]:
    d = c("Cumulative_Degradation")
    return {
        "DegPerRaceLap": safe_div(d, F.greatest(c("LapNumber"), F.lit(1))),
        "DegPerTyreLap": safe_div(d, F.greatest(c("TyreLife"), F.lit(1.0))),
        "Abs_Cumulative_Degradation": F.abs(d),
        "Positive_Degradation": flag(d > 0),
    }


def lap_delta() -> dict[str, Column]:
    d = c("LapTime_Delta")
    return {
        "DeltaAbs": F.abs(d),
        "LapTimeDeltaPositive": flag(d > 0),
        "DeltaPerTyreLap": safe_div(d, F.greatest(c("TyreLife"), F.lit(1.0))),
    }


def position_change() -> dict[str, Column]:
    d = c("Position_Change")
    return {"Abs_Position_Change": F.abs(d), "Gained_Position": flag(d > 0), "Lost_Position": flag(d < 0)}


def second_view() -> dict[str, Column]:
    t, d = c("LapTime"), c("Cumulative_Degradation")
    return {
        "LapNumber_over_RaceProgress": safe_div(c("LapNumber"), c("RaceProgress")),
        "TyreLife_over_LapNumber": c("TyreLife") / F.greatest(c("LapNumber"), F.lit(1)),
        "LapTime_x_Degradation": t * d,
        "LapTime_x_Degradation_abs": t * F.abs(d),
        "LapTime_over_Degradation_abs": safe_div(t, F.abs(d)),
    }


# typical stint length per compound, fixed values
STINT_LAPS = {"HARD": 23.0, "INTERMEDIATE": 16.0, "MEDIUM": 17.0, "SOFT": 14.0, "WET": 14.0}


def compound_age(typical=STINT_LAPS, default=17.0) -> dict[str, Column]:
    lookup = F.create_map(*[F.lit(x) for kv in typical.items() for x in kv])
    norm = F.coalesce(F.try_element_at(lookup, c("Compound")), F.lit(default))
    return {
        "NormTyreLife": c("TyreLife") / norm,
        "LapsOverdue": c("TyreLife") - norm,
        "TyreOverdue": flag(c("TyreLife") > norm),
        "NormTyre_x_RaceProgress": c("TyreLife") / norm * c("RaceProgress"),
    }


DIGIT_BASE = ["LapTime", "LapTime_Delta", "Cumulative_Degradation", "RaceProgress"]


def digits(columns=DIGIT_BASE, whole=(1, 10, 100, 1000), decimals=(1, 2, 3)) -> dict[str, Column]:
    """Sign and single decimal digits of a number, as small categories."""
    out = {}
    for name in columns:
        x = F.coalesce(F.round(c(name), 6), F.lit(0.0))
        out[f"{name}_sign"] = F.signum(x).cast("int")
        for p in whole:
            out[f"{name}_digit_{p}s"] = (F.floor(F.floor(F.abs(x)) / p) % 10).cast("int")
        for d in decimals:
            out[f"{name}_decimal_digit_{d}"] = (F.floor(F.abs(x) * float(10 ** d)) % 10).cast("int")
    return out


# resolutions per column, fixed values
NUMBER_CATS = {
    "LapTime": ([1, 0], [0.5, 1.0, 2.0, 5.0]),
    "LapTime_Delta": ([1, 0], [0.5, 1.0, 2.0, 5.0, 10.0]),
    "Cumulative_Degradation": ([1, 0], [1.0, 2.0, 5.0, 10.0, 20.0]),
}


def number_categories(config=NUMBER_CATS) -> dict[str, Column]:
    """One number at several resolutions (half-even rounding); the exact value is the finest."""
    out = {}
    for name, (rounds, steps) in config.items():
        out[f"{name}_exact"] = c(name)
        for d in rounds:
            out[f"{name}_round_{d}"] = F.rint(c(name) * float(10 ** d)) / float(10 ** d)
        for s in steps:
            out[f"{name}_step_{str(s).replace('.', '_')}"] = F.rint(c(name) / s) * s
    return out


#: Fixed values.
BIGRAM_BASE = [
    "Driver", "Compound", "Race", "Year", "PitStop", "LapNumber", "Stint", "TyreLife", "Position",
    "RaceProgress", "Position_Change",
]


def as_key(name: str, dtype: str) -> Column:
    """Category text of a column; floats by their millionths, so no float is ever printed."""
    x = F.rint(c(name) * 1e6).cast("long") if dtype == "double" else c(name)
    return F.coalesce(x.cast("string"), F.lit("__MISSING__"))


def bigrams(dtypes: dict[str, str], columns=BIGRAM_BASE) -> dict[str, Column]:
    pair = lambda a, b: F.concat_ws("__", as_key(a, dtypes[a]), as_key(b, dtypes[b]))
    return {f"{a}__{b}": pair(a, b) for a, b in combinations(columns, 2)}


#: Fixed values.
CROSSES = {
    "Race_Year": ["Race", "Year"],
    "Compound_Stint": ["Compound", "Stint"],
    "Driver_Race": ["Driver", "Race"],
    "Driver_Compound": ["Driver", "Compound"],
    "Race_Compound": ["Race", "Compound"],
    "Race_Compound_Stint": ["Race", "Compound", "Stint"],
    "Compound_RacePhase": ["Compound", "RacePhase"],
    "Compound_TyreLifeBin": ["Compound", "TyreLifeBin"],
    "RacePhase_TyreLifeBin": ["RacePhase", "TyreLifeBin"],
}


def crosses(config=CROSSES) -> dict[str, Column]:
    """Joined category keys; bin columns must exist. A null part has a text of its own, so no two keys run together."""
    part = lambda x: F.coalesce(c(x).cast("string"), F.lit("__MISSING__"))
    return {name: F.concat_ws("_", *[part(x) for x in cols]) for name, cols in config.items()}


def no_nulls(columns, sentinel="__NA__") -> dict[str, Column]:
    return {x: F.coalesce(c(x), F.lit(sentinel)) for x in columns}


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def log_loss_row(y: Column, p: Column, eps=1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; null, not an error, for a constant column."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))
