"""Row-level domain features."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import exprs as ex
from ..sources.laps import laps, split_of
from .registry import on_laps, query, r, rounded


def sql_div(a: str, b: str) -> str:
    return f"({a}) / (({b}) + CAST(0.000001 AS DOUBLE))"


def row_query(name: str, columns, sql: dict[str, str]):
    """Query over all laps adding columns; `sql` maps each output to its text.

    A text starting with # is an integer, with = is taken as it is; others are rounded floats.
    """
    def run(spark, sf):
        d = laps(spark, sf)
        return rounded(d.select("id", *[e.alias(n) for n, e in columns(d).items()]))
    parts = []
    for n, t in sql.items():
        parts.append(f"CAST({t[1:]} AS INT) AS {n}" if t[0] == "#" else f"{t[1:]} AS {n}" if t[0] == "=" else r(t, n))
    query(name, on_laps("SELECT id, " + ", ".join(parts) + " FROM laps"))(run)


TOTAL = "least(greatest(LapNumber / greatest(RaceProgress, CAST(0.000001 AS DOUBLE)), 1), 120)"
LEFT = f"greatest({TOTAL} - LapNumber, 0)"
row_query("D2_race_geometry", lambda d: ex.geometry(), {
    "EstimatedTotalLaps": TOTAL, "LapsRemaining": LEFT, "RemainingRaceProgress": "1 - RaceProgress",
    "LapProgress_x_LapNumber": "LapNumber * RaceProgress"})


def bin_sql(x: str, edges, labels) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= CAST({e} AS DOUBLE) THEN '{lb}'" for e, lb in zip(edges, labels)) \
        + f" ELSE '{labels[-1]}' END"


BIN_SQL = {n: bin_sql(*spec) for n, spec in ex.BINS.items()}
row_query("D3_bins", lambda d: ex.bins(), {n: "=" + s for n, s in BIN_SQL.items()})
row_query("D4_tyre_ratios", lambda d: ex.tyre_ratios(), {
    "TyreAgeRatio": sql_div("TyreLife", "greatest(LapNumber, 1)"),
    "LapPerTyreLife": sql_div("LapNumber", "TyreLife + 1"),
    "TyreLife_x_RaceProgress": "TyreLife * RaceProgress",
    "PitWindowPressure": "TyreLife * RaceProgress",
    "TyreAgeVsRace": sql_div("TyreLife", f"greatest({TOTAL}, 1)"),
    "TyreLife_to_LapsRemaining": sql_div("TyreLife", f"{LEFT} + 1"),
    "LapMinusTyreLife": "LapNumber - TyreLife"})
row_query("D5_stint", lambda d: ex.stint(), {
    "StintPressure": "Stint * TyreLife", "Is_First_Stint": "#(Stint = 1)", "Is_Late_Stint": "#(Stint >= 3)"})
row_query("D6_position_pressure", lambda d: ex.position_pressure(), {"PositionPressure": "Position * RaceProgress"})
row_query("D7_degradation", lambda d: ex.degradation(), {
    "DegPerRaceLap": sql_div("Cumulative_Degradation", "greatest(LapNumber, 1)"),
    "DegPerTyreLap": sql_div("Cumulative_Degradation", "greatest(TyreLife, 1)"),
    "Abs_Cumulative_Degradation": "abs(Cumulative_Degradation)",
    "Positive_Degradation": "#(Cumulative_Degradation > 0)"})
row_query("D8_lap_delta", lambda d: ex.lap_delta(), {
    "DeltaAbs": "abs(LapTime_Delta)", "LapTimeDeltaPositive": "#(LapTime_Delta > 0)",
    "DeltaPerTyreLap": sql_div("LapTime_Delta", "greatest(TyreLife, 1)")})
row_query("D9_position_change", lambda d: ex.position_change(), {
    "Abs_Position_Change": "abs(Position_Change)", "Gained_Position": "#(Position_Change > 0)",
    "Lost_Position": "#(Position_Change < 0)"})
row_query("D10_second_view", lambda d: ex.second_view(), {
    "LapNumber_over_RaceProgress": sql_div("LapNumber", "RaceProgress"),
    "TyreLife_over_LapNumber": "TyreLife / greatest(LapNumber, 1)",
    "LapTime_x_Degradation": "LapTime * Cumulative_Degradation",
    "LapTime_x_Degradation_abs": "LapTime * abs(Cumulative_Degradation)",
    "LapTime_over_Degradation_abs": sql_div("LapTime", "abs(Cumulative_Degradation)")})
NORM = "CASE Compound " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ex.STINT_LAPS.items()) + " ELSE 17.0 END"
NORM = f"CAST({NORM} AS DOUBLE)"
row_query("D11_compound_age", lambda d: ex.compound_age(), {
    "NormTyreLife": f"TyreLife / {NORM}", "LapsOverdue": f"TyreLife - {NORM}",
    "TyreOverdue": f"#(TyreLife > {NORM})", "NormTyre_x_RaceProgress": f"TyreLife / {NORM} * RaceProgress"})

DIGIT_SQL = {}
for col in ex.DIGIT_BASE:
    x = f"round({col}, 6)"
    DIGIT_SQL[f"{col}_sign"] = f"#sign({x})"
    for p in (1, 10, 100, 1000):
        DIGIT_SQL[f"{col}_digit_{p}s"] = f"#(CAST(floor(abs({x})) AS BIGINT) // {p} % 10)"
    for d in (1, 2, 3):
        DIGIT_SQL[f"{col}_decimal_digit_{d}"] = f"#(CAST(floor(abs({x}) * CAST({10 ** d} AS DOUBLE)) AS BIGINT) % 10)"
row_query("D12_digits", lambda d: ex.digits(), DIGIT_SQL)

CAT_SQL = {}
for col, (rounds, steps) in ex.NUMBER_CATS.items():
    CAT_SQL[f"{col}_exact"] = col
    for d in rounds:
        k = f"CAST({10 ** d} AS DOUBLE)"
        CAT_SQL[f"{col}_round_{d}"] = f"round_even({col} * {k}, 0) / {k}"
    for s in steps:
        k = f"CAST({s} AS DOUBLE)"
        CAT_SQL[f"{col}_step_{str(s).replace('.', '_')}"] = f"round_even({col} / {k}, 0) * {k}"
row_query("D13_number_categories", lambda d: ex.number_categories(), CAT_SQL)


def key_sql(x: str) -> str:
    scaled = f"CAST(round_even({x} * 1000000, 0) AS BIGINT)"
    return f"CAST({scaled if x in ('TyreLife', 'RaceProgress', 'Position_Change') else x} AS VARCHAR)"


row_query("D14_bigrams", lambda d: ex.bigrams(dict(d.dtypes)), {
    f"{a}__{b}": f"=concat_ws('__', {key_sql(a)}, {key_sql(b)})" for a, b in combinations(ex.BIGRAM_BASE, 2)})

WITH_BINS = ("binned", "SELECT *, " + ", ".join(f"{s} AS {n}" for n, s in BIN_SQL.items()) + " FROM laps")


def cross_sql(names=tuple(ex.CROSSES)) -> str:
    return ", ".join(f"concat_ws('_', {', '.join(ex.CROSSES[n])}) AS {n}" for n in names)


@query("D15_cross_categories", on_laps(f"SELECT id, {cross_sql()} FROM binned", WITH_BINS))
def d15(spark, sf):
    return laps(spark, sf).withColumns(ex.bins()).select("id", *[e.alias(n) for n, e in ex.crosses().items()])


@query("D16_source_flag", on_laps("""
    SELECT id, 1 AS is_original FROM train UNION ALL SELECT id, 0 FROM ext"""))
def d16(spark, sf):
    orig, ext = split_of(spark, sf, "train"), split_of(spark, sf, "ext")
    return orig.select("id", F.lit(1).alias("is_original")).unionByName(ext.select("id", F.lit(0).alias("is_original")))


@query("D17_null_sentinels", on_laps("""
    SELECT id, coalesce(CASE WHEN id % 97 <> 0 THEN Compound END, '__NA__') AS Compound,
      coalesce(Driver, '__NA__') AS Driver, coalesce(Race, '__NA__') AS Race FROM laps"""))
def d17(spark, sf):
    # a few compounds are missing as delivered; the event log has none missing, so the lap table's copy blanks some. All rows are read and kept
    d = laps(spark, sf).withColumn("Compound", F.when(F.col("id") % 97 != 0, F.col("Compound")))
    return d.withColumns(ex.no_nulls(["Compound", "Driver", "Race"])).select("id", "Compound", "Driver", "Race")
