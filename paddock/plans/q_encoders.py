"""Encoders: frequency, codes, bins, target statistics, group statistics, scaling, sequences."""

from pyspark.sql import functions as F

from ..functions import exprs as ex
from ..operators import encoders as en
from ..operators import target_stats as ts
from ..operators.folds import stratified_folds
from ..operators.timeline import neighbours
from ..sources.laps import CATS, RYD, TARGET, laps, split_of
from .q_domain import WITH_BINS, cross_sql
from .q_folds import FOLDED, fold_sql, folded
from .registry import on_laps, query, r, rounded


#: The compound of the lap before: null on a first lap, so there is a null category to count.
PREV = ("prev", "SELECT *, lag(Compound) OVER (PARTITION BY Race, Year, Driver ORDER BY LapNumber) AS PrevCompound FROM laps")
INDUCTIVE = "(SELECT * FROM prev WHERE split <> 'test')"


def with_previous(d):
    return neighbours(d, RYD, "LapNumber", lambda w: {"PrevCompound": F.lag("Compound").over(w)}, back=1)


def count_sql(columns, fit: str, freq: bool) -> str:
    out = ["id"]
    joins = ""
    for x in columns:
        out.append(f"coalesce(c_{x}.n, 0) AS {x}_count")
        if freq:
            out.append(r(f"CAST(coalesce(c_{x}.n, 0) AS DOUBLE) / (SELECT count(*) FROM {fit})", f"{x}_freq"))
        same = "IS NOT DISTINCT FROM" if freq else "="
        joins += f" LEFT JOIN (SELECT {x}, count(*) AS n FROM {fit} GROUP BY {x}) c_{x} ON c_{x}.{x} {same} l.{x}"
    return on_laps(f"SELECT {', '.join(out)} FROM prev l{joins}", PREV)


def freq_query(columns, keep, total):
    def run(spark, sf):
        d = with_previous(laps(spark, sf))
        d = en.frequency(d.select("id", "split", *columns), d.where(keep), columns, total, count_null=total)
        return rounded(d.select("id", *[f"{x}_count" for x in columns], *[f"{x}_freq" for x in columns if total]))
    return run


COUNTED = [*CATS, "Year", "PitStop"]
FREQ = [*CATS, "PrevCompound"]
query("E1_frequency", count_sql(FREQ, "prev", True))(freq_query(FREQ, "true", True))
query("E2_inductive_frequency", count_sql(FREQ, INDUCTIVE, True))(freq_query(FREQ, "split <> 'test'", True))
query("E3_train_counts", count_sql([*COUNTED, "PrevCompound"], "(SELECT * FROM prev WHERE split = 'train')", False))(
    freq_query([*COUNTED, "PrevCompound"], "split = 'train'", False))


def code_sql(columns, fit: str, offset: int, by: str, unseen: int) -> str:
    joins = "".join(
        f" LEFT JOIN (SELECT {x}, row_number() OVER (ORDER BY {by.format(x=x)}) - 1 AS n FROM {fit} GROUP BY {x}) c_{x}"
        f" ON c_{x}.{x} = l.{x}" for x in columns)
    out = ", ".join(f"CAST(coalesce(c_{x}.n + {offset}, {unseen}) AS INT) AS {x}_code" for x in columns)
    return f"SELECT id, {out} FROM laps l{joins}"


def code_query(columns, fit, fitter, offset=0, unseen=-1):
    def run(spark, sf):
        f = laps(spark, sf) if fit == "laps" else split_of(spark, sf, fit)
        d = laps(spark, sf).select("id", *columns)
        for x in columns:
            codes = fitter(f, x, f"{x}_code").withColumn(f"{x}_code", F.col(f"{x}_code") + offset)
            d = en.apply_codes(d, codes, x, f"{x}_code", unseen)
        return d.select("id", *[f"{x}_code" for x in columns])
    return run


query("E4_first_seen_codes", on_laps(code_sql(COUNTED, "train", 0, "min(id)", -1)))(
    code_query(COUNTED, "train", en.first_seen_codes))
query("E8_shared_dictionary", on_laps(code_sql(CATS, "laps", 0, "{x}", -1)))(
    code_query(CATS, "laps", en.sorted_codes))
query("E9_codes_with_unknown_slot", on_laps(code_sql(CATS, "train", 1, "min(id)", 0)))(
    code_query(CATS, "train", en.first_seen_codes, offset=1, unseen=0))
query("E10_ordinal_codes", on_laps(code_sql(CATS, "train", 0, "{x}", -1)))(
    code_query(CATS, "train", en.sorted_codes))


def bin_sql(column: str, n: int, fit: str = "train") -> tuple[str, str]:
    qs = ", ".join(str(i / n) for i in range(1, n))
    edges = f"SELECT DISTINCT unnest(quantile_cont(CAST({column} AS DOUBLE), [{qs}])) AS e FROM {fit}"
    return (f"b_{column}", f"""SELECT v AS {column}, CAST((SELECT count(*) FROM ({edges}) WHERE e <= v) AS INT) AS b
        FROM (SELECT DISTINCT {column} AS v FROM laps)""")


@query("E5_quantile_bins", on_laps("""
    SELECT id, b_RaceProgress.b AS RaceProgress_200_bin, b_LapTime.b AS LapTime_7_bin FROM laps
    JOIN b_RaceProgress USING (RaceProgress) JOIN b_LapTime USING (LapTime)""",
    bin_sql("RaceProgress", 200), bin_sql("LapTime", 7)))
def e5(spark, sf):
    train = split_of(spark, sf, "train")
    edges = {**en.fit_bins(train, ["RaceProgress"], 200), **en.fit_bins(train, ["LapTime"], 7)}
    return laps(spark, sf).select(
        "id", en.apply_bins("RaceProgress", edges["RaceProgress"]).alias("RaceProgress_200_bin"),
        en.apply_bins("LapTime", edges["LapTime"]).alias("LapTime_7_bin"))


E6 = ["TyreLife", "LapTime", "Cumulative_Degradation", "RaceProgress"]


E6_BLANKED = "SELECT id, " + ", ".join(f"CASE WHEN id % 53 <> 0 THEN {x} END AS {x}" for x in E6) + " FROM "


@query("E6_quantile_bins_with_null_slot", on_laps(
    "SELECT id, " + ", ".join(f"coalesce(b_{x}.b, 32) AS {x}_bin" for x in E6)
    + " FROM lapsb " + " ".join(f"LEFT JOIN b_{x} USING ({x})" for x in E6),
    ("lapsb", E6_BLANKED + "laps"), ("trainb", E6_BLANKED + "train"), *[bin_sql(x, 32, "trainb") for x in E6]))
def e6(spark, sf):
    # the lap table misses no value, so some are blanked for the extra slot; quantiles pass over them, all rows are read and kept
    blank = lambda d: d.withColumns({x: F.when(F.col("id") % 53 != 0, F.col(x)) for x in E6})
    edges = en.fit_bins(blank(split_of(spark, sf, "train")), E6, 32)
    return blank(laps(spark, sf)).select("id", *[en.apply_bins(x, edges[x], null_slot=32).alias(f"{x}_bin") for x in E6])


COMBOS = {"Race_Compound": ["Race", "Compound"], "Race_Year": ["Race", "Year"]}


@query("E7_combo_codes", on_laps(
    code_sql(list(COMBOS), "ctrain", 0, "min(id)", -1).replace("FROM laps l", "FROM combos l"),
    ("combos", "SELECT *, concat_ws('_', Race, Compound) AS Race_Compound, concat_ws('_', Race, Year) AS Race_Year FROM laps"),
    ("ctrain", "SELECT * FROM combos WHERE split = 'train'")))
def e7(spark, sf):
    d = laps(spark, sf).withColumns(ex.crosses(COMBOS))
    train = d.where(F.col("split") == "train")
    out = d.select("id", *COMBOS)
    for x in COMBOS:
        out = en.apply_codes(out, en.first_seen_codes(train, x, f"{x}_code"), x, f"{x}_code")
    return out.select("id", *[f"{x}_code" for x in COMBOS])


@query("E11_cap_cardinality", on_laps("""
    SELECT id, coalesce(k.Driver, '__OTHER__') AS Driver_capped FROM laps l LEFT JOIN (
      SELECT Driver FROM (SELECT Driver, row_number() OVER (ORDER BY count(*) DESC, Driver) AS p,
        count(*) OVER () AS d FROM laps GROUP BY Driver) WHERE p < 64 OR d <= 64) k ON k.Driver = l.Driver"""))
def e11(spark, sf):
    d = laps(spark, sf).select("id", "Driver")
    return en.cap_cardinality(d, d, "Driver", 64, "Driver_capped").select("id", "Driver_capped")


NESTED = ("nested", "SELECT *, concat_ws('_', Race, Compound) AS Race_Compound, concat_ws('_', Race, Year) AS Race_Year FROM ("
          + fold_sql("fold, Year, PitNextLap", "folded", seed=43, out="inner_fold") + ")")


def nested_rows(spark, sf):
    d = stratified_folds(folded(spark, sf), ["fold", "Year", TARGET], seed=43, out="inner_fold")
    return d.withColumns(ex.crosses(COMBOS))


def te_sql(key: str) -> str:
    """Straight definition: filter the training part of each (outer, inner) pair and average."""
    return f"""
      SELECT a.id, o.k AS "outer", a.fold, a.inner_fold, a.{key},
        CASE WHEN o.k = a.fold THEN -1 ELSE a.inner_fold END AS part
      FROM nested a CROSS JOIN (SELECT DISTINCT fold AS k FROM nested) o"""


def te_stats(key: str) -> str:
    """Mean, number and population variance of the rows that each (outer, part) may see, by key; without a key, of all of them."""
    by = f", t.{key}" if key else ""
    return f"""
      SELECT o.k AS "outer", i.j AS part{by}, avg(t.PitNextLap) AS m, var_pop(t.PitNextLap) AS v, count(*) AS n
      FROM (SELECT DISTINCT fold AS k FROM nested) o
      CROSS JOIN (SELECT DISTINCT inner_fold AS j FROM nested UNION ALL SELECT -1) i
      JOIN nested t ON t.fold <> o.k AND t.inner_fold <> i.j
      GROUP BY o.k, i.j{by}"""


def eb_sql(key: str, every: str) -> str:
    """Empirical-Bayes shrinkage: n t / (v + n t), with v the variance within the key and t that of all rows."""
    w = f"coalesce({key}.n * {every}.v / nullif({key}.v + {key}.n * {every}.v, 0), 0)"
    return f"CASE WHEN {key}.n IS NULL THEN {every}.m ELSE {w} * {key}.m + (1 - {w}) * {every}.m END"


@query("E12_nested_target_encoding", on_laps(
    f"""SELECT a.id, a."outer", {r(eb_sql('x', 'p'), 'Race_Compound_te')}, {r(eb_sql('y', 'p'), 'Race_Year_te')}
    FROM rows_rc a JOIN rows_ry b ON a.id = b.id AND a."outer" = b."outer"
    JOIN st p ON p."outer" = a."outer" AND p.part = a.part
    LEFT JOIN st_rc x ON x."outer" = a."outer" AND x.part = a.part AND x.Race_Compound = a.Race_Compound
    LEFT JOIN st_ry y ON y."outer" = b."outer" AND y.part = b.part AND y.Race_Year = b.Race_Year""",
    FOLDED, NESTED, ("rows_rc", te_sql("Race_Compound")), ("rows_ry", te_sql("Race_Year")),
    ("st_rc", te_stats("Race_Compound")), ("st_ry", te_stats("Race_Year")), ("st", te_stats(""))))
def e12(spark, sf):
    return rounded(ts.nested_target_encode(
        nested_rows(spark, sf), {"Race_Compound": "Race_Compound_te", "Race_Year": "Race_Year_te"}, TARGET, "fold", "inner_fold"))


# fixed key lists
TS_KEYS = [
    "Driver", "Race_Year", "Driver_Race", "Driver_Compound", "Race_Compound", "Race_Compound_Stint",
    "Compound_TyreLifeBin", "RacePhase_TyreLifeBin", "Compound_Stint", "TyreLifeBin", "PositionBin",
]
OUTER = '"outer"'
TS_ROWS = [
    FOLDED, WITH_BINS,
    ("ts_rows", f"""SELECT b.*, {OUTER}, CASE WHEN f.fold = {OUTER} THEN -1 ELSE f.inner_fold END AS part FROM (
        SELECT id, Driver, PitNextLap, TyreLifeBin, PositionBin, {cross_sql()} FROM binned) b
        JOIN ({fold_sql('fold, PitNextLap', 'folded', seed=44, out='inner_fold')}) f USING (id)
        CROSS JOIN (SELECT CAST(unnest(range(5)) AS INT) AS {OUTER})"""),
    ("seen", f"SELECT DISTINCT {OUTER}, part FROM ts_rows"),
    ("parts", f"""SELECT p.{OUTER}, p.part, avg(t.PitNextLap) AS m FROM seen p
        JOIN ts_rows t ON t.{OUTER} = p.{OUTER} AND t.part >= 0 AND t.part <> p.part GROUP BY p.{OUTER}, p.part"""),
] + [(f"st_{k}", f"""SELECT p.{OUTER}, p.part, t.{k}, sum(t.PitNextLap) AS s, count(*) AS n,
        coalesce(stddev_samp(t.PitNextLap), 0) AS sd FROM seen p
        JOIN ts_rows t ON t.{OUTER} = p.{OUTER} AND t.part >= 0 AND t.part <> p.part GROUP BY p.{OUTER}, p.part, t.{k}""") for k in TS_KEYS]
TS_OUT = ", ".join(
    f"{r(f'coalesce((st_{k}.s + p.m * 20) / (st_{k}.n + 20), p.m)', f'ts_{k}_mean')}, "
    f"{r(f'coalesce(st_{k}.sd, 0)', f'ts_{k}_std')}, coalesce(st_{k}.n, 0) AS ts_{k}_cnt" for k in TS_KEYS)


@query("E13_target_stats", on_laps(
    f"SELECT a.id, a.{OUTER}, {TS_OUT} FROM ts_rows a JOIN parts p ON p.{OUTER} = a.{OUTER} AND p.part = a.part "
    + " ".join(f"LEFT JOIN st_{k} ON st_{k}.{OUTER} = a.{OUTER} AND st_{k}.part = a.part AND st_{k}.{k} = a.{k}" for k in TS_KEYS), *TS_ROWS))
def e13(spark, sf):
    d = stratified_folds(folded(spark, sf), ["fold", TARGET], seed=44, out="inner_fold")
    d = d.withColumns(ex.bins()).withColumns(ex.crosses())
    out = ts.add_target_stats(d.select("id", TARGET, "fold", "inner_fold", *TS_KEYS), TS_KEYS, TARGET, "fold", "inner_fold")
    return rounded(out.select("id", "outer", *[f"ts_{k}_{s}" for k in TS_KEYS for s in ("mean", "std", "cnt")]))


def plain_sql(keys: str) -> str:
    return f"SELECT {keys}, avg(PitNextLap) AS m, var_pop(PitNextLap) AS v, count(*) AS n FROM train GROUP BY {keys}"


@query("E14_plain_target_encoding", on_laps(
    f"""SELECT id, {r(eb_sql('x', 'p'), 'Race_Compound_te')}, {r(eb_sql('y', 'p'), 'Driver_te')} FROM train
    JOIN ({plain_sql('Race, Compound')}) x USING (Race, Compound) JOIN ({plain_sql('Driver')}) y USING (Driver),
    (SELECT avg(PitNextLap) AS m, var_pop(PitNextLap) AS v FROM train) p"""))
def e14(spark, sf):
    d = split_of(spark, sf, "train").withColumns(ex.crosses({"Race_Compound": COMBOS["Race_Compound"]}))
    fit, out = d, d
    for key in ("Race_Compound", "Driver"):
        out = ts.target_encode(out, fit, key, TARGET, f"{key}_te")
    return rounded(out.select("id", "Race_Compound_te", "Driver_te"))


# fixed key and value lists
GS_KEYS = ["Race_Year", "Race_Compound_Stint", "Driver_Race", "Compound_Stint"]
GS_VALUES = ["LapTime_Delta", "Position_Change", "RaceProgress", "TyreLife"]
GS_COLS = [f"{v}_{s}_by_{k}" for k in GS_KEYS for v in GS_VALUES for s in ("mean", "std", "diff_mean")]


def gs_sql() -> str:
    parts = []
    for k in GS_KEYS:
        for v in GS_VALUES:
            w = f"OVER (PARTITION BY {k})"
            parts += [r(f"avg({v}) {w}", f"{v}_mean_by_{k}"), r(f"coalesce(stddev_samp({v}) {w}, 0)", f"{v}_std_by_{k}"),
                      r(f"{v} - (avg({v}) {w})", f"{v}_diff_mean_by_{k}")]
    return f"SELECT id, {', '.join(parts)} FROM crossed"


@query("E15_group_stats", on_laps(gs_sql(), WITH_BINS, (
    "crossed", f"SELECT id, {', '.join(GS_VALUES)}, {cross_sql(GS_KEYS)} FROM binned")))
def e15(spark, sf):
    d = laps(spark, sf).withColumns(ex.crosses({k: ex.CROSSES[k] for k in GS_KEYS})).select("id", *GS_KEYS, *GS_VALUES)
    return rounded(en.group_stats(d, d, GS_KEYS, GS_VALUES).select("id", *GS_COLS))


E17 = ["tyre_minus_compound_median", "tyre_over_compound_p75", "tyre_overdue_p75", "tyre_overdue_p90",
       "tyre_beyond_p90_amt", "deg_vs_compound_median"]
TYREQ = ("tq", """SELECT Compound, quantile_cont(TyreLife, 0.5) AS med, quantile_cont(TyreLife, 0.75) AS p75,
    quantile_cont(TyreLife, 0.9) AS p90, quantile_cont(Cumulative_Degradation, 0.5) AS deg FROM laps GROUP BY Compound""")


@query("E17_tyre_overdue", on_laps(
    f"""SELECT id, {r('TyreLife - med', E17[0])}, {r('TyreLife / (p75 + 0.000001::DOUBLE)', E17[1])},
    CAST(TyreLife > p75 AS INT) AS {E17[2]}, CAST(TyreLife > p90 AS INT) AS {E17[3]},
    {r('greatest(TyreLife - p90, 0)', E17[4])}, {r('Cumulative_Degradation - deg', E17[5])}
    FROM laps JOIN tq USING (Compound)""", TYREQ))
def e17(spark, sf):
    d = laps(spark, sf)
    return rounded(en.add_tyre_overdue(d, d).select("id", *E17))


E18 = ["tyre_overdue_p75", "tyre_overdue_p90", "tyre_life_ratio_p50", "tyre_over_p90_flag"]


@query("E18_tyre_overdue_inductive", on_laps(
    f"""SELECT id, {r('TyreLife - coalesce(c.p75, g.p75)', E18[0])}, {r('TyreLife - coalesce(c.p90, g.p90)', E18[1])},
    {r('TyreLife / (coalesce(c.p50, g.p50) + 0.000001::DOUBLE)', E18[2])},
    CAST(TyreLife > coalesce(c.p90, g.p90) AS INT) AS {E18[3]}
    FROM laps LEFT JOIN (SELECT Compound, quantile_cont(TyreLife, 0.5) AS p50, quantile_cont(TyreLife, 0.75) AS p75,
      quantile_cont(TyreLife, 0.9) AS p90 FROM train GROUP BY Compound) c USING (Compound)
    CROSS JOIN (SELECT quantile_cont(TyreLife, 0.5) AS p50, quantile_cont(TyreLife, 0.75) AS p75,
      quantile_cont(TyreLife, 0.9) AS p90 FROM train) g"""))
def e18(spark, sf):
    return rounded(en.add_tyre_overdue_inductive(laps(spark, sf), split_of(spark, sf, "train")).select("id", *E18))


@query("E19_percentile_map", on_laps(f"""
    SELECT id, {r('''(rank() OVER (ORDER BY TyreLife) + (count(*) OVER (PARTITION BY TyreLife) - 1) / CAST(2 AS DOUBLE))
      / count(*) OVER ()''', 'tyre_global_pct')} FROM laps"""))
def e19(spark, sf):
    d = laps(spark, sf)
    return rounded(d.join(en.percentile_map(d, "TyreLife", "tyre_global_pct"), "TyreLife").select("id", "tyre_global_pct"))


SCALED = ["LapTime", "TyreLife", "LapTime_Delta", "Cumulative_Degradation", "RaceProgress"]


@query("E20_standard_scale", on_laps("SELECT id, " + ", ".join(
    r(f"({x} - (SELECT avg({x}) FROM train)) / (SELECT stddev_pop({x}) FROM train)", f"{x}_z") for x in SCALED)
    + " FROM laps"))
def e20(spark, sf):
    d = en.standard_scale(laps(spark, sf), split_of(spark, sf, "train"), SCALED)
    return rounded(d.select("id", *[f"{x}_z" for x in SCALED]))


@query("E21_winsorize", on_laps("SELECT id, " + ", ".join(
    r(f"least(greatest({x}, (SELECT quantile_cont({x}, 0.005) FROM train)), (SELECT quantile_cont({x}, 0.995) FROM train))", x)
    for x in SCALED) + " FROM laps"))
def e21(spark, sf):
    return rounded(en.winsorize(laps(spark, sf), split_of(spark, sf, "train"), SCALED).select("id", *SCALED))


#: Roles of a lap in a sequence, fixed values.
ROLES = {"test": 0, "train": 1, "ext": 2}
MAX_LEN = 128
_PAD = {"laps": 0, "roles": -1, "ids": -1, "mask": 0, "fit_mask": 0, "score_mask": 0, "new_mask": 0, "target": 0, "pace": 0}


def sequence_sql() -> str:
    """Whole padded arrays, as text; the pace in millionths, so that both engines print it alike."""
    item = {
        "laps": "LapNumber", "roles": "role", "ids": "CASE WHEN role = 2 THEN -1 ELSE id END", "mask": "1", "fit_mask": "CAST(role > 0 AS INT)",
        "score_mask": "CAST(role = 1 AS INT)", "new_mask": "CAST(role = 0 AS INT)", "target": "CASE WHEN role > 0 THEN CAST(PitNextLap AS INT) ELSE 0 END",
        "pace": "CAST(round(LapTime * 1000000 + CAST(1e-3 AS DOUBLE)) AS BIGINT)"}
    arrays = ", ".join(f"array_to_string(list_resize(list(CAST({e} AS BIGINT) ORDER BY p), {MAX_LEN}, {_PAD[n]}::BIGINT), ',') AS {n}" for n, e in item.items())
    return f"""SELECT Race, Year, Driver, source, CAST((p - 1) // {MAX_LEN} AS INT) AS segment, CAST(count(*) AS INT) AS n, {arrays} FROM (
      SELECT *, row_number() OVER (PARTITION BY Race, Year, Driver, source ORDER BY role, LapNumber, id) AS p FROM (
        SELECT *, CAST(role = 2 AS INT) AS source FROM (SELECT *, CASE split {' '.join(f"WHEN '{k}' THEN {v}" for k, v in ROLES.items())} END AS role FROM laps)))
      GROUP BY Race, Year, Driver, source, segment"""


@query("E22_sequences", on_laps(sequence_sql()))
def e22(spark, sf):
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("split"))
    d = en.role_sequences(laps(spark, sf).withColumn("role", role), RYD, "LapNumber", "role", "id", TARGET, ["LapTime"], MAX_LEN)
    whole = lambda a: F.array_join(F.transform(a, lambda x: x.cast("bigint").cast("string")), ",")
    pace = F.transform("LapTime", lambda x: F.round(x * 1000000 + 1e-3))
    arrays = {n: whole(pace if n == "pace" else n) for n in _PAD}
    return d.select(*RYD, "source", "segment", "n", *[a.alias(n) for n, a in arrays.items()])
