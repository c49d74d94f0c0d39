"""Set operations and exploratory reports."""

from pyspark.sql import functions as F

from ..functions import exprs as ex
from ..operators import field as fl
from ..operators import reports as rp
from ..operators import rows as ro
from ..operators.encoders import column_quantiles, long_form
from ..operators.folds import pseudo_labels
from ..operators.spread import quantiles
from ..sources.laps import CATS, LAP_SCHEMA, NUMS, RYD, RYL, TARGET, combined, oof, split_of
from .features import features
from .q_features import FEATURE_CTES, FIELD, LOO, PACE
from .q_folds import FOLDED, folded
from .registry import on_laps, query, r, rounded

COLS = LAP_SCHEMA.names


def train_test(spark, sf):
    return split_of(spark, sf, "train").drop("split"), split_of(spark, sf, "test").drop("split", TARGET)


@query("U1_diagonal_union", on_laps(
    f"SELECT {', '.join(c for c in COLS if c != TARGET)}, CASE WHEN split = 'train' THEN PitNextLap END AS PitNextLap, split FROM comb"))
def u1(spark, sf):
    train, test = train_test(spark, sf)
    return ro.diagonal_union({"train": train, "test": test})


@query("U2_split_back", on_laps(f"SELECT {', '.join(c for c in COLS if c != TARGET)} FROM test"))
def u2(spark, sf):
    train, test = train_test(spark, sf)
    both = ro.diagonal_union({"train": train, "test": test})
    return both.where(F.col("split") == "test").drop("split", TARGET)


@query("U3_augmented_fold", on_laps("""
    SELECT id, PitNextLap AS target, 'train' AS source FROM folded WHERE fold <> 0
    UNION ALL SELECT id, PitNextLap, 'ext' FROM ext
    UNION ALL SELECT id, CASE WHEN RaceProgress >= 0.9 THEN 1 ELSE 0 END, 'pseudo' FROM test
      WHERE RaceProgress >= 0.9 OR RaceProgress <= 0.1""", FOLDED))
def u3(spark, sf):
    tag = lambda d, s: d.select("id", F.col(TARGET).alias("target"), F.lit(s).alias("source"))
    train = folded(spark, sf).select("id", F.col(TARGET).alias("target"), F.lit("train").alias("source"), "fold")
    test = pseudo_labels(split_of(spark, sf, "test"), "RaceProgress", 0.9, 0.1).withColumn(TARGET, F.col("pseudo").cast("double"))
    return ro.augment_fold(train, 0, tag(split_of(spark, sf, "ext"), "ext"), tag(test, "pseudo"))


@query("U4_distinct_laps", on_laps("SELECT DISTINCT Race, Year, LapNumber, sc_likely FROM pace", FIELD, PACE))
def u4(spark, sf):
    d = combined(spark, sf)
    lap = fl.lap_table(d).transform(fl.add_pace_ratio).select(*RYL, "sc_likely")
    return d.select(*RYL).join(lap, RYL).dropDuplicates(RYL)


@query("U5_group_overlap", on_laps("""
    SELECT count(*) FILTER (WHERE l AND r) AS shared, count(*) FILTER (WHERE l AND NOT r) AS only_left,
      count(*) FILTER (WHERE r AND NOT l) AS only_right
    FROM (SELECT Race, Year, Driver, bool_or(split = 'train') AS l, bool_or(split = 'test') AS r FROM comb GROUP BY ALL)"""))
def u5(spark, sf):
    return ro.key_overlap(*train_test(spark, sf), RYD)


@query("U6_shared_laps", on_laps("""
    SELECT Race, Year, Driver, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right,
      count(*) FILTER (WHERE l > 0 AND r > 0) AS n_common_laps FROM (
      SELECT Race, Year, Driver, LapNumber, count(*) FILTER (WHERE split = 'train') AS l,
        count(*) FILTER (WHERE split = 'test') AS r FROM comb GROUP BY ALL)
    GROUP BY Race, Year, Driver HAVING sum(l) > 0 AND sum(r) > 0"""))
def u6(spark, sf):
    return ro.shared_laps(*train_test(spark, sf), RYD)


DUP = ["Compound", "Race", "Year", "PitStop", "LapNumber", "Stint", "TyreLife"]


@query("U7_duplicate_features", on_laps(
    f"SELECT {', '.join(DUP)} FROM train INTERSECT SELECT {', '.join(DUP)} FROM test"))
def u7(spark, sf):
    train, test = train_test(spark, sf)
    return train.select(*DUP).intersect(test.select(*DUP))


def side_sql(a: str, b: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{name}' AS side, {c} AS value FROM (SELECT {c} FROM {a} EXCEPT SELECT {c} FROM {b})" for c in CATS)


@query("U8_category_difference", on_laps(side_sql("train", "ext", "only_left") + " UNION ALL " + side_sql("ext", "train", "only_right")))
def u8(spark, sf):
    return ro.category_difference(split_of(spark, sf, "train"), split_of(spark, sf, "ext"), CATS)


@query("U9_novelty", on_laps(" UNION ALL ".join(f"""
    SELECT '{c}' AS feature, (SELECT count(DISTINCT {c}) FROM train) AS n_train_unique, count(DISTINCT {c}) AS n_test_unique,
      count(*) FILTER (WHERE {c} NOT IN (SELECT {c} FROM train)) AS n_test_novel_rows,
      {r(f'100.0 * count(*) FILTER (WHERE {c} NOT IN (SELECT {c} FROM train)) / count(*)', 'pct_test_novel')} FROM ext""" for c in CATS)))
def u9(spark, sf):
    return rounded(ro.novelty(split_of(spark, sf, "train"), split_of(spark, sf, "ext"), CATS))


@query("U10_top_and_bottom", on_laps("""
    SELECT * FROM (SELECT id, Driver, LapTime, 'top' AS side FROM comb ORDER BY LapTime DESC, id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT id, Driver, LapTime, 'bottom' AS side FROM comb ORDER BY LapTime, id LIMIT 10)"""))
def u10(spark, sf):
    return ro.extremes(combined(spark, sf).select("id", "Driver", "LapTime"), "LapTime", 10)


@query("U11_unpivot_stats", on_laps(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{s}' AS stat, {r(f'{s}({c})', 'value')} FROM comb" for c in NUMS for s in ("avg", "min", "max"))))
def u11(spark, sf):
    g = long_form(combined(spark, sf), NUMS).groupBy("column").agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rounded(g.unpivot(["column"], ["avg", "min", "max"], "stat", "value"))


@query("U12_overwrite_slice", on_laps(f"SELECT id, {r('CASE WHEN Year = 2022 THEN oof_d ELSE oof_a END', 'score')} FROM oof"))
def u12(spark, sf):
    d = oof(spark, sf)
    base = d.select("id", F.col("oof_a").alias("score"))
    special = d.where(F.col("Year") == 2022).select("id", F.col("oof_d").alias("score"))
    return rounded(ro.overwrite_slice(base, special, "score"))


DTYPES = {f.name: f.dataType.simpleString() for f in LAP_SCHEMA.fields}


@query("R1_schema_table", on_laps(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, {str(c != TARGET).lower()} AS in_test, count(DISTINCT {c}) AS n_unique,
    count(*) - count({c}) AS n_null FROM train""" for c, t in DTYPES.items())))
def r1(spark, sf):
    train, test = train_test(spark, sf)
    return rp.schema_table(train.select(*COLS), test)


@query("R2_target_counts", on_laps(f"""
    SELECT PitNextLap AS target, count(*) AS n, {r('count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE)', 'share')}
    FROM train GROUP BY PitNextLap"""))
def r2(spark, sf):
    d = split_of(spark, sf, "train")
    g = d.groupBy(F.col(TARGET).alias("target")).agg(F.count("*").alias("n"))
    return rounded(g.withColumn("share", F.col("n") / d.agg(F.count("*")).scalar()))


@query("R3_year_stats", on_laps(f"""
    SELECT Year, count(*) AS n_train, {r('avg(PitStop)', 'pit_rate')}, {r('avg(PitNextLap)', 'target_rate')},
      (SELECT count(*) FROM test t WHERE t.Year = train.Year) AS n_test FROM train GROUP BY Year"""))
def r3(spark, sf):
    train, test = train_test(spark, sf)
    g = train.groupBy("Year").agg(
        F.count("*").alias("n_train"), F.avg("PitStop").alias("pit_rate"), F.avg(TARGET).alias("target_rate"))
    return rounded(g.join(test.groupBy("Year").agg(F.count("*").alias("n_test")), "Year", "left"))


def rate_sql(keys: str, source="train", where="", names="") -> str:
    return f"SELECT {names or keys}, count(*) AS n, {r('avg(PitNextLap)', 'rate')} FROM {source} {where} GROUP BY {keys}"


@query("R4_rate_by_year_compound", on_laps(rate_sql("Year, Compound")))
def r4(spark, sf):
    return rounded(rp.rate_by(split_of(spark, sf, "train"), ["Year", "Compound"], TARGET))


@query("R5_rate_by_race", on_laps(rate_sql("Race") + " ORDER BY rate DESC, Race"))
def r5(spark, sf):
    return rounded(rp.rate_by(split_of(spark, sf, "train"), ["Race"], TARGET).orderBy(F.desc("rate"), "Race"))


@query("R6_synthetic_drivers", on_laps(f"""
    SELECT Driver LIKE 'D%' AND length(Driver) = 4 AS synthetic, count(*) AS n, count(DISTINCT Driver) AS drivers,
      {r('avg(PitNextLap)', 'rate')} FROM train GROUP BY 1"""))
def r6(spark, sf):
    d = split_of(spark, sf, "train").withColumn("synthetic", F.col("Driver").startswith("D") & (F.length("Driver") == 4))
    # drivers first, so that the distinct count needs no second pass over the rows
    per = d.groupBy("synthetic", "Driver").agg(F.count("*").alias("k"), F.sum(TARGET).alias("s"))
    g = per.groupBy("synthetic").agg(F.sum("k").alias("n"), F.count("*").alias("drivers"), F.sum("s").alias("s"))
    return rounded(g.select("synthetic", "n", "drivers", (F.col("s") / F.col("n")).alias("rate")))


@query("R7_describe", on_laps(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS count, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')},
    {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'quantile_cont({c}, 0.25)', 'q25')},
    {r(f'quantile_cont({c}, 0.5)', 'q50')}, {r(f'quantile_cont({c}, 0.75)', 'q75')} FROM train""" for c in NUMS)))
def r7(spark, sf):
    return rounded(rp.describe(split_of(spark, sf, "train"), NUMS))


TAILS = {"p0_1": 0.001, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p99_9": 0.999}
HEAVY = ["LapTime", "LapTime_Delta", "Cumulative_Degradation"]


@query("R8_tail_percentiles", on_laps(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(r(f"quantile_cont({c}, {p})", n) for n, p in TAILS.items()) + " FROM train" for c in HEAVY)))
def r8(spark, sf):
    return rounded(column_quantiles(split_of(spark, sf, "train"), HEAVY, TAILS))


@query("R9_train_test_comparison", on_laps(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r(f"avg({c}) FILTER (WHERE split = 'train')", 'train_mean')},
    {r(f"quantile_cont({c}, 0.5) FILTER (WHERE split = 'train')", 'train_median')},
    {r(f"avg({c}) FILTER (WHERE split = 'test')", 'test_mean')},
    {r(f"quantile_cont({c}, 0.5) FILTER (WHERE split = 'test')", 'test_median')} FROM comb""" for c in NUMS)))
def r9(spark, sf):
    return rounded(rp.split_comparison(combined(spark, sf), NUMS))


ALLNUM = [*NUMS, TARGET]


@query("R10_correlations", on_laps(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr')} FROM train" for i, a in enumerate(ALLNUM) for b in ALLNUM[i + 1:])))
def r10(spark, sf):
    return rounded(rp.correlations(split_of(spark, sf, "train"), ALLNUM))


# report bins, fixed values
TYRE_EDGES, TYRE_LABELS = [5, 10, 15, 20, 30], ["00-05", "06-10", "11-15", "16-20", "21-30", "31+"]
PROGRESS = [round(i / 10, 1) for i in range(1, 10)]


def case_sql(x, edges, labels):
    return "CASE " + " ".join(f"WHEN {x} <= CAST({e} AS DOUBLE) THEN '{n}'" for e, n in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"


BINNED = {
    "tyrelife": case_sql("TyreLife", TYRE_EDGES, TYRE_LABELS),
    "tyrelife_compound": f"concat({case_sql('TyreLife', TYRE_EDGES, TYRE_LABELS)}, '_', Compound)",
    "progress": case_sql("RaceProgress", PROGRESS, [f"d{i}" for i in range(1, 11)]),
    "position": "CAST(Position AS VARCHAR)",
}


@query("R11_rate_by_bins", on_laps(" UNION ALL ".join(
    f"SELECT '{k}' AS report, {v} AS bin, count(*) AS n, {r('avg(PitNextLap)', 'rate')} FROM train GROUP BY 2" for k, v in BINNED.items())))
def r11(spark, sf):
    tyre = ex.right_closed(F.col("TyreLife"), TYRE_EDGES, TYRE_LABELS)
    bins = {
        "tyrelife": tyre, "tyrelife_compound": F.concat_ws("_", tyre, "Compound"),
        "progress": ex.right_closed(F.col("RaceProgress"), PROGRESS, [f"d{i}" for i in range(1, 11)]),
        "position": F.col("Position").cast("string"),
    }
    items = F.array(*[F.struct(F.lit(k).alias("report"), v.alias("bin")) for k, v in bins.items()])
    d = split_of(spark, sf, "train").select(TARGET, F.explode(items).alias("b")).select(TARGET, "b.*")
    return rounded(rp.rate_by(d, ["report", "bin"], TARGET))


def quintile_sql(source: str, x: str) -> str:
    edges = f"SELECT DISTINCT unnest(quantile_cont({x}, [0.2, 0.4, 0.6, 0.8])) AS e FROM {source}"
    return f"""SELECT CAST(b + 1 AS INT) AS bucket, count(*) AS n, {r(f'avg({x})', 'bucket_mean')}, {r('avg(PitNextLap)', 'rate')}
      FROM (SELECT *, (SELECT count(*) FROM ({edges}) WHERE e < {x}) AS b FROM {source} WHERE {x} IS NOT NULL) GROUP BY b"""


@query("R12_rate_by_field_pit_share", on_laps(
    quintile_sql("shares", "field_pit_share"), FIELD, LOO,
    ("shares", "SELECT field_pit_share, PitNextLap FROM train JOIN loo USING (id)")))
def r12(spark, sf):
    d = fl.add_leave_one_out_share(combined(spark, sf), RYL, "PitStop", "field_pit_share").where(F.col("split") == "train")
    return rounded(rp.rate_by_quantile(d.select("field_pit_share", TARGET), "field_pit_share", TARGET, 5))


TRAINF = ("tf", "SELECT * FROM feat WHERE split = 'train'")


def train_features(spark, sf):
    return features(spark, sf).where(F.col("split") == "train")


@query("R12_rate_by_tyre_life_norm", on_laps(quintile_sql("tf", "tyre_life_norm"), *FEATURE_CTES, TRAINF))
def r12_tyre(spark, sf):
    return rounded(rp.rate_by_quantile(train_features(spark, sf), "tyre_life_norm", TARGET, 5))


@query("R13_neighbour_contingency", on_laps(rate_sql(
    "1, 2", "tf", "", "coalesce(ahead_pitted_last_3 > 0, false) AS ahead, coalesce(behind_pitted_last_3 > 0, false) AS behind"),
    *FEATURE_CTES, TRAINF))
def r13(spark, sf):
    pitted = lambda c, name: F.coalesce(F.col(c) > 0, F.lit(False)).alias(name)
    return rounded(rp.rate_by(train_features(spark, sf), [
        pitted("ahead_pitted_last_3", "ahead"), pitted("behind_pitted_last_3", "behind")], TARGET))


FLAGS = ["sc_likely", "in_pit_window", "cant_finish_on_current_tyres", "is_wet_race", "lap_is_anomalous"]


@query("R14_flag_rates", on_laps(" UNION ALL ".join(
    [f"""SELECT '{f}' AS flag, CAST({f} AS DOUBLE) AS value, count(*) AS n, {r('avg(PitNextLap)', 'rate')},
      {r('count(*) / CAST((SELECT count(*) FROM tf) AS DOUBLE)', 'share')} FROM tf WHERE {f} IS NOT NULL GROUP BY {f}""" for f in FLAGS]
    + [f"""SELECT 'stops_remaining', greatest(least(floor(stops_remaining_proxy), 3), -3), count(*), {r('avg(PitNextLap)', 'rate')},
      {r('count(*) / CAST((SELECT count(*) FROM tf) AS DOUBLE)', 'share')} FROM tf WHERE Year <> 2023 GROUP BY 2"""]),
    *FEATURE_CTES, TRAINF))
def r14(spark, sf):
    d = train_features(spark, sf)
    stops = F.greatest(F.least(F.floor("stops_remaining_proxy"), F.lit(3)), F.lit(-3))
    values = {**{f: F.col(f) for f in FLAGS}, "stops_remaining": F.when(F.col("Year") != 2023, stops)}
    items = F.array(*[F.struct(F.lit(k).alias("flag"), v.cast("double").alias("value")) for k, v in values.items()])
    long = d.select(TARGET, F.explode(items).alias("x")).select(TARGET, "x.*").where(F.col("value").isNotNull())
    g = rp.rate_by(long, ["flag", "value"], TARGET)
    return rounded(g.withColumn("share", F.col("n") / d.agg(F.count("*")).scalar()))


@query("R15_race_rankings", on_laps(f"""
    SELECT * FROM (SELECT 'pit_cost' AS report, 'top' AS side, Race, {r('pit_cost_seconds', 'value')} FROM cost ORDER BY pit_cost_seconds DESC, Race LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'pit_cost', 'bottom', Race, {r('pit_cost_seconds', 'value')} FROM cost ORDER BY pit_cost_seconds, Race LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'sc_rate', 'top', Race, {r('avg(sc_likely)', 'value')} FROM tf GROUP BY Race ORDER BY avg(sc_likely) DESC, Race LIMIT 5)""",
    *FEATURE_CTES, TRAINF))
def r15(spark, sf):
    d = train_features(spark, sf)
    cost = d.groupBy("Race").agg(F.first("pit_cost_seconds").alias("value"))
    both = ro.extremes(cost, "value", 5, "Race").withColumn("report", F.lit("pit_cost"))
    sc = d.groupBy("Race").agg(F.avg("sc_likely").alias("value")).orderBy(F.desc("value"), "Race").limit(5)
    sc = sc.withColumns({"side": F.lit("top"), "report": F.lit("sc_rate")})
    return rounded(both.unionByName(sc).select("report", "side", "Race", "value"))


@query("R16_clipped_histogram", on_laps("""
    SELECT bin, count(*) AS n, """ + r("count(*) / ((SELECT count(*) FROM train) * max(width))", "density") + """
    FROM (SELECT (hi - lo) / 50 AS width, CAST(least(floor((least(greatest(LapTime, lo), hi) - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin
      FROM train CROSS JOIN (SELECT quantile_cont(LapTime, 0.01) AS lo, quantile_cont(LapTime, 0.99) AS hi FROM train))
    GROUP BY bin"""))
def r16(spark, sf):
    d = split_of(spark, sf, "train")
    q = quantiles(d, [], "LapTime", {"lo": 0.01, "hi": 0.99}).first()
    return rounded(rp.histogram(d, "LapTime", 50, q["lo"], q["hi"]))


@query("R16_paired_histogram", on_laps("""
    SELECT split, bin, count(*) AS n, """ + r("count(*) / (max(total) * max(width))", "density") + """
    FROM (SELECT split, count(*) OVER (PARTITION BY split) AS total, (hi - lo) / 40 AS width,
        CAST(least(floor((LapTime - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin
      FROM comb CROSS JOIN (SELECT min(LapTime) AS lo, max(LapTime) AS hi FROM comb)) GROUP BY split, bin"""))
def r16_paired(spark, sf):
    d = combined(spark, sf)
    span = d.agg(F.min("LapTime").alias("lo"), F.max("LapTime").alias("hi")).first()
    return rounded(rp.histogram(d, "LapTime", 40, span["lo"], span["hi"], ["split"]))
