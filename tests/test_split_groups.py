"""The plans for hot groups are exact: the same queries with tiny limits, so that all of them split."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paddock.operators import spread as sp
from paddock.operators.auc import auc
from paddock.operators.encoders import fit_bins
from paddock.operators.timeline import neighbours, running
from paddock.sources.laps import build_laps, table
from tests.conftest import SF
from tools.check import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SPLIT = [
    "F1_pit_cost", "F4_field_lap_stats", "F5_pace_ratio_nearest", "F7_laps_since_sc", "F10_pits_so_far", "F13_neighbour_pits",
    "F15_typical_stint", "F18_pit_window", "F20_rolling_laptime", "F24_stint_start_pace", "F25_pace_acceleration",
    "F26_tyre_age_peer_rank", "E4_first_seen_codes", "E8_shared_dictionary", "E17_tyre_overdue", "E19_percentile_map",
    "C1_stratified_folds", "C7_subsample_flagged", "T2_stint_lags", "T4_next_event_target", "T6_identity_audit",
    "A1_roc_auc", "A4_slice_auc", "A6_spearman", "A7_calibration", "A19_tie_clusters", "B6_rank_blend_remapped",
    "B10_remap_by_rank", "B13_slice_weights", "B15_weight_line", "R7_describe", "R12_rate_by_field_pit_share",
]


@pytest.mark.parametrize("name", SPLIT)
def test_split_plan_matches_sql(tight, con, name):
    _, message = compare(tight, con, SF, name, QUERIES[name], ORACLES[name])
    assert message.startswith("ok"), message


def test_laps_build_in_blocks(tight, con):
    build = lambda s, sf: build_laps(table(s, sf, "events"), lambda name, b: sp.cut(b()))
    _, message = compare(tight, con, SF, "laps", build, ORACLES["base_laps"])
    assert message.startswith("ok"), message


@pytest.fixture
def skewed(tight, con):
    """A third of the rows in one group, another third with one value."""
    d = table(tight, SF, "events").withColumns({
        "k": F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")),
        "v": F.when(F.col("event_id") % 3 == 1, 7.0).otherwise(F.floor("value").cast("double")),
        "y": (F.col("event_type") == "purchase").cast("int"),
    }).select("event_id", "k", "v", "y")
    con.execute("""CREATE OR REPLACE VIEW skewed AS SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS k,
        CASE WHEN event_id % 3 = 1 THEN 7.0::DOUBLE ELSE floor(value) END AS v, CAST(event_type = 'purchase' AS INT) AS y FROM events""")
    return d


def same(spark, con, df, sql):
    _, message = compare(spark, con, SF, "q", lambda s, d: df, sql)
    assert message.startswith("ok"), message


def test_positions_of_a_hot_group_with_a_hot_value(tight, con, skewed):
    same(tight, con, sp.with_position(skewed, ["k"], ["v", "event_id"], "p").select("event_id", "p"),
         "SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY v, event_id) AS p FROM skewed")
    same(tight, con, sp.with_position(skewed, [], ["v", "event_id"], "p").select("event_id", "p"),
         "SELECT event_id, row_number() OVER (ORDER BY v, event_id) AS p FROM skewed")


def test_ranges_stay_small_under_skew(tight, skewed):
    limit = sp.size_limit(skewed, ["k"])
    s = sp.spread(skewed, ["k"], ["v", "event_id"], limit)
    assert s.groupBy("k", sp.RNG).count().agg(F.max("count")).first()[0] <= 2 * limit


def test_ranks_of_one_group_with_unique_values(tight, con, skewed):
    same(tight, con, sp.with_avg_rank(skewed, [], {"event_id": "p"}, "raw").select("event_id", "p"),
         "SELECT event_id, CAST(rank() OVER (ORDER BY event_id) AS DOUBLE) AS p FROM skewed")


def test_ranks_and_auc_of_a_hot_group(tight, con, skewed):
    same(tight, con, sp.with_avg_rank(skewed, ["k"], {"v": "p"}, "raw").select("event_id", "p"),
         """SELECT event_id, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0::DOUBLE AS p
         FROM skewed""")
    got = {r["k"]: r["auc"] for r in auc(skewed, ["k"], "v", "y").collect()}
    rows = skewed.where("k = 0").toPandas()
    pos, neg = rows[rows.y == 1].v.to_numpy(), rows[rows.y == 0].v.to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert got[0] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_quantiles_of_a_hot_group(tight, con, skewed):
    probs = {"a": 0.05, "b": 0.5, "c": 0.95}
    d = sp.quantiles(skewed, ["k"], "v", probs).select("k", *[F.round(c, 9).alias(c) for c in probs])
    same(tight, con, d, "SELECT k, " + ", ".join(f"round(quantile_cont(v, {q}), 9) AS {n}" for n, q in probs.items())
         + " FROM skewed GROUP BY k")


def test_many_quantiles_of_a_hot_group(tight, con, skewed):
    d = tight.createDataFrame([(i, e) for i, e in enumerate(fit_bins(skewed, ["event_id"], 200)["event_id"])], "i int, e double")
    qs = ", ".join(str(i / 200) for i in range(1, 200))
    same(tight, con, d.select("i", F.round("e", 6).alias("e")),
         f"""SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INT) AS i, round(e, 6) AS e FROM (
         SELECT unnest(quantile_cont(CAST(event_id AS DOUBLE), [{qs}])) AS e FROM skewed)""")


@pytest.fixture
def awkward(spark, con):
    """Null keys, null and NaN order values, one frequent text, and a tie-break that follows the value."""
    spark.conf.set("paddock.hotRows", "40")
    spark.conf.set("paddock.blockRows", "7")
    rows = []
    for i in range(900):
        k = None if i % 3 == 0 else ("a" if i % 3 == 1 else f"k{i % 7}")
        v = None if i % 11 == 0 else (float("nan") if i % 13 == 0 else float(i // 100))
        rows.append((i, k, v, "x" if i % 2 else f"t{i:04d}", i // 9))
    d = spark.createDataFrame(rows, "id long, k string, v double, t string, pos long")
    yield d
    spark.conf.unset("paddock.hotRows")
    spark.conf.unset("paddock.blockRows")


def both_ways(spark, make):
    split = sorted(map(tuple, make().collect()), key=str)
    spark.conf.set("paddock.hotRows", "1000000")
    spark.conf.set("paddock.blockRows", "1000000")
    plain = sorted(map(tuple, make().collect()), key=str)
    assert len(split) > 0 and str(split) == str(plain)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["v", "id"], ["t", "id"]])
def test_positions_on_both_paths(spark, awkward, keys, order):
    both_ways(spark, lambda: sp.with_position(awkward, keys, order, "p").select("id", "p"))


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks_on_both_paths(spark, awkward, keys):
    both_ways(spark, lambda: sp.with_avg_rank(awkward, keys, {"v": "p", "t": "q"}).select("id", "p", "q"))
    assert awkward.where("k IS NULL AND v IS NOT NULL").count() == sp.with_avg_rank(awkward, ["k"], {"v": "p"}).where("k IS NULL AND p IS NOT NULL").count()


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_on_both_paths(spark, awkward, method):
    d = awkward.where("NOT isnan(v)")
    both_ways(spark, lambda: sp.quantiles(d, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}, method=method).select("k", *[F.round(c, 9).alias(c) for c in "abc"]))
    assert sp.quantiles(d, ["k"], "v", {"a": 0.5}).where("k IS NULL").count() == 1


def test_prefix_sums_and_auc_on_both_paths(spark, awkward):
    t = awkward.where("v IS NOT NULL").groupBy("k", "t").agg(F.count("*").alias("n"))
    both_ways(spark, lambda: sp.prefix_sums(t, ["k"], "t", ["n"], sp.size_limit(t, ["k"])).select("k", "t", "n", "n_below"))
    y = awkward.withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    both_ways(spark, lambda: auc(y, ["k"], "pos", "y").select("k", F.round("auc", 12).alias("auc"), "n"))


def test_timelines_on_both_paths(spark, awkward):
    d = sp.with_position(awkward, ["k"], ["id"], "at")
    both_ways(spark, lambda: running(d, ["k"], "at", {"s": ("sum", F.col("id")), "m": ("min", F.col("v")), "x": ("max", F.col("pos"))}).select("id", "s", "m", "x"))
    both_ways(spark, lambda: neighbours(d, ["k"], "at", lambda w: {"z": F.lag("id", 2).over(w)}, back=2).select("id", "z"))


def test_a_tie_break_that_follows_the_value_still_cuts(spark, awkward):
    d = spark.range(4000).select(F.col("id"), F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("v"))
    s = sp.spread(d, [], ["v", "id"], 40)
    assert s.groupBy(sp.RNG).count().agg(F.max("count")).first()[0] <= 160
