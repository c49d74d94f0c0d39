"""Scans, sinks, the prediction pool and alignment checks."""

import hashlib

from pyspark.sql import functions as F

from ..session import stage_dir
from ..sources import scans as sc
from ..sources.laps import LAP_SCHEMA, TARGET, combined, laps, oof, split_of, table
from .features import features
from .q_folds import OOF_FOLDED, oof_folded
from .registry import on_laps, query, r, rounded

LAP_COLS = LAP_SCHEMA.names


def folder(spark, sf, name):
    """A folder of this run in the shared stage directory."""
    tag = hashlib.md5(sf.encode()).hexdigest()[:12]
    return f"{stage_dir(spark)}/{spark.sparkContext.applicationId}/{tag}/{name}"


@query("base_laps", on_laps("SELECT * FROM laps"))
def base_laps(spark, sf):
    return laps(spark, sf)


@query("S1_csv_scan", on_laps(f"SELECT {', '.join(LAP_COLS)} FROM train"))
def s1(spark, sf):
    path = folder(spark, sf, "train_csv")
    split_of(spark, sf, "train").select(*LAP_COLS).write.mode("overwrite").csv(path, header=True)
    return sc.scan_csv(spark, path)


@query("S2_external_scan", on_laps(
    f"SELECT {', '.join(x for x in LAP_COLS if x != 'id')}, CAST(-1 AS BIGINT) AS id FROM delivered WHERE Compound IS NOT NULL",
    ("delivered", f"SELECT {', '.join(x for x in LAP_COLS if x not in ('id', 'Compound'))}, CASE WHEN id % 50 <> 0 THEN Compound END AS Compound FROM ext")))
def s2(spark, sf):
    # lay the augmentation rows out as delivered: no id, a leaky column, some missing compounds (the scan drops those rows)
    path = folder(spark, sf, "ext_csv")
    d = split_of(spark, sf, "ext").withColumn("Compound", F.when(F.col("id") % 50 != 0, F.col("Compound")))
    d = d.withColumn("Normalized_TyreLife", F.col("TyreLife") / 30.0).drop("id", "split")
    d.select(*[x for x in LAP_COLS if x != "id"], "Normalized_TyreLife").write.mode("overwrite").csv(path, header=True)
    return sc.scan_external(spark, path, "Normalized_TyreLife")


@query("S3_pruned_parquet_scan", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 25 AND l_returnflag = 'R'""")
def s3(spark, sf):
    d = table(spark, sf, "lineitem").where((F.col("l_quantity") >= 25) & (F.col("l_returnflag") == "R"))
    return d.select("l_orderkey", "l_linenumber", "l_quantity")


@query("S4_feature_sink", on_laps("SELECT split, count(*) AS n FROM comb GROUP BY split"))
def s4(spark, sf):
    return features(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query("S5_oof_sink", on_laps(f"SELECT id, Year, target, {r('oof_d', 'oof')}, fold FROM oof_folded", OOF_FOLDED))
def s5(spark, sf):
    path = folder(spark, sf, "oof_d.parquet")
    sc.write_oof(oof_folded(spark, sf).withColumnRenamed("oof_d", "oof"), path)
    return rounded(spark.read.parquet(path))


@query("S6_submission_sink", on_laps(f"SELECT id, {r('TyreLife / (TyreLife + 10)', 'PitNextLap')} FROM test"))
def s6(spark, sf):
    path = folder(spark, sf, "submission_csv")
    score = F.col("TyreLife") / (F.col("TyreLife") + 10.0)
    sc.write_submission(split_of(spark, sf, "test").select("id", score.alias("PitNextLap")), path)
    return rounded(spark.read.schema("id long, PitNextLap double").csv(path, header=True))


def pool(spark, sf):
    """A pool of base tables on disk (tests/test_sources.py has pools with bases that must be refused)."""
    d = oof_folded(spark, sf)
    where = folder(spark, sf, "pool")
    test = split_of(spark, sf, "test").select("id", F.lit(0.5).alias("PitNextLap"))
    for name, column in {"tyre": "oof_a", "pace": "oof_c", "strong": "oof_d"}.items():
        sc.write_oof(d.withColumn("oof", F.col(column)), f"{where}/oof_{name}.parquet")
        sc.write_submission(test, f"{where}/submission_{name}.csv")
    return sc.load_pool(spark, where, oof(spark, sf))


@query("S7_prediction_pool", on_laps(" UNION ALL ".join(
    f"SELECT '{n}' AS base, id, {r(c, 'score')} FROM oof" for n, c in
    {"tyre": "oof_a", "pace": "oof_c", "strong": "oof_d"}.items())))
def s7(spark, sf):
    return rounded(pool(spark, sf))


@query("S8_alignment", on_laps("""
    SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS matched,
      count(*) FILTER (WHERE b.id IS NULL) AS only_left, count(*) FILTER (WHERE a.id IS NULL) AS only_right,
      count(*) FILTER (WHERE a.target <> b.target) AS target_mismatch
    FROM oof a FULL JOIN (SELECT id, PitNextLap AS target FROM comb) b ON a.id = b.id"""))
def s8(spark, sf):
    return sc.alignment(oof(spark, sf).select("id", "target"), combined(spark, sf).select("id", F.col(TARGET).alias("target")))
