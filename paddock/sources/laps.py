"""The lap table and the prediction table derived from the driver's event log."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import with_position
from ..operators.timeline import neighbours, running
from ..session import staged

LAP_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("Driver", T.StringType()),
    T.StructField("Compound", T.StringType()),
    T.StructField("Race", T.StringType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("PitStop", T.IntegerType()),
    T.StructField("LapNumber", T.IntegerType()),
    T.StructField("Stint", T.IntegerType()),
    T.StructField("TyreLife", T.DoubleType()),
    T.StructField("Position", T.IntegerType()),
    T.StructField("LapTime", T.DoubleType()),
    T.StructField("LapTime_Delta", T.DoubleType()),
    T.StructField("Cumulative_Degradation", T.DoubleType()),
    T.StructField("RaceProgress", T.DoubleType()),
    T.StructField("Position_Change", T.DoubleType()),
    T.StructField("PitNextLap", T.DoubleType()),
])
TARGET = "PitNextLap"
R, RY, RYL, RYD = ["Race"], ["Race", "Year"], ["Race", "Year", "LapNumber"], ["Race", "Year", "Driver"]
CATS = ["Driver", "Compound", "Race"]
NUMS = [
    "Year", "PitStop", "LapNumber", "Stint", "TyreLife", "Position", "LapTime", "LapTime_Delta",
    "Cumulative_Degradation", "RaceProgress", "Position_Change",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_laps(events: DataFrame, cut) -> DataFrame:
    """Turn each user's ordered events into a driver's laps; purchases are pit stops.

    `cut(name, build)` stages an intermediate table: the ordering passes below read their input
    several times, so each must start from a table and not from the whole plan before it.
    """
    d = events.select(
        F.col("event_id").alias("id"), "user_id", "ts", "value",
        (F.col("user_id") % 5).cast("int").alias("race_k"),
        (2022 + F.floor(F.col("user_id") / 5) % 4).cast("int").alias("Year"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("PitStop"),
    )
    user = ["user_id"]
    order = with_position(d, user, ["ts", "id"], "LapNumber", reread=True)
    d = cut("lap_order", lambda: order.withColumn("LapNumber", F.col("LapNumber").cast("int")).drop("ts"))
    d = neighbours(d, user, "LapNumber", lambda w: {
        "_pv": F.lag("value").over(w),
        "_nxt": F.coalesce(F.lead("PitStop").over(w), F.lit(0)),
        "_start": F.coalesce(F.lag("PitStop").over(w), F.lit(1)) == 1,
    }, back=1, ahead=1)
    start = F.when(F.col("_start"), F.struct(F.col("LapNumber").alias("lap"), F.col("value").alias("v")))
    d = running(d, user, "LapNumber", {
        "_pits": ("sum", F.col("PitStop")),
        "_stint": ("max", start),
    })
    stints = d.withColumns({
        "Stint": (1 + F.col("_pits") - F.col("PitStop")).cast("int"),
        "TyreLife": (F.col("LapNumber") - F.col("_stint.lap") + 1).cast("double"),
        "v0": F.col("_stint.v"),
    }).drop("_pits", "_stint", "_start")
    d = cut("lap_stints", lambda: stints)
    longest = d.groupBy("race_k", "Year").agg(F.max("LapNumber").alias("mx"))
    d = with_position(d, ["race_k", "Year", "LapNumber"], ["value", "id"], "_p", reread=True)
    d = d.withColumn("Position", (1 + (F.col("_p") - 1) % 20).cast("int"))
    d = neighbours(d, user, "LapNumber", lambda w: {"_pp": F.lag("Position").over(w)}, back=1)
    d = d.join(longest, ["race_k", "Year"])
    uid, stint = F.col("user_id"), (F.col("user_id") + F.col("Stint")) % 11
    text = uid.cast("string")
    return d.select(
        "id",
        F.when((uid < 1000) & (uid % 7 < 4), F.concat(F.lit("D"), F.lpad(text, 3, "0")))
        .otherwise(F.concat(F.lit("R"), F.lpad(text, 5, "0"))).alias("Driver"),
        F.when(stint < 4, "MEDIUM").when(stint < 8, "HARD")
        .when((stint < 10) | (F.col("race_k") >= 2), "SOFT")
        .when(F.col("Stint") % 2 == 0, "WET").otherwise("INTERMEDIATE").alias("Compound"),
        F.when(F.col("race_k") == 0, "Pre-Season Testing")
        .otherwise(F.concat(F.lit("GP"), F.col("race_k").cast("string"))).alias("Race"),
        "Year", "PitStop", "LapNumber", "Stint", "TyreLife", "Position",
        (60.0 + F.col("value")).alias("LapTime"),
        (F.col("value") - F.coalesce("_pv", "value")).alias("LapTime_Delta"),
        (F.col("value") - F.col("v0")).alias("Cumulative_Degradation"),
        (F.col("LapNumber").cast("double") / F.col("mx")).alias("RaceProgress"),
        F.coalesce(F.col("_pp") - F.col("Position"), F.lit(0)).cast("double").alias("Position_Change"),
        F.col("_nxt").cast("double").alias("PitNextLap"),
        F.when(uid % 10 == 9, "ext").when(F.col("id") % 10 < 7, "train").otherwise("test").alias("split"),
    )


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lap, split into train, test and augmentation (ext) rows."""
    cut = lambda name, build: staged(spark, name, sf_dir, build)
    return staged(spark, "laps", sf_dir, lambda: build_laps(table(spark, sf_dir, "events"), cut), ["split"])


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test laps together; augmentation rows stay out."""
    return laps(spark, sf_dir).where(F.col("split").isin("train", "test"))


def split_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return laps(spark, sf_dir).where(F.col("split") == name)


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four deterministic base predictions for the training laps."""
    d = split_of(spark, sf_dir, "train")
    noise = lambda m, p: (F.col("id") * m % p).cast("double") / float(p)
    return d.select(
        "id", "Year", "Race", "Compound", F.col(TARGET).alias("target"),
        (F.col("TyreLife") / (F.col("TyreLife") + 10.0)).alias("oof_a"),
        noise(7919, 10007).alias("oof_b"),
        ((F.col("LapTime") - 59.0) / (F.col("LapTime") + 100.0)).alias("oof_c"),
        (0.5 * F.col("RaceProgress") + 0.25 * F.col(TARGET) + 0.25 * noise(104729, 1009)).alias("oof_d"),
    )


def test_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same four bases for the test laps, whose label no base may use."""
    d = split_of(spark, sf_dir, "test")
    noise = lambda m, p: (F.col("id") * m % p).cast("double") / float(p)
    return d.select(
        "id",
        (F.col("TyreLife") / (F.col("TyreLife") + 10.0)).alias("oof_a"),
        noise(7919, 10007).alias("oof_b"),
        ((F.col("LapTime") - 59.0) / (F.col("LapTime") + 100.0)).alias("oof_c"),
        (0.75 * F.col("RaceProgress") + 0.25 * noise(104729, 1009)).alias("oof_d"),
    )


def with_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold rows (part "oof") and test rows (part "test") of the bases, one below the other."""
    a = oof(spark, sf_dir).select(F.lit("oof").alias("part"), "id", "target", "oof_a", "oof_b", "oof_c", "oof_d")
    b = test_bases(spark, sf_dir).select(F.lit("test").alias("part"), "id", F.lit(None).cast("double").alias("target"), "oof_a", "oof_b", "oof_c", "oof_d")
    return a.unionByName(b)
