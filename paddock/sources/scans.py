"""CSV and Parquet scans and sinks, and the prediction-pool loader."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .laps import LAP_SCHEMA

OOF_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("target", T.DoubleType()),
    T.StructField("oof", T.DoubleType()),
    T.StructField("fold", T.IntegerType()),
])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = LAP_SCHEMA) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).csv(path, header=True)


def scan_external(spark: SparkSession, path: str, leaky: str, dropna_compound=True) -> DataFrame:
    """Augmentation rows: no key of their own, and a column that gives the label away."""
    schema = T.StructType([f for f in LAP_SCHEMA.fields if f.name != "id"] + [T.StructField(leaky, T.DoubleType())])
    d = scan_csv(spark, path, schema).drop(leaky)
    if dropna_compound:
        d = d.dropna(subset=["Compound"])
    return d.withColumn("id", F.lit(-1).cast("long"))


def write_oof(df: DataFrame, path: str) -> None:
    """Write an out-of-fold table after checking its columns and types."""
    want = [(f.name, f.dataType.simpleString()) for f in OOF_SCHEMA.fields]
    got = df.select(*[n for n, _ in want]).dtypes
    if got != want:
        raise ValueError(f"out-of-fold table has {got}, expected {want}")
    df.select(*[n for n, _ in want]).write.mode("overwrite").parquet(path)


def write_submission(df: DataFrame, path: str, key="id") -> None:
    """CSV ordered by key; the part files follow each other, so no single task writes it all."""
    df.orderBy(key).write.mode("overwrite").csv(path, header=True)


SKIPPED = r"^(blend|stack)|rankblend"  # names of earlier blends, fixed value


def load_pool(spark: SparkSession, folder: str, ref: DataFrame) -> DataFrame:
    """(base, id, score) of every admissible base among the tables `oof_<base>.parquet` of a folder.

    A base must not itself be a blend, must have a `submission_<base>.csv` in the folder, must hold each reference id once
    and no other, and must have no missing score. All bases are judged in one pass over the pool.
    """
    base = F.regexp_extract(F.input_file_name(), r"oof_([^/]+)\.parquet", 1)
    preds = spark.read.schema(OOF_SCHEMA).parquet(f"{folder}/oof_*.parquet").select(base.alias("base"), "id", F.col("oof").alias("score"))
    # Only the paths are read, not the files.
    files = spark.read.format("binaryFile").load(f"{folder}/submission_*.csv")
    submitted = files.select(F.regexp_extract("path", r"submission_([^/]+)\.csv", 1).alias("base")).distinct()
    preds = preds.where(~F.col("base").rlike(SKIPPED)).join(submitted, "base", "left_semi")
    bad = F.col("score").isNull() | F.isnan("score")
    once = preds.groupBy("base", "id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    seen = once.join(ref.select("id", F.lit(1).alias("_known")), "id", "left")
    n_ref = ref.agg(F.count("*")).scalar()
    ok = seen.groupBy("base").agg(F.count("*").alias("ids"), F.sum("n").alias("n"), F.count("_known").alias("known"), F.sum("bad").alias("bad"))
    ok = ok.where((F.col("n") == n_ref) & (F.col("ids") == n_ref) & (F.col("known") == n_ref) & (F.col("bad") == 0))
    return preds.join(ok.select("base"), "base", "left_semi")


def alignment(a: DataFrame, b: DataFrame, key="id", target="target") -> DataFrame:
    """Counts that must be zero before two prediction tables are combined by key."""
    x = a.select(key, F.col(target).alias("_ta"), F.lit(1).alias("_a"))
    y = b.select(key, F.col(target).alias("_tb"), F.lit(1).alias("_b"))
    j = x.join(y, key, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(
        F.count_if(both).alias("matched"), F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(both & ~F.col("_ta").eqNullSafe(F.col("_tb"))).alias("target_mismatch"))
