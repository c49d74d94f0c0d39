"""Set and row operations on splits."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diagonal_union(frames: dict[str, DataFrame], tag="split") -> DataFrame:
    """Union by column name with a tag; columns a frame lacks become typed nulls."""
    tagged = [f.withColumn(tag, F.lit(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def shared_columns(*frames: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    """Columns that all frames have, in the order of the first: the features a model fitted on one can use on the others."""
    return [c for c in frames[0].columns if c not in leave_out and all(c in f.columns for f in frames[1:])]


def augment_fold(train: DataFrame, fold: int, *extra: DataFrame, fold_col="fold") -> DataFrame:
    """Training rows of a fold plus augmentation rows; the held-out fold is never touched."""
    kept = train.where(F.col(fold_col) != fold).drop(fold_col)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), extra, kept)


def key_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys are shared, only left and only right."""
    sides = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    g = sides.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return g.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared"),
        F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))


def shared_laps(a: DataFrame, b: DataFrame, keys: list[str], lap="LapNumber") -> DataFrame:
    """Per group present on both sides: rows on each side, and laps that both sides have."""
    sides = a.select(*keys, lap, F.lit(1).alias("l")).unionByName(b.select(*keys, lap, F.lit(0).alias("l")))
    laps = sides.groupBy(*keys, lap).agg(F.sum("l").alias("nl"), F.sum(1 - F.col("l")).alias("nr"))
    g = laps.groupBy(*keys).agg(
        F.sum("nl").alias("n_left"), F.sum("nr").alias("n_right"),
        F.count_if((F.col("nl") > 0) & (F.col("nr") > 0)).alias("n_common_laps"))
    return g.where((F.col("n_left") > 0) & (F.col("n_right") > 0))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit("__NA__")).alias(c) for c in columns]).unpivot([], columns, "feature", "value")


def value_counts(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n_left, n_right) of every category, one aggregate for all columns."""
    both = _long(a, columns).withColumn("l", F.lit(1)).unionByName(_long(b, columns).withColumn("l", F.lit(0)))
    return both.groupBy("feature", "value").agg(F.sum("l").alias("n_left"), F.sum(1 - F.col("l")).alias("n_right"))


def category_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    v = value_counts(a, b, columns).where((F.col("n_left") == 0) | (F.col("n_right") == 0))
    side = F.when(F.col("n_right") == 0, "only_left").otherwise("only_right")
    return v.select("feature", side.alias("side"), "value")


def novelty(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Per categorical: distinct values on each side and test rows whose value train lacks."""
    v = value_counts(train, test, columns)
    g = v.groupBy("feature").agg(
        F.count_if(F.col("n_left") > 0).alias("n_train_unique"), F.count_if(F.col("n_right") > 0).alias("n_test_unique"),
        F.sum(F.when(F.col("n_left") == 0, F.col("n_right")).otherwise(0)).alias("n_test_novel_rows"),
        F.sum("n_right").alias("_n"))
    return g.withColumn("pct_test_novel", 100 * F.col("n_test_novel_rows") / F.col("_n")).drop("_n")


def extremes(df: DataFrame, metric: str, k: int, key="id") -> DataFrame:
    """The k highest and k lowest rows by a metric (ties by key)."""
    top = df.orderBy(F.desc(metric), key).limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(metric, key).limit(k).withColumn("side", F.lit("bottom")))


def overwrite_slice(base: DataFrame, special: DataFrame, score: str, key="id") -> DataFrame:
    """Replace predictions wherever the specialist has one."""
    s = special.select(key, F.col(score).alias("_s"))
    return base.join(s, key, "left").withColumn(score, F.coalesce("_s", score)).drop("_s")
