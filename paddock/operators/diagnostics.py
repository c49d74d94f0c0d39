"""Calibration, residual, slice and correlation reports over a prediction table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import correlation, log_loss_row
from ..session import cut
from .auc import auc, auc_of_counts
from .encoders import fit_bins
from .spread import quantiles, search, size_limit, with_avg_rank, with_position


def long_scores(df: DataFrame, bases: list[str], keep: list[str]) -> DataFrame:
    """(keep.., base, score) rows of a wide prediction table."""
    return df.select(*keep, *bases).unpivot(keep, bases, "base", "score")


def slice_table(df: DataFrame, slices: list[str], score="score", label="target", min_n=50) -> DataFrame:
    """n, positive rate, AUC and log-loss per slice; one-class and small slices are left out."""
    # Counts per (slice, score) say all: the loss of a row depends on its score and label alone.
    y, s = F.col(label), F.col(score)
    counts = cut(df.where(s.isNotNull() & y.isNotNull()).groupBy(*slices, score).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg")))
    loss = F.col("_pos") * log_loss_row(F.lit(1.0), s) + F.col("_neg") * log_loss_row(F.lit(0.0), s)
    loss = counts.groupBy(*slices).agg((F.sum(loss) / F.sum(F.col("_pos") + F.col("_neg"))).alias("logloss"))
    a = auc_of_counts(counts, slices, score, size_limit(counts, slices)).where((F.col("n") >= min_n) & F.col("auc").isNotNull())
    a = a.withColumn("pos_rate", F.col("n_pos") / F.col("n")).drop("n_pos")
    return a.join(loss, slices)


def long_slices(df: DataFrame, scans: dict[str, Column], keep: list[str]) -> DataFrame:
    """Repeat each row once per slicing, as (scan, slice)."""
    items = F.array(*[F.struct(F.lit(k).alias("scan"), v.cast("string").alias("slice")) for k, v in scans.items()])
    return df.select(*keep, F.explode(items).alias("_s")).select(*keep, "_s.*").where(F.col("slice").isNotNull())


def leverage(df: DataFrame, scans: dict[str, Column], score="score", label="target", min_n=50) -> DataFrame:
    """Slices by how much global AUC they hold back: n * (global AUC - slice AUC)."""
    d = long_slices(df, scans, [score, label])
    t = slice_table(d, ["scan", "slice"], score, label, min_n)
    whole = auc(df, [], score, label).select("auc").scalar()
    return t.withColumn("lift", F.col("n") * (whole - F.col("auc")))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair, as (a, b, rho): ranks once, then one aggregate."""
    ranked = with_avg_rank(df.select(*columns), [], {c: f"r_{c}" for c in columns}, "raw")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = ranked.agg(*[correlation(F.col(f"r_{a}"), F.col(f"r_{b}")).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], row.columns, "pair", "rho")
    part = F.split("pair", r"\|")
    return long.select(part[0].alias("a"), part[1].alias("b"), "rho")


def equal_frequency_bins(df: DataFrame, score: str, bins: int, out: str, key="id") -> DataFrame:
    """Bin by sorted position (ties by key); the last bin takes the remainder."""
    d = with_position(df, [], [score, key], "_p")
    size = F.greatest(F.floor(df.agg(F.count("*")).scalar() / bins), F.lit(1))
    return d.withColumn(out, F.least(F.floor((F.col("_p") - 1) / size), F.lit(bins - 1)).cast("int")).drop("_p")


def calibration(df: DataFrame, score="score", label="target", bins=10) -> DataFrame:
    d = equal_frequency_bins(df, score, bins, "_b")
    g = d.groupBy((F.col("_b") + 1).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("pred_mean"), F.avg(label).alias("actual_rate"))
    return g.withColumn("bias", F.col("pred_mean") - F.col("actual_rate"))


def quantile_bin(df: DataFrame, column: str, bins: int) -> Column:
    """Right-closed quantile bin of a column (0-based), duplicate edges dropped."""
    return search(column, fit_bins(df, [column], bins)[column], strict=True)


def decile_calibration(df: DataFrame, score="score", label="target", bins=10) -> DataFrame:
    d = df.withColumn("decile", (quantile_bin(df, score, bins) + 1).cast("int"))
    ll = F.avg(log_loss_row(F.col(label), F.col(score)))
    g = d.groupBy("decile").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_pred"), F.avg(label).alias("obs_rate"), ll.alias("_ll"))
    mixed = (F.col("obs_rate") > 0) & (F.col("obs_rate") < 1)
    return g.withColumns({
        "logloss": F.when(mixed, F.col("_ll")), "bias": F.col("mean_pred") - F.col("obs_rate"),
    }).drop("_ll")


def gap_profile(df: DataFrame, group: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """How group 1 differs from group 0: relative gap of means, total variation of categories.

    Rows in neither group (null) are left out.
    """
    d = df.where(F.col(group).isNotNull())
    side = lambda x, g: F.avg(F.when(F.col(group) == g, F.col(x)))
    means = d.agg(*[
        F.struct(side(x, 0).alias("base_mean"), side(x, 1).alias("group_mean")).alias(x) for x in numeric])
    num = means.unpivot([], numeric, "feature", "m").select("feature", "m.*")
    gap = F.col("group_mean") - F.col("base_mean")
    num = num.select(
        "feature", F.lit("numeric").alias("kind"), "base_mean", "group_mean", gap.alias("abs_gap"),
        (gap / (F.abs("base_mean") + 1e-6) * 100).alias("rel_gap_pct"))
    size = d.groupBy().agg(F.count_if(F.col(group) == 0).alias("n0"), F.count_if(F.col(group) == 1).alias("n1"))
    n0, n1 = size.select("n0").scalar(), size.select("n1").scalar()
    values = d.select(group, *categorical).unpivot([group], categorical, "feature", "value")
    counts = values.groupBy("feature", "value").agg(
        F.count_if(F.col(group) == 0).alias("c0"), F.count_if(F.col(group) == 1).alias("c1"))
    tvd = 0.5 * F.sum(F.abs(F.col("c0") / n0 - F.col("c1") / n1)) * 100
    none = F.lit(None).cast("double")
    cat = counts.groupBy("feature").agg(tvd.alias("rel_gap_pct")).select(
        "feature", F.lit("categorical").alias("kind"), none.alias("base_mean"), none.alias("group_mean"),
        none.alias("abs_gap"), "rel_gap_pct")
    return num.unionByName(cat)


def residual_groups(df: DataFrame, score="score", label="target") -> DataFrame:
    """1 for the quarter of rows with the highest loss, 0 for the lowest, null between."""
    d = df.withColumn("loss", log_loss_row(F.col(label), F.col(score)))
    q = quantiles(d, [], "loss", {"lo": 0.25, "hi": 0.75}).first()
    return d.withColumn("worst", F.when(F.col("loss") <= q["lo"], 0).when(F.col("loss") > q["hi"], 1))


def disagreement_groups(df: DataFrame, a: str, b: str, q=0.95) -> DataFrame:
    """1 for rows whose two rank percentiles differ the most, 0 for the rest."""
    d = with_avg_rank(df, [], {a: "_ra", b: "_rb"}).withColumn("rank_diff", F.abs(F.col("_ra") - F.col("_rb")))
    at = quantiles(d, [], "rank_diff", {"q": q}).first()["q"]
    return d.withColumn("disagree", (F.col("rank_diff") >= at).cast("int")).drop("_ra", "_rb")


def residual_correlations(df: DataFrame, features: list[str], score="score", label="target") -> DataFrame:
    res = F.col(label) - F.col(score)
    row = df.agg(*[correlation(F.col(x).cast("double"), res).alias(x) for x in features])
    return row.unpivot([], row.columns, "feature", "corr")


def gate(folds: DataFrame, min_delta=0.0002, need_up=3) -> DataFrame:
    """Accept, reject or leave open a candidate from (fold, base_auc, cand_auc) rows."""
    g = folds.agg(
        F.avg("base_auc").alias("base_mean"), F.avg("cand_auc").alias("cand_mean"),
        F.stddev_pop("base_auc").alias("base_std"),
        F.count_if(F.col("cand_auc") > F.col("base_auc")).alias("folds_up"))
    delta = F.col("cand_mean") - F.col("base_mean")
    floor = F.greatest(0.5 * F.col("base_std"), F.lit(min_delta))
    verdict = F.when((delta >= floor) & (F.col("folds_up") >= need_up), "KEEP").when(delta <= 0, "DISCARD")
    return g.withColumns({"delta": delta, "floor": floor, "verdict": verdict.otherwise("INCONCLUSIVE")})
