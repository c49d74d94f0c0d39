"""Blend operators over a wide prediction table (id, target, one column per model)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, logit
from .auc import with_candidates
from .contest import OUTER, best
from .diagnostics import equal_frequency_bins
from .spread import quantiles, value_ranks, size_limit, with_avg_rank, with_position

LOW, HIGH, EPS = 1e-6, 1 - 1e-6, 1e-9


def weighted(columns: dict[str, float], transform=lambda c: c) -> Column:
    """Sum of weight * transform(column), divided by the sum of the weights."""
    total = float(sum(columns.values()))
    terms = [F.lit(float(w)) * transform(F.col(c)) for c, w in columns.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out / total


def geometric(columns: dict[str, float]) -> Column:
    """Weighted mean of clipped logs."""
    return weighted(columns, lambda c: F.log(clip(c, 1e-6, 1 - 1e-6)))


def rank_percentile(df: DataFrame, columns: dict[str, float], out: str, keys: list[str] = ()) -> DataFrame:
    """Weighted mean of rank percentiles, ranked within `keys`."""
    d = with_avg_rank(df, list(keys), {c: f"_r_{c}" for c in columns})
    d = d.withColumn(out, weighted({f"_r_{c}": w for c, w in columns.items()}))
    return d.drop(*[f"_r_{c}" for c in columns])


def two_model(anchor: Column, support: Column, w) -> Column:
    return clip((1 - F.lit(w)) * anchor + F.lit(w) * support, LOW, HIGH)


def gated(anchor: Column, support: Column, w, low=0.05, high=0.95) -> Column:
    """Blend only where the anchor is undecided."""
    return F.when(anchor.between(low, high), two_model(anchor, support, w)).otherwise(clip(anchor, LOW, HIGH))


def sorted_values(df: DataFrame, column: str, out: str, key="id") -> DataFrame:
    """(_pos, out): the column's values by sorted position."""
    return with_position(df.select(key, column), [], [column, key], "_pos").select("_pos", F.col(column).alias(out))


def onto_anchor(df: DataFrame, order: str, anchor: str, out: str, key="id") -> DataFrame:
    """Give the i-th row in `order` (ties by key) the i-th smallest anchor value."""
    d = with_position(df, [], [order, key], "_pos").join(sorted_values(df, anchor, out, key), "_pos")
    return d.withColumn(out, clip(F.col(out), LOW, HIGH)).drop("_pos")


def add_unit_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    return with_avg_rank(df, [], {c: f"u_{c}" for c in columns}, "unit")


def rank_mix(anchor: str, support: str, w) -> Column:
    return (1 - F.lit(w)) * F.col(f"u_{anchor}") + F.lit(w) * F.col(f"u_{support}")


def logit_mix(anchor: str, support: str, w) -> Column:
    """Blend of rank logits. Rounded, so that equal blends tie whatever the last bit of log()."""
    x = lambda c: logit(clip(F.col(f"u_{c}"), LOW, HIGH))
    return F.round((1 - F.lit(w)) * x(anchor) + F.lit(w) * x(support), 9)


def rank_blend(df: DataFrame, anchor: str, support: str, w: float, out: str, mix=rank_mix) -> DataFrame:
    """Order rows by blended ranks (or rank logits), keep the anchor's distribution of values."""
    d = add_unit_ranks(df, [anchor, support]).withColumn("_mix", mix(anchor, support, w))
    return onto_anchor(d, "_mix", anchor, out).drop("_mix", f"u_{anchor}", f"u_{support}")


def piecewise(df: DataFrame, anchor: str, support: str, out: str, bins=20, scale_clip=None) -> DataFrame:
    """Scale the anchor per equal-frequency bin by mean(support) / mean(anchor)."""
    d = equal_frequency_bins(df, anchor, bins, "_b")
    scale = (F.avg(support) + EPS) / (F.avg(anchor) + EPS)
    if scale_clip:
        scale = clip(scale, *scale_clip)
    d = d.join(d.groupBy("_b").agg(scale.alias("_scale")), "_b")
    return d.withColumn(out, clip(F.col(anchor) * F.col("_scale"), LOW, HIGH)).drop("_b", "_scale")


def remap_by_rank(df: DataFrame, score: str, anchor: str, out: str) -> DataFrame:
    """The anchor value at the floor of the score's average rank; equal scores stay equal."""
    ranks = value_ranks(df, [], score, size_limit(df, [])).select(
        score, F.floor("avg_rank").cast("long").alias("_pos"))
    values = ranks.join(sorted_values(df, anchor, out), "_pos").select(score, out)
    return df.join(values, score)


def logit_of_rank(df: DataFrame, columns: dict[str, float], out: str) -> DataFrame:
    d = with_avg_rank(df, [], {c: f"_r_{c}" for c in columns}, "n-1")
    x = weighted({f"_r_{c}": w for c, w in columns.items()}, lambda c: logit(clip(c, 1e-6, 1 - 1e-6)))
    return d.withColumn(out, x).drop(*[f"_r_{c}" for c in columns])


def tail_rank_blend(df: DataFrame, anchor: str, support: str, w: float, q: float, out: str) -> DataFrame:
    """Blend rank percentiles only at or above the anchor's q-th percentile."""
    d = with_avg_rank(df, [], {anchor: "_ra", support: "_rs"})
    at = quantiles(d, [], "_ra", {"t": q}).first()["t"]
    mixed = (1 - w) * F.col("_ra") + w * F.col("_rs")
    return d.withColumn(out, F.when(F.col("_ra") >= at, mixed).otherwise(F.col("_ra"))).drop("_ra", "_rs")


def sliced_weights(
    df: DataFrame, slice_col: str, fold: str, grid: list[float], anchor: str, support: str, out: str,
    default=0.20, k=5, min_n=100, min_class=5, label="target",
) -> DataFrame:
    """Blend with a weight per slice, chosen by AUC on the other folds only.

    Weights are rated by histograms per (fold, slice, weight); only those that can still win are scored exactly (`contest`).
    Slices that are small or nearly one-class use the default; the smallest of equally good weights wins.
    """
    d = with_candidates(df.select(slice_col, fold, anchor, support, label), [{"w": float(w)} for w in grid])
    w = F.col("cand.w")
    d = d.select(fold, slice_col, w.alias("w"), label, ((1 - w) * F.col(anchor) + w * F.col(support)).alias("_s"))
    ok = (F.col("n") >= min_n) & (F.col("n_pos") >= min_class) & (F.col("n_pos") <= F.col("n") - min_class)
    found = best(d, [slice_col], "w", "_s", label, fold, k, eligible=ok, sized_on=(df, [slice_col]))
    d = df.join(found.withColumnRenamed(OUTER, fold), [fold, slice_col], "left")
    d = d.withColumn("w", F.coalesce("w", F.lit(default)))
    return d.withColumn(out, (1 - F.col("w")) * F.col(anchor) + F.col("w") * F.col(support))


def normalise_scores(long: DataFrame, eps=1e-6) -> DataFrame:
    """Rank-normalise the bases of a (base, id, score) table that leave [0, 1]."""
    span = long.groupBy("base").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    out = span.select("base", ((F.col("_lo") < -eps) | (F.col("_hi") > 1 + eps)).alias("normalised"))
    d = with_avg_rank(long, ["base"], {"score": "_pct"}).join(out, "base")
    return d.withColumn("score", F.when(F.col("normalised"), F.col("_pct")).otherwise(F.col("score"))).drop("_pct")
