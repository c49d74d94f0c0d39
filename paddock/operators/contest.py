"""The best of many candidate scores by AUC, with exact scoring only of those that can still win.

Every candidate is first bounded by a histogram: rows become counts per score bin before the shuffle, so at most
bins x candidates rows (and groups) leave a task, and fewer if it holds fewer rows. In a bin with one score the pairs of a positive and
a negative are ties; in any other bin all may be won or all lost. This gives a lower and an upper bound of the AUC. Histograms
add up, so those of a held-out fold's other folds are sums of fold histograms and rows are read once, not once per fold.
A candidate whose upper bound is below the best lower bound of its contest is out; only the rows of the others are repeated
per candidate and counted by exact score. The winner is that of exact scoring throughout.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .auc import auc
from .spread import UNBOUNDED

BINS = 16384
#: Contested candidates up to this number are broadcast to the rows; beyond it they meet by a shuffle.
MAX_BROADCAST = 200_000
#: Room for the last digits of sums in the bounds.
_SLACK = 1e-9
OUTER = "_outer"


def bin_of(score: Column, bins: int) -> Column:
    """A bin that never falls as the score grows; scores outside [0, 1] are in the end bins, NaN in the last (NaN is greatest)."""
    at = F.floor(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)) * bins)
    return F.when(F.isnan(score), F.lit(bins - 1)).otherwise(F.least(at, F.lit(bins - 1))).cast("int")


def histograms(long: DataFrame, keys: list[str], score: str, label: str, bins: int = BINS) -> DataFrame:
    """(keys, _bin, _pos, _neg, _min, _max) counts of a frame with one row per row and candidate; partial counts leave the tasks."""
    return long.where(F.col(score).isNotNull()).groupBy(*keys, bin_of(F.col(score), bins).alias("_bin")).agg(
        F.sum(F.col(label)).cast("double").alias("_pos"), F.sum(1 - F.col(label)).cast("double").alias("_neg"),
        F.min(score).alias("_min"), F.max(score).alias("_max"))


def other_folds(hist: DataFrame, keys: list[str], fold: str, k: int) -> DataFrame:
    """Histograms of all folds but `_outer`, for each `_outer` in 0..k-1. Rows without a fold count in all of them."""
    outer = F.explode(F.filter(F.array(*[F.lit(o) for o in range(k)]), lambda o: ~o.eqNullSafe(F.col(fold))))
    d = hist.withColumn(OUTER, outer)
    return d.groupBy(OUTER, *keys, "_bin").agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.min("_min").alias("_min"), F.max("_max").alias("_max"))


def bounds(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _low, _high, n, n_pos) per candidate. A window holds the bins of one candidate; null bounds where a class is missing."""
    win = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(UNBOUNDED, -1)
    d = hist.withColumn("_nb", F.coalesce(F.sum(F.coalesce("_neg", F.lit(0.0))).over(win), F.lit(0.0)))
    d = d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_pos", "_neg")})
    pairs = F.col("_pos") * F.col("_neg")
    tied = F.col("_min").eqNullSafe(F.col("_max"))
    g = d.groupBy(*keys).agg(
        F.sum(F.col("_pos") * F.col("_nb") + F.when(tied, pairs / 2).otherwise(0.0)).alias("_won"),
        F.sum(F.when(tied, 0.0).otherwise(pairs)).alias("_open"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    all_pairs = F.col("_p") * F.col("_n")
    return g.select(
        *keys, (F.try_divide(F.col("_won"), all_pairs) - _SLACK).alias("_low"),
        (F.try_divide(F.col("_won") + F.col("_open"), all_pairs) + _SLACK).alias("_high"),
        (F.col("_p") + F.col("_n")).cast("long").alias("n"), F.col("_p").cast("long").alias("n_pos"))


def contenders(bounded: DataFrame, contest: list[str], always: Column | None = None) -> DataFrame:
    """Candidates that can win their contest, with `_rivals` (how many can), and those that are `always` wanted."""
    win = Window.partitionBy(*contest)
    can = F.coalesce(F.col("_high") >= F.max("_low").over(win), F.lit(False))
    d = bounded.withColumn("_can", can)
    d = d.withColumn("_rivals", F.sum(F.col("_can").cast("int")).over(win))
    return d.where(F.col("_can") | always if always is not None else F.col("_can"))


def rescored(long: DataFrame, asked: DataFrame, contest: list[str], cand: str, score: str, label: str, fold: str | None, sized_on) -> DataFrame:
    """Exact (contest, cand, auc, n, n_pos) of the candidates in `asked`, from their rows alone."""
    keys = [*contest, cand]
    inner = [c for c in keys if c != OUTER]
    few = asked.count() <= MAX_BROADCAST
    want = asked.select(*keys).withColumnsRenamed({c: f"_w_{c}" for c in inner})
    same = reduce(lambda a, b: a & b, [long[c].eqNullSafe(want[f"_w_{c}"]) for c in inner])
    d = long.join(F.broadcast(want) if few else want, same, "inner").drop(*[f"_w_{c}" for c in inner])
    if fold:
        d = d.where(~F.col(OUTER).eqNullSafe(F.col(fold)))
    return auc(d, keys, score, label, sized_on=sized_on)


def best(
    long: DataFrame, contest: list[str], cand: str, score: str, label: str, fold: str | None = None, k: int = 0,
    bins: int = BINS, eligible: Column | None = None, sized_on: tuple[DataFrame, list[str]] | None = None,
) -> DataFrame:
    """(contest, cand): the candidate with the greatest AUC above 0 in each contest, the smallest of equals.

    `long` has one row per row and candidate; it is never shuffled as such. With `fold`, each contest is held once per fold on the rows of the
    k - 1 others, and `_outer` is the fold left out. `eligible` says, from `n` and `n_pos`, which candidates take part.
    """
    keys = [*([OUTER] if fold else []), *contest]
    hist = histograms(long, [*contest, *([fold] if fold else []), cand], score, label, bins)
    if fold:
        hist = other_folds(cut(hist), [*contest, cand], fold, k)
    rated = bounds(hist, [*keys, cand])
    if eligible is not None:
        rated = rated.where(eligible)
    left = cut(contenders(rated, keys))
    sole = (F.col("_rivals") == 1) & (F.col("_low") > 0)
    exact = rescored(long, left.where(~sole), keys, cand, score, label, fold, sized_on or (long, contest))
    won = exact.where(F.col("auc") > 0).groupBy(*keys).agg(F.max_by(cand, F.struct("auc", -F.col(cand))).alias(cand)).where(F.col(cand).isNotNull())
    return left.where(sole).select(*keys, cand).unionByName(won)


def best_scored(
    long: DataFrame, contest: list[str], cand: str, score: str, label: str, always: Column | None = None, bins: int = BINS,
    sized_on: tuple[DataFrame, list[str]] | None = None,
) -> DataFrame:
    """Exact (contest, cand, auc, n, n_pos) of every candidate that can win its contest or is `always` wanted."""
    rated = bounds(histograms(long, [*contest, cand], score, label, bins), [*contest, cand])
    left = cut(contenders(rated, contest, always))
    return rescored(long, left, contest, cand, score, label, None, sized_on or (long, contest))
