"""Exact tie-aware ROC-AUC, grouped and for many candidate scores at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .spread import RNG, UNBOUNDED, size_limit, spread

SCORE = "_score"


def auc(
    df: DataFrame, by: list[str], score: str, label: str, weight: str | None = None,
    sized_on: tuple[DataFrame, list[str]] | None = None,
) -> DataFrame:
    """AUC per group with n and n_pos (weighted if asked); null where a class is missing.

    Rows are first reduced to (group, score) counts. `sized_on` names a smaller frame and keys
    whose group sizes bound the ones here, for frames that repeat every row per candidate.
    """
    w = F.col(weight) if weight else F.lit(1)
    limit = size_limit(*(sized_on or (df, by)))
    t = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(w * F.col(label)).alias("_pos"), F.sum(w * (1 - F.col(label))).alias("_neg"))
    return auc_of_counts(t, by, score, limit)


def auc_of_counts(t: DataFrame, by: list[str], score: str, limit: int | None) -> DataFrame:
    """As `auc`, from a table with one row per (group, score) and its counts `_pos` and `_neg`."""
    zero = F.lit(0)
    if limit is None:
        win = Window.partitionBy(*by).orderBy(score).rowsBetween(UNBOUNDED, -1)
        u = t.withColumn("_nb", F.coalesce(F.sum("_neg").over(win), zero))
        g = u.groupBy(*by).agg(_wins().alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    else:
        s = spread(cut(t), by, [score], limit)
        win = Window.partitionBy(*by, RNG).orderBy(score).rowsBetween(UNBOUNDED, -1)
        u = s.withColumn("_nb", F.coalesce(F.sum("_neg").over(win), zero))
        part = u.groupBy(*by, RNG).agg(_wins().alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
        # every negative of an earlier range is beaten by every positive of this one
        before = Window.partitionBy(*by).orderBy(RNG).rowsBetween(UNBOUNDED, -1)
        part = part.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(before), zero))
        g = part.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("_u", "_p", "_n")])
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    return g.select(
        *by, F.try_divide(F.col("_u").cast("double"), p * n).alias("auc"),
        (F.col("_p") + F.col("_n")).cast("long").alias("n"), F.col("_p").cast("long").alias("n_pos"))


def _wins() -> Column:
    return F.sum(F.col("_pos") * (F.col("_nb") + F.col("_neg") / 2))


def blend_expr(bases: list[str], weights: Column | str) -> Column:
    """Weighted sum over an array of weights, in base order."""
    w = F.col(weights) if isinstance(weights, str) else weights
    terms = [w[i] * F.col(b) for i, b in enumerate(bases)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def with_candidates(df: DataFrame, cands: list[dict], name: str = "cand") -> DataFrame:
    """Repeat each row once per candidate of a parameter list, as a struct column."""
    fields = list(cands[0])
    def lit(v):
        return F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
    items = F.array(*[F.struct(*[lit(c[f]).alias(f) for f in fields]) for c in cands])
    return df.withColumn(name, F.explode(items))


def batched_auc(
    df: DataFrame, bases: list[str], cands: list[dict], label: str = "target", by: list[str] = (),
    bins: int | None = None, weight: str | None = None,
) -> DataFrame:
    """AUC of every weight vector in one job, as (cand id, by.., auc).

    `cands` are {"id": .., "w": [..]}. With `bins` the scores (in [0, 1]) are cut to that many
    levels, which bounds the table per candidate; use it while searching and confirm without.
    """
    by = list(by)
    d = with_candidates(df.select(*bases, label, *by, *([weight] if weight else [])), cands)
    score = blend_expr(bases, F.col("cand.w"))
    if bins:
        score = F.floor(score * bins) / bins
    d = d.select(F.col("cand.id").alias("cand"), *by, label, score.alias(SCORE), *([weight] if weight else []))
    return auc(d, ["cand", *by], SCORE, label, weight, sized_on=(df, by))
