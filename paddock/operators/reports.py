"""Exploratory reports: every table is one or two aggregates."""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoders import column_quantiles, long_form
from .spread import quantiles, search, size_limit, value_ranks, with_position


def rate_by(df: DataFrame, keys: list, target: str, extra: dict[str, Column] = {}) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(target).alias("rate"), *[e.alias(n) for n, e in extra.items()])


def schema_table(df: DataFrame, other: DataFrame) -> DataFrame:
    """Column, type, whether the other frame has it, distinct values and nulls.

    Each column is counted on its own, in its own type: a scan of that column, combined before its shuffle.
    """
    def one(name: str, dtype: str) -> DataFrame:
        values = df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
        return values.agg(
            F.lit(name).alias("column"), F.lit(dtype).alias("dtype"), F.lit(name in other.columns).alias("in_test"),
            F.count("v").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    return reduce(DataFrame.unionByName, [one(*c) for c in df.dtypes])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max, one row per column."""
    long = long_form(df, columns).where(F.col("value").isNotNull())
    g = long.groupBy("column").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return g.join(column_quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "column")


def split_comparison(df: DataFrame, columns: list[str], split="split", sides=("train", "test")) -> DataFrame:
    """Mean and median per column on each side."""
    long = long_form(df, columns, [split])
    mean = long.groupBy("column", split).agg(F.avg("value").alias("mean"))
    med = quantiles(long, ["column", split], "value", {"median": 0.5})
    t = mean.join(med, ["column", split])
    pick = lambda c, s: F.max(F.when(F.col(split) == s, F.col(c))).alias(f"{s}_{c}")
    return t.groupBy("column").agg(*[pick(c, s) for s in sides for c in ("mean", "median")])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Full correlation matrix (upper triangle), over the rows that have both values; null with a constant column.

    One pass for counts, means and ranges, one for sums of centred values and products. Columns without nulls share
    their sums; a pair with a null gets sums of its own.
    """
    x = lambda c: F.col(c).cast("double")
    first = df.agg(F.count("*").alias("n"), *[f(x(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in
                                              (("n", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    z = [x(c) - F.lit(float(first[f"m{i}"] or 0.0)) for i, c in enumerate(columns)]
    whole = [first[f"n{i}"] == first["n"] for i in range(len(columns))]
    sums = {f"s{i}": z[i] for i in range(len(columns)) if whole[i]} | {f"q{i}": z[i] * z[i] for i in range(len(columns)) if whole[i]}
    pairs = list(combinations(range(len(columns)), 2))
    for i, j in pairs:
        both = (lambda e, i=i, j=j: F.when(z[i].isNotNull() & z[j].isNotNull(), e))
        sums[f"p{i}_{j}"] = z[i] * z[j]
        if not (whole[i] and whole[j]):
            sums |= {f"n{i}_{j}": both(F.lit(1.0)), f"a{i}_{j}": both(z[i]), f"b{i}_{j}": both(z[j]),
                     f"c{i}_{j}": both(z[i] * z[i]), f"d{i}_{j}": both(z[j] * z[j])}
    row = df.agg(*[F.sum(e).alias(k) for k, e in sums.items()])

    def value(i: int, j: int) -> Column:
        shared = whole[i] and whole[j]
        n = F.lit(float(first["n"])) if shared else F.col(f"n{i}_{j}")
        sx, sy, qx, qy = (F.col(f"s{i}"), F.col(f"s{j}"), F.col(f"q{i}"), F.col(f"q{j}")) if shared else (
            F.col(f"{k}{i}_{j}") for k in "abcd")
        vx, vy = qx - sx * sx / n, qy - sy * sy / n
        # far below what the column's range allows is rounding, not variation
        least = lambda k: F.lit(1e-20 * ((first[f"hi{k}"] or 0.0) - (first[f"lo{k}"] or 0.0)) ** 2)
        return F.when((vx > least(i) * n) & (vy > least(j) * n), (F.col(f"p{i}_{j}") - sx * sy / n) / F.sqrt(vx * vy))

    items = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), value(i, j).alias("corr")) for i, j in pairs])
    return row.select(F.explode(items).alias("x")).select("x.*")


def rate_by_quantile(df: DataFrame, column: str, target: str, bins: int) -> DataFrame:
    """Target rate per right-closed quantile bucket, with the bucket's mean value.

    Rows with no value are left out, and so are duplicate edges.
    """
    d = df.where(F.col(column).isNotNull())
    row = quantiles(d, [], column, {f"q{i}": i / bins for i in range(1, bins)}).first()
    edges = sorted({float(v) for v in row if v is not None}) if row else []
    b = (search(column, edges, strict=True) + 1).cast("int")
    return d.groupBy(b.alias("bucket")).agg(
        F.count("*").alias("n"), F.avg(column).alias("bucket_mean"), F.avg(target).alias("rate"))


def histogram(df: DataFrame, column: str, bins: int, lo: float, hi: float, by: list[str] = ()) -> DataFrame:
    """Counts and density per equal-width bin; values outside [lo, hi] fall in the end bins."""
    x = F.least(F.greatest(F.col(column).cast("double"), F.lit(lo)), F.lit(hi))
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    g = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    if not by:
        total = df.agg(F.count("*")).scalar()
        return g.withColumn("density", F.col("n") / (total * F.lit(width)))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_t"))
    return g.join(sizes, list(by)).withColumn("density", F.col("n") / (F.col("_t") * F.lit(width))).drop("_t")


def tie_clusters(df: DataFrame, name: str, score: str, first=5) -> DataFrame:
    """Groups of equal scores: size, best rank and the first few names.

    Names are positioned inside the tie before any is collected, so a tie of any size gives a
    list of at most `first`.
    """
    ranks = value_ranks(df, [], score, size_limit(df, [])).where(F.col("n") > 1)
    ranks = ranks.select(score, "n", (F.col("n_group") - F.col("n_below") - F.col("n") + 1).alias("best_rank"))
    head = with_position(df, [score], [name], "_i").where(F.col("_i") <= first)
    names = head.groupBy(score).agg(F.concat_ws(",", F.sort_array(F.collect_list(name))).alias("first_names"))
    return ranks.join(names, score)
