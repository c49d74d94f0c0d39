"""Ordered work on groups of any size.

A window or an exact percentile over a group runs in one task, so it is only planned that way
after a check that every group is small (one aggregate over the key columns). If some group
has more than `paddock.hotRows` rows, the table is range-partitioned by group and order: prefix sums, row
positions, ranks and quantiles work inside a range and add the totals of the earlier ranges.
Both ways are exact, and order nulls first and NaN last. Null keys are a group like any other.
"""

from functools import reduce
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, hot_rows

RNG = "_rng"
UNBOUNDED = Window.unboundedPreceding


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all): one aggregate over the key columns."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    biggest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return biggest or 0, total or 0


def size_limit(df: DataFrame, keys: list[str], sizes: tuple[int, int] | None = None) -> int | None:
    """Rows a group may have in one sorted task, or None if no group exceeds it."""
    biggest, _ = sizes or group_sizes(df, keys)
    limit = hot_rows(df.sparkSession)
    return limit if biggest > limit else None


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; each key appears once."""
    if not keys:
        raise ValueError("no keys to join on")
    r = right.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_j_{k}"]) for k in keys])
    return left.join(r, same, how).drop(*[f"_j_{k}" for k in keys])


def search(col: str, edges: list, strict: bool = False) -> Column:
    """How many of the sorted edges are <= the value (< the value when `strict`)."""
    below = (lambda v: F.col(col) <= v) if strict else (lambda v: F.col(col) < v)
    if len(edges) <= 128:  # a balanced tree of comparisons
        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(below(F.lit(edges[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))
        return tree(0, len(edges))
    # two short scans over constant arrays
    step = isqrt(len(edges))
    full = len(edges) // step
    upto = lambda a: F.size(F.filter(a, lambda v: ~below(v)))
    coarse = upto(F.array(*[F.lit(edges[i * step - 1]) for i in range(1, full + 1)]))
    chunks = F.array(*[F.array(*[F.lit(v) for v in edges[i:i + step]]) for i in range(0, len(edges), step)])
    # past the last chunk there is nothing left to count
    return coarse * F.lit(step) + F.greatest(upto(F.get(chunks, coarse)), F.lit(0))


def spread(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """`df` with `_rng`, increasing along `order` in every group, about `limit` rows in each range or fewer.

    The ranges follow the rows, whatever the number of groups, of shuffle partitions or of equal values: `order` ends in a
    tie-break, so a frequent value is cut as well. The result is written, because ranges come from a sample and two
    evaluations would differ. `df` is read twice, for the sample and for the rows.
    """
    n = max(2, ceil(df.count() / limit))
    ranged = df.repartitionByRange(n, *keys, *order)
    return cut(ranged.withColumn(RNG, F.spark_partition_id().cast("long")))


def offsets(s: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of the earlier ranges, one row per (group, range)."""
    w = Window.partitionBy(*keys).orderBy(RNG).rowsBetween(UNBOUNDED, -1)
    t = s.groupBy(*keys, RNG).agg(*[e.alias(c) for c, e in sums.items()])
    return t.select(*keys, RNG, *[F.sum(c).over(w).alias(f"_off_{c}") for c in sums])


def prefix_sums(t: DataFrame, keys: list[str], order: str, cols: list[str], limit: int | None) -> DataFrame:
    """Add `<c>_below`, the sum of c over rows of the group that sort before this one.

    `t` has one row per (keys, order).
    """
    zero = F.lit(0)
    if limit is None:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(UNBOUNDED, -1)
        return t.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(w), zero) for c in cols})
    s = spread(cut(t), keys, [order], limit)
    w = Window.partitionBy(*keys, RNG).orderBy(order).rowsBetween(UNBOUNDED, -1)
    off = offsets(s, keys, {c: F.sum(c) for c in cols})
    out = s.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(w), zero) for c in cols})
    out = join_on(out, off, [*keys, RNG])
    out = out.withColumns({f"{c}_below": F.col(f"{c}_below") + F.coalesce(f"_off_{c}", zero) for c in cols})
    return out.drop(RNG, *[f"_off_{c}" for c in cols])


def with_position(df: DataFrame, keys: list[str], order: list[str], out: str, reread: bool = False) -> DataFrame:
    """Exact 1-based row number in the group; `order` must be unique in it. Nulls come first.

    Set `reread` if df is a table or a projection of one: a hot group then makes it be read again
    rather than written first.
    """
    limit = size_limit(df, keys)
    if limit is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    s = spread(df if reread else cut(df), keys, order, limit)
    w = Window.partitionBy(*keys, RNG).orderBy(*order)
    d = join_on(s.withColumn(out, F.row_number().over(w)), offsets(s, keys, {"n": F.count("*")}), [*keys, RNG])
    return d.withColumn(out, F.col(out).cast("long") + F.coalesce("_off_n", F.lit(0))).drop(RNG, "_off_n")


def with_group_size(t: DataFrame, keys: list[str], n: str, out: str) -> DataFrame:
    size = t.groupBy(*keys).agg(F.sum(n).alias(out))
    return join_on(t, size, keys) if keys else t.withColumn(out, size.scalar())


def value_ranks(df: DataFrame, keys: list[str], value: str, limit: int | None = None) -> DataFrame:
    """One row per (keys, value): n ties, n_below, avg_rank (1-based) and group size n_group."""
    t = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    p = prefix_sums(with_group_size(t, keys, "n", "n_group"), keys, value, ["n"], limit)
    return p.withColumn("avg_rank", F.col("n_below") + (F.col("n") + 1) / 2)


def _scaled(r: Column, n: Column, scale: str) -> Column:
    return {
        "raw": r,
        "n": r / n,
        "n-1": F.try_divide(r, (n - 1).cast("double")),
        "unit": (r - 1) / F.greatest(n - 1, F.lit(1)),
    }[scale]


def with_avg_rank(df: DataFrame, keys: list[str], columns: dict[str, str], scale: str = "n") -> DataFrame:
    """Average-method rank of each column in its group, as {value column: output column}.

    scale: "raw" keeps the rank, "n" divides by the group size, "n-1" by size - 1, and
    "unit" maps to [0, 1] as (rank - 1) / max(1, size - 1). Nulls get no rank.
    """
    limit = size_limit(df, keys)
    for value, out in columns.items():
        if limit is None:
            w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
            ties = F.count(value).over(Window.partitionBy(*keys, value))
            size = F.count(value).over(Window.partitionBy(*keys))
            rank = F.rank().over(w) + (ties - 1) / 2
            df = df.withColumn(out, F.when(F.col(value).isNotNull(), _scaled(rank, size, scale)))
        else:
            ranks = value_ranks(df, keys, value, limit)
            rank = _scaled(F.col("avg_rank"), F.col("n_group"), scale)
            df = join_on(df, ranks.select(*keys, value, rank.alias(out)), [*keys, value])
    return df


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
    weight: str | None = None, method: str = "linear",
) -> DataFrame:
    """Exact quantiles per group.

    `percentile` keeps every distinct value of a group in one buffer, so it serves small groups
    only; beyond that a row is kept only if it is one of the two order statistics that some quantile
    interpolates. `method="nearest"` takes the closer of the two instead.
    """
    d = df.where(F.col(value).isNotNull())
    sizes = group_sizes(d, keys)
    if sizes[0] <= hot_rows(df.sparkSession) and method == "linear":
        p = F.percentile(value, list(probs.values()), F.col(weight) if weight else 1).alias("_q")
        g = d.groupBy(*keys).agg(p)
        return g.select(*keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    size_of = F.sum(weight) if weight else F.count("*")
    t = d.groupBy(*keys, value).agg(size_of.alias("_n"))
    p = prefix_sums(with_group_size(t, keys, "_n", "_size"), keys, value, ["_n"], size_limit(d, keys, sizes))
    # per row, the quantiles whose position falls on (or right beside) its run of equal values
    at = F.transform(F.array(*[F.lit(float(q)) for q in probs.values()]), lambda q, i: F.struct(
        i.alias("i"), ((F.col("_size") - 1) * q).alias("pos")))
    first, end = F.col("_n_below"), F.col("_n_below") + F.col("_n")
    hits = F.filter(at, lambda t: (F.floor(t["pos"]) < end) & (F.ceil(t["pos"]) >= first))
    h = p.withColumn("_t", F.explode(hits)).select(*keys, value, first.alias("_from"), end.alias("_to"), "_t.*")
    pick = lambda side: F.max(F.when((side >= F.col("_from")) & (side < F.col("_to")), F.col(value))).cast("double")
    v = h.groupBy(*keys, "i").agg(
        pick(F.floor("pos")).alias("lo"), pick(F.ceil("pos")).alias("hi"), F.max(F.col("pos") - F.floor("pos")).alias("frac"))
    lo, hi, frac = F.col("lo"), F.col("hi"), F.col("frac")
    mixed = F.when(frac < 0.5, lo).otherwise(hi) if method == "nearest" else lo + (hi - lo) * frac
    # one entry per requested quantile
    g = v.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", mixed.alias("q")))).alias("_q"))
    return g.select(*keys, *[F.try_element_at("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
