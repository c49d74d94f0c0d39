"""Encoders fitted on one set of rows and applied to another.

Fitted state is a small table (joined; the engine broadcasts it when it is small) or, for bin
edges, a list whose length is a parameter.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import join_on, search, quantiles, with_avg_rank, with_position


def frequency(df: DataFrame, fit: DataFrame, columns: list[str], total: bool = True, count_null: bool = True) -> DataFrame:
    """Add <col>_count, and <col>_freq when `total`, counted on `fit`; unseen values count 0.

    Null is a category of its own, or counts 0 without `count_null`.
    """
    for x in columns:
        counts = fit.groupBy(x).agg(F.count("*").alias(f"{x}_count"))
        df = join_on(df, counts, [x]) if count_null else df.join(counts, x, "left")
        df = df.withColumn(f"{x}_count", F.coalesce(f"{x}_count", F.lit(0).cast("long")))
    if not total:
        return df
    n = fit.agg(F.count("*")).scalar()
    return df.withColumns({f"{x}_freq": F.col(f"{x}_count") / n for x in columns})


def first_seen_codes(fit: DataFrame, column: str, out: str, key="id") -> DataFrame:
    """0-based code per distinct value in order of first appearance (smallest key)."""
    seen = fit.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias("_first"))
    return with_position(seen, [], ["_first"], "_p").select(column, (F.col("_p") - 1).cast("int").alias(out))


def sorted_codes(fit: DataFrame, column: str, out: str) -> DataFrame:
    """0-based code per distinct value in sorted order."""
    values = fit.select(column).where(F.col(column).isNotNull()).distinct()
    return with_position(values, [], [column], "_p").select(column, (F.col("_p") - 1).cast("int").alias(out))


def apply_codes(df: DataFrame, codes: DataFrame, column: str, out: str, unseen: int = -1) -> DataFrame:
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(unseen)))


def cap_cardinality(df: DataFrame, fit: DataFrame, column: str, cap: int, out: str, other="__OTHER__") -> DataFrame:
    """Keep the cap-1 most frequent values when there are more than `cap`; the rest become one."""
    counts = fit.groupBy(column).agg(F.count("*").alias("_n"))
    n_values = counts.agg(F.count("*")).scalar()
    keep = counts.orderBy(F.desc("_n"), column).limit(cap - 1).select(column, F.lit(True).alias("_keep"))
    kept = F.col("_keep").isNotNull() | (n_values <= cap)
    d = df.join(F.broadcast(keep), column, "left")
    return d.withColumn(out, F.when(kept, F.col(column)).otherwise(other)).drop("_keep")


def long_form(df: DataFrame, columns: list[str], extra: list[str] = ()) -> DataFrame:
    """(column, value) rows of numeric columns, nulls left out by the readers."""
    return df.select(*extra, *[F.col(x).cast("double").alias(x) for x in columns]).unpivot(
        list(extra), columns, "column", "value")


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of many columns in one job: one row per column."""
    return quantiles(long_form(df, columns), ["column"], "value", probs)


def fit_bins(fit: DataFrame, columns: list[str], n_bins: int) -> dict[str, list[float]]:
    """Distinct interior quantile edges per column; the driver reads n_bins - 1 numbers each."""
    probs = {f"q{i}": i / n_bins for i in range(1, n_bins)}
    rows = column_quantiles(fit, columns, probs).collect()
    return {row["column"]: sorted({row[q] for q in probs}) for row in rows}


def apply_bins(x: str, edges: list[float], null_slot: int | None = None) -> Column:
    """Left-closed bin index; values outside the fitted range fall in the outer bins, nulls in a bin of their own (or stay null)."""
    at = search(x, edges).cast("int")
    return F.when(F.col(x).isNull(), F.lit(null_slot)).otherwise(at)


def group_stats(df: DataFrame, fit: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, sample std (0 for one row) and difference to the mean, per key and value column."""
    for k in keys:
        aggs = []
        for v in values:
            aggs += [F.avg(v).alias(f"{v}_mean_by_{k}"), F.stddev_samp(v).alias(f"{v}_std_by_{k}")]
        df = df.join(fit.groupBy(k).agg(*aggs), k, "left")
        df = df.withColumns({f"{v}_std_by_{k}": F.coalesce(f"{v}_std_by_{k}", F.lit(0.0)) for v in values})
        df = df.withColumns({f"{v}_diff_mean_by_{k}": F.col(v) - F.col(f"{v}_mean_by_{k}") for v in values})
    return df


def add_tyre_overdue(df: DataFrame, fit: DataFrame) -> DataFrame:
    """Tyre age against its compound's quantiles, and degradation against the compound median."""
    age = quantiles(fit, ["Compound"], "TyreLife", {"_med": 0.5, "_p75": 0.75, "_p90": 0.9})
    deg = quantiles(fit, ["Compound"], "Cumulative_Degradation", {"_deg": 0.5})
    d = df.join(age, "Compound", "left").join(deg, "Compound", "left")
    t = F.col("TyreLife")
    return d.withColumns({
        "tyre_minus_compound_median": t - F.col("_med"),
        "tyre_over_compound_p75": t / (F.col("_p75") + 1e-6),
        "tyre_overdue_p75": (t > F.col("_p75")).cast("int"),
        "tyre_overdue_p90": (t > F.col("_p90")).cast("int"),
        "tyre_beyond_p90_amt": F.greatest(t - F.col("_p90"), F.lit(0.0)),
        "deg_vs_compound_median": F.col("Cumulative_Degradation") - F.col("_deg"),
    }).drop("_med", "_p75", "_p90", "_deg")


def add_tyre_overdue_inductive(df: DataFrame, fit: DataFrame) -> DataFrame:
    """The same idea fitted on training rows only; unseen compounds use the global quantiles."""
    probs = {"50": 0.5, "75": 0.75, "90": 0.9}
    per = quantiles(fit, ["Compound"], "TyreLife", {f"_c{k}": p for k, p in probs.items()})
    glob = quantiles(fit, [], "TyreLife", probs)
    d = df.join(per, "Compound", "left")
    q = {k: F.coalesce(F.col(f"_c{k}"), glob.select(k).scalar()) for k in probs}
    t = F.col("TyreLife")
    return d.withColumns({
        "tyre_overdue_p75": t - q["75"],
        "tyre_overdue_p90": t - q["90"],
        "tyre_life_ratio_p50": t / (q["50"] + 1e-6),
        "tyre_over_p90_flag": (t > q["90"]).cast("int"),
    }).drop(*[f"_c{k}" for k in probs])


def percentile_map(fit: DataFrame, value: str, out: str) -> DataFrame:
    """Mean percentile rank of each distinct value."""
    ranked = with_avg_rank(fit.select(value), [], {value: out}, "n")
    return ranked.where(F.col(value).isNotNull()).groupBy(value).agg(F.max(out).alias(out))


def standard_scale(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std fitted on `fit`; a constant column is only centred."""
    moments = fit.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(x) for x in columns]).first()
    scale = lambda x: (F.col(x) - moments[x]["m"]) / (moments[x]["s"] or 1.0)
    return df.withColumns({f"{x}_z": scale(x) for x in columns})


def winsorize(df: DataFrame, fit: DataFrame, columns: list[str], lo=0.005, hi=0.995) -> DataFrame:
    """Clip to quantiles fitted on `fit` (two numbers per column)."""
    rows = column_quantiles(fit, columns, {"lo": lo, "hi": hi}).collect()
    return df.withColumns({
        row["column"]: F.least(F.greatest(F.col(row["column"]).cast("double"), F.lit(row["lo"])), F.lit(row["hi"]))
        for row in rows
    })


def sequences(df: DataFrame, keys: list[str], pos: str, columns: list[str], max_len: int) -> DataFrame:
    """Ordered arrays per timeline, padded to max_len, with a mask.

    `pos` is dense and 1-based. A timeline longer than max_len becomes several segments, so an
    array never grows with the data and no lap is lost.
    """
    seg = F.floor((F.col(pos) - 1) / max_len).cast("int")
    item = F.struct(F.col(pos), *[F.col(x) for x in columns])
    g = df.groupBy(*keys, seg.alias("segment")).agg(F.array_sort(F.collect_list(item)).alias("seq"))
    n = F.size("seq")
    zero = F.struct(F.lit(0).cast("int").alias(pos), *[F.lit(0.0).alias(x) for x in columns])
    pad = F.when(n < max_len, F.array_repeat(zero, max_len - n)).otherwise(F.slice("seq", 1, 0))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0))))
    return g.select(*keys, "segment", n.alias("n"), F.concat("seq", pad).alias("seq"), mask.alias("mask"))


def role_sequences(df: DataFrame, keys: list[str], pos: str, role: str, key: str, target: str, columns: list[str], max_len: int) -> DataFrame:
    """Padded arrays per timeline and source, with the role of every position.

    Roles: 0 new rows (to be predicted), 1 training rows (fitted and scored), 2 augmentation rows (fitted, never scored). Augmentation rows are a
    timeline of their own (`source` 1), so laps that both sources hold do not mix. Rows follow each other by role, position and key; a
    timeline longer than max_len becomes several segments. Per position: `laps`, `roles` (pad -1), `ids` (-1 for augmentation rows and padding),
    `mask`, `fit_mask` (has a target), `score_mask` (training rows), `new_mask`, `target` (clipped to 0..1, 0 where there is none) and the
    columns (nulls become 0). `has_train` and `has_positive` say what a segment holds.
    """
    r = F.col(role)
    d = df.select(*keys, pos, r.cast("int").alias("_role"), F.col(key).alias("_id"), F.col(target).cast("double").alias("_t"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    d = d.withColumn("source", (F.col("_role") == 2).cast("int"))
    d = with_position(d, [*keys, "source"], ["_role", pos, "_id"], "_p")
    known = F.col("_role") > 0
    item = {
        "laps": (F.col(pos).cast("bigint"), 0), "roles": (F.col("_role"), -1), "ids": (F.when(F.col("_role") == 2, -1).otherwise(F.col("_id")).cast("bigint"), -1),
        "mask": (F.lit(1), 0), "fit_mask": (known.cast("int"), 0), "score_mask": ((F.col("_role") == 1).cast("int"), 0), "new_mask": ((F.col("_role") == 0).cast("int"), 0),
        "target": (F.when(known, F.least(F.greatest(F.coalesce("_t", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0), 0.0),
        **{c: (F.coalesce(f"_v{i}", F.lit(0.0)), 0.0) for i, c in enumerate(columns)}}
    rows = d.select(*keys, "source", F.floor((F.col("_p") - 1) / max_len).cast("int").alias("segment"), F.struct("_p", *[e.alias(n) for n, (e, _) in item.items()]).alias("_i"))
    g = rows.groupBy(*keys, "source", "segment").agg(F.array_sort(F.collect_list("_i")).alias("_s"))
    n = F.size("_s")
    kinds = {f.name: f.dataType for f in rows.schema["_i"].dataType}
    padded = [F.concat(F.col("_s")[name], F.array_repeat(F.lit(pad).cast(kinds[name]), F.lit(max_len) - n)).alias(name) for name, (_, pad) in item.items()]
    return g.select(*keys, "source", "segment", n.alias("n"), *padded, F.exists("_s", lambda x: x["score_mask"] == 1).alias("has_train"),
                    F.exists("_s", lambda x: (x["score_mask"] == 1) & (x["target"] > 0.5)).alias("has_positive"))
