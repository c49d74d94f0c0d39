"""Deterministic folds, samples and weights, all derived from a seeded hash of the row key."""

from math import ceil, exp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .spread import join_on, with_position


def hash_key(seed, key="id") -> Column:
    """First 52 bits of md5(seed-key) as a number; the same order in every engine."""
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


def unit_hash(seed, key="id") -> Column:
    """Seeded uniform number in [0, 1)."""
    return hash_key(seed, key) / F.lit(float(2 ** 52))


def stratified_folds(df: DataFrame, strata: list[str], k=5, seed=42, key="id", out="fold", reread=False) -> DataFrame:
    """Shuffle each stratum by the hash and deal its rows to the folds in turn."""
    d = with_position(df.withColumn("_h", hash_key(seed, key)), strata, ["_h", key], "_p", reread)
    return d.withColumn(out, ((F.col("_p") - 1) % k).cast("int")).drop("_h", "_p")


def deal_run(loads: list[int], size: int, n: int) -> list[tuple[int, list[int]]]:
    """Deal n groups of one size, each into the emptiest fold (the first of equals); `loads` is brought up to date.

    The result is [(first group, folds in turn)]: from a group on, folds take turns in that order until the next entry. The folds in turn are
    those within one group of the emptiest. The number of entries depends on the number of folds, not on that of groups.
    """
    out, at = [], 0
    while at < n:
        low = min(loads)
        # folds that the emptiest would pass with one group more take turns, in the order of their loads
        turn = sorted((f for f in range(len(loads)) if loads[f] < low + size or loads[f] == low), key=lambda f: (loads[f], f))
        rest = [loads[f] for f in range(len(loads)) if f not in turn]
        # full turns before the next fold is as near as these are, and one at least if no fold is left
        turns = (n - at) // len(turn) if not rest or not size else min((n - at) // len(turn), max(0, (min(rest) - low - size) // size))
        if turns:
            out.append((at, turn))
            at += turns * len(turn)
            for f in turn:
                loads[f] += turns * size
        else:
            out.append((at, turn[:1]))
            at += 1
            loads[turn[0]] += size
    return out


def group_folds(df: DataFrame, group: str, k=5, out="fold") -> DataFrame:
    """Keep each group in one fold: the largest group first (ties by name, null first), each into the fold with the fewest rows so far.

    The driver deals runs of groups of equal size: it reads one row per distinct size (fewer than sqrt(2 rows)).
    """
    sizes = cut(df.groupBy(group).agg(F.count("*").alias("_n")))
    runs = sizes.groupBy("_n").agg(F.count("*").alias("groups")).orderBy(F.desc("_n")).collect()
    loads, dealt = [0] * k, []
    for r in runs:
        dealt += [(r["_n"], at, turn) for at, turn in deal_run(loads, r["_n"], r["groups"])]
    if not dealt:
        return df.withColumn(out, F.lit(None).cast("int"))
    table = df.sparkSession.createDataFrame(dealt, "_n long, at long, turn array<int>")
    table = table.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("_turns"))
    ranked = with_position(sizes, ["_n"], [group], "_p").withColumn("_p", F.col("_p") - 1).join(table, "_n")
    mine = F.element_at(F.filter("_turns", lambda t: t["at"] <= F.col("_p")), -1)
    fold = F.get(mine["turn"], ((F.col("_p") - mine["at"]) % F.size(mine["turn"])).cast("int"))
    return join_on(df, ranked.select(group, fold.alias(out)), [group])


def group_stratified_folds(df: DataFrame, groups: list[str], year: str, target: str, k=5, seed=42) -> DataFrame:
    """Fold whole groups, stratified by year and by whether the group has any positive."""
    g = df.groupBy(*groups).agg(
        F.min("id").alias("_gid"), F.max(year).alias("_gy"), F.max((F.col(target) > 0).cast("int")).alias("_any"))
    g = stratified_folds(g, ["_gy", "_any"], k, seed, "_gid")
    return join_on(df, g.select(*groups, "fold"), groups)


def is_holdout(rate=0.2, seed=7) -> Column:
    """Row-wise shuffled split by a hash threshold."""
    return (unit_hash(seed) < rate).cast("int")


def pseudo_labels(pred: DataFrame, score="score", hi=0.92, lo=0.03, out="pseudo") -> DataFrame:
    """Keep only confident rows of a prediction table, with their hard label."""
    label = F.when(F.col(score) >= hi, 1).when(F.col(score) <= lo, 0)
    return pred.withColumn(out, label).where(F.col(out).isNotNull())


def subsample_flagged(df: DataFrame, fold: str, flag: str, rate: float, seed=42) -> DataFrame:
    """Keep all unflagged rows and the first rate*n flagged rows per fold in hash order."""
    flagged = with_position(df.where(F.col(flag) == 1).withColumn("_h", hash_key(seed)), [fold], ["_h", "id"], "_p")
    n = flagged.groupBy(fold).agg(F.count("*").alias("_n"))
    kept = flagged.join(n, fold).where(F.col("_p") <= F.floor(F.col("_n") * rate))
    return df.where(F.col(flag) == 0).unionByName(kept.select(*df.columns))


def poisson_weight(seed, rate: float = 1.0) -> Column:
    """Bootstrap multiplicity: inverse Poisson(rate) CDF of the row's hash, as far as its 52 bits tell values apart."""
    u = unit_hash(seed)
    term = total = exp(-rate)
    cdf = []
    while total < 1 - 2**-52:
        cdf.append(total)
        term *= rate / len(cdf)
        if total + term == total:
            break
        total += term
    w = F.lit(len(cdf))
    for i in reversed(range(len(cdf))):
        w = F.when(u < cdf[i], i).otherwise(w)
    return w


#: Rows that one task draws at once, about, and bits of each of the two levels above them.
_LEAF_ROWS, _LEVEL_BITS = 50_000, 12


def _draw(n: int, weights: np.ndarray, *seed: int) -> np.ndarray:
    """Counts of n draws, by conditional binomials: they add up to n."""
    return np.random.default_rng(seed).multinomial(n, weights / weights.sum())


def exact_bags(df: DataFrame, share: float, seeds: list[int], key="id", out="bags") -> DataFrame:
    """`df` with an array of every row's copies in each bag: int(share * rows) draws with replacement, exactly that many.

    Draws are split over ranges of the key's hash, then over parts of each range, then over rows, each time by conditional binomials that are
    seeded by the bag and the range. So the counts depend on the keys only, not on how rows are partitioned. The driver reads
    at most 2**12 counts; a task holds one part, about 50,000 rows. Keys are unique.
    """
    total = df.count()
    n = int(share * total)
    bits = min(2 * _LEVEL_BITS, max(0, ceil(log2(max(total, 1) / _LEAF_ROWS))))
    first = min(bits, _LEVEL_BITS)
    h = hash_key("bags", key)
    names = [c for c in df.columns if c != out]
    rows = df.select(*names, h.alias("_h")).withColumns({
        "_a": F.shiftright("_h", 52 - first).cast("int"), "_b": (F.shiftright("_h", 52 - bits) % (1 << (bits - first))).cast("int")})
    sizes = rows.groupBy("_a", "_b").agg(F.count("*").alias("n")).groupBy("_a").agg(F.sort_array(F.collect_list(F.struct("_b", "n"))).alias("parts"))
    sizes = cut(sizes)
    tops = sorted((r["_a"], r["n"]) for r in sizes.select("_a", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n")).collect())
    draws = {a: [] for a, _ in tops}
    for s in seeds:
        got = _draw(n, np.array([m for _, m in tops], float), s) if tops else []
        for (a, _), d in zip(tops, got, strict=True):
            draws[a].append(int(d))

    def split(batches):
        for batch in batches:
            at, part, drawn = [], [], []
            for a, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.array([p["n"] for p in parts], float)
                each = np.array([_draw(d, w, s, a) for s, d in zip(seeds, draws[a], strict=True)])
                at += [a] * len(parts)
                part += [p["_b"] for p in parts]
                drawn += each.T.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(part, pa.int32()), pa.array(drawn, pa.list_(pa.int64()))], names=["_a", "_b", "_d"])

    drawn = cut(sizes.mapInArrow(split, "_a int, _b int, _d array<bigint>"))
    rows = rows.join(drawn, ["_a", "_b"]).repartition("_a", "_b").sortWithinPartitions("_a", "_b", "_h", key)
    rows = rows.select(*names, "_a", "_b", "_d")
    fields = T.StructType([*[rows.schema[c] for c in names], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def deal(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        a, b, d = (t.column(c)[0].as_py() for c in ("_a", "_b", "_d"))
        m = t.num_rows
        copies = np.array([_draw(x, np.ones(m), s, a, b) for s, x in zip(seeds, d, strict=True)]).T
        bags = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(seeds), pa.int32()), pa.array(copies.ravel().astype(np.int32)))
        cols = [t.column(c).combine_chunks() for c in names]
        yield pa.RecordBatch.from_arrays([*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], bags], names=[*names, out])

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_a", "_b")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and tuple(keys[:, i]) != now:
                    yield from deal(held)
                    held = []
                now = tuple(keys[:, i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from deal(held)

    return rows.mapInArrow(run, fields)
