"""Window features along one entity's timeline.

`pos` is a dense 1-based position in the group (a gap-free lap number, or the result of
`with_position`). A timeline longer than `block_rows` is cut into blocks, so a hot entity is
many tasks. Neighbour features copy the few rows next to a cut into the block that needs
them; running features add the totals of the earlier blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import block_rows, cut
from .spread import join_on

BLK = "_blk"


def neighbours(df: DataFrame, keys: list[str], pos: str, make, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add columns that depend on at most `back` earlier and `ahead` later rows.

    `make(w)` gets the ordered window and returns one dict of columns, or a list of dicts when
    later columns use earlier ones. `back` must cover the whole chain.
    """
    size = max(block_rows(df.sparkSession), back + ahead + 1)
    at = F.col(pos).cast("long") - 1
    own = F.floor(at / size)
    off = at % size
    targets = F.array(own)
    if back:
        targets = F.when(off >= size - back, F.array(own, own + 1)).otherwise(targets)
    if ahead:
        targets = F.when((own > 0) & (off < ahead), F.concat(targets, F.array(own - 1))).otherwise(targets)
    d = df.withColumn(BLK, F.explode(targets))
    w = Window.partitionBy(*keys, BLK).orderBy(pos)
    stages = make(w)
    for cols in stages if isinstance(stages, list) else [stages]:
        d = d.withColumns(cols)
    return d.where(F.col(BLK) == own).drop(BLK)


def running(
    df: DataFrame, keys: list[str], pos: str, features: dict[str, tuple[str, Column]],
    include_current: bool = True, reverse: bool = False, reread: bool = False,
) -> DataFrame:
    """Add running "sum", "min" or "max" of an expression from the group's first row on.

    With `reverse` the frame runs from the last row back. Excluding the current row leaves null
    where the frame is empty. Set `reread` if df is a table or a projection of one.
    """
    aggs = {"sum": F.sum, "min": F.min, "max": F.max}
    size = block_rows(df.sparkSession)
    end = 0 if include_current else -1
    o = (lambda c: F.col(c).desc()) if reverse else F.col
    longest = df.agg(F.max(pos)).first()[0] or 0
    if longest <= size:
        w = Window.partitionBy(*keys).orderBy(o(pos)).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({c: aggs[fn](e).over(w) for c, (fn, e) in features.items()})
    d = (df if reread else cut(df)).withColumn(BLK, F.floor((F.col(pos).cast("long") - 1) / size))
    w = Window.partitionBy(*keys, BLK).orderBy(o(pos)).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy(o(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*keys, BLK).agg(*[aggs[fn](e).alias(f"_t_{c}") for c, (fn, e) in features.items()])
    carry = carry.select(
        *keys, BLK, F.count("*").over(before).alias("_earlier"),
        *[aggs[fn](f"_t_{c}").over(before).alias(f"_c_{c}") for c, (fn, _) in features.items()],
    ).where(F.col("_earlier") > 0).drop("_earlier")
    d = d.withColumns({c: aggs[fn](e).over(w) for c, (fn, e) in features.items()})
    d = join_on(d, carry, [*keys, BLK])
    for c, (fn, _) in features.items():
        here, there = F.col(c), F.col(f"_c_{c}")
        if fn == "sum":
            both = F.coalesce(here + there, here, there)
        elif fn == "min":
            both = F.when(there.isNull() | (here <= there), here).otherwise(there)
        else:
            both = F.when(there.isNull() | (here >= there), here).otherwise(there)
        d = d.withColumn(c, both)
    return d.drop(BLK, *[f"_c_{c}" for c in features])


def rolling(w, n: int):
    """Frame of the last n observed rows."""
    return w.rowsBetween(-(n - 1), 0)


def at_least(x: Column, frame, k: int, value: Column) -> Column:
    """`value` where the frame has at least k non-null entries of x."""
    return F.when(F.count(x).over(frame) >= k, value)
