"""Registered queries: a Spark callable and, where SQL can express it, its ANSI text."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the lap table as one SQL text
LAPS_SQL = """
WITH b AS (
  SELECT event_id AS id, user_id, ts, value,
    CAST(user_id % 5 AS INT) AS race_k,
    CAST(2022 + (CAST(floor(user_id / 5) AS BIGINT) % 4) AS INT) AS Year,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS PitStop,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS LapNumber
  FROM events),
c AS (
  SELECT *, CAST(1 + coalesce(sum(PitStop) OVER (PARTITION BY user_id ORDER BY LapNumber
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS Stint
  FROM b),
e AS (
  SELECT *,
    CAST(row_number() OVER (PARTITION BY user_id, Stint ORDER BY LapNumber) AS DOUBLE) AS TyreLife,
    CAST(1 + (row_number() OVER (PARTITION BY race_k, Year, LapNumber ORDER BY value, id) - 1) % 20 AS INT) AS Position,
    first_value(value) OVER (PARTITION BY user_id, Stint ORDER BY LapNumber
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v0,
    lag(value) OVER (PARTITION BY user_id ORDER BY LapNumber) AS pv,
    max(LapNumber) OVER (PARTITION BY race_k, Year) AS mx,
    coalesce(lead(PitStop) OVER (PARTITION BY user_id ORDER BY LapNumber), 0) AS nxt
  FROM c)
SELECT id,
  CASE WHEN user_id < 1000 AND user_id % 7 < 4
       THEN concat('D', lpad(CAST(user_id AS VARCHAR(20)), 3, '0'))
       ELSE concat('R', lpad(CAST(user_id AS VARCHAR(20)), 5, '0')) END AS Driver,
  CASE WHEN (user_id + Stint) % 11 < 4 THEN 'MEDIUM'
       WHEN (user_id + Stint) % 11 < 8 THEN 'HARD'
       WHEN (user_id + Stint) % 11 < 10 OR race_k >= 2 THEN 'SOFT'
       WHEN Stint % 2 = 0 THEN 'WET' ELSE 'INTERMEDIATE' END AS Compound,
  CASE WHEN race_k = 0 THEN 'Pre-Season Testing'
       ELSE concat('GP', CAST(race_k AS VARCHAR(5))) END AS Race,
  Year, PitStop, LapNumber, Stint, TyreLife, Position,
  CAST(60 AS DOUBLE) + value AS LapTime,
  value - coalesce(pv, value) AS LapTime_Delta,
  value - v0 AS Cumulative_Degradation,
  CAST(LapNumber AS DOUBLE) / mx AS RaceProgress,
  CAST(coalesce(lag(Position) OVER (PARTITION BY user_id ORDER BY LapNumber) - Position, 0) AS DOUBLE) AS Position_Change,
  CAST(nxt AS DOUBLE) AS PitNextLap,
  CASE WHEN user_id % 10 = 9 THEN 'ext' WHEN id % 10 < 7 THEN 'train' ELSE 'test' END AS split
FROM e"""

OOF_SQL = """
SELECT id, Year, Race, Compound, PitNextLap AS target,
  TyreLife / (TyreLife + CAST(10 AS DOUBLE)) AS oof_a,
  CAST((id * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS oof_b,
  (LapTime - CAST(59 AS DOUBLE)) / (LapTime + CAST(100 AS DOUBLE)) AS oof_c,
  CAST(0.5 AS DOUBLE) * RaceProgress + CAST(0.25 AS DOUBLE) * PitNextLap
    + CAST(0.25 AS DOUBLE) * (CAST((id * 104729) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE)) AS oof_d
FROM laps WHERE split = 'train'"""


BOTH_SQL = """
SELECT 'oof' AS part, id, target, oof_a, oof_b, oof_c, oof_d FROM oof UNION ALL
SELECT 'test' AS part, id, NULL AS target,
  TyreLife / (TyreLife + CAST(10 AS DOUBLE)) AS oof_a,
  CAST((id * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS oof_b,
  (LapTime - CAST(59 AS DOUBLE)) / (LapTime + CAST(100 AS DOUBLE)) AS oof_c,
  CAST(0.75 AS DOUBLE) * RaceProgress + CAST(0.25 AS DOUBLE) * (CAST((id * 104729) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE)) AS oof_d
FROM test"""


def on_laps(sql: str, *ctes: tuple[str, str]) -> str:
    """Prefix a query with the lap tables (laps, comb, train, test, ext, oof) and more CTEs."""
    parts = [
        f"laps AS ({LAPS_SQL})",
        "comb AS (SELECT * FROM laps WHERE split IN ('train', 'test'))",
        "train AS (SELECT * FROM laps WHERE split = 'train')",
        "test AS (SELECT * FROM laps WHERE split = 'test')",
        "ext AS (SELECT * FROM laps WHERE split = 'ext')",
        f"oof AS ({OOF_SQL})",
        f"both_parts AS ({BOTH_SQL})",
    ]
    parts += [f"{name} AS ({body})" for name, body in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL text if there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that two engines' last bits do not matter.

    The nudge settles exact halves, which a different order of summation would round either way.
    """
    return df.select(*[
        (F.round(F.col(c) + 1e-9, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def r(expr: str, name: str) -> str:
    """SQL text of a rounded output column."""
    return f"round(CAST({expr} AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name}"


def r_all(*names: str, prefix: str = "") -> str:
    return ", ".join(r(prefix + n, n) for n in names)
