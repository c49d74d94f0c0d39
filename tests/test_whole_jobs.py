"""Queries that treat missing values meet some: on rows made here, each does the whole of what its name says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paddock.sources.laps import laps, split_of


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with 2,000 events of 30 users."""
    folder = str(tmp_path_factory.mktemp("made"))
    events = spark.range(2000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), ((F.col("id") * 7 + F.floor(F.col("id") / 31)) % 30).alias("user_id"),
        F.when(F.col("id") % 5 == 2, "purchase").otherwise("view").alias("event_type"), (F.col("id") * 37 % 501 / 4).alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_missing_compounds_get_the_sentinel(spark, made):
    rows = {r.id: r for r in entry.queries()["D17_null_sentinels"](spark, made).collect()}
    own = {r.id: r for r in laps(spark, made).collect()}
    assert len(rows) == len(own) == 2000
    assert {i for i, r in rows.items() if r.Compound == "__NA__"} == {i for i in own if i % 97 == 0}
    assert all(r.Compound == own[i].Compound for i, r in rows.items() if i % 97) and all((r.Driver, r.Race) == (own[i].Driver, own[i].Race) for i, r in rows.items())


def test_missing_numbers_get_the_extra_bin_and_no_edge(spark, made):
    rows = {r.id: r for r in entry.queries()["E6_quantile_bins_with_null_slot"](spark, made).collect()}
    assert set(rows) == set(range(2000))
    for x in ("TyreLife", "LapTime", "Cumulative_Degradation", "RaceProgress"):
        assert {i for i, r in rows.items() if r[f"{x}_bin"] == 32} == {i for i in rows if i % 53 == 0}
    train = [r.LapTime for r in split_of(spark, made, "train").where("id % 53 <> 0").collect()]
    edges = sorted(set(np.quantile(train, [i / 32 for i in range(1, 32)])))
    own = {r.id: r.LapTime for r in laps(spark, made).collect()}
    assert all(r.LapTime_bin == np.searchsorted(edges, own[i], "right") for i, r in rows.items() if i % 53)


def test_external_rows_without_compound_are_dropped(spark, made):
    rows = entry.queries()["S2_external_scan"](spark, made).collect()
    ext = split_of(spark, made, "ext").collect()
    kept = [r for r in ext if r.id % 50]
    assert len(kept) < len(ext) and sorted((r.Driver, r.LapNumber, r.Compound) for r in rows) == sorted((r.Driver, r.LapNumber, r.Compound) for r in kept)
    assert "Normalized_TyreLife" not in rows[0].asDict() and {r.id for r in rows} == {-1}
