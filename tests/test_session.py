"""Staged tables on a cluster: a `file:` folder is used if all machines share it, and refused if not."""

import pytest
from pyspark.sql import functions as F

from paddock import session


@pytest.fixture
def cluster(spark, monkeypatch):
    """The test session under a cluster's master name; its `spark.checkpoint.dir` is a `file:` folder."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_seen_by_all", set(), raising=False)
    monkeypatch.setattr(session, "_staged", {})
    return spark


def test_tables_are_cut_and_staged_in_a_shared_folder_of_files(cluster, tmp_path):
    d = cluster.range(100).withColumn("k", F.col("id") % 3)
    assert session.stage_dir(cluster) == cluster.conf.get("spark.checkpoint.dir")
    assert sorted(map(tuple, session.cut(d).collect())) == sorted(map(tuple, d.collect()))
    got = session.staged(cluster, "x", str(tmp_path), lambda: d, ["k"])
    assert got.groupBy("k").count().orderBy("k").collect() == d.groupBy("k").count().orderBy("k").collect()
    assert len(session._seen_by_all) == 1  # tried out once


def test_without_a_checkpoint_folder_the_warehouse_is_used(cluster, tmp_path, monkeypatch):
    settings = {"spark.sql.warehouse.dir": f"file:{tmp_path}/wh"}
    monkeypatch.setattr(cluster.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(type(cluster.conf), "get", lambda self, key, *default: settings.get(key, *default))
    assert session.stage_dir(cluster) == f"file:{tmp_path}/wh/paddock-staged"


def test_a_folder_of_one_machine_is_refused(cluster, monkeypatch):
    real, folder = session._path, session.stage_dir(cluster)
    session._seen_by_all.clear()
    # the driver looks into a folder of its own
    monkeypatch.setattr(session, "_path", lambda spark, name: real(spark, name.replace(folder, f"{folder}-driver")))
    with pytest.raises(RuntimeError, match="one machine"):
        session.stage_dir(cluster)
    cluster.conf.set("paddock.sharedFiles", "true")
    try:
        assert session.stage_dir(cluster) == folder
    finally:
        cluster.conf.unset("paddock.sharedFiles")


@pytest.mark.parametrize("name", ["A2_log_loss", "B10_remap_by_rank"])
def test_queries_on_laps_run_on_a_cluster(cluster, tmp_path, name):
    from paddock.plans import catalog

    rows = [(i, i % 40, f"2024-01-{1 + i % 28:02d} 00:00:{i % 60:02d}", ["view", "purchase", "click"][i % 7 % 3], float(i * 37 % 101)) for i in range(4000)]
    events = cluster.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    on_cluster = catalog.QUERIES[name](cluster, str(tmp_path)).collect()
    cluster.sparkContext.master = "local[8]"
    assert on_cluster and sorted(map(str, on_cluster)) == sorted(map(str, catalog.QUERIES[name](cluster, str(tmp_path)).collect()))
