import pytest
from pyspark.sql import SparkSession

from tools.check import duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stage")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.fixture
def tight(spark):
    """Split every group and timeline that has more than some rows."""
    spark.conf.set("paddock.hotRows", "2500")
    spark.conf.set("paddock.blockRows", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.unset("paddock.hotRows")
    spark.conf.unset("paddock.blockRows")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
