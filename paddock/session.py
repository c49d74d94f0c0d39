"""Session settings, and tables staged in the shared folder the cluster names."""

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, str] = {}
_own_dir: dict[str, str] = {}
_cleared_at_end: set[str] = set()
_seen_by_all: set[tuple[str, str]] = set()


def hot_rows(spark: SparkSession) -> int:
    """Groups with more rows than this are split into ranges of about as many rows."""
    return int(spark.conf.get("paddock.hotRows", "1000000"))


def block_rows(spark: SparkSession) -> int:
    """Rows of one timeline that stay together in one window partition."""
    return int(spark.conf.get("paddock.blockRows", "1000000"))


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _all_see(spark: SparkSession, folder: str) -> bool:
    """Whether the driver finds what the executors write to a folder: one small file per core."""
    n = max(2, spark.sparkContext.defaultParallelism)
    probe = f"{folder}/{spark.sparkContext.applicationId}/probe-{uuid.uuid4().hex}"
    spark.range(0, n, 1, n).write.parquet(probe)
    parts, fs = _path(spark, f"{probe}/part-*")
    found = len(fs.globStatus(parts) or [])
    fs.delete(parts.getParent(), True)
    return found == n


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: `spark.checkpoint.dir`, else the warehouse; local runs without the former have their own.

    On a cluster a `file:` folder may be mounted by all machines or not. That is tried out once per application, unless
    `paddock.sharedFiles` says that it is; a folder of one machine is refused, as tables written there would come back empty.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if sc.master == "local" or sc.master.startswith("local["):
        if not named and app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="paddock-")
        return named.rstrip("/") if named else _own_dir[app]
    folder = (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/paddock-staged").rstrip("/")
    if (app, folder) not in _seen_by_all:
        doubtful = _path(spark, folder)[1].getScheme() == "file" and spark.conf.get("paddock.sharedFiles", "false") != "true"
        if doubtful and not _all_see(spark, folder):
            raise RuntimeError(f"{folder} is a folder of one machine; set spark.checkpoint.dir to one that all executors share")
        _seen_by_all.add((app, folder))
    return folder


def app_dir(spark: SparkSession) -> str:
    """This application's folder of staged and cut tables; it goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _cleared_at_end:
        _cleared_at_end.add(app)
        atexit.register(clear_staged, spark)
    return f"{stage_dir(spark)}/{app}"


def clear_staged(spark: SparkSession) -> None:
    """Delete all staged and cut tables of this application. Frames that read them are of no use afterwards."""
    if spark.sparkContext._jsc is None:
        return
    path, fs = _path(spark, f"{stage_dir(spark)}/{spark.sparkContext.applicationId}")
    fs.delete(path, True)
    _staged.clear()


def _stamp(spark: SparkSession, source: str) -> str:
    """A source folder's tables with their sizes and times: it changes when a table does."""
    path, fs = _path(spark, f"{source}/*")
    found = fs.globStatus(path) or []
    return source + "".join(sorted(f"|{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def staged(spark: SparkSession, name: str, source: str, build, partition_by=()) -> DataFrame:
    """Build a table once per application and state of the source, write it, and read it back from then on.

    Cuts the lineage with a written table, so lost executors do not recompute it.
    """
    tag = hashlib.md5(_stamp(spark, source).encode()).hexdigest()[:12]
    path = f"{app_dir(spark)}/{tag}/{name}"
    if path not in _staged:
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        _staged[path] = path
    return spark.read.parquet(path)


def cut(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write a derived table that is about to be read several times, and read it back."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
