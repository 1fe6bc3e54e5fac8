"""Session defaults and the shared folder that tables between jobs are written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}  # folder of each application on one machine that names none


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if that place exists there.

    A cluster whose machines don't share it gets the package by ``--py-files`` or an installation.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = root + (os.pathsep + known if known else "")
    return spark


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "relayscope") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return reach(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a test on one
    machine) a local folder takes its place.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="relayscope-")
    return _LOCAL[app]


_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def forget(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder; call it once no result is needed any more."""
    gone = 0
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _WRITTEN:
        path = hadoop.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
