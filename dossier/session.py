"""Session helpers: one place for the settings that every job relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_recorders: list[list[str]] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "dossier") -> SparkSession:
    """A session for tests and benches; on a cluster, the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def spread(df: DataFrame, task_bytes: int = 16 << 20) -> DataFrame:
    """df, dealt to all cores where it is small: a file of one row group is one task, which is too
    few for costly work row by row. A large table has tasks for all cores, and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    and all runs on one machine, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="dossier-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, of this application."""
    path = f"{shared_folder(spark).rstrip('/')}/dossier/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _recorders:
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that are given out meanwhile, in order."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.pop()


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """For intermediate tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """For the end of a job, when its results are written elsewhere: deletes what it left in the shared folder."""
    delete(spark, [f"{shared_folder(spark).rstrip('/')}/dossier/{spark.sparkContext.applicationId}"])


def free_shuffles(spark: SparkSession) -> None:
    """The shuffle files of plans that nothing holds any more go now. Left alone, they stay until the
    driver's JVM happens to collect its garbage, which a job that moves much may not see before its end."""
    spark._jvm.System.gc()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes df once to the shared folder and reads it back.
    Lost executors cost a re-run of the write's tasks only."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
