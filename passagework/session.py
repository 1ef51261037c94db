"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes the shuffle files of an execution at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", *, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("passagework")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: `spark.checkpoint.dir`.

    Only a local session, where driver and executors are one process, may do
    without the setting and use a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-passagework-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialise(df: DataFrame, partition_by: tuple[str, ...] = (), *, keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder, in folders of `partition_by`, and read it back.

    Used where several branches of a job need the same costly table: it is
    computed once, survives lost executors, and each branch reads only its columns.
    The shuffle files of the write are freed with it, so a job of several such steps
    holds the files of one step at a time. `release_tables` deletes the table unless it is to `keep`.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    spark = df.sparkSession
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path, compression="zstd")
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    if not keep:
        _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that this process has written between steps.
_WRITTEN: list[str] = []


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that `materialise` has written so far, once a job's results are stored; returns their number."""
    return _delete(spark, list(_WRITTEN))


def release_table(table: DataFrame) -> int:
    """Delete a table that `materialise` has written and no later step reads; returns 1, or 0 if it isn't one or is to keep."""
    folders = {name for file in table.inputFiles() for name in file.split("/")}
    return _delete(table.sparkSession, [p for p in _WRITTEN if p.rsplit("/", 1)[-1] in folders])


def _delete(spark: SparkSession, paths: list[str]) -> int:
    for path in paths:
        _WRITTEN.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
