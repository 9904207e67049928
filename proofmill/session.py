"""Sessions, table loading, and tables cut from their lineage in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = "4m"


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    # Workers import this package from where it lies.
    os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), *filter(None, [os.environ.get("PYTHONPATH")])])
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("proofmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PROOFMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer: a small file is else one task's work.

    What a shuffle leaves in few partitions isn't known before it is run, so such a table is dealt
    anew, unless its last shuffle has a number of its own.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    _, shuffled, last = df._jdf.queryExecution().executedPlan().toString().partition("Exchange")
    if shuffled:
        return df if "REPARTITION_BY_NUM" in last.partition("\n")[0] else df.repartition(cores)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by keys over as many partitions as shuffles have, which aren't merged by their size: rows that compress well are else held by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of ``SMALL_BATCH``, whatever their number and length.

    Spark's own limit is 64 MB, and executor and worker each hold a batch more than once, for every
    task.  It holds for the session, as a frame is run after it is made.
    """
    spark.conf.set(BATCH_BYTES, SMALL_BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one, and that on a local master only."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='proofmill-')}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, so what follows survives lost executors without
    repeating the work, and joins plan with real sizes.  The table goes when the
    driver's process ends.
    """
    path = f"{shared_dir(df.sparkSession)}/proofmill/{label}-{uuid.uuid4().hex}"
    out = _written(df, path)
    where, fs = _located(df.sparkSession, path)
    fs.deleteOnExit(where)
    return out


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[tuple[Callable[[DataFrame, str], DataFrame], Callable[[DataFrame, str], DataFrame]]]:
    """Two forms of ``stash``: tables of the first are deleted at the end of the block, those of the second stay.

    What a block returns must be built on tables that stay.  Within the block the
    shuffle files of a query go when it ends, as its result is written then, and
    batches for Python are small.
    """
    folder = f"{shared_dir(spark)}/proofmill/scratch-{uuid.uuid4().hex}"

    def passing(df: DataFrame, label: str) -> DataFrame:
        return _written(df, f"{folder}/{label}-{uuid.uuid4().hex}")

    before = {FILE_CLEANUP: spark.conf.get(FILE_CLEANUP, "false"), BATCH_BYTES: spark.conf.get(BATCH_BYTES)}
    spark.conf.set(FILE_CLEANUP, "true")
    small_batches(spark)
    try:
        yield passing, stash
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        where, fs = _located(spark, folder)
        fs.delete(where, True)
