"""What operators need from the running session: a shared folder, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast explicitly; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on one machine only, one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="termloom-")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint in the shared folder, which keeps its partitioning.

    Spark removes the files of a checkpoint that is no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once and written by columns to the shared folder, for rows of which later steps read some columns only.

    The tables of an application lie in a folder of its own, which goes when the driver ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder below the shared one."""
    return f"{_scratch(spark, shared_dir(spark).rstrip('/'), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex[:12]}"


_SCRATCH: set[str] = set()


def _scratch(spark: SparkSession, below: str, application: str) -> str:
    folder = f"{below}/termloom-{application}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        atexit.register(_remove, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path)
    return folder


def _remove(file_system, path) -> None:
    try:
        file_system.delete(path, True)
    except Exception:  # the driver's JVM went first; the folder stays
        return


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df as a broadcast side if its known number of rows is small, as a shuffled one beyond that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_once(*jobs: Callable[[], object]) -> None:
    """Runs independent Spark jobs side by side; the first error is raised once all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(job) for job in jobs]
    for r in running:
        r.result()
