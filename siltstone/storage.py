"""Cutting lineage with tables every executor can read.

A stored table survives the loss of executors, unlike a local checkpoint, and gives the
planner true sizes.  The folder is ``spark.checkpoint.dir``; only where that is unset and
the master is a single machine's is a temporary folder set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, object]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors, from the session's settings."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed with the tables."""
    path = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def new_state(spark: SparkSession, path: str) -> None:
    """Has a stream's state below the shared folder removed with the tables."""
    _made.append((spark, path))


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def workspace() -> Iterator[None]:
    """Tables stored inside are removed at the end: for a driver that lives long, around computing and writing a result.

    What is read lazily after it has gone, so results have to be written (or collected) inside.
    """
    before = len(_made)
    try:
        yield
    finally:
        for spark, path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """Rows over all cores where a scan has fewer pieces than there are cores, as with one small file.

    For work that costs far more than moving the rows, and only up to ``most_bytes`` of input: a larger scan is split where it is read
    (``spark.sql.files.maxPartitionBytes``) and never moved.
    """
    execution = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) > most_bytes or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans it
            return
