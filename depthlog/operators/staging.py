"""Cut lineage by writing tables to the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # application -> folder made for a local session that names none
_WRITTEN: dict[str, list[str]] = {}  # application -> staged tables that are still there
CLEAN_BYTES = 32 << 20  # after a write of this size shuffle files that no plan needs are deleted


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this process only in local mode without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="depthlog-"))


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that is released with the staged tables."""
    path = f"{shared_folder(spark)}/depthlog/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write once, read back: later plans neither recompute the input nor see it change."""
    return staged_at(df)[1]


def staged_at(df: DataFrame) -> tuple[str, DataFrame]:
    """The folder of the staged table, for `discard`, and the table."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    clean_shuffles(spark, path)
    return path, spark.read.schema(df.schema).parquet(path)


def folder_of(spark: SparkSession, path: str):
    """(file system, folder)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def clean_shuffles(spark: SparkSession, written: str) -> None:
    """Let Spark delete the shuffle files of ended jobs after a big write to `written`.

    Spark deletes those that no plan refers to, but sees that at a garbage collection of the driver only, which may be
    half an hour away."""
    fs, folder = folder_of(spark, written)
    if fs.getContentSummary(folder).getLength() >= CLEAN_BYTES:
        spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables, or other new folders, that nothing reads any more."""
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, folder = folder_of(spark, path)
        fs.delete(folder, True)
        if path in known:
            known.remove(path)


def staged(spark: SparkSession) -> list[str]:
    """Folders of the staged tables that were not released."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the staged tables, from number `since` on; results read from them must be computed by then."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        fs, folder = folder_of(spark, path)
        fs.delete(folder, True)
    del paths[since:]


@contextmanager
def scope(spark: SparkSession):
    """Tables staged inside are deleted at the end."""
    before = len(staged(spark))
    try:
        yield
    finally:
        release(spark, before)
