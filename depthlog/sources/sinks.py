"""Writing tables: parquet by split and well, CSV exports, JSON parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from depthlog.operators.joins import absent_in, attach_split
from depthlog.operators.series import block_of

GROUP, GROUPS = "group", 256


def export_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wanted columns in order, each once, those that exist."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                  rows_per_file: int = 5_000_000) -> None:
    """Partitioned parquet; a heavy partition value is cut into files of bounded length."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_splits(df: DataFrame, manifest: DataFrame, path: str, key: str = "WELL", split: str = "SPLIT", order: str = "SOURCE_ROW") -> None:
    """Samples by split and well, after checking that every listed well has data."""
    absent = [r[0] for r in absent_in(manifest, df, key).limit(20).collect()]
    if absent:
        raise ValueError(f"wells of the manifest without data: {absent}")
    rows = attach_split(df, manifest, key, split, order).filter(F.col(split).isNotNull())
    # A well's rows meet by blocks before they are written: as many files as blocks, however many tasks the input has.
    write_parquet(rows.repartition(split, key, block_of(order)), path, [split, key])


def write_files(df: DataFrame, path: str, file: str, order: str, fmt: str, mode: str = "overwrite", **options) -> None:
    """One folder {file}=... with one file for each value of `file`, its rows by `order`, for any number of files.

    The folders lie in a few hundred others, so that tasks list many each, and tasks put their own files into place:
    both would be work of the driver for every single file. A task that is repeated writes the same names again. The
    number of tasks is given, because a file costs the same however few bytes it has."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn(GROUP, F.pmod(F.xxhash64(file), F.lit(GROUPS)))
    (rows.repartition(tasks, GROUP, file).sortWithinPartitions(GROUP, file, order).drop(*([order] if order.startswith("__") else []))
     .write.mode(mode).option("mapreduce.fileoutputcommitter.algorithm.version", "2").options(**options)
     .partitionBy(GROUP, file).format(fmt).save(path))


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, sep=sep)


def write_parameters(spark: SparkSession, path: str, json_text: str) -> None:
    """One JSON document as one line of text."""
    spark.createDataFrame([(json_text,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=False).first()["value"]
