"""Score wells as their files arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from depthlog.operators.features import clean_curves, feature_table
from depthlog.schema import INPUT_CURVES
from depthlog.operators.staging import scope, stage
from depthlog.sources.las import FIRST_ROW, place_lines, read_las

LEDGER = f"WELL string, {FIRST_ROW} long, n long, FILE string, STAMP timestamp"
TAKEN = "rows of the well are in another file"


def current_pieces(entries: DataFrame) -> DataFrame:
    """Of entries (WELL, FIRSTROW, n, FILE, STAMP) the pieces that count: a later file (by time, then name) replaces an
    earlier one of the same well and first row. `taken`: an earlier piece of the well reaches into this one."""
    versions = Window.partitionBy("WELL", FIRST_ROW).orderBy(F.desc("STAMP"), F.desc("FILE"))
    before = Window.partitionBy("WELL").orderBy(FIRST_ROW).rowsBetween(Window.unboundedPreceding, -1)
    newest = entries.withColumn("__v", F.row_number().over(versions)).filter(F.col("__v") == 1).drop("__v")
    reached = F.max(F.col(FIRST_ROW) + F.col("n")).over(before)
    return newest.withColumn("taken", F.coalesce(reached > F.col(FIRST_ROW), F.lit(False)))


def score_landing(spark: SparkSession, folder: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
                  rejects: str | None = None, glob: str = "*.las", files_per_batch: int = 1000) -> StreamingQuery:
    """Read new LAS files, keep their samples, build features of the wells they belong to, apply `score`, write one
    partition per well.

    A well may arrive in several files (pieces, told apart by their first row; 0 where none is stated) and in any
    batches. Samples are kept by well and piece in `out`_samples, and a ledger of pieces (well, first row, rows, file,
    time of the file) in `out`_ledger. Each batch is put together with the ledger of its wells: which piece counts depends
    on all files that came so far and on nothing else, so results and rejects do not depend on how files fall into
    batches. A piece that is sent again replaces the one before; one that begins inside an earlier piece is a reject as
    long as that one reaches so far. A well is scored anew, from all its pieces, in each batch that brings one of them.
    A repeated batch changes nothing. Files without data lines are no pieces.

    `rejects` holds unreadable files by batch, and overlapping pieces under batch -1, written anew from the ledger.
    Centred row windows are not available on a stream, hence the batch function.
    """
    store, book = out.rstrip("/") + "_samples", out.rstrip("/") + "_ledger"
    lines = (spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", files_per_batch).text(folder).selectExpr("value", "_metadata"))

    def write(df: DataFrame, path: str, parts: list[str]) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 5_000_000)
         .partitionBy(*parts).parquet(path))

    def ledger() -> DataFrame:
        if not path_exists(spark, book):
            return spark.createDataFrame([], LEDGER)
        return spark.read.schema(LEDGER).parquet(book)

    def handle(batch: DataFrame, number: int) -> None:
        with scope(spark):
            samples, bad = read_las(place_lines(batch), INPUT_CURVES, pieces=True)
            samples = stage(samples)
            stamps = batch.groupBy(F.col("_metadata.file_path").alias("FILE")).agg(F.max("_metadata.file_modification_time").alias("STAMP"))
            came = stage(samples.groupBy("WELL", FIRST_ROW, "FILE").agg(F.count(F.lit(1)).alias("n")).join(stamps, "FILE"))
            if not came.isEmpty():
                known = ledger().join(came.select("WELL").distinct(), "WELL", "left_semi").join(came.select("FILE"), "FILE", "left_anti")
                pieces = stage(current_pieces(known.unionByName(came)))
                write(samples.join(pieces.select("FILE"), "FILE", "left_semi").drop("FILE"), store, ["WELL", FIRST_ROW])
                write(pieces.drop("taken"), book, ["WELL"])
                kind = "WELL string, FIRSTROW long, " + ", ".join(
                    f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name not in ("WELL", FIRST_ROW, "FILE"))
                wanted = pieces.filter(~F.col("taken")).select("WELL", FIRST_ROW)
                whole = spark.read.schema(kind).parquet(store).join(wanted, ["WELL", FIRST_ROW], "left_semi").drop(FIRST_ROW)
                write(score(feature_table(clean_curves(whole), keep=["DEPT", *INPUT_CURVES])), out, ["WELL"])
            if rejects:
                bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
                double = current_pieces(ledger()).filter("taken")
                double.select(F.col("FILE").alias("file"), F.lit(TAKEN).alias("error")).write.mode("overwrite").parquet(f"{rejects}/batch=-1")

    return (lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
