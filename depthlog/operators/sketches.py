"""Approximate quantiles that can be stored and merged: one small sketch for each key and curve.

A sketch's size does not depend on its rows, it is made in every task before anything is shuffled, and sketches of
different runs, files or wells add up. Ranks are right to `rank_error(k)` of the rows (with 99 % confidence); the exact
way is quality.describe_curves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from depthlog.operators.quantiles import long_form
from depthlog.operators.series import as_list

K = 400


def rank_error(k: int = K) -> float:
    """Published error of the sketch: share of the rows by which a rank may be off."""
    return 2.296 / k ** 0.9021


def sketches(df: DataFrame, key, columns: Sequence[str], k: int = K) -> DataFrame:
    """key, curve, n, low, high, sketch of the known values; NaN and NULL are left out."""
    rows = long_form(df, as_list(key), columns).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(*as_list(key), "curve").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, key=(), k: int = K) -> DataFrame:
    """Sketches of a coarser key, or of several runs, from those of their parts."""
    return parts.groupBy(*as_list(key), "curve").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def keep(parts: DataFrame, path: str, run: str) -> None:
    """Store the sketches of a run; the same run again replaces its own."""
    (parts.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def kept(spark: SparkSession, path: str) -> DataFrame:
    """Sketches of all runs: what they were stored with, and the run."""
    return spark.read.parquet(path)


def sketch_quantiles(parts: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """A column for each wanted quantile in place of the sketch; 0 and 1 are the exact ends."""
    def at(q):
        if q <= 0 or q >= 1:
            return F.col("low" if q <= 0 else "high")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
    return parts.withColumns({n: at(q) for n, q in wanted.items()}).drop("sketch")
