"""A well-log table over the TPC-H-like `lineitem`: well = supplier, position = shipping order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from depthlog.operators.features import clean_curves
from depthlog.operators.series import by_depth, rank_rows
from depthlog.schema import CODES

MODELS = {"a": "pred_a", "b": "pred_b", "c": "pred_c"}
RAW = {"GR": "gr_raw", "RDEP": "rdep_raw", "RMED": "rmed_raw", "DTC": "dtc_raw", "RHOB": "rhob_raw"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_PREPARED: dict[tuple, DataFrame] = {}


def prepared(spark: SparkSession, sf_dir: str, kind: str, make) -> DataFrame:
    """Tables every query starts from are sorted and written once per session, then reused."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _PREPARED or not still_there(spark, _PREPARED[at]):
        _PREPARED[at] = make()
    return _PREPARED[at]


def still_there(spark: SparkSession, df: DataFrame) -> bool:
    try:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    items = (read(spark, sf_dir, "lineitem")
             .select(F.col("l_suppkey").cast("int").alias("well"), *order, "l_quantity", "l_discount", "l_tax"))
    return rank_rows(items, "well", order, "pos", items.count()).withColumn("pos", F.col("pos") + 1)


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well, pos, dept, five raw curves, true_code, three predictions, one confidence."""
    placed = prepared(spark, sf_dir, "items", lambda: numbered_items(spark, sf_dir))
    code = F.array(*[F.lit(c) for c in sorted(CODES)])

    def lith(index):
        return F.element_at(code, (index % 12 + 1).cast("int"))

    ti = (F.floor(F.col("pos") / 20) + F.col("well")) % 12
    moved = (F.floor((F.col("pos") + 3) / 20) + F.col("well")) % 12
    return placed.select(
        "well", F.col("pos").cast("int").alias("pos"),
        F.expr("CAST(1000.0 + pos * 0.152 + CASE WHEN pos > 300 THEN 50.0 ELSE 0.0 END AS DOUBLE)").alias("dept"),
        (F.col("l_quantity") - 3.0).alias("gr_raw"),
        (F.col("l_extendedprice") / 1000.0).alias("rdep_raw"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("rmed_raw"),
        (F.col("l_tax") * 1000.0).alias("dtc_raw"),
        F.when(F.floor(F.col("pos") / 25) % 4 == 0, None)
         .otherwise(2.0 + F.col("l_discount") * 7.0).alias("rhob_raw"),
        F.when(F.col("pos") <= 40, None).otherwise(lith(ti)).alias("true_code"),
        F.when(F.col("l_partkey") % 5 == 0, lith(ti + 1)).otherwise(lith(ti)).alias("pred_a"),
        F.when(F.col("l_partkey") % 7 == 0, lith(ti + 5)).otherwise(lith(ti)).alias("pred_b"),
        lith(moved).alias("pred_c"),
        (0.05 + F.col("l_discount") * 9.0).alias("conf_a"))


def clean_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`wells` plus the clean curves GR, RDEP, RMED, DTC, RHOB."""
    return clean_curves(wells(spark, sf_dir), RAW)


def wells_by_depth(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`columns` of the well table, numbered from 0 by depth within the well as `at`."""
    df = prepared(spark, sf_dir, "depth", lambda: by_depth(wells(spark, sf_dir), "well", "dept", "pos", "at"))
    return df.select(*dict.fromkeys(["well", "pos", "dept", "at", *columns]))


def split_of(well):
    return (F.when(well % 10 == 0, "BLIND_TEST").when(well % 10 == 1, "PUBLIC").otherwise("TRAIN"))


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: well, split."""
    well = F.col("s_suppkey").cast("int")
    return read(spark, sf_dir, "supplier").select(well.alias("well"), split_of(well).alias("split"))


# --- the same tables for the SQL check -------------------------------------------------------

WELLS_CTES = """
cls(idx, code) AS (VALUES (0,30000),(1,65000),(2,65030),(3,70000),(4,70032),(5,74000),
                          (6,80000),(7,86000),(8,88000),(9,90000),(10,93000),(11,99000)),
o AS (
  SELECT CAST(l_suppkey AS INT) AS well, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
         CAST(row_number() OVER (PARTITION BY l_suppkey
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS pos
  FROM lineitem),
k AS (SELECT o.*, CAST((floor(pos / 20.0) + well) AS INT) % 12 AS ti FROM o),
wells AS (
  SELECT k.well, k.pos,
         CAST(1000.0 + k.pos * 0.152 + CASE WHEN k.pos > 300 THEN 50.0 ELSE 0.0 END AS DOUBLE) AS dept,
         k.l_quantity - 3.0               AS gr_raw,
         k.l_extendedprice / 1000.0       AS rdep_raw,
         k.l_extendedprice * k.l_discount AS rmed_raw,
         k.l_tax * 1000.0                 AS dtc_raw,
         CASE WHEN CAST(floor(k.pos / 25.0) AS INT) % 4 = 0 THEN NULL
              ELSE 2.0 + k.l_discount * 7.0 END AS rhob_raw,
         CASE WHEN k.pos <= 40 THEN NULL ELSE t.code END AS true_code,
         CASE WHEN k.l_partkey % 5 = 0 THEN a.code ELSE t.code END AS pred_a,
         CASE WHEN k.l_partkey % 7 = 0 THEN b.code ELSE t.code END AS pred_b,
         c.code AS pred_c,
         0.05 + k.l_discount * 9.0 AS conf_a
  FROM k JOIN cls t ON t.idx = k.ti
         JOIN cls a ON a.idx = (k.ti + 1) % 12
         JOIN cls b ON b.idx = (k.ti + 5) % 12
         JOIN cls c ON c.idx = CAST((floor((k.pos + 3) / 20.0) + k.well) AS INT) % 12),
curves AS (
  SELECT *, CASE WHEN gr_raw < 0 THEN NULL ELSE gr_raw END AS GR,
         CASE WHEN rdep_raw <= 0 THEN NULL ELSE rdep_raw END AS RDEP,
         CASE WHEN rmed_raw <= 0 THEN NULL ELSE rmed_raw END AS RMED,
         CASE WHEN dtc_raw <= 0 THEN NULL ELSE dtc_raw END AS DTC,
         CASE WHEN rhob_raw <= 0 THEN NULL ELSE rhob_raw END AS RHOB
  FROM wells),
base AS (
  SELECT *, log10(RDEP) AS RDEP_LOG10, log10(RMED) AS RMED_LOG10 FROM curves),
samples AS (
  SELECT well, pos, dept, 'a' AS model, true_code, pred_a AS pred_code FROM wells
  UNION ALL SELECT well, pos, dept, 'b', true_code, pred_b FROM wells
  UNION ALL SELECT well, pos, dept, 'c', true_code, pred_c FROM wells),
sources AS (
  SELECT well, pos, dept, model AS source, pred_code AS code FROM samples
  UNION ALL SELECT well, pos, dept, 'Original', true_code FROM wells),
logs AS (
  SELECT well, pos, dept, true_code, 'GR' AS curve, GR AS value FROM curves
  UNION ALL SELECT well, pos, dept, true_code, 'RDEP', RDEP FROM curves
  UNION ALL SELECT well, pos, dept, true_code, 'RMED', RMED FROM curves
  UNION ALL SELECT well, pos, dept, true_code, 'DTC', DTC FROM curves
  UNION ALL SELECT well, pos, dept, true_code, 'RHOB', RHOB FROM curves),
raw_logs AS (
  SELECT well, pos, dept, 'GR' AS curve, gr_raw AS value FROM wells
  UNION ALL SELECT well, pos, dept, 'RDEP', rdep_raw FROM wells
  UNION ALL SELECT well, pos, dept, 'RMED', rmed_raw FROM wells
  UNION ALL SELECT well, pos, dept, 'DTC', dtc_raw FROM wells
  UNION ALL SELECT well, pos, dept, 'RHOB', rhob_raw FROM wells),
lith(code, name, display_order) AS (VALUES (30000,'Sandstone',0),(65000,'Shale',2),(65030,'Sandstone/Shale',1),
  (70000,'Limestone',4),(70032,'Chalk',5),(74000,'Dolomite',6),(80000,'Marl',3),(86000,'Anhydrite',7),
  (88000,'Halite',8),(90000,'Coal',9),(93000,'Basement',10),(99000,'Tuff',11)),
manifest AS (
  SELECT CAST(s_suppkey AS INT) AS well,
         CASE WHEN s_suppkey % 10 = 0 THEN 'BLIND_TEST' WHEN s_suppkey % 10 = 1 THEN 'PUBLIC' ELSE 'TRAIN' END AS split
  FROM supplier)
"""


def on_wells(select: str) -> str:
    """Check SQL over the well tables; further CTEs may come first as ", name AS (...) SELECT"."""
    select = select.strip()
    return f"WITH {WELLS_CTES}{select if select.startswith(',') else chr(10) + select}"
