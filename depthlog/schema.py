"""Fixed vocabulary of the well-log data model: curves, classes, penalties, feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "WELL"
ROW = "SOURCE_ROW"
DEPTH = "DEPT"
TRUE = "TRUE_CODE"

# --- fixed values: curve names, label names, sentinels -------------------------------------
INPUT_CURVES = ("GR", "RDEP", "RMED", "DTC", "RHOB")
LOG_CURVES = ("RDEP", "RMED")
BASE_FEATURES = ("GR", "RDEP_LOG10", "RMED_LOG10", "DTC", "RHOB")
LABEL_CURVE = "FORCE_2020_LITHOFACIES_LITHOLOGY"
LABEL_CANDIDATES = (LABEL_CURVE, "TRUE_LITHOLOGY", "LITHOLOGY", "LITHOFACIES", "FACIES", "LABEL")
EMPTY_LABEL_TEXT = ("", "NONE", "NAN", "NULL", "NA", "N/A", "-999", "-999.25", "-9999")
LAS_NULL = -999.25
SENTINELS = (-999.0, -999.25, -9999.0)
LOCATION_CURVES = ("X_LOC", "Y_LOC", "Z_LOC")

# --- fixed values: lithology code, name, display position ----------------------------------
LITHOLOGY = (
    (30000, "Sandstone", 0),
    (65000, "Shale", 2),
    (65030, "Sandstone/Shale", 1),
    (70000, "Limestone", 4),
    (70032, "Chalk", 5),
    (74000, "Dolomite", 6),
    (80000, "Marl", 3),
    (86000, "Anhydrite", 7),
    (88000, "Halite", 8),
    (90000, "Coal", 9),
    (93000, "Basement", 10),
    (99000, "Tuff", 11),
)
CODES = tuple(code for code, _, _ in LITHOLOGY)

# --- fixed values: splits ------------------------------------------------------------------
SPLITS = ("TRAIN", "PUBLIC", "BLIND_TEST")

# --- fixed values: sampling and windows ----------------------------------------------------
STEP = 0.152
STEP_ATOL = 1e-6
STEP_RTOL = 1e-5
WINDOWS = (5, 9, 21)
FINE_WINDOWS = (3, 7, 15)
MIN_VALID = 3

# --- fixed values: misclassification penalties, true class by row, predicted by column -----
PENALTY_ORDER = (30000, 65030, 65000, 80000, 74000, 70000, 70032, 88000, 86000, 99000, 90000, 93000)
PENALTY_COARSE = """
0    2    3    3.5  2.5  3.5  3    3    3    3    3    3
2    0    2    3.5  2.5  3.5  3    3    3    3    3    3
3    2    0    3.5  2.5  3.5  3    3    3    3    3    3
3.5  3.5  3.5  0    3    2    2.5  3    3    3    3    3
2.5  2.5  2.5  3    0    3    2.5  3    3    3    3    3
3.5  3.5  3.5  2    3    0    2    3    3    3    3    3
3    3    3    2.5  2.5  2    0    3    3    3    3    3
3    3    3    3    3    3    3    0    2    3    3    3
3    3    3    3    3    3    3    3    0    3    3    3
3    3    3    3    3    3    3    3    3    0    3    3
3    3    3    3    3    3    3    3    3    3    0    3
3    3    3    3    3    3    3    3    3    3    3    0
"""
# The halite cell on the diagonal of this second table is 4, as published: keep it.
PENALTY_FINE = """
0      2      3.5    3      3.75   3.5    3.5    4      4      2.5    3.875  3.25
2      0      2.375  2.75   4      3.75   3.75   3.875  4      3      3.75   3
3.5    2.375  0      2      3.5    3.5    3.75   4      3.25   2.75   3.25   3
3      2.75   2      0      2.5    2      2.25   4      4      3.375  3.75   3.25
3.75   4      3.5    2.5    0      2.625  2.875  3.75   3      3      4      3.625
3.5    3.75   3.5    2      2.625  0      1.375  4      3.75   3.5    4      3.625
3.5    3.75   3.75   2.25   2.875  1.375  0      4      3.75   3.125  4      3.75
4      3.875  4      4      3.75   4      4      4      2.75   3.75   3.75   4
4      4      4      4      3.25   3.75   3.75   2.75   0      4      4      3.875
2.5    3      2.75   3.375  3      3.5    3.125  3.75   4      0      2.5    3.25
3.875  3.75   3.25   3.75   4      4      4      3.75   4      2.5    0      4
3.25   3      3      3.25   3.625  3.625  3.75   4      3.875  3.25   4      0
"""


def penalty_rows(table: str = PENALTY_COARSE) -> list[tuple[int, int, float]]:
    """(true code, predicted code, penalty) for all 144 cells."""
    grid = [[float(x) for x in line.split()] for line in table.strip().splitlines()]
    return [(t, p, grid[i][j])
            for i, t in enumerate(PENALTY_ORDER) for j, p in enumerate(PENALTY_ORDER)]


def penalty_table(spark: SparkSession, table: str = PENALTY_COARSE) -> DataFrame:
    return spark.createDataFrame(penalty_rows(table), "true_code INT, pred_code INT, penalty DOUBLE")


def lithology_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LITHOLOGY), "code INT, name STRING, display_order INT")


def rolling_names(windows=WINDOWS, columns=BASE_FEATURES) -> list[str]:
    return [f"{c}_ROLL{s}_{w}" for c in columns for w in windows for s in ("MEAN", "STD")]


def feature_names() -> list[str]:
    """The 41 model inputs in contract order."""
    return [*BASE_FEATURES, *rolling_names(), "RESISTIVITY_SEPARATION",
            *(f"{c}_MISSING" for c in BASE_FEATURES)]
