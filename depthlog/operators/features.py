"""Cleaning and feature construction: base curves, flags, rolling statistics, gradients."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from depthlog.functions import columns as C
from depthlog.operators.series import BLOCK_ROWS, as_list, attach, over_frame, renumber
from depthlog.schema import (BASE_FEATURES, FINE_WINDOWS, INPUT_CURVES, KEY, LABEL_CANDIDATES, MIN_VALID, ROW, STEP,
                             STEP_ATOL, STEP_RTOL, TRUE,
                             WINDOWS, feature_names, rolling_names)


# --- schema ---------------------------------------------------------------------------------

def normalise_columns(df: DataFrame) -> DataFrame:
    """Strip and upper-case column names; names that then collide are an error."""
    names = [c.strip().upper() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after upper-casing: {', '.join(twice)}")
    return df.toDF(*names)


def detect_label_column(columns: Sequence[str]) -> str | None:
    """Original spelling of the best label candidate, or None."""
    spelling = {c.strip().upper(): c for c in columns}
    return next((spelling[c] for c in LABEL_CANDIDATES if c in spelling), None)


def missing_curves(columns: Sequence[str], required: Sequence[str] = INPUT_CURVES) -> list[str]:
    present = {c.strip().upper() for c in columns}
    return [c for c in required if c not in present]


def add_absent_curves(df: DataFrame, curves: Sequence[str] = INPUT_CURVES) -> DataFrame:
    """All curves as DOUBLE; absent ones NULL, text that is no number NULL."""
    return df.withColumns({c: C.number(F.col(c)) if c in df.columns else F.lit(None).cast("double")
                           for c in curves})


def choose_depth(df: DataFrame, key=KEY, order: str = ROW, out: str = "DEPT") -> DataFrame:
    """DEPT, else DEPTH, else NULL, as DOUBLE."""
    source = next((c for c in ("DEPT", "DEPTH") if c in df.columns), None)
    return df.withColumn(out, C.number(F.col(source)) if source else F.lit(None).cast("double"))


def depth_or_row(df: DataFrame, key=KEY, depth: str = "DEPT", order: str = ROW) -> DataFrame:
    """Row position as depth for keys that have no depth at all."""
    known = df.groupBy(*as_list(key)).agg(F.count(depth).alias("__depths"), F.max(order).alias("__last"))
    return (attach(df, known, key, spread=order, last="__last")
            .withColumn(depth, F.when(F.col("__depths") == 0, F.col(order).cast("double"))
                        .otherwise(F.col(depth))).drop("__depths"))


def check_features(columns: Sequence[str], expected: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Raise when the feature contract is broken; report missing and unexpected names."""
    expected = list(expected or feature_names())
    report = {"missing": [c for c in expected if c not in columns],
              "unexpected": [c for c in columns if c not in expected]}
    if len(set(expected)) != len(expected):
        raise ValueError("feature names are not unique")
    if report["missing"] or report["unexpected"]:
        raise ValueError(f"feature schema mismatch: {report}")
    return report


# --- cleaning -------------------------------------------------------------------------------

def clean_curves(df: DataFrame, curves: dict[str, str] | None = None) -> DataFrame:
    """Finite, physically possible curves; `curves` maps the clean name to the raw column."""
    curves = curves or {c: c for c in INPUT_CURVES}
    return df.withColumns({c: C.physical(c, C.number(F.col(raw))) for c, raw in curves.items()})


def base_features(df: DataFrame) -> DataFrame:
    """The five model bases from clean curves: resistivities as log10."""
    return df.withColumns({"RDEP_LOG10": C.log10_positive(F.col("RDEP")),
                           "RMED_LOG10": C.log10_positive(F.col("RMED"))})


def missing_flags(df: DataFrame, columns: Sequence[str] = BASE_FEATURES) -> DataFrame:
    return df.withColumns({f"{c}_MISSING": F.col(c).isNull().cast("int") for c in columns})


def restore_missing(df: DataFrame, columns: Sequence[str] = BASE_FEATURES) -> DataFrame:
    """Undo an imputation: flagged values become NULL again."""
    return df.withColumns({c: F.when(F.col(f"{c}_MISSING") == 0, F.col(c)) for c in columns})


def drop_empty(df: DataFrame, columns: Sequence[str] = BASE_FEATURES) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


# --- rolling --------------------------------------------------------------------------------

def rolling(df: DataFrame, columns: Sequence[str] = BASE_FEATURES, windows: Sequence[int] = WINDOWS,
            key=KEY, order: str = ROW, min_valid: int = MIN_VALID,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred rolling mean and sample deviation, NULL below `min_valid` values."""
    reach = max(windows) // 2
    names = rolling_names(windows, columns)

    def rolled(rows):
        schema = StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in names]])
        return rows.mapInArrow(_roller(list(columns), list(windows), min_valid), schema)

    framed = over_frame(df, key, order, reach, reach, lambda w: {"__nth": F.row_number().over(w)}, block_rows, then=rolled)
    return framed.select(*df.columns, *names)


def _roller(columns: Sequence[str], windows: Sequence[int], min_valid: int):
    """A function of Arrow batches that adds the rolling columns to sorted rows; `__nth` is 1 where a series begins.

    The rows a batch still needs from the next one wait for it. Each step adds one place of the frame for all rows of the
    batch; the deviation is built up as Spark's own is, so near-constant values lose no digits. The functions are nested
    so that they travel to the tasks with what they use."""
    def moments(x, known, series, lowest, highest):
        """Count, mean and sample deviation of the known values from `lowest` to `highest` places away in the same series."""
        size = len(x)
        n, total, mean, m2 = (np.zeros(size) for _ in range(4))
        with np.errstate(invalid="ignore", over="ignore"):
            for d in range(lowest, highest + 1):
                here, there = slice(max(0, -d), max(0, size - max(0, d))), slice(max(0, d), max(0, size + min(0, d)))
                used = known[there] & (series[here] == series[there])
                v = x[there]
                n[here] += used
                total[here] += np.where(used, v, 0.0)
                delta = np.where(used, v - mean[here], 0.0)
                part = delta / np.maximum(n[here], 1.0)
                mean[here] += part
                m2[here] += delta * (delta - part)
            return n, total / np.maximum(n, 1.0), np.sqrt(m2 / np.maximum(n - 1.0, 1.0))

    def rolled(batches):
        back, ahead = max(windows) // 2, (max(windows) - 1) // 2
        held, given = None, 0
        for batch in chain(batches, [None]):
            parts = [t for t in (held, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            if not parts:
                return
            table = pa.concat_tables(parts).combine_chunks()
            upto = max(given, table.num_rows - (0 if batch is None else ahead))
            first, last = max(0, given - back), min(table.num_rows, upto + ahead)
            part = table.slice(first, last - first)
            series = np.cumsum(part["__nth"].to_numpy() == 1)
            own = slice(given - first, upto - first)
            rows = table.slice(given, upto - given)
            for c in columns:
                known = part[c].is_valid().to_numpy()
                x = pc.fill_null(part[c].cast(pa.float64()), 0.0).to_numpy()
                for width in windows:
                    n, mean, std = moments(x, known, series, -(width // 2), (width - 1) // 2)
                    for name, values, least in (("MEAN", mean, 1), ("STD", std, 2)):
                        cells = pa.array(values[own], pa.float64(), mask=n[own] < max(min_valid, least))
                        rows = rows.append_column(f"{c}_ROLL{name}_{width}", cells)
            yield from rows.to_batches()
            held = table.slice(max(0, upto - back))
            given = upto - max(0, upto - back)
    return rolled


def feature_table(df: DataFrame, key=KEY, order: str = ROW, keep: Sequence[str] = (),
                  scope: str = "all", label: str = TRUE, windows: Sequence[int] = WINDOWS,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The 41 model inputs from clean curves.

    Flags come before rolling, and rolling before empty rows are dropped. scope="labelled"
    rolls over labelled, non-empty rows only, as in training; "all" over every row, as in
    scoring.
    """
    keys = as_list(key)
    base = missing_flags(base_features(df))
    if scope == "labelled":
        base = renumber(drop_empty(base.filter(F.col(label).isNotNull())), key, order, "__at", block_rows)
    elif scope != "all":
        raise ValueError("scope is 'all' or 'labelled'")
    at = "__at" if scope == "labelled" else order
    flags = [f"{c}_MISSING" for c in BASE_FEATURES]
    needed = list(dict.fromkeys([*keys, order, at, *keep, *BASE_FEATURES, *flags]))
    rolled = rolling(base.select(*needed), windows=windows, key=key, order=at, block_rows=block_rows)
    full = drop_empty(rolled.withColumn("RESISTIVITY_SEPARATION", F.col("RDEP_LOG10") - F.col("RMED_LOG10")))
    names = feature_names() if tuple(windows) == WINDOWS else [
        c for c in full.columns if c not in {*keys, order, at, *keep}]
    others = [k for k in keep if k not in {*keys, order, *names}]
    return full.select(*keys, order, *others, *names)


# --- gradients ------------------------------------------------------------------------------

def neighbour_gradient(df: DataFrame, columns: Sequence[str] = BASE_FEATURES, key=KEY, order: str = ROW,
                       spacing: float = STEP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Previous and next sample and the centred gradient at a fixed spacing."""
    def build(w):
        out = {}
        for c in columns:
            before, after = F.lag(c).over(w), F.lead(c).over(w)
            out[f"{c}_PREV"], out[f"{c}_NEXT"] = before, after
            out[f"{c}_GRADIENT"] = (after - before) / F.lit(2 * spacing)
        return out
    return over_frame(df, key, order, 1, 1, build, block_rows)


def forward_gradient(df: DataFrame, columns: Sequence[str] = BASE_FEATURES, key=KEY, order: str = ROW,
                     depth: str = "DEPT", regular_only: bool = False, step: float = STEP,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Change to the next sample per metre, where both samples are known and depth increases.

    With `regular_only`, a gradient across an abnormal step is NULL. The step tested is the
    one the gradient spans.
    """
    def build(w):
        dz = F.lead(depth).over(w) - F.col(depth)
        usable = dz > 0
        if regular_only:
            usable = usable & (F.abs(dz - step) <= STEP_ATOL + STEP_RTOL * abs(step))
        return {f"{c}_GRAD": F.when(usable, F.try_divide(F.lead(c).over(w) - F.col(c), dz))
                for c in columns}
    return over_frame(df, key, order, 0, 1, build, block_rows)


# --- named feature lists --------------------------------------------------------------------

def feature_sets() -> dict[str, list[str]]:
    """Named inputs for ablation runs, by number of features."""
    base, flags = list(BASE_FEATURES), [f"{c}_MISSING" for c in BASE_FEATURES]
    prev_next = [f"{c}_{s}" for c in BASE_FEATURES for s in ("PREV", "NEXT", "GRADIENT")]
    grad = [f"{c}_GRAD" for c in BASE_FEATURES]
    fine = rolling_names(FINE_WINDOWS)
    full = feature_names()
    return {
        "base_5": base,
        "base_separation_6": base + ["RESISTIVITY_SEPARATION"],
        "base_flags_10": base + flags,
        "rolling_35": base + rolling_names(),
        "full_41": full,
        "rolling_mean_20": base + [n for n in rolling_names() if "MEAN" in n],
        "gradient_46": full + grad,
        "neighbour_56": full + prev_next,
        "fine_rolling_76": full + grad + fine,
    }
