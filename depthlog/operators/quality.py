"""Inventory and data-quality tables over many wells at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from depthlog.functions import columns as C
from depthlog.operators.quantiles import curve_quantiles, long_form, positions_of_counts, quantiles
from depthlog.operators.series import BLOCK_ROWS, as_list, attach, over_frame, renumber, runs, runs_of, with_previous
from depthlog.operators.staging import stage
from depthlog.schema import INPUT_CURVES, KEY, ROW, STEP, STEP_ATOL, TRUE

MEDIAN_POINTS, MEDIAN_ROWS = 512, 1 << 17  # parts of the sorted values of so many rows, which bracket a median


def curve_names(df: DataFrame, curves: Sequence[str] = INPUT_CURVES, key=KEY) -> DataFrame:
    """Names of the curves with at least one value, in one text per key."""
    keys = as_list(key)
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"__{c}") for c in curves])
    present = F.array_compact(F.array(*[F.when(F.col(f"__{c}") > 0, F.lit(c)) for c in sorted(curves)]))
    return counts.select(*keys, F.concat_ws(", ", present).alias("curves"), F.size(present).cast("long").alias("n_curves"))


def infinity_counts(long: DataFrame) -> DataFrame:
    infinite = F.abs(F.col("value")) == float("inf")
    return long.groupBy("curve").agg(F.count_if(infinite).alias("infinite"),
                                     F.count_if(~infinite & ~F.isnan("value")).alias("finite_values"))


def crop_to_labels(df: DataFrame, key=KEY, depth: str = "DEPT", label: str = TRUE, order: str = ROW,
                   top: float | None = None, base: float | None = None, on_empty: str = "drop") -> DataFrame:
    """Samples inside the labelled depth range of their key and inside [top, base].

    A key whose two ranges do not meet is left out, or fails the job with on_empty="error".
    """
    keys = as_list(key)
    labelled = F.when(F.col(label).isNotNull(), F.col(depth))
    ranges = df.groupBy(*keys).agg(F.min(labelled).alias("__top"), F.max(labelled).alias("__base"),
                                    F.max(order).alias("__last"))
    lo = F.greatest("__top", F.lit(top if top is not None else float("-inf")))
    hi = F.least("__base", F.lit(base if base is not None else float("inf")))
    ranges = ranges.filter(F.col("__top").isNotNull())
    if on_empty == "error":
        apart = F.raise_error(F.concat(F.lit("no labelled depth in the interval: "), F.to_json(F.struct(*keys)))).cast("boolean")
        ranges = ranges.filter(F.when(lo <= hi, True).otherwise(apart))
    return (attach(df, ranges, keys, spread=order, last="__last")
            .filter(F.col(depth).between(lo, hi)).drop("__top", "__base"))


# --- steps ----------------------------------------------------------------------------------

def steps(df: DataFrame, key=KEY, order: str = ROW, depth: str = "DEPT", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Depth and `step` from the preceding sample (NULL on the first)."""
    keys = as_list(key)
    return with_previous(df.select(*keys, order, depth), keys, order, {"__prev": F.col(depth)}, block_rows).withColumn(
        "step", F.col(depth) - F.col("__prev")).drop("__prev")


def well_inventory(df: DataFrame, curves: Sequence[str] = INPUT_CURVES, key=KEY, order: str = ROW,
                   depth: str = "DEPT", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows, depth range, median and mean step, number and names of curves per key."""
    keys = as_list(key)
    moves = steps(df, keys, order, depth, block_rows)
    basic = moves.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(depth).alias("depth_min"),
                                     F.max(depth).alias("depth_max"), F.avg("step").alias("mean_step"))
    return (basic.join(quantiles(moves, keys, F.col("step"), {"median_step": 0.5}), keys, "left")
            .join(curve_names(df, curves, keys), keys))


def curve_availability(df: DataFrame, curves: Sequence[str] = INPUT_CURVES, key=KEY) -> DataFrame:
    """1 where a key has values of a curve, else 0; one column per curve."""
    keys = as_list(key)
    return df.groupBy(*keys).agg(*[(F.count(c) > 0).cast("int").alias(c) for c in curves])


def availability_summary(matrix: DataFrame, curves: Sequence[str] = INPUT_CURVES) -> DataFrame:
    totals = matrix.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in curves])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("curve"), F.col(c).alias("wells"), (100.0 * F.col(c) / F.col("__n")).alias("pct"))
        for c in curves])))


def sampling_audit(df: DataFrame, key=KEY, order: str = ROW, depth: str = "DEPT", step: float = STEP,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smallest, largest and median step and the number of non-standard steps per key."""
    keys = as_list(key)
    moves = steps(df, keys, order, depth, block_rows)
    odd = F.abs(F.col("step") - step) > STEP_ATOL
    return moves.groupBy(*keys).agg(F.min("step").alias("min_step"), F.max("step").alias("max_step"),
                                    F.count_if(odd).alias("odd_steps")).join(
        quantiles(moves, keys, F.col("step"), {"median_step": 0.5}), keys, "left")


def gap_classes(df: DataFrame, key=KEY, order: str = ROW, depth: str = "DEPT", step: float = STEP,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Non-increasing steps, steps by size class, and whether depth only increases, per key."""
    keys = as_list(key)
    s = F.col("step")
    over = {f"over_{name}": F.count_if(s > limit) for name, limit in
            (("1_step", step + STEP_ATOL), ("2_steps", 2 * step + STEP_ATOL), ("1m", 1.0), ("10m", 10.0), ("100m", 100.0))}
    return steps(df, keys, order, depth, block_rows).groupBy(*keys).agg(
        F.count(s).alias("steps"), F.count_if(s <= 0).alias("not_increasing"), (F.count_if(s <= 0) == 0).alias("monotonic"),
        *[c.alias(n) for n, c in over.items()])


def order_checks(df: DataFrame, key=KEY, order: str = ROW, depth: str = "DEPT", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Is the position contiguous, and is depth in position order, per key."""
    keys = as_list(key)
    return steps(df, keys, order, depth, block_rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(order).alias("first_row"), F.max(order).alias("last_row"),
        (F.max(order) - F.min(order) + 1 == F.count(F.lit(1))).cast("int").alias("contiguous"),
        F.count_if(F.col("step") < 0).alias("out_of_order"))


# --- labels ---------------------------------------------------------------------------------

def label_coverage(df: DataFrame, label: str = TRUE, key=KEY) -> DataFrame:
    keys = as_list(key)
    n, have = F.count(F.lit(1)), F.count(label)
    return df.groupBy(*keys).agg(n.alias("total"), have.alias("labelled"), (n - have).alias("missing"),
                                 (100.0 * have / n).alias("pct_labelled"))


def spread_over(table: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, median, mean and maximum of a column of a per-key table."""
    basic = table.groupBy(*by).agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"))
    middle = quantiles(table, list(by), F.col(column), {"median": 0.5})
    return basic.join(middle, list(by)) if by else basic.withColumn("median", middle.select("median").scalar())


def label_summary(df: DataFrame, label: str = TRUE, key=KEY, order: str = ROW, depth: str = "DEPT",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Labelled interval, median step inside it, distinct classes and share labelled per key."""
    keys = as_list(key)
    labelled = renumber(df.filter(F.col(label).isNotNull() & F.col(depth).isNotNull()).select(*keys, order, depth),
                        keys, order, "__at", block_rows)
    middle = quantiles(steps(labelled, keys, "__at", depth, block_rows), keys, F.col("step"), {"median_step": 0.5})
    at = F.when(F.col(label).isNotNull(), F.col(depth))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count(label).alias("labelled"), F.min(at).alias("top"), F.max(at).alias("base"),
        F.countDistinct(label).alias("classes"), (100.0 * F.count(label) / F.count(F.lit(1))).alias("pct_labelled"),
    ).join(middle, keys, "left")


def label_status(df: DataFrame, label: str = TRUE, key=KEY, depth: str = "DEPT") -> DataFrame:
    """no_column / no_valid_labels / partial / full, with counts and the labelled depth range."""
    keys = as_list(key)
    has = label in df.columns
    flag = F.col(label).isNotNull() if has else F.lit(False)
    status = (F.when(~F.lit(has), "no_column").when(F.col("labelled") == 0, "no_valid_labels")
              .when(F.col("labelled") < F.col("samples"), "partial").otherwise("full"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(flag).alias("labelled"),
        F.min(F.when(flag, F.col(depth))).alias("depth_min"), F.max(F.when(flag, F.col(depth))).alias("depth_max"),
    ).withColumns({"status": status, "fraction": F.col("labelled") / F.col("samples")})


def label_diagnostics(df: DataFrame, label: str, key=KEY) -> DataFrame:
    """Empty, recognised and unrecognised label texts per key."""
    text = F.col(label)
    known, empty = C.decode_label(text).isNotNull(), C.is_empty_label(text)
    return df.groupBy(*as_list(key)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty"), F.count_if(known).alias("recognised"),
        F.count_if(~empty & ~known).alias("unrecognised"))


def unknown_labels(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """The k commonest unrecognised texts; ties alphabetically."""
    text = F.col(label)
    return (df.filter(~C.is_empty_label(text) & C.decode_label(text).isNull())
            .groupBy(F.trim(text).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "label").limit(k))


def lithology_distribution(df: DataFrame, label: str = TRUE, key=KEY) -> DataFrame:
    """Samples, share of all labelled samples, wells and share of all wells per class."""
    keys = as_list(key)
    cells = df.groupBy(*keys, F.col(label).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    wells = cells.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    per_class = (cells.filter(F.col("code").isNotNull()).groupBy("code")
                 .agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("wells")))
    whole = Window.partitionBy(F.lit(0))
    return per_class.withColumns({
        "name": C.code_to_name(F.col("code")), "pct_samples": 100.0 * F.col("samples") / F.sum("samples").over(whole),
        "pct_wells": 100.0 * F.col("wells") / wells})


def class_presence(df: DataFrame, classes: Sequence[int], label: str = TRUE, key=KEY) -> DataFrame:
    """1 where a key contains a class; one column per class."""
    return df.groupBy(*as_list(key)).agg(*[
        F.max(F.coalesce((F.col(label) == c).cast("int"), F.lit(0))).alias(f"has_{c}") for c in classes])


def class_by_split(df: DataFrame, splits: Sequence[str], label: str = TRUE, split: str = "split", key=KEY) -> DataFrame:
    """Samples, share within the class, and wells per class and split; zero where absent."""
    keys = as_list(key)
    cells = (df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("code"), split, *keys)
             .agg(F.count(F.lit(1)).alias("n")))
    per = cells.groupBy("code", split).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("wells"))
    table = per.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct(split, F.struct("n", "wells")))).alias("m"))
    zero = F.lit(0).cast("long")
    filled = (table.withColumn(split, F.explode(F.array(*[F.lit(s) for s in splits])))
              .withColumn("cell", F.try_element_at("m", F.col(split)))
              .select("code", split, F.coalesce("cell.n", zero).alias("samples"), F.coalesce("cell.wells", zero).alias("wells")))
    return filled.withColumn("pct", 100.0 * F.try_divide(F.col("samples").cast("double"),
                                                       F.sum("samples").over(Window.partitionBy("code"))))


# --- curves ---------------------------------------------------------------------------------

def missingness(df: DataFrame, curves: Sequence[str] = INPUT_CURVES, key=KEY) -> DataFrame:
    """Missing samples per key and curve; an absent curve is 100 % missing."""
    keys = as_list(key)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[
        (F.count(c) if c in df.columns else F.sum(F.lit(0))).cast("long").alias(f"__{c}") for c in curves])
    cells = F.array(*[F.struct(F.lit(c).alias("curve"), (F.col("total") - F.col(f"__{c}")).alias("missing")) for c in curves])
    return (counts.select(*keys, "total", F.inline(cells))
            .withColumn("pct_missing", 100.0 * F.col("missing") / F.col("total")))


def missingness_summary(table: DataFrame, limit: float = 50.0) -> DataFrame:
    pooled = table.groupBy("curve").agg((100.0 * F.sum("missing") / F.sum("total")).alias("pooled"),
                                        F.count_if(F.col("pct_missing") > limit).alias("wells_over_limit"))
    return spread_over(table, "pct_missing", ["curve"]).join(pooled, "curve")


def range_summary(df: DataFrame, curves: Sequence[str], key=KEY) -> DataFrame:
    """Smallest minimum, largest maximum and median of the per-key medians of each curve."""
    keys = as_list(key)
    cells = long_form(df, keys, curves)
    ends = cells.groupBy("curve").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    medians = stage(curve_quantiles(df, keys, {c: F.col(c) for c in curves}, {"__m": 0.5}))
    return ends.join(quantiles(medians, ["curve"], F.col("__m"), {"median_of_medians": 0.5}), "curve")


def anomaly_counts(df: DataFrame, curves: Sequence[str]) -> DataFrame:
    v = F.col("value")
    return long_form(df, [], curves).groupBy("curve").agg(
        F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("zero"), F.count_if(F.abs(v) > 1000).alias("over_1000"),
        F.count_if(F.abs(v) > 5000).alias("over_5000"), F.min(v).alias("min"), F.max(v).alias("max"))


def value_locations(df: DataFrame, curves: Sequence[str], key=KEY, order: str = ROW, depth: str = "DEPT") -> DataFrame:
    """Where zero and negative values lie: count, first and last depth, minimum, per key and curve."""
    keys = as_list(key)
    kind = F.when(F.col("value") < 0, "negative").when(F.col("value") == 0, "zero")
    return (long_form(df, [*keys, order, depth], curves).withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .groupBy(*keys, "curve", "kind").agg(
                F.count(F.lit(1)).alias("n"), F.min_by(depth, order).alias("first_depth"),
                F.max_by(depth, order).alias("last_depth"), F.min("value").alias("min")))


def extreme_values(df: DataFrame, curve: str, limit: float, key=KEY, order: str = ROW) -> DataFrame:
    """Samples with |value| above the limit, largest magnitude first."""
    size = F.abs(F.col(curve))
    return df.filter(size > limit).withColumn("magnitude", size).orderBy(F.desc("magnitude"), *as_list(key), order)


def describe(df: DataFrame, curves: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per group and curve."""
    cells = long_form(df, list(by), curves)
    group = [*by, "curve"]
    basic = cells.groupBy(*group).agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = curve_quantiles(df, by, {c: F.col(c) for c in curves}, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(quartiles, group, "left")


def class_feature_spread(df: DataFrame, curves: Sequence[str], label: str = TRUE) -> DataFrame:
    """N, median, quartiles and interquartile range per class and curve."""
    cells = long_form(df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "code"), ["code"], curves)
    counts = cells.groupBy("code", "curve").agg(F.count("value").alias("n"))
    q = quantiles(cells, ["code", "curve"], F.col("value"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return counts.join(q, ["code", "curve"], "left").withColumn("iqr", F.col("q75") - F.col("q25"))


def _halves(rows, names: Sequence[str], brackets: dict[str, tuple[float, float]] | None = None):
    """(curve, value, n) of many rows, counted over Arrow batches in the tasks.

    With `brackets`: how often each value inside a column's bracket occurs, and under NULL how many lie below it. Without:
    the known values of a column under NULL, and each of MEDIAN_POINTS parts of the sorted values of a task's next
    MEDIAN_ROWS rows by its middle value; NaN is in no part."""
    names, points, most = list(names), MEDIAN_POINTS, MEDIAN_ROWS

    def made(name, values, n):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values, pa.float64(), from_pandas=False),
                                           pa.array(n, pa.int64())], names=["curve", "value", "n"])

    def known(batches, i):
        return np.concatenate([b.column(i).drop_null().to_numpy(zero_copy_only=False) for b in batches])

    def summarised(batches):
        for name, i in zip(names, range(len(names))):
            x = known(batches, i)
            yield made(name, [None], [len(x)])
            x = np.sort(x[~np.isnan(x)])
            if len(x):
                size = -(-len(x) // points)
                first = np.arange(0, len(x), size)
                last = np.minimum(first + size, len(x))
                yield made(name, np.clip(x[(first + last - 1) // 2], -1e300, 1e300), last - first)  # infinities have no bucket

    def counted(batches):
        for name, i in zip(names, range(len(names))):
            x, (lo, hi) = known(batches, i), brackets[name]
            yield made(name, [None], [np.count_nonzero(x < lo)])
            yield made(name, *np.unique(x[(x >= lo) & (x <= hi)], return_counts=True))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= most:
                yield from (counted if brackets else summarised)(held)
                held, n = [], 0
        if held:
            yield from (counted if brackets else summarised)(held)

    return rows.mapInArrow(run, "curve string, value double, n long")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column name with its exact median; columns without a value are absent.

    A summary of each column, made in the tasks, gives an interval that holds the median; a second pass counts what lies
    below it and the values inside, so a small share of the values is shuffled. Ranks are counted, not estimated: a column
    whose median turns out to lie outside its interval goes through `quantiles`."""
    value = {c: F.col(c).cast("double") + 0.0 for c in dict.fromkeys(columns)}
    values = df.select(*[v.alias(f"x{i}") for i, v in enumerate(value.values())])
    seen = stage(_halves(values, value))
    parted = seen.filter(F.col("value").isNotNull()).groupBy("curve", "value").agg(F.sum("n").alias("n"))
    share = 2.0 / MEDIAN_POINTS
    upto, total = F.col("below") + F.col("n"), F.col("total")
    ends = {r["curve"]: (r["lo"], r["hi"]) for r in positions_of_counts(parted, ["curve"]).groupBy("curve").agg(
        F.coalesce(F.max(F.when(upto < (0.5 - share) * total - 2, F.col("value"))), F.lit(float("-inf"))).alias("lo"),
        F.coalesce(F.min(F.when(F.col("below") > (0.5 + share) * total + 2, F.col("value"))), F.lit(float("inf"))).alias("hi")).collect()}
    size = {r["curve"]: r["n"] for r in seen.filter(F.col("value").isNull()).groupBy("curve").agg(F.sum("n").alias("n")).collect()}
    known = {c: (i, size[c]) for i, c in enumerate(value) if c in ends}
    left = {c for c in value if size.get(c) and c not in known}
    parts = []
    if known:
        inside = _halves(values.select(*[f"x{i}" for i, _ in known.values()]), list(known), ends)
        counts = stage(inside.groupBy("curve", "value").agg(F.sum("n").alias("n")).filter(F.col("n") > 0))
        sums = {r["curve"]: (r["below"], r["inside"]) for r in counts.groupBy("curve").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("inside")).collect()}
        held = {c: (sums[c][0], n) for c, (_, n) in known.items()
                if c in sums and sums[c][0] <= (n - 1) // 2 and n // 2 < sums[c][0] + sums[c][1]}
        left |= set(known) - set(held)
        if held:
            first, n = (F.create_map(*[F.lit(x) for c, pair in held.items() for x in (c, pair[k])])[F.col("curve")] for k in (0, 1))
            at = positions_of_counts(counts.filter(F.col("value").isNotNull() & F.col("curve").isin(*held)), ["curve"])
            below = F.col("below") + first
            here = lambda rank: (below <= rank) & (rank < below + F.col("n"))
            lo, hi = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
            mid = at.groupBy("curve").agg(F.max(F.when(here(lo), F.col("value"))).alias("lo"), F.max(F.when(here(hi), F.col("value"))).alias("hi"),
                                          F.max((n - 1) / 2 - lo).alias("w"))
            parts.append(mid.select("curve", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("median")))
    if left or not parts:
        rest = [c for c in columns if c in left] or list(columns)
        parts.append(quantiles(long_form(df, [], rest), ["curve"], F.col("value"), {"median": 0.5}))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def first_locations(df: DataFrame, columns: Sequence[str], key=KEY, order: str = ROW) -> DataFrame:
    """First known value of each location column per key."""
    return df.groupBy(*as_list(key)).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def block_locations(places: DataFrame, x: str, y: str, block: str) -> DataFrame:
    """Wells, centroid and extent per block."""
    return places.groupBy(block).agg(
        F.count(F.lit(1)).alias("wells"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"),
        (F.max(x) - F.min(x)).alias("x_range"), (F.max(y) - F.min(y)).alias("y_range"))


# --- stretches of bad or missing values -----------------------------------------------------

def value_runs(df: DataFrame, curves: Sequence[str], key=KEY, order: str = ROW, depth: str = "DEPT",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stretches of missing, zero or negative values per key and curve with their depth range."""
    keys = as_list(key)
    v = {c: F.col(c).cast("double") for c in curves}
    kinds = {c: F.when(x.isNull(), "missing").when(x < 0, "negative").when(x == 0, "zero") for c, x in v.items()}
    own = F.col("own")
    return runs_of(df, keys, order, {c: (kinds[c], v[c]) for c in curves}, "curve",
                   {"depth_start": ("first", F.col(depth)), "depth_end": ("last", F.col(depth)), "min": ("min", own), "max": ("max", own)},
                   block_rows, [depth], lambda kind: kind.isNotNull()).withColumnRenamed("value", "kind")


def run_totals(stretches: DataFrame, key=KEY) -> DataFrame:
    return stretches.groupBy(*as_list(key), "curve", "kind").agg(
        F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"), F.sum("n").alias("samples"))


def gap_context(df: DataFrame, label: str = TRUE, logs: Sequence[str] = (), key=KEY, order: str = ROW,
                depth: str = "DEPT", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Label and logs one sample before and after each unlabelled stretch that has both sides."""
    keys = as_list(key)
    watched = [label, *logs]
    beside = over_frame(df.select(*keys, order, depth, *watched), keys, order, 1, 1, lambda w: {
        "__has_before": F.lag(order).over(w).isNotNull(), "__has_after": F.lead(order).over(w).isNotNull(),
        **{f"{c}_before": F.lag(c).over(w) for c in watched}, **{f"{c}_after": F.lead(c).over(w) for c in watched}}, block_rows)
    aggs = {"gap_top": ("first", F.col(depth)), "gap_base": ("last", F.col(depth)),
            "__has_before": ("first", F.col("__has_before")), "__has_after": ("last", F.col("__has_after")),
            **{f"{c}_before": ("first", F.col(f"{c}_before")) for c in watched},
            **{f"{c}_after": ("last", F.col(f"{c}_after")) for c in watched}}
    return (runs(beside, keys, order, F.col(label).isNull(), aggs, block_rows)
            .filter(F.col("value") & F.col("__has_before") & F.col("__has_after"))
            .drop("value", "__has_before", "__has_after"))


def around_nearest(df: DataFrame, target: float, rows: int = 20, key=KEY, order: str = ROW, depth: str = "DEPT") -> DataFrame:
    """Up to `rows` samples either side of the sample nearest to a depth; the first wins ties."""
    keys = as_list(key)
    nearest = df.groupBy(*keys).agg(F.min_by(order, F.struct(F.abs(F.col(depth) - target), F.col(order))).alias("__near"),
                                     F.max(order).alias("__last"))
    return (attach(df, nearest, keys, spread=order, last="__last")
            .filter(F.col(order).between(F.col("__near") - rows, F.col("__near") + rows)).drop("__near"))
