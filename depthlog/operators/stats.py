"""Descriptive well statistics: summaries, mix, beds, contacts, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlog.functions import columns as C
from depthlog.operators import whole
from depthlog.operators.quality import steps
from depthlog.operators.quantiles import cumulative_counts, curve_quantiles, long_form, quantiles
from depthlog.operators.series import (BLOCK_ROWS, as_list, attach, enough_tasks, join_null_safe, over_frame, renumber, run_counts, runs, runs_of, with_previous)
from depthlog.schema import CODES, INPUT_CURVES, KEY, LOG_CURVES, STEP, TRUE


def curve_summary(df: DataFrame, curves: Sequence[str] = INPUT_CURVES, by: Sequence[str] = (KEY,)) -> DataFrame:
    """Count, valid, missing %, extremes, P10/P50/P90, mean and deviation; log curves positive only."""
    used = {c: F.when(F.col(c).cast("double") > 0, F.col(c).cast("double")) if c in LOG_CURVES else F.col(c).cast("double") for c in curves}
    cells = long_form(df.select(*by, *[v.alias(c) for c, v in used.items()]), list(by), curves)
    group = [*by, "curve"]
    n, valid = F.count(F.lit(1)), F.count("value")
    basic = cells.groupBy(*group).agg(
        n.alias("samples"), valid.alias("valid"), (100.0 * (1 - valid / n)).alias("pct_missing"), F.min("value").alias("min"),
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_samp("value").alias("std"))
    return basic.join(curve_quantiles(df, by, used, {"p10": 0.1, "p50": 0.5, "p90": 0.9}), group, "left")


def sample_step(df: DataFrame, key=KEY, order: str = "DEPTH_ROW", depth: str = "DEPT", positive_only: bool = True,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Median depth step per key: of the positive steps, or of all; 1.0 where there is none."""
    keys = as_list(key)
    moves = steps(df, keys, order, depth, block_rows)
    used = F.when(F.col("step") > 0, F.col("step")) if positive_only else F.col("step")
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            .join(quantiles(moves, keys, used, {"step": 0.5}), keys, "left")
            .select(*keys, F.coalesce("step", F.lit(1.0)).alias("step")))


def source_samples(df: DataFrame, models: dict[str, str], true: str | None = TRUE, keep: Sequence[str] = (),
                   original: str = "Original") -> DataFrame:
    """One row per (sample, source): `keep`, source, code. The labels are one of the sources."""
    sources = {**({original: true} if true else {}), **models}
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(s).alias("source"), F.col(c).cast("int").alias("code")) for s, c in sources.items()])))


def lithology_mix(df: DataFrame, models: dict[str, str], true: str | None = TRUE, key=KEY, order: str = "DEPTH_ROW",
                  depth: str = "DEPT", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Samples, net thickness and share per class and source."""
    keys = as_list(key)
    counts = (source_samples(df, models, true, keys).filter(F.col("code").isNotNull())
              .groupBy(*keys, "source", "code").agg(F.count(F.lit(1)).alias("samples")))
    share = F.col("samples") / F.sum("samples").over(Window.partitionBy(*keys, "source"))
    return (counts.withColumn("fraction", share).join(sample_step(df, keys, order, depth, True, block_rows), keys)
            .withColumn("thickness", F.col("samples") * F.col("step")).drop("step"))


def mix_entropy(mix: DataFrame, key=KEY) -> DataFrame:
    p = F.col("fraction")
    return mix.groupBy(*as_list(key), "source").agg(
        F.count(F.lit(1)).alias("classes"), (-F.sum(p * F.log2(p))).alias("entropy"), F.max(F.lit(math.log2(12))).alias("max_entropy"))


def distribution_share(df: DataFrame, models: dict[str, str], true: str = TRUE, key=KEY, original: str = "Original") -> DataFrame:
    """Share of each class per source, zero rows kept for classes any source has.

    Where a key has labels, every source counts labelled samples only.
    """
    keys = as_list(key)
    whole = Window.partitionBy(*keys)
    rows = source_samples(df.withColumn("__labelled", F.col(true).isNotNull()), models, true, [*keys, "__labelled"], original)
    counts = (rows.filter(F.col("code").isNotNull()).groupBy(*keys, "source", "code", "__labelled")
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumn("__any", F.max(F.col("__labelled").cast("int")).over(whole))
              .filter(F.col("__labelled") | (F.col("__any") == 0))
              .groupBy(*keys, "source", "code").agg(F.sum("n").alias("n"))
              .withColumn("__present", F.collect_set("code").over(whole)))
    table = counts.groupBy(*keys, "source").agg(
        F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("__m"), F.first("__present").alias("__present"),
        F.sum("n").alias("__total"))
    return (table.withColumn("code", F.explode("__present"))
            .withColumn("samples", F.coalesce(F.try_element_at("__m", F.col("code")), F.lit(0)).cast("long"))
            .withColumn("share_pct", 100.0 * F.col("samples") / F.col("__total"))
            .select(*keys, "source", "code", "samples", "share_pct"))


def depth_composition(df: DataFrame, code: str, key=KEY, depth: str = "DEPT", order: str = "DEPTH_ROW",
                      bins: int = 24) -> DataFrame:
    """Share of each class in equal-width depth bins, zeros included; the last bin is closed."""
    keys = as_list(key)
    rows = df.filter(F.col(code).isNotNull() & F.col(depth).isNotNull()).select(*keys, order, depth, F.col(code).alias("code"))
    ends = rows.groupBy(*keys).agg(F.min(depth).alias("__lo"), F.max(depth).alias("__hi"), F.max(order).alias("__last"))
    at = F.try_divide((F.col(depth) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))
    counts = (attach(rows, ends, keys, spread=order, last="__last")
              .withColumn("bin", F.coalesce(F.least(F.floor(at), F.lit(bins - 1)), F.lit(0)).cast("int"))
              .groupBy(*keys, "bin", "code").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "bin"))))
    table = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("bin", "code"), "fraction"))).alias("__m"),
        F.collect_set("code").alias("__codes"))
    return (table.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("code", F.explode("__codes"))
            .select(*keys, "bin", "code", F.coalesce(F.try_element_at("__m", F.struct("bin", "code")), F.lit(0.0)).alias("fraction")))


def interval_stats(df: DataFrame, first_model: str, true: str = TRUE, key=KEY, order: str = "DEPTH_ROW",
                   depth: str = "DEPT", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Samples, depths, step and beds per key; original beds bridge rows without label (NULL where no row has one)."""
    keys = as_list(key)
    counted = run_counts(df, keys, order, {"beds_first_model": (F.col(first_model), False), "beds_original": (F.col(true), True)}, block_rows,
                         {"n": ("sum", F.lit(1)), "top": ("min", F.col(depth)), "base": ("max", F.col(depth))})
    return (counted.withColumns({"span": F.col("base") - F.col("top"), "beds_original": F.nullif("beds_original", F.lit(0))})
            .join(sample_step(df, keys, order, depth, True, block_rows), keys))


def bed_runs(df: DataFrame, models: dict[str, str], true: str | None = TRUE, key=KEY, order: str = "DEPTH_ROW",
             original: str = "Original", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Beds of every source; a row without label ends a bed and is none itself."""
    keys = as_list(key)
    sources = {**({original: true} if true else {}), **models}
    return runs_of(df, keys, order, {s: (F.col(c).cast("int"), None) for s, c in sources.items()}, "source", None, block_rows,
                   wanted=lambda v: v.isNotNull()).withColumnRenamed("value", "code")


def bed_thickness(df: DataFrame, models: dict[str, str], true: str | None = TRUE, key=KEY, order: str = "DEPTH_ROW",
                  depth: str = "DEPT", original: str = "Original", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Beds, mean and largest thickness per source and class; the step is the median of all steps."""
    keys = as_list(key)
    beds = (bed_runs(df, models, true, keys, order, original, block_rows).groupBy(*keys, "source", "code")
            .agg(F.count(F.lit(1)).alias("beds"), F.avg("n").alias("__mean"), F.max("n").alias("__max")))
    return (beds.join(sample_step(df, keys, order, depth, False, block_rows), keys)
            .select(*keys, "source", "code", "beds", (F.col("__mean") * F.col("step")).alias("mean_thickness"),
                    (F.col("__max") * F.col("step")).alias("max_thickness")))


def run_length_spread(df: DataFrame, code: str, key=KEY, order: str = "DEPTH_ROW", bridge: bool = True, step: float = STEP,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distribution of run lengths per class, in samples and metres."""
    keys = as_list(key)
    rows = df.select(*keys, order, code)
    if bridge:
        rows = renumber(rows.filter(F.col(code).isNotNull()), keys, order, order, block_rows)
    lengths = (runs(rows, keys, order, F.col(code), None, block_rows).filter(F.col("value").isNotNull())
               .withColumnRenamed("value", "code"))
    basic = lengths.groupBy("code").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"),
        F.max("n").alias("max"))
    q = quantiles(lengths, ["code"], F.col("n"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(q, "code").withColumns({"mean_m": F.col("mean") * step, "median_m": F.col("median") * step})


def transitions(df: DataFrame, code: str, key=KEY, order: str = "DEPTH_ROW", bridge: bool = True, min_count: int = 1,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Contacts from one bed to the next, per key; rows without code are bridged by default."""
    keys = as_list(key)
    rows = df.select(*keys, order, code)
    if bridge:
        rows = renumber(rows.filter(F.col(code).isNotNull()), keys, order, order, block_rows)
    return (with_previous(rows, keys, order, {"from_code": F.col(code)}, block_rows)
            .filter(F.col("from_code") != F.col(code))
            .groupBy(*keys, "from_code", F.col(code).alias("to_code")).agg(F.count(F.lit(1)).alias("contacts"))
            .filter(F.col("contacts") >= min_count))


def ranked_transitions(table: DataFrame) -> DataFrame:
    """Most contacts first, then display order of both classes; at most one row per class pair."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("contacts"), C.code_to_display(F.col("from_code")), C.code_to_display(F.col("to_code")))
    return table.withColumn("rank", F.row_number().over(order))


def transition_matrix(table: DataFrame, codes: Sequence[int] = CODES) -> DataFrame:
    """One row per class left, one column per class entered, zeros kept; classes seen only."""
    codes = sorted(codes)
    seen = table.select(F.explode(F.array("from_code", "to_code")).alias("from_code")).distinct()
    counts = table.groupBy("from_code").agg(*[
        F.sum(F.when(F.col("to_code") == c, F.col("contacts")).otherwise(0)).alias(f"to_{c}") for c in codes])
    return seen.join(counts, "from_code", "left").na.fill(0)


# --- correlations ---------------------------------------------------------------------------

def spearman(df: DataFrame, curves: Sequence[str] = INPUT_CURVES, by: Sequence[str] = (), most: int = BLOCK_ROWS) -> DataFrame:
    """Rank correlation of every ordered pair of curves, each pair on its complete rows; ranks are averages over ties.

    Keys of at most `most` rows are ranked whole in one task, many at a time; others, and a table without a key, by counts
    of their distinct values (`_rank_products`). Pairs without complete rows are absent."""
    names, size = list(curves), len(curves)
    x = [C.log10_positive(F.col(c)) if c in LOG_CURVES else F.col(c).cast("double") for c in names]
    pairs = list(combinations(range(size), 2))
    if by:
        light, heavy, rows = whole.split_keys(df, by, most)
        sums = ", ".join(f"{s}_{i}_{j} double" for i, j in pairs for s in ("ab", "aa", "bb"))
        table = whole.per_key(light, by, x, sums, rows, _whole_rank_products())
        if heavy is not None:
            table = table.unionByName(_rank_products(heavy, x, by))
    else:
        table = _rank_products(df, x, by)
    out = []
    for i, j in pairs:
        rho = F.try_divide(F.col(f"ab_{i}_{j}"), F.sqrt(f"aa_{i}_{j}") * F.sqrt(f"bb_{i}_{j}"))
        there = F.col(f"aa_{i}_{j}").isNotNull()
        out += [F.when(there, F.struct(F.lit(names[u]).alias("left"), F.lit(names[v]).alias("right"), rho.alias("rho"))) for u, v in ((i, j), (j, i))]
    return table.select(*by, F.inline(F.filter(F.array(*out), lambda p: p.isNotNull())))


def _whole_rank_products():
    """Sums of products of centred ranks for every pair of columns, one per key; NULL where a pair has no complete row.

    A function of a function, so that executors get it with the task and need not import it."""
    def centred(place, middle):
        n = np.bincount(place)
        return (np.cumsum(n) - n / 2.0)[place] - middle

    def make(group, keys, columns):
        places = []  # of every known value among the distinct values of all keys, by key and value
        for x, _, at, new in columns:
            place = np.zeros(len(x), np.int64)
            place[at] = np.cumsum(new) - 1
            places.append(place)
        found = {}
        for i, j in combinations(range(len(columns)), 2):
            both = np.flatnonzero(columns[i][1] & columns[j][1])
            g = group[both]
            total = np.bincount(g, minlength=keys)
            middle = (np.cumsum(total) - total + total / 2.0)[g]
            a, b = centred(places[i][both], middle), centred(places[j][both], middle)
            for name, product in (("ab", a * b), ("aa", a * a), ("bb", b * b)):
                found[f"{name}_{i}_{j}"] = pa.array(np.bincount(g, product, keys), pa.float64(), mask=total == 0)
        return found
    return make


def _rank_products(df: DataFrame, x: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """The same sums for keys of any size.

    A value of a curve has another rank for each partner, since other rows are complete. All of them come from one table
    of distinct values with as many counts as partners, added up once; rows get them by curve and value, each row's curves
    meet again, and one aggregate sums the products of all pairs."""
    size = len(x)
    x = [c + F.lit(0.0) for c in x]  # zero is one value, whatever its sign
    numbered = df.select(*by, F.monotonically_increasing_id().alias("__row"), *[c.alias(f"__x{i}") for i, c in enumerate(x)])
    partners = [F.col(f"__x{j}").isNotNull().cast("long").alias(f"n{j}") for j in range(size)]
    cells = F.array(*[F.struct(F.lit(i).alias("curve"), F.col(f"__x{i}").alias("value")) for i in range(size)])
    long = numbered.select(*by, "__row", *partners, F.inline(cells)).filter(F.col("value").isNotNull())
    key, counted = [*by, "curve"], [f"n{j}" for j in range(size)]
    counts = long.groupBy(*key, "value").agg(*[F.sum(c).alias(c) for c in counted])
    centred = [F.col(f"below_{c}") + F.col(c) / 2.0 - F.col(f"total_{c}") / 2.0 for c in counted]
    slots = [F.get(F.array(*centred), F.lit(k) + (F.col("curve") <= k).cast("int")).alias(f"s{k}") for k in range(size - 1)]  # all but the own curve
    ranks = cumulative_counts(counts, key, counted).select(*key, "value", *slots)
    placed = join_null_safe(long.select(*key, "__row", "value"), ranks, [*key, "value"]).drop("value")
    # Numbers, not arrays, go back to their rows, and no task tries to add up what is not there yet.
    rows = placed.repartition(*enough_tasks(df.sparkSession, df.count()), *by, "__row").groupBy(*by, "__row").agg(*[
        F.max(F.when(F.col("curve") == i, F.col(f"s{k}"))).alias(f"r{i}_{k}") for i in range(size) for k in range(size - 1)])
    sums = {}
    for i, j in combinations(range(size), 2):
        a, b = F.col(f"r{i}_{j - 1}"), F.col(f"r{j}_{i}")
        both = a.isNotNull() & b.isNotNull()
        sums |= {f"ab_{i}_{j}": F.sum(a * b), f"aa_{i}_{j}": F.sum(F.when(both, a * a)), f"bb_{i}_{j}": F.sum(F.when(both, b * b))}
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Linear correlation of column pairs, each on its complete rows; one pass, no shuffle of rows."""
    table = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    return table.select(*by, F.inline(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"__{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def mean_absolute_difference(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    table = df.groupBy(*by).agg(*[F.avg(F.abs(F.col(a) - F.col(b))).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    return table.select(*by, F.inline(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"__{i}").alias("mean_abs_diff"))
        for i, (a, b) in enumerate(pairs)])))


# --- samples and tracks ---------------------------------------------------------------------

def hash_sample(df: DataFrame, n: int, identity: Sequence[str], seed: int = 0) -> DataFrame:
    """A repeatable sample of n rows: the smallest hashes of identity and seed."""
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in identity], F.lit(str(seed)))
    return df.withColumn("__h", F.md5(text)).orderBy("__h", *identity).limit(n).drop("__h")


def crossplot(df: DataFrame, x: str, y: str, panels: Sequence[str], n: int, identity: Sequence[str], seed: int = 0) -> DataFrame:
    """Complete rows with positive log curves, sampled to at most n points."""
    rows = df.dropna(subset=list(dict.fromkeys([x, y, *panels])))
    for axis in (x, y):
        if axis in LOG_CURVES:
            rows = rows.filter(F.col(axis) > 0)
    return hash_sample(rows.select(*dict.fromkeys([*identity, x, y, *panels])), n, identity, seed)


def panel_agreement(df: DataFrame, true: str, panels: dict[str, str]) -> DataFrame:
    """Share of all labelled rows on which each panel agrees with the labels."""
    table = df.agg(*[F.avg((F.col(c) == F.col(true)).cast("int")).alias(m) for m, c in panels.items()])
    return table.select(F.inline(F.array(*[F.struct(F.lit(m).alias("panel"), F.col(m).alias("agreement")) for m in panels])))


def wrong_samples(df: DataFrame, pred: str, true: str, complete: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(dict.fromkeys([pred, true, *complete]))).filter(F.col(pred) != F.col(true))


def insert_gap_rows(df: DataFrame, columns: Sequence[str], key=KEY, order: str = "DEPTH_ROW", depth: str = "DEPT",
                    factor: float = 5.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """After a step above `factor` typical steps, one extra row with NULL columns (`is_gap` = 1)."""
    keys = as_list(key)
    typical = (sample_step(df, keys, order, depth, True, block_rows).withColumnRenamed("step", "__typical")
               .join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(order).alias("__last")), keys))
    ahead = over_frame(df.select(*keys, order, depth, *columns), keys, order, 0, 1,
                       lambda w: {"__step": F.lead(depth).over(w) - F.col(depth)}, block_rows)
    rows = attach(ahead, typical, keys, spread=order, last="__last", block_rows=block_rows)
    types = dict(df.dtypes)
    own = F.struct(F.col(depth).alias(depth), *[F.col(c).alias(c) for c in columns], F.lit(0).alias("is_gap"))
    gap = F.struct((F.col(depth) + F.col("__typical")).alias(depth),
                   *[F.lit(None).cast(types[c]).alias(c) for c in columns], F.lit(1).alias("is_gap"))
    wide = (F.col("__step") > factor * F.col("__typical")) & (F.col("__n") >= 3)
    return rows.select(*keys, order, F.inline(F.when(wide, F.array(own, gap)).otherwise(F.array(own))))


def depth_edges(df: DataFrame, key=KEY, order: str = "DEPTH_ROW", depth: str = "DEPT", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Upper and lower edge of each depth cell: mid-points, mirrored at both ends."""
    d = F.col(depth)

    def build(w):
        up, down = F.lag(depth).over(w), F.lead(depth).over(w)
        return {"upper": F.coalesce((up + d) / 2, d - (down - d) / 2), "lower": F.coalesce((d + down) / 2, d + (d - up) / 2)}
    return over_frame(df, key, order, 1, 1, build, block_rows)
