"""Exact quantiles and average ranks of groups of any size.

The built-in percentile keeps every distinct value of a group in one task. Here equal values
are counted first, the counts are spread by an order-preserving bucket, and the position of a
bucket within its group comes from one total per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlog.functions.columns import order_bucket
from depthlog.operators import whole
from depthlog.operators.series import ALL_BEFORE, BLOCK_ROWS, UP_TO_HERE, as_list, join_null_safe


def value_positions(df: DataFrame, key, value: Column) -> DataFrame:
    """Distinct values per key with `n`, rows `below` the value, and the group `total`."""
    key = as_list(key)
    counts = (df.select(*key, value.cast("double").alias("value")).filter(F.col("value").isNotNull())
              .groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n")))
    return positions_of_counts(counts, key)


def positions_of_counts(counts: DataFrame, key) -> DataFrame:
    """`below` and `total` for distinct `value`s that already carry their counts `n`."""
    key = as_list(key)
    part = [*key, "__b"]
    # Enough buckets that one group can occupy every task of a shuffle, and no more.
    resolution = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.withColumn("__b", order_bucket(F.col("value"), resolution))
    group = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    offsets = (counts.groupBy(*part).agg(F.sum("n").alias("__n"))
               .withColumn("total", F.sum("__n").over(group))
               .withColumn("__off", F.coalesce(
                   F.sum("__n").over(group.orderBy("__b").rowsBetween(*ALL_BEFORE)), F.lit(0)))
               .drop("__n"))
    here = Window.partitionBy(*part).orderBy("value").rowsBetween(*UP_TO_HERE)
    return (counts.withColumn("__cum", F.sum("n").over(here)).join(offsets, part)
            .withColumn("below", F.col("__off") + F.col("__cum") - F.col("n"))
            .drop("__b", "__cum", "__off"))


def cumulative_counts(counts: DataFrame, key, columns: Sequence[str]) -> DataFrame:
    """`below_c` (in smaller values) and `total_c` (in the group) of several count columns of distinct `value`s, in one pass."""
    key = as_list(key)
    resolution = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.withColumn("__b", order_bucket(F.col("value"), resolution))
    group = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__b").rowsBetween(*ALL_BEFORE)
    offsets = rows.groupBy(*key, "__b").agg(*[F.sum(c).alias(f"__n_{c}") for c in columns])
    offsets = offsets.select(*key, "__b", *[F.coalesce(F.sum(f"__n_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in columns],
                             *[F.sum(f"__n_{c}").over(group).alias(f"total_{c}") for c in columns])
    here = Window.partitionBy(*key, "__b").orderBy("value").rowsBetween(*UP_TO_HERE)
    summed = rows.withColumns({f"__cum_{c}": F.sum(c).over(here) for c in columns})
    return (join_null_safe(summed, offsets, [*key, "__b"])
            .withColumns({f"below_{c}": F.col(f"__off_{c}") + F.col(f"__cum_{c}") - F.col(c) for c in columns})
            .drop("__b", *[f"{p}_{c}" for c in columns for p in ("__off", "__cum")]))


def quantiles(df: DataFrame, key, value: Column, wanted: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per entry of `wanted`.

    Keys without any value are absent.
    """
    key = as_list(key)
    pos = value_positions(df, key, value)
    upto = F.col("below") + F.col("n")
    at, targets = {}, []
    for name, q in wanted.items():
        h = (F.col("total") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        here = lambda rank: (F.col("below") <= rank) & (rank < upto)
        at[name] = [F.max(F.when(here(lo), F.col("value"))).alias(f"__lo_{name}"),
                    F.max(F.when(here(hi), F.col("value"))).alias(f"__hi_{name}"),
                    F.max(h - lo).alias(f"__w_{name}")]
        targets.append(here(lo) | here(hi))
    wanted_rows = targets[0]
    for t in targets[1:]:
        wanted_rows = wanted_rows | t
    found = pos.filter(wanted_rows).groupBy(*key).agg(*[c for cs in at.values() for c in cs])
    return found.select(*key, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n)
        for n in wanted])


def curve_quantiles(df: DataFrame, key, curves: dict[str, Column], wanted: dict[str, float], most: int = BLOCK_ROWS) -> DataFrame:
    """`quantiles` of several columns per key, named in `curve`: rows travel once for all of them, and no value is counted.

    Keys of more than `most` rows go through `quantiles`. A curve without any value in a key is absent, as is a NULL key."""
    key, names = as_list(key), list(curves)
    for k in key:
        df = df.filter(F.col(k).isNotNull())
    cells = F.array(*[F.struct(F.lit(n).alias("curve"), c.cast("double").alias("value")) for n, c in curves.items()])
    exact = lambda rows: quantiles(rows.select(*key, F.inline(cells)), [*key, "curve"], F.col("value"), wanted)
    if not key:
        return exact(df)
    light, heavy, rows = whole.split_keys(df, key, most)
    outs = {(i, n): f"__q{i}_{j}" for i in range(len(names)) for j, n in enumerate(wanted)}

    def make(group, keys, columns):
        found = {}
        for i, (values, _, at, _) in enumerate(columns):
            x, n = values[at], np.bincount(group[at], minlength=keys)
            first, there = (np.cumsum(n) - n)[n > 0], n > 0
            for name, q in wanted.items():
                h = (n[there] - 1) * float(q)
                lo = np.floor(h)
                a, b = x[first + lo.astype(np.int64)], x[first + np.ceil(h).astype(np.int64)]
                value = np.zeros(keys)
                value[there] = a + (b - a) * (h - lo)
                found[outs[i, name]] = pa.array(value, pa.float64(), mask=~there)
        return found

    wide = whole.per_key(light, key, list(curves.values()), ", ".join(f"{c} double" for c in outs.values()), rows, make)
    back = F.array(*[F.struct(F.lit(c).alias("curve"), *[F.col(outs[i, n]).alias(n) for n in wanted]) for i, c in enumerate(names)])
    found = wide.select(*key, F.inline(back)).filter(F.col(next(iter(wanted))).isNotNull())
    return found if heavy is None else found.unionByName(exact(heavy))


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str],
              name: str = "curve", value: str = "value") -> DataFrame:
    """One row per (row, column), in one pass and without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                      for c in columns])
    return df.select(*keep, F.inline(pairs))
