"""Joins, set operations, splits and audits over wells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from depthlog.functions import columns as C
from depthlog.operators.quantiles import quantiles
from depthlog.operators.series import as_list, attach, join_null_safe, number_rows, rank_rows, renumber
from depthlog.schema import KEY, ROW, SPLITS, STEP


def unique_by(df: DataFrame, key) -> DataFrame:
    """The table itself; the job fails on the second row of any key."""
    keys = as_list(key)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    twice = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(F.struct(*keys)))).cast("boolean")
    return df.withColumn("__nth", nth).filter(F.when(F.col("__nth") == 1, True).otherwise(twice)).drop("__nth")


def attach_split(df: DataFrame, manifest: DataFrame, key=KEY, split: str = "SPLIT", order: str = ROW) -> DataFrame:
    """Left join of the split, many rows to one; a stale split column is replaced."""
    return attach(df.drop(split), unique_by(manifest.select(*as_list(key), split), key), key, "left", order)


def split_rows(df: DataFrame, name: str, split: str = "SPLIT") -> DataFrame:
    if name not in SPLITS:
        raise ValueError(f"no split named {name}; known: {', '.join(SPLITS)}")
    return df.filter(F.col(split) == name)


def attach_one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join that fails on a duplicate key of either side, so the row count is kept."""
    return unique_by(left, key).join(unique_by(right, key), list(key), "left")


def attach_by_position(left: DataFrame, right: DataFrame, key, left_order: str, right_order: str, out: str = "sample") -> DataFrame:
    """Join the n-th row of a key on one side to the n-th row on the other."""
    keys = as_list(key)
    a = renumber(left, keys, left_order, out)
    b = renumber(right, keys, right_order, out).drop(right_order)
    return a.join(b, [*keys, out])


def absent_in(left: DataFrame, right: DataFrame, key=KEY) -> DataFrame:
    keys = as_list(key)
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def present_in(left: DataFrame, right: DataFrame, key=KEY) -> DataFrame:
    keys = as_list(key)
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")


def split_changes(old: DataFrame, new: DataFrame, key=KEY, split: str = "SPLIT") -> DataFrame:
    """Keys whose split differs between two manifests, or that one of them lacks."""
    keys = as_list(key)
    a = old.select(*keys, F.col(split).alias("old_split"))
    b = new.select(*keys, F.col(split).alias("new_split"))
    return a.join(b, keys, "full_outer").filter(~F.col("old_split").eqNullSafe(F.col("new_split")))


def stack_wells(*parts: DataFrame) -> DataFrame:
    """All tables as one; columns a table lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def split_audit(df: DataFrame, manifest: DataFrame, expected: dict[str, int], key=KEY, split: str = "SPLIT") -> DataFrame:
    """Per split: wells listed, wells with data, wells listed elsewhere too, and the expected number."""
    keys = as_list(key)
    listed = manifest.groupBy(*keys).agg(F.count_distinct(split).alias("__splits"))
    per = (manifest.join(listed, keys).join(df.select(*keys).distinct().withColumn("__data", F.lit(1)), keys, "left")
           .groupBy(split).agg(F.count_distinct(*keys).alias("wells"), F.count("__data").alias("with_data"),
                               F.count_if(F.col("__splits") > 1).alias("in_other_split")))
    want = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    return per.withColumn("expected", F.try_element_at(want, F.col(split)).cast("long")).withColumn(
        "ok", ((F.col("in_other_split") == 0) & (F.col("wells") == F.col("expected"))).cast("int"))


def random_split(wells: DataFrame, first: int, names: tuple[str, str], key=KEY, seed: int = 42, out: str = "SPLIT") -> DataFrame:
    """`first` wells, in order of a hash of name and seed, get the first name, the rest the second."""
    keys = as_list(key)
    hashed = wells.select(*keys).distinct().withColumn("__h", F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))))
    ranked = number_rows(hashed, [], [F.col("__h"), *[F.col(k) for k in keys]], [F.substring("__h", 1, 2)], "__rank")
    return ranked.select(*keys, F.when(F.col("__rank") < first, names[0]).otherwise(names[1]).alias(out))


def well_chunks(wells: DataFrame, size: int = 20, key=KEY) -> DataFrame:
    """Wells in ascending order, cut into groups of `size`."""
    keys = as_list(key)
    ranked = rank_rows(wells.select(*keys).distinct(), [], keys, "__rank")
    return ranked.select(*keys, F.floor(F.col("__rank") / size).alias("chunk"))


# --- universal depth grid -------------------------------------------------------------------

def snap_to_grid(df: DataFrame, label: str, key=KEY, depth: str = "DEPT", step: float = STEP) -> DataFrame:
    """Nearest node of the regular grid over the labelled depths of all wells; the upper node wins ties."""
    rows = df.filter(F.col(label).isNotNull() & F.col(depth).isNotNull())
    lo, hi = rows.agg(F.min(depth)).scalar(), rows.agg(F.max(depth)).scalar()
    last = F.floor((hi - lo) / step)
    node = F.greatest(F.lit(0), F.least(F.ceil((F.col(depth) - lo) / step - 0.5), last))
    return (rows.withColumn("node", node.cast("long"))
            .withColumn("node_depth", lo + F.col("node") * step)
            .withColumn("error", F.abs(F.col(depth) - F.col("node_depth"))))


def snap_report(snapped: DataFrame, key=KEY) -> DataFrame:
    """Samples, error statistics (median and 95 % exact) and samples that share a node, per key."""
    keys = as_list(key)
    middle = quantiles(snapped, keys, F.col("error"), {"median_error": 0.5, "p95_error": 0.95})
    nodes = snapped.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("worst"), F.sum("error").alias("sum"))
    table = nodes.groupBy(*keys).agg(
        F.sum("n").alias("samples"), F.max("worst").alias("max_error"), (F.sum("sum") / F.sum("n")).alias("mean_error"),
        (F.sum("n") - F.count(F.lit(1))).alias("collisions"))
    return join_null_safe(table, middle, keys)


def grid_codes(df: DataFrame, label: str, key=KEY, order: str = ROW, depth: str = "DEPT", step: float = STEP) -> DataFrame:
    """One class per (grid node, key): node by rounding half-even, the last sample wins."""
    keys = as_list(key)
    rows = df.filter(F.col(label).isNotNull() & F.col(depth).isNotNull() & ~F.col(label).isin(-999, -9999))
    lo = rows.agg(F.min(depth)).scalar()
    return (rows.withColumn("node", F.rint((F.col(depth) - lo) / step).cast("long"))
            .groupBy("node", *keys).agg(F.max_by(label, order).alias("code"), F.count(F.lit(1)).alias("samples"))
            .withColumn("depth", F.round(lo + F.col("node") * step, 3)))


def grid_matrix(cells: DataFrame, wells: Sequence, key: str = KEY) -> DataFrame:
    """Depth x well table for the named wells; the long form is the one for any number of wells."""
    return cells.groupBy("node", "depth").pivot(key, list(wells)).agg(F.first("code"))


def full_grid(df: DataFrame, label: str, depth: str = "DEPT", step: float = STEP) -> DataFrame:
    """Every node between the smallest and largest labelled depth."""
    rows = df.filter(F.col(label).isNotNull() & F.col(depth).isNotNull())
    ends = rows.agg(F.min(depth).alias("lo"), F.max(depth).alias("hi"))
    # one row expands to the grid; the chunk explode first spreads it over many tasks
    chunk = 65536
    n = F.floor((F.col("hi") - F.col("lo")) / step)
    chunks = (ends.filter(F.col("lo").isNotNull()).withColumn("n", n)
              .withColumn("c", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / chunk)))).repartition("c"))
    start = F.col("c") * chunk
    return (chunks.withColumn("node", F.explode(F.sequence(start, F.least(start + chunk - 1, F.col("n")))))
            .select("node", F.round(F.col("lo") + F.col("node") * step, 3).alias("depth")))


def grid_fill_report(cells: DataFrame, key=KEY) -> DataFrame:
    return cells.groupBy(*as_list(key)).agg(F.count(F.lit(1)).alias("nodes"), F.sum("samples").alias("samples"))


def well_density(places: DataFrame, x: str, y: str, size: int = 200, pad: float = 0.08) -> DataFrame:
    """Gaussian kernel density of positions on a size x size grid (Scott bandwidth).

    Bandwidth and extent are one aggregated row. Every position contributes to the fixed
    number of grid nodes; contributions are summed per node before they are shuffled.
    """
    spots = places.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    points = places.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = points.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    one = s.select(F.struct("*")).scalar()
    # A position is a few bytes but size * size nodes of work: bytes would bring all of them into a few tasks.
    g = spots.repartition(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("s", one)
    h = F.pow(F.col("s.n"), -1.0 / 3.0)  # square of n ** (-1/6)
    det = F.col("s.vx") * F.col("s.vy") - F.col("s.cxy") * F.col("s.cxy")
    px, py = (F.col("s.x1") - F.col("s.x0")) * pad, (F.col("s.y1") - F.col("s.y0")) * pad
    node = lambda lo, hi, p, i: lo - p + i * ((hi - lo + 2 * p) / (size - 1))
    dx = node(F.col("s.x0"), F.col("s.x1"), px, F.col("i")) - F.col("x")
    dy = node(F.col("s.y0"), F.col("s.y1"), py, F.col("j")) - F.col("y")
    q = (F.col("s.vy") * dx * dx - 2 * F.col("s.cxy") * dx * dy + F.col("s.vx") * dy * dy) / (det * h)
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    kernel = F.col("w") * F.exp(-0.5 * q) / (F.col("s.n") * 2 * F.pi() * h * F.sqrt(det))
    return (g.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
            .groupBy("i", "j").agg(F.sum(kernel).alias("density")))
