"""Ordered series per key, without ever putting one whole key into one task.

A key (a well) may hold a large share of all rows, so windows here are never partitioned by
the key alone. Every series has a dense integer row position; the position splits it into
blocks of `block_rows`, and windows run over (key, block):

* bounded frames copy the few rows either side of a block edge into the neighbouring block;
* running totals add a per-block offset, computed over one small row per block;
* runs are found inside blocks, and only runs touching a block edge are merged per key.

The position column must be dense (0,1,2,... or 1,2,3,...) within each key. `number_rows`,
`renumber` and `rank_rows` make such columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlog.operators.staging import stage
from depthlog.schema import KEY, ROW

BLOCK = "__block"
BLOCK_ROWS = 1_000_000
PART_ROWS = 2 * BLOCK_ROWS  # rows of a task, where the session's number of shuffle partitions would leave it more
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20

ALL_BEFORE = (Window.unboundedPreceding, -1)
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def as_list(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def block_of(order: str | Column, block_rows: int = BLOCK_ROWS) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(block_rows)).cast("long")


def join_null_safe(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on key columns of one name, NULL meeting NULL; the key columns of the left side stay."""
    names = {k: f"__right_{k}" for k in key}
    other = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(F.broadcast(other) if small else other, on, how).drop(*names.values())


def enough_tasks(spark, rows: int) -> list[int]:
    """The number of partitions for a shuffle of so many rows; none where the session's own number will do."""
    tasks = -(-rows // PART_ROWS)
    return [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


# --- positions -----------------------------------------------------------------------------

def number_rows(df: DataFrame, key, order: Sequence[Column], bucket: Sequence[Column],
                out: str = ROW, start: int = 0) -> DataFrame:
    """Dense position of each row within its key.

    `bucket` is a coarse, non-decreasing function of `order` (for example the leading order
    column). Rows are numbered inside (key, bucket); the offset of a bucket comes from counts
    summed before any shuffle. A NULL key is a key like any other.
    """
    key = as_list(key)
    names = [f"__b{i}" for i in range(len(bucket))]
    rows = df.withColumns(dict(zip(names, bucket)))
    part = [*key, *names]
    offsets = (rows.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__off", F.coalesce(
                   F.sum("__n").over(Window.partitionBy(*key).orderBy(*names)
                                     .rowsBetween(*ALL_BEFORE)), F.lit(0)))
               .drop("__n"))
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (join_null_safe(rows.withColumn("__rn", local), offsets, part)
            .withColumn(out, (F.col("__off") + F.col("__rn") - 1 + start).cast("long"))
            .drop(*names, "__off", "__rn"))


def renumber(df: DataFrame, key=KEY, order: str = ROW, out: str | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Close the holes a filter left in a position column."""
    return number_rows(df, key, [F.col(order)], [block_of(order, block_rows)], out or order)


def rank_rows(df: DataFrame, key, order: Sequence[str], out: str, rows: int = 0) -> DataFrame:
    """Dense position by any total order, whatever the distribution of key and order values.

    Range partitioning samples (key, order), so a heavy key is cut into many partitions. The
    sorted table is staged: partition numbers must not change between counting and joining.
    The number of rows, where it is known, bounds what one task sorts.
    """
    key = as_list(key)
    ordered = (df.repartitionByRange(*enough_tasks(df.sparkSession, rows), *key, *order).sortWithinPartitions(*key, *order)
               .withColumn("__part", F.spark_partition_id())
               .withColumn("__slot", F.monotonically_increasing_id()))
    rows = stage(ordered)
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    offsets = (rows.groupBy(*key, "__part")
               .agg(F.min("__slot").alias("__first"), F.count(F.lit(1)).alias("__n"))
               .withColumn("__off", F.coalesce(
                   F.sum("__n").over(w.orderBy("__part").rowsBetween(*ALL_BEFORE)), F.lit(0)))
               .drop("__n"))
    return (attach(rows, offsets, [*key, "__part"], spread=F.shiftright("__slot", 20))
            .withColumn(out, (F.col("__off") + F.col("__slot") - F.col("__first")).cast("long"))
            .drop("__part", "__slot", "__first", "__off"))


def by_depth(df: DataFrame, key=KEY, depth: str = "DEPT", order: str = ROW,
             out: str = "DEPTH_ROW") -> DataFrame:
    """Drop samples without depth and number the rest by depth; stored order breaks ties."""
    return rank_rows(df.filter(F.col(depth).isNotNull()), key, [depth, order], out)


# --- windows over blocks -------------------------------------------------------------------

def over_frame(df: DataFrame, key, order: str, before: int, after: int,
               build: Callable[[Window], dict[str, Column] | list[dict[str, Column]]],
               block_rows: int = BLOCK_ROWS, keep_block: bool = False,
               then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add window columns that look at most `before` rows back and `after` rows ahead.

    `build` gets the window specification, partitioned by (key, block) and ordered by
    position, and returns the new columns; a list of such steps may build on one another in the
    same pass, if `before` and `after` reach far enough for all of them. With `keep_block` the result stays partitioned by
    (key, block), so a following window over the block needs no shuffle. `then` sees the rows of the tasks in
    this order, with the copied edge rows, and returns them in the same order.
    """
    key = as_list(key)
    lo = block_of(F.col(order) - after, block_rows)
    hi = block_of(F.col(order) + before, block_rows)
    copies = df.withColumn(BLOCK, F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*key, BLOCK).orderBy(order)
    built = build(w)
    for columns in built if isinstance(built, list) else [built]:
        copies = copies.withColumns(columns)
    if then is not None:
        copies = then(copies)
    own = copies.filter(F.col(BLOCK) == block_of(order, block_rows))
    return own if keep_block else own.drop(BLOCK)


def with_previous(df: DataFrame, key, order: str, columns: dict[str, Column],
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Values of the preceding row."""
    return over_frame(df, key, order, 1, 0,
                      lambda w: {n: F.lag(c).over(w) for n, c in columns.items()}, block_rows)


def running_totals(df: DataFrame, key, order: str, totals: dict[str, Column],
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running sums over the whole series of each key."""
    key = as_list(key)
    rows = df.withColumn(BLOCK, block_of(order, block_rows))
    w = Window.partitionBy(*key, BLOCK).orderBy(order).rowsBetween(*UP_TO_HERE)
    earlier = Window.partitionBy(*key).orderBy(BLOCK).rowsBetween(*ALL_BEFORE)
    offsets = (rows.groupBy(*key, BLOCK).agg(*[F.sum(c).alias(f"__o_{n}") for n, c in totals.items()])
               .withColumns({f"__o_{n}": F.coalesce(F.sum(f"__o_{n}").over(earlier), F.lit(0))
                             for n in totals}))
    return (rows.withColumns({n: F.sum(c).over(w) for n, c in totals.items()})
            .transform(join_null_safe, offsets, [*key, BLOCK])
            .withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"__o_{n}") for n in totals})
            .drop(BLOCK, *[f"__o_{n}" for n in totals]))


def runs(df: DataFrame, key, order: str, value: Column, aggs: dict | None = None,
         block_rows: int = BLOCK_ROWS, carry: Sequence[str] | None = None, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Maximal stretches of consecutive rows with equal value (NULL equals NULL).

    One row per run: key, value, first_row, last_row, n, and `aggs` given as
    {name: (kind, column)} with kind min, max, sum, first or last. With `carry`, only these columns
    travel and the agg columns are made from them later. `wanted` keeps runs by their value.
    """
    aggs = aggs or {}
    if carry is None:
        df = df.select(*as_list(key), order, value.alias("__value"), *[c.alias(f"__agg_{n}") for n, (_, c) in aggs.items()])
        value, carry = F.col("__value"), [f"__agg_{n}" for n in aggs]
        aggs = {n: (kind, F.col(f"__agg_{n}")) for n, (kind, _) in aggs.items()}
    return _runs(df, as_list(key), order, {None: (value, None)}, [], aggs, carry, wanted, block_rows)


def runs_of(df: DataFrame, key, order: str, values: dict[str, tuple[Column, Column | None]], name: str, aggs: dict | None = None,
            block_rows: int = BLOCK_ROWS, carry: Sequence[str] = (), wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """`runs` of several values of a row, named in the column `name`, without a row for each value before the windows.

    `values` is {name: (value, own)}; agg columns are made from the columns `carry` and from `own`."""
    return _runs(df, as_list(key), order, values, [name], aggs or {}, carry, wanted, block_rows)


def _runs(df, key, order, values, name, aggs, carry, wanted, block_rows) -> DataFrame:
    plain = {"min": F.min, "max": F.max, "sum": F.sum}
    owns = {i: own for i, (_, own) in enumerate(values.values()) if own is not None}
    columns = {f"__v{i}": v for i, (v, _) in enumerate(values.values())} | {f"__own{i}": own for i, own in owns.items()}

    rows = over_frame(
        df.select(*key, order, *carry, *[c.alias(n) for n, c in columns.items()]), key, order, 1, 0,
        lambda w: {f"__s{i}": F.when(F.lag(order).over(w).isNull(), 1)
                   .otherwise((~F.col(f"__v{i}").eqNullSafe(F.lag(f"__v{i}").over(w))).cast("int")) for i in range(len(values))},
        block_rows, keep_block=True)
    w = Window.partitionBy(*key, BLOCK).orderBy(order).rowsBetween(*UP_TO_HERE)

    def within(column, kind):
        if kind == "first":
            return F.min_by(column, order)
        return F.max_by(column, order) if kind == "last" else plain[kind](column)

    def across(name, kind):
        if kind == "first":
            return F.min_by(name, "first_row")
        return F.max_by(name, "last_row") if kind == "last" else plain[kind](name)

    # A piece is the part of a run inside one block; only pieces at a block edge can belong to
    # a longer run, so only those (two per block) are looked at key-wide. A run's pieces share
    # its value, so runs that are not wanted leave here.
    marked = rows.withColumns({f"__p{i}": F.sum(f"__s{i}").over(w) for i in range(len(values))})
    cells = F.array(*[F.struct(*[F.lit(n).alias(label) for label in name], F.col(f"__v{i}").alias("value"), F.col(f"__s{i}").alias("__starts"),
                               F.col(f"__p{i}").alias("__piece"), *[F.col(f"__own{j}").alias("own") for j in owns if j == i])
                      for i, n in enumerate(values)]) if name else None
    if name:
        long = marked.select(*key, BLOCK, order, *carry, F.inline(cells))
    else:
        long = marked.withColumnsRenamed({"__v0": "value", "__s0": "__starts", "__p0": "__piece"})
    group = [*key, *name]
    pieces = ((long if wanted is None else long.filter(wanted(F.col("value"))))
              .groupBy(*group, BLOCK, "__piece", "value")
              .agg(F.max("__starts").alias("__starts"),
                   F.min(order).alias("first_row"), F.max(order).alias("last_row"),
                   F.count(F.lit(1)).alias("n"),
                   *[within(c, kind).alias(n) for n, (kind, c) in aggs.items()]))
    inner = (F.floor(F.col("first_row") / block_rows) == F.floor((F.col("first_row") - 1) / block_rows)) & \
            (F.floor(F.col("last_row") / block_rows) == F.floor((F.col("last_row") + 1) / block_rows))
    edge = pieces.withColumn("__edge", F.when(inner, F.col("first_row")).otherwise(F.lit(-1)))
    chain = Window.partitionBy(*group, "__edge").orderBy("first_row").rowsBetween(*UP_TO_HERE)
    return (edge.withColumn("__run", F.max(F.when(F.col("__starts") == 1, F.col("first_row"))).over(chain))
            .groupBy(*group, "__run", "value")
            .agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.sum("n").alias("n"),
                 *[across(n, kind).alias(n) for n, (kind, _) in aggs.items()])
            .drop("__run"))


def run_counts(df: DataFrame, key, order: str, values: dict[str, tuple[Column, bool]], block_rows: int = BLOCK_ROWS,
               aggs: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Number of runs of several values per key, in one pass with one shuffle of the rows.

    `values` names each count: (value, bridge). NULL equals NULL; with `bridge`, rows without value are left out instead.
    `aggs` adds {name: (kind, column)} with kind min, max or sum. Starts are counted inside a block; only the first and
    last value of each block are compared across the key.
    """
    key, aggs = as_list(key), aggs or {}
    plain = {"min": F.min, "max": F.max, "sum": F.sum}
    rows = df.select(*key, F.col(order).alias("__at"), *[c.alias(f"__v_{n}") for n, (c, _) in values.items()],
                     *[c.alias(f"__a_{n}") for n, (_, c) in aggs.items()]).withColumn(BLOCK, block_of("__at", block_rows))

    def begins(value, before, bridge, opens):
        if bridge:
            return value.isNotNull() & (before.isNull() | (before != value))
        return opens | ~before.eqNullSafe(value)

    def before(column, bridge, w):
        return F.last(column, ignorenulls=True).over(w.rowsBetween(*ALL_BEFORE)) if bridge else F.lag(column).over(w)

    w = Window.partitionBy(*key, BLOCK).orderBy("__at")
    marked = rows.withColumns({"__opens": F.lag("__at").over(w).isNull(),
                               **{f"__p_{n}": before(f"__v_{n}", b, w) for n, (_, b) in values.items()}})
    # The first value of a block is not counted here, but below, against the block before.
    within = [e for n, (_, b) in values.items() for v, p in [(F.col(f"__v_{n}"), F.col(f"__p_{n}"))] for e in (
        F.count_if(p.isNotNull() & begins(v, p, True, None) if b else ~F.col("__opens") & begins(v, p, False, F.lit(False))).alias(f"__n_{n}"),
        F.min_by(v, F.when(v.isNotNull(), F.col("__at")) if b else F.col("__at")).alias(f"__f_{n}"),
        F.max_by(v, F.when(v.isNotNull(), F.col("__at")) if b else F.col("__at")).alias(f"__l_{n}"))]
    blocks = marked.groupBy(*key, BLOCK).agg(*within, *[plain[k](f"__a_{n}").alias(f"__a_{n}") for n, (k, _) in aggs.items()])
    w = Window.partitionBy(*key).orderBy(BLOCK)
    seen = blocks.withColumns({"__opens": F.lag(BLOCK).over(w).isNull(),
                               **{f"__p_{n}": before(f"__l_{n}", b, w) for n, (_, b) in values.items()}})
    return seen.groupBy(*key).agg(
        *[plain[k](f"__a_{n}").alias(n) for n, (k, _) in aggs.items()],
        *[F.sum(F.col(f"__n_{n}") + begins(F.col(f"__f_{n}"), F.col(f"__p_{n}"), b, F.col("__opens")).cast("int")).alias(n)
          for n, (_, b) in values.items()])


def number_runs(table: DataFrame, key, out: str = "run", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive number of each run within its key, from 0."""
    return number_rows(table, key, [F.col("first_row")], [block_of("first_row", block_rows)], out)


# --- joining a small per-key result back ---------------------------------------------------

def attach(rows: DataFrame, stats: DataFrame, key, how: str = "inner", spread: str | Column = ROW,
           last: str | None = None, block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join per-key results to the rows of the series, without moving the rows if possible.

    The per-key table is staged. Up to `broadcast_rows` rows and `broadcast_bytes` it is broadcast.
    Beyond that both sides carry a piece number, so that no key is collected in one task: the
    block of the position `spread`, or `spread` itself when it is a column expression. The
    per-key side is then repeated once per piece its key really has: from `last`, a column
    with the greatest position of the key (dropped), or from one pass over the rows.
    """
    key = as_list(key)
    stats = stage(stats)
    written = int(str(stats._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if written <= broadcast_bytes and stats.count() <= broadcast_rows:
        return join_null_safe(rows, stats.drop(last) if last is not None else stats, key, how, small=True)
    left = rows.withColumn("__piece", block_of(spread, block_rows) if isinstance(spread, str) else spread)
    if last is not None:
        right = stats.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), block_of(last, block_rows)))).drop(last)
    else:
        right = join_null_safe(left.select(*key, "__piece").distinct(), stats, key)
    return join_null_safe(left, right, [*key, "__piece"], how).drop("__piece")
