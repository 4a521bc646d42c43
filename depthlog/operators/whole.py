"""Statistics of whole keys in one task, for the keys that fit one; the others are split off for a way that cuts them.

Rows travel once, by key, as their numbers; numpy then works on the rows of many keys at a time. A key of more than
`most` rows never comes here, and the number of tasks follows the rows, so the memory of a task does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from depthlog.operators.series import BLOCK_ROWS, enough_tasks, join_null_safe
from depthlog.operators.staging import stage

SLAB_ROWS = 1 << 17  # rows of complete keys that numpy gets at a time


def split_keys(df: DataFrame, key: Sequence[str], most: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of the keys of at most `most` rows, the rows of all others (None if there are none), and the number of the former."""
    sizes = stage(df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")))
    heavy = F.col("__n") > most
    light, many = sizes.agg(F.coalesce(F.sum(F.when(~heavy, F.col("__n"))), F.lit(0)), F.count_if(heavy)).first()
    if not many:
        return df, None, light
    apart = sizes.filter(heavy).select(*key)  # no more keys than rows / most
    return (join_null_safe(df, apart, key, "left_anti", small=True), join_null_safe(df, apart, key, "left_semi", small=True), light)


def per_key(df: DataFrame, key: Sequence[str], columns: Sequence, out: str, rows: int,
            make: Callable[[np.ndarray, int, list[tuple]], dict[str, pa.Array]]) -> DataFrame:
    """The key and the columns `out`, one row per key, of which `df` holds `rows` rows in all.

    `make` gets the number of each row's key (ascending from 0), how many keys there are, and of each column: the values as
    doubles, whether they are known, the places of the known ones by key and value, and which of these differ from the one
    before (NaN is last and equals NaN). It returns the columns of `out`, one entry per key."""
    key, size, most = list(key), len(columns), SLAB_ROWS
    slim = df.select(*key, *[(c.cast("double") + 0.0).alias(f"__x{i}") for i, c in enumerate(columns)])
    together = slim.repartition(*enough_tasks(df.sparkSession, rows), *key).sortWithinPartitions(*key)
    fields = [f for f in together.schema.fields if f.name in key]
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields] + StructType.fromDDL(out).fields)

    def begins(table):
        """Places at which another key begins."""
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in key:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def cells(column, group):
        x, known = column.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(known)
        at = at[np.lexsort((x[at], group[at]))]
        new = np.ones(len(at), bool)
        g, v = group[at], x[at]
        new[1:] = (g[1:] != g[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
        return x, known, at, new

    def made(table, first):
        group = np.repeat(np.arange(len(first)), np.diff([*first, table.num_rows]))
        found = make(group, len(first), [cells(table.column(f"__x{i}").combine_chunks(), group) for i in range(size)])
        keys = table.select(key).take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[keys.column(k).combine_chunks() for k in key], *found.values()], names=[*key, *found])

    def run(batches):
        held, n, limit = [], 0, most
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= limit:
                table = pa.Table.from_batches(held)
                first = begins(table)
                last = int(first[-1])  # the last key may go on in the next batch
                if last:
                    yield made(table.slice(0, last), first[:-1])
                held, n = table.slice(last).to_batches(), n - last
                limit = max(most, 2 * n)
        if n:
            table = pa.Table.from_batches(held)
            yield made(table, begins(table))

    return together.mapInArrow(run, schema)
