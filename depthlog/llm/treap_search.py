"""Ranked lexical search on K2-treaps of the grid of terms and documents.

The grid has a row for each term and a column for each document; a cell holds the term's share in the document's score
without its weight: (10^9 * tf) div (1000 * tf + 12 * m). Documents are dealt into blocks of columns, in the order of
doc_id inside a block. A block's grid is cut in four again and again; a quadrant that holds something is a cell of the
next level and keeps the largest value in it. The levels are kept as bits (which quadrants of a cell hold something) and
as differences to the maximum of the cell above.

For an item every term is a row. The paths of all its rows go down together: a node is a range of columns with one cell
for each row, and its bound is the sum of the cells' maxima times the terms' weights. Nodes are expanded best bound first,
and the search of a block ends when no bound can enter the best k. At a single column the sum is the exact score.

Above the blocks the maxima of a term's row in each block give bounds in the same way: an item is first searched in its
best block; the score of its k-th document is the threshold below which other blocks are left out, and nodes inside the
others. The terms of the items are the only rows kept; other terms count in lengths. Up to `TABLE_ROWS` terms (and
`TABLE_BYTES`) go to the tasks that read the texts as a table; beyond that, terms of documents and items are joined.

Defined cases: a null or empty text has no terms; an item without terms, or whose terms no document has, has no row; each
row of either table is a document or an item of its own, whatever its id; null ids are kept, as documents before all
others of equal score; extra columns are never read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from depthlog.operators.series import rank_rows
from depthlog.operators.staging import stage

BLOCK_DOCS, BLOCK_CELLS = 2048, 1 << 20
TABLE_ROWS, TABLE_BYTES = 400_000, 8 << 20
ITEMS_A_ROW, ROWS_A_TASK, EXPAND = 64, 16, 64

#: Bytes that part terms become blanks, A-Z become small; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


# --- counting -------------------------------------------------------------------------------

def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (one number for each row), item_id, term, count."""
    def run(batches):
        for b in batches:
            rows = [(at, t.decode(), n) for at, text in enumerate(b["text"].to_pylist()) for t, n in Counter(terms_of(text)).items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b["item"].take(at), b["item_id"].take(at), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item", "item_id", "term", "count"])

    kind = items.schema[item_id].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return numbered.mapInArrow(run, f"item bigint, item_id {kind}, term string, count bigint")


def count_terms(docs: DataFrame, vocabulary: DataFrame, doc_id: str, text: str, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc, doc_id, n (terms with repeats), rows and tfs (of the vocabulary's terms in the document) of documents with a term."""
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, size = vocabulary.select(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if rows <= table_rows and size <= TABLE_BYTES:
        table = {r["term"].encode(): r["row"] for r in vocabulary.collect()}

        def counted(batches):
            for b in batches:
                out = []
                for text in b["text"].to_pylist():
                    found = terms_of(text)
                    seen = Counter(t for t in found if t in table)
                    out.append((len(found), [table[t] for t in seen], list(seen.values())))
                numbers = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b["doc"], b["doc_id"], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], numbers),
                     pa.array([o[2] for o in out], numbers)], ["doc", "doc_id", "n", "rows", "tfs"])

        return source.mapInArrow(counted, f"doc bigint, doc_id {kind}, n bigint, rows array<bigint>, tfs array<bigint>").filter("n > 0")

    def postings(batches):
        for b in batches:
            for at, text in enumerate(b["text"].to_pylist()):
                found = terms_of(text)
                seen = Counter(found)
                if seen:  # one document at a time
                    same = pa.array([at] * len(seen), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b["doc"].take(same), b["doc_id"].take(same), pa.array([len(found)] * len(seen), pa.int64()),
                         pa.array([t.decode() for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                        ["doc", "doc_id", "n", "term", "tf"])

    exploded = source.mapInArrow(postings, f"doc bigint, doc_id {kind}, n bigint, term string, tf bigint")
    met = exploded.join(vocabulary, "term", "left")
    cells = F.filter(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "tf"))), lambda c: c.isNotNull())
    return met.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), cells.alias("cells")).select(
        "doc", "doc_id", "n", F.col("cells.row").alias("rows"), F.col("cells.tf").alias("tfs"))


# --- the treap of a block -------------------------------------------------------------------

def interleaved(rows: np.ndarray, cols: np.ndarray, levels: int) -> np.ndarray:
    """Morton codes, the bit of the row before that of the column."""
    code = np.zeros(len(rows), np.int64)
    for bit in range(levels):
        code |= ((rows >> bit & 1) << (2 * bit + 1)) | ((cols >> bit & 1) << (2 * bit))
    return code


def build(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, levels: int) -> tuple[bytes, bytes]:
    """(bits, differences) of a grid of 2^levels rows and columns, level by level from the top."""
    code = interleaved(rows, cols, levels)
    order = np.argsort(code, kind="stable")
    code, largest = code[order], values[order].astype(np.int32)
    bits, steps = [], []
    for _ in range(levels):
        above = code >> 2
        starts = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
        parent = np.cumsum(np.r_[False, above[1:] != above[:-1]])
        quadrants = np.zeros((len(starts), 4), np.uint8)
        quadrants[parent, code & 3] = 1
        top = np.maximum.reduceat(largest, starts)
        bits.append(quadrants.ravel())
        steps.append(top[parent] - largest)
        code, largest = above[starts], top
    steps.append(largest)  # the root's maximum itself
    return np.packbits(np.concatenate(bits[::-1])).tobytes(), np.concatenate(steps[::-1]).astype(np.int32).tobytes()


class Treap:
    """A block's treap, opened for searches: cells are numbered level by level."""

    def __init__(self, bits: bytes, steps: bytes, levels: int):
        steps = np.frombuffer(steps, np.int32)
        self.levels = levels
        largest = [steps[:1]]
        at, there = 1, 1
        flags = np.unpackbits(np.frombuffer(bits, np.uint8))
        seen = 0
        for _ in range(levels):
            held = flags[4 * seen:4 * (seen + there)].reshape(-1, 4)
            seen += there
            parent = np.repeat(np.arange(there), held.sum(axis=1, dtype=np.int64))
            largest.append(largest[-1][parent] - steps[at:at + len(parent)])
            at, there = at + len(parent), len(parent)
        set_bits = flags[:4 * seen]
        self.child = np.where(set_bits, np.cumsum(set_bits, dtype=np.int32), -1)  # the n-th set bit is cell n
        self.largest = np.append(np.concatenate(largest), 0).astype(np.int64)  # the last one stands for no cell

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the k best (ties: smaller column) with a score of at least `least`."""
        cells = np.zeros((1, len(rows)), np.int64)
        depth, first, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), self.largest[cells] @ weights
        found_cols, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            if len(found) == k:
                alive = (bound > found[-1]) | ((bound == found[-1]) & (first < found_cols[-1]))
            else:
                alive = bound >= least
            if not alive.all():
                cells, depth, first, bound = cells[alive], depth[alive], first[alive], bound[alive]
            if not len(bound):
                break
            if len(bound) > EXPAND:
                order = np.argpartition(-bound, EXPAND - 1)
                now, later = order[:EXPAND], order[EXPAND:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            single = depth[now] == self.levels
            if single.any():
                done = now[single]
                cols, scores = np.r_[found_cols, first[done]], np.r_[found, bound[done]]
                keep = np.lexsort((cols, -scores))[:k]
                found_cols, found = cols[keep], scores[keep]
            now = now[~single]
            half = self.levels - 1 - depth[now]
            row_bit = (rows[None, :] >> half[:, None]) & 1
            base = cells[now] * 4 + 2 * row_bit
            parts = [(cells[later], depth[later], first[later], bound[later])]
            for side in (0, 1):
                down = np.where(cells[now] >= 0, self.child[np.where(cells[now] >= 0, base + side, 0)], -1)
                sums = self.largest[down] @ weights
                some = sums >= least
                parts.append((down[some], depth[now][some] + 1, first[now][some] + (side << half[some]), sums[some]))
            cells, depth, first, bound = (np.concatenate(x) for x in zip(*parts))
        return found_cols, found


def index(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """block, doc_ids, rows (term numbers in order), tops (their maxima), levels, bits, steps: the index as a table."""
    kind = counted.schema["doc_id"].dataType.simpleString()

    def packed(block, parts):
        docs = pa.Table.from_batches(parts).combine_chunks()
        docs = docs.take(pc.sort_indices(docs, [("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
        column = lambda c: docs[c].combine_chunks()
        rows, tf = (column(c).flatten().to_numpy() for c in ("rows", "tfs"))
        cols = np.repeat(np.arange(len(docs)), pc.list_value_length(column("rows")).to_numpy())
        m = 100 - 25 + 25 * column("n").to_numpy() * n_docs // n_terms
        values = 1_000_000_000 * tf // (1000 * tf + 12 * m[cols])
        names, at = np.unique(rows, return_inverse=True)
        tops = np.zeros(len(names), np.int64)
        np.maximum.at(tops, at, values)
        levels = max(1, int(max(len(names), len(docs)) - 1).bit_length())
        bits, steps = build(at, cols, values, levels)
        ids = column("doc_id")
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([names], pa.list_(pa.int64())), pa.array([tops], pa.list_(pa.int64())), pa.array([levels], pa.int32()),
             pa.array([bits], pa.binary()), pa.array([steps], pa.binary())], ["block", "doc_ids", "rows", "tops", "levels", "bits", "steps"])

    def run(batches):
        from pyspark import TaskContext
        number, held, docs, cells = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            start = 0
            for at, size in enumerate(pc.list_value_length(b["rows"]).to_pylist()):
                if docs and (docs >= BLOCK_DOCS or cells + size > BLOCK_CELLS):
                    yield packed(number, [*held, b.slice(start, at - start)])
                    number, held, start, docs, cells = number + 1, [], at, 0, 0
                docs, cells = docs + 1, cells + size
            held.append(b.slice(start))
        if docs:
            yield packed(number, held)

    return (counted.filter(F.size("rows") > 0).select("doc_id", "n", "rows", "tfs")
            .mapInArrow(run, f"block bigint, doc_ids array<{kind}>, rows array<bigint>, tops array<bigint>, levels int, bits binary, steps binary"))


# --- searching ------------------------------------------------------------------------------

def search_blocks(blocks: DataFrame, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each (item, block, least) asked for, in that block."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    n = asked.count()
    spark = blocks.sparkSession
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (ROWS_A_TASK * ITEMS_A_ROW)))))
    rows = (asked.join(queries, "item").groupBy("block", F.pmod(F.xxhash64("item"), F.lit(1 << 30)).alias("h"))
            .agg(F.collect_list(F.struct("item", "least", "rows", "weights")).alias("items")))
    # A block's items travel in rows of about ITEMS_A_ROW, however many they are.
    many = asked.groupBy("block").agg(F.ceil(F.count("*") / ITEMS_A_ROW).alias("parts"))
    dealt = (rows.join(many, "block").groupBy("block", F.pmod("h", F.col("parts")).alias("part"))
             .agg(F.flatten(F.collect_list("items")).alias("items")))

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                treap = Treap(b["bits"][at].as_py(), b["steps"][at].as_py(), b["levels"][at].as_py())
                names, ids = b["rows"][at].values.to_numpy(), b["doc_ids"][at].values
                for item in b["items"][at].as_py():
                    wanted, weights = np.array(item["rows"], np.int64), np.array(item["weights"], np.int64)
                    place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                    here = names[place] == wanted
                    cols, scores = treap.search(place[here], weights[here], k, item["least"])
                    yield pa.RecordBatch.from_arrays([pa.array([item["item"]] * len(cols), pa.int64()), ids.take(pa.array(cols)),
                                                      pa.array(scores)], ["item", "doc_id", "score"])

    met = dealt.join(blocks.select("block", "doc_ids", "rows", "levels", "bits", "steps"), "block")
    return met.repartition(tasks, "block", "part").select("items", "doc_ids", "rows", "levels", "bits", "steps").mapInArrow(
        run, f"item bigint, doc_id {kind}, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           table_rows: int = TABLE_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    asked = stage(item_terms(items, item_id, text))
    vocabulary = stage(rank_rows(asked.select("term").distinct(), [], ["term"], "row"))
    counted = stage(count_terms(docs, vocabulary, doc_id, text, table_rows))
    n_docs, n_terms = counted.select(F.count("*"), F.sum("n")).first()
    df = counted.select(F.explode("rows").alias("row")).groupBy("row").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    terms = stage(asked.join(vocabulary, "term").join(df, "row").select("item", "row", (weight * F.col("count")).alias("weight"))
                  .filter("weight > 0"))
    blocks = stage(index(counted, n_docs, n_terms or 1))
    queries = stage(terms.groupBy("item").agg(F.collect_list("row").alias("rows"), F.collect_list("weight").alias("weights")))
    tops = blocks.select("block", F.explode(F.arrays_zip("rows", "tops")).alias("c")).select("block", "c.rows", "c.tops")
    bounds = stage(terms.join(tops.withColumnRenamed("rows", "row"), "row").groupBy("item", "block")
                   .agg(F.sum(F.col("weight") * F.col("tops")).alias("bound")))
    best = bounds.groupBy("item").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    first = stage(search_blocks(blocks, best.withColumn("least", F.lit(1).cast("bigint")), queries, k))
    floor = first.groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(1)).cast("bigint").alias("least"))
    others = stage(bounds.join(best, ["item", "block"], "left_anti").join(floor, "item", "left")
                   .withColumn("least", F.coalesce("least", F.lit(1).cast("bigint"))).filter("bound >= least").select("item", "block", "least"))
    second = search_blocks(blocks, others, queries, k)
    names = asked.select("item", "item_id").distinct()
    return (ranked(first.unionByName(second), k).join(names, "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
