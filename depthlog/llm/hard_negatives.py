"""Hard-negative mining with exact integer scores by the method of the Four Russians.

A component x becomes the integer floor(256 * x). Candidates are held as bit planes: plane k of a vector is bit k of its
components (two's complement, so the top plane counts negatively), packed into one byte for each group of eight
dimensions. For each anchor and group the sums of all 256 subsets of its eight components are laid out once; a byte of a
plane is an index into them. A score is built plane by plane from the top: shift what is there, add the looked-up sums.

Rows are dealt in the order of (label, id) into blocks of candidates and blocks of anchors. A block of anchors meets
blocks of candidates as tiles, one row each: for the positives those whose labels overlap, for the negatives those that
are not wholly of one and the same label, so a pair of rows is scored about once. A tile sends on the best few of each
anchor only (of each positive's range in the second pass); a window over these finds the best of all. Nothing is
collected, and a tile's size does not depend on how labels are spread.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; of rows that repeat
an id one is taken (smallest label, then vector); shorter vectors count as if zeros followed; an empty vector scores 0;
if products could leave 64 bits, an error says so; an anchor without another row of its label has no row; an empty table
gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from depthlog.operators.series import rank_rows
from depthlog.operators.staging import stage

CANDIDATES, ANCHORS, SLICE = 4096, 256, 512
SCALE, DIMS = 256, 8
TILES_A_TASK = 32


def quantised(embeddings: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """id, label, q (integers of one length) of the rows that take part."""
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                             F.col(vector).cast("array<double>").alias("v"))
    sound = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = sound.select("id", F.struct("label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("q")).alias("row"))
    return stage(whole.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.q"))


def planes_of(q: np.ndarray, bits: int) -> np.ndarray:
    """(bits, rows, groups) bytes: bit j of a byte belongs to dimension j of its group."""
    shifts = np.arange(bits)[:, None, None]
    return np.packbits(((q[None] >> shifts) & 1).astype(np.uint8), axis=2, bitorder="little")


def subset_sums(q: np.ndarray, kind) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of eight components."""
    groups = q.shape[1] // DIMS
    out = np.zeros((groups, 1 << DIMS, len(q)), kind)
    for g in range(groups):
        for j in range(DIMS):
            out[g, 1 << j:2 << j] = out[g, :1 << j] + q[:, g * DIMS + j].astype(kind)
    return out


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(candidates, anchors): lookups are added, what is there is shifted, plane by plane from the sign down."""
    bits, rows, groups = planes.shape
    out = np.zeros((rows, sums.shape[2]), sums.dtype)
    for start in range(0, rows, SLICE):
        part = planes[:, start:start + SLICE]
        total = out[start:start + SLICE]
        found = np.empty_like(total)
        for k in range(bits - 1, -1, -1):
            total += total
            for g in range(groups):
                np.take(sums[g], part[k, :, g], axis=0, out=found)
                if k == bits - 1:
                    total -= found
                else:
                    total += found
    return out


def best(points: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and candidate of the k largest points of each anchor (rows) among the allowed ones; of equal points the
    earlier column comes first."""
    n = points.shape[1]
    keys = np.where(ok, points.astype(np.int64) * n + np.arange(n - 1, -1, -1), np.iinfo(np.int64).min)
    cols = np.argpartition(keys, n - k, axis=1)[:, n - k:] if n > k else np.broadcast_to(np.arange(n), (len(points), n))
    rows = np.repeat(np.arange(len(points)), cols.shape[1])
    cols = cols.ravel()
    there = ok[rows, cols]
    return rows[there], cols[there]


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """block, low, high (labels), members (id, label, q; by id) of the rows in the order of label and id."""
    block = F.floor(F.col("at") / size)
    return (rank_rows(rows, [], ["label", "id"], "at").groupBy(block.alias("block"))
            .agg(F.min("label").alias("low"), F.max("label").alias("high"),
                 F.sort_array(F.collect_list(F.struct("id", "label", "q"))).alias("members")))


def packed(members, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components of one block, padded with zeros to `width`."""
    q = np.zeros((len(members), width), np.int64)
    for at, m in enumerate(members):
        q[at, :len(m["q"])] = m["q"]
    return np.array([m["id"] for m in members], np.int64), np.array([m["label"] for m in members], np.int64), q


class Miner:
    """Blocks of one table and the two passes over its tiles."""

    def __init__(self, embeddings: DataFrame, anchors: str, id_column: str, vector: str, label: str):
        rows = quantised(embeddings, id_column, vector, label)
        value = F.array_max(F.transform("q", lambda x: F.greatest(x, -x - 1)))
        wide, largest = rows.select(F.max(F.size("q")), F.max(value)).first()
        self.width = max(1, -(-(wide or 0) // DIMS)) * DIMS
        self.bits = int(largest or 0).bit_length() + 1
        limit = self.width << (2 * self.bits - 2)
        if self.bits > 40 or limit * CANDIDATES >= 1 << 63:
            raise ValueError(f"components of {self.bits} bits in {self.width} dimensions can leave 64-bit scores")
        self.kind = np.int32 if limit < 1 << 30 else np.int64
        self.spark = rows.sparkSession
        self.candidates = stage(self._planes(in_blocks(rows, CANDIDATES)))
        chosen = in_blocks(rows.filter(anchors), ANCHORS)
        self.anchors = stage(self._values(chosen))
        self.n_anchors = self.anchors.count()

    def _planes(self, blocks: DataFrame) -> DataFrame:
        width, bits = self.width, self.bits

        def run(batches):
            for b in batches:
                for at, low, high, members in zip(b["block"], b["low"], b["high"], b["members"]):
                    ids, labels, q = packed(members, width)
                    yield pd.DataFrame({"block": [at], "low": [low], "high": [high], "ids": [ids.tobytes()],
                                        "labels": [labels.tobytes()], "planes": [planes_of(q, bits).tobytes()]})

        return blocks.mapInPandas(run, "block bigint, low bigint, high bigint, ids binary, labels binary, planes binary")

    def _values(self, blocks: DataFrame) -> DataFrame:
        width = self.width

        def run(batches):
            for b in batches:
                for at, low, high, members in zip(b["block"], b["low"], b["high"], b["members"]):
                    ids, labels, q = packed(members, width)
                    yield pd.DataFrame({"a": [at], "a_low": [low], "a_high": [high], "a_ids": [ids.tobytes()],
                                        "a_labels": [labels.tobytes()], "a_values": [q.tobytes()]})

        return blocks.mapInPandas(run, "a bigint, a_low bigint, a_high bigint, a_ids binary, a_labels binary, a_values binary")

    def tiles(self, same: bool, more: DataFrame | None = None) -> DataFrame:
        """One row for each block of anchors and block of candidates that may hold pairs of one label (or of two)."""
        if not self.n_anchors:
            return None
        heads = self.anchors.select("a", "a_low", "a_high")
        pairs = (self.candidates.select("block", "low", "high", F.explode(F.expr(f"sequence(0L, {self.n_anchors - 1}L)")).alias("a"))
                 .join(heads, "a"))
        if same:
            wanted = pairs.filter("low <= a_high AND a_low <= high")
        else:
            wanted = pairs.filter("NOT (low = high AND a_low = a_high AND low = a_low)")
        chosen = stage(wanted.select("a", "block"))
        n = chosen.count()
        # Enough tasks that a batch of tiles stays small, and no fewer than the session asks for.
        tasks = max(1, min(n, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TILES_A_TASK))))
        met = chosen.join(self.anchors.drop("a_low", "a_high"), "a").join(self.candidates.drop("low", "high"), "block")
        return (met if more is None else met.join(more, "a")).repartition(tasks, "a", "block")

    def unpack(self, row):
        """Anchor ids, labels, candidate ids, labels, scores (anchors in rows) of one tile."""
        a_ids, a_labels = np.frombuffer(row.a_ids, np.int64), np.frombuffer(row.a_labels, np.int64)
        ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        values = np.frombuffer(row.a_values, np.int64).reshape(len(a_ids), self.width)
        planes = np.frombuffer(row.planes, np.uint8).reshape(self.bits, len(ids), self.width // DIMS)
        return a_ids, a_labels, ids, labels, np.ascontiguousarray(scores(planes, subset_sums(values, self.kind)).T)


class Tile:
    """What a task needs to read a tile (a Miner holds DataFrames and cannot travel)."""

    unpack = Miner.unpack

    def __init__(self, miner: Miner):
        self.width, self.bits, self.kind = miner.width, miner.bits, miner.kind


def positives(miner: Miner, k: int) -> DataFrame:
    """a, anchor_id, positive_id, positive_score: the first k other rows of the anchor's label."""
    tile = Tile(miner)

    def run(batches):
        for b in batches:
            for row in b.itertuples():
                a_ids, a_labels, ids, labels, points = tile.unpack(row)
                rows, cols = best(points, (a_labels[:, None] == labels) & (a_ids[:, None] != ids), k)
                yield pd.DataFrame({"a": row.a, "anchor_id": a_ids[rows], "positive_id": ids[cols],
                                    "positive_score": points[rows, cols].astype(np.int64)})

    found = miner.tiles(True).mapInPandas(run, "a bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return stage(found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).drop("place"))


def mine(embeddings: DataFrame, anchors: str = "id % 50 = 0", n_positives: int = 5, n_negatives: int = 3,
         low: int = 50, high: int = 95, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive the first
    negatives whose score is between `low` and `high` percent of the positive's."""
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    miner = Miner(embeddings, anchors, id_column, vector, label)
    if not miner.n_anchors:
        return miner.spark.createDataFrame([], schema).select("anchor_id", "positive_id", F.lit(1).alias("rank"), "negative_id", "positive_score", "negative_score")
    pairs = positives(miner, n_positives).groupBy("a").agg(
        F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("wanted"))
    tile = Tile(miner)

    def run(batches):
        for b in batches:
            for row in b.itertuples():
                a_ids, a_labels, ids, labels, points = tile.unpack(row)
                anchor = np.array([w["anchor_id"] for w in row.wanted], np.int64)
                positive = np.array([w["positive_id"] for w in row.wanted], np.int64)
                score = np.array([w["positive_score"] for w in row.wanted], np.int64)
                at = np.searchsorted(a_ids, anchor)  # ids of a block are in order
                for start in range(0, len(at), ANCHORS):
                    some = slice(start, start + ANCHORS)
                    p, mine_at = score[some, None], at[some]
                    there = points[mine_at].astype(np.int64)
                    ok = (a_labels[mine_at, None] != labels) & (low * p <= 100 * there) & (100 * there <= high * p)
                    rows, cols = best(there, ok, n_negatives)
                    yield pd.DataFrame({"anchor_id": anchor[some][rows], "positive_id": positive[some][rows],
                                        "positive_score": score[some][rows], "negative_id": ids[cols],
                                        "negative_score": there[rows, cols]})

    found = miner.tiles(False, pairs).mapInPandas(run, schema)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n_negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def turned_labels(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The table with the label of every seventh id moved on by one."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", moved.alias("label"))
