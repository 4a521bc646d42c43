"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits: four segments of 16 on a ring. If two differ in at most 3 bits, some segment starts a
chain in which, for every length l, the first l segments differ in at most l * 3/4 bits: 0, 1, 2 and 3. Candidates
are joined on the first two links of that chain (segment equal, next one within one bit, by writing out its 17
values on one side), so the join key has 32 bits; the third link is checked before the full distance.

Exact copies share a fingerprint and are joined as one row. A fingerprint has at most 43,744 others within 3 bits, so
links grow with the number of different fingerprints, never with the square of a group of copies.

Defined cases: null and empty texts, and texts of blanks, have fingerprint zero and are linked like any other; a
repeated row comes back as often as it is given; a null doc_id takes part but is never the smallest while another id
is reachable; documents that share a doc_id, or have none, are told apart by their texts; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import LongType

from depthlog.llm.components import components
from depthlog.operators.staging import stage

SEED, SHINGLE, BLOCK = 42, 3, 1 << 16
SEGMENT, NEAR = 16, 3


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the lower-cased word shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip([0] + ends, ends[size - 1:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at:at + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@pandas_udf(LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def links(fingerprints: DataFrame) -> DataFrame:
    """src < dst: pairs of different fingerprints (column fp) at most 3 bits apart; a pair may come more than once."""
    rings = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("start"), (F.col("fp") if not s else F.shiftleft("fp", SEGMENT * s).bitwiseOR(
            F.shiftrightunsigned("fp", 64 - SEGMENT * s))).alias("ring")) for s in range(4)])).alias("r")
    ).select("fp", "r.start", "r.ring")
    key = F.shiftrightunsigned("ring", 32).bitwiseOR(F.shiftleft(F.col("start").cast("long"), 32))
    keyed = rings.select("fp", "ring", key.alias("key"))
    near = F.explode(F.array(F.col("key"), *[F.col("key").bitwiseXOR(F.lit(1 << i)) for i in range(SEGMENT)]))
    a = keyed.select(F.col("fp").alias("src"), F.col("ring").alias("ring_a"), near.alias("key"))
    b = keyed.select(F.col("fp").alias("dst"), F.col("ring").alias("ring_b"), "key")
    third = F.bit_count(F.shiftrightunsigned(F.col("ring_a").bitwiseXOR(F.col("ring_b")), SEGMENT)) <= 2
    full = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= NEAR
    return a.join(b, [a["key"] == b["key"], a["src"] < b["dst"], third, full]).select("src", "dst")


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, fp and a hash of the text of every document."""
    return stage(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp"), F.xxhash64("text").alias("hash")))


def grouped(marked: DataFrame) -> DataFrame:
    """fp, component, first (without_id, doc_id, fp, hash: the smallest document) of every different fingerprint."""
    order = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "fp", "hash")
    distinct = stage(marked.groupBy("fp").agg(F.min(order).alias("first")))
    reached = components(links(distinct))
    return distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every document: the smallest doc_id reachable over links, itself included."""
    marked = marks(docs)
    named = grouped(marked)
    smallest = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    return marked.select("doc_id", "fp").join(named.join(smallest, "component").select("fp", "component_id"), "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id (null comes last), then
    fingerprint, then hash of the text; of its repeated rows one stays."""
    marked = marks(docs)
    held = stage(grouped(marked).groupBy("component").agg(F.min("first").alias("first"))
                 .select(*[F.col(f"first.{c}").alias(f"__{c}") for c in ("doc_id", "fp", "hash")]))
    here = [F.col("__id_here").eqNullSafe(F.col("__doc_id")), F.col("__hash_here") == F.col("__hash")]
    names = docs.columns
    # Rows of one id and text are found again by these; no fingerprint is made a second time.
    rows = docs.withColumns({"__id_here": F.col("doc_id"), "__hash_here": F.xxhash64("text")})
    repeated = stage(marked.groupBy(F.col("doc_id").alias("__id_here"), F.col("hash").alias("__hash_here"))
                     .agg(F.count("*").alias("__n")).filter("__n > 1").join(held, here, "left_semi")
                     .select(F.col("__id_here").alias("__again_id"), F.col("__hash_here").alias("__again_hash")))
    joined = rows.join(held, here)
    if not repeated.limit(1).count():
        return joined.select(*names)
    again = [F.col("__id_here").eqNullSafe(F.col("__again_id")), F.col("__hash_here") == F.col("__again_hash")]
    return (joined.join(repeated, again, "left_anti").select(*names)
            .unionByName(joined.join(repeated, again, "left_semi").dropDuplicates(["__id_here", "__hash_here"]).select(*names)))
