"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node, named by their smallest id; each keeps its smallest ids (as many as a result may need), so
copies never meet one another. Unequal norms are evened out by one more component (square root of what is missing to
the largest norm), so that the graph of large inner products is a graph of near points. That component is never
rounded beside the products: what it lacks to one is used instead, which is small when the norm is.

The graph starts from blocks of vectors that are neighbours in the order of random sign codes of their directions. A round joins every
node with its neighbours' neighbours: the members of a node's neighbourhood (neighbours both ways) meet there with
their vectors, and a pair is passed on if it beats the weakest neighbour of one of the two and one of its edges is
new. Nodes with many incoming edges are dealt into blocks, each with all outgoing ones, so no neighbourhood is large.

A query starts from its own node and a few fixed entry nodes (the longest vectors, and some by hash), and expands the
best unexpanded nodes of its beam until all are expanded. Vectors travel as directions in half precision and a norm in
double precision, and similarities are summed in single precision; the beam's final scores are sums of products in
double precision of the original vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, neither do rows
without an id; of rows that repeat an id one is taken (the smallest vector); all vectors must have one length; a query
has fewer than k results only if there are fewer candidates; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlog.operators.staging import stage

DEGREE, TABLES, BLOCK, BITS, HUB = 36, 8, 192, 24, 48
BEAM, EXPAND, ENTRIES = 128, 32, 8
SEED = 11


def usable(embeddings: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id, vec (array<double>) of the vectors that take part."""
    v = F.col("vec")
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    sound = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                        & F.exists(v, lambda x: x != 0))
    return sound.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (vec_id, node) of all vectors, nodes (node, vec) of the different ones."""
    marks = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(SEED), "vec").alias("h2")]
    marked = vectors.select("vec_id", "vec", *marks)
    firsts = stage(marked.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "vec")).alias("first"))
                   .select("h1", "h2", F.col("first.vec_id").alias("node"), F.col("first.vec").alias("vec")))
    members = stage(marked.select("vec_id", "h1", "h2").join(firsts.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node"))
    return members, firsts.select("node", "vec")


def levelled(nodes: DataFrame) -> DataFrame:
    """node, v: bytes of the norm as a share of the largest (double) and of the direction (half precision)."""
    largest = nodes.select(F.max(F.sqrt(dot(F.col("vec"), F.col("vec"))))).first()[0] or 1.0

    def scaled(batches):
        for b in batches:
            x = np.vstack(b["vec"])
            norms = np.sqrt((x * x).sum(axis=1))
            directions = (x / np.where(norms > 0, norms, 1)[:, None]).astype(np.float16)
            yield pd.DataFrame({"node": b["node"], "v": [n.tobytes() + r.tobytes() for n, r in zip(norms / largest, directions)]})

    return nodes.mapInPandas(scaled, "node bigint, v binary")


def unpacked(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Directions (single precision) and norms (double)."""
    raw = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)
    return np.ascontiguousarray(raw[:, 8:]).view(np.float16).astype(np.float32), np.ascontiguousarray(raw[:, :8]).view(np.float64)[:, 0]


def similarities(vectors) -> np.ndarray:
    """Inner products of all levelled pairs less one; none of a vector with itself. With a and b what the extra
    components lack to one, their product less one is a * b - a - b."""
    x, norms = unpacked(vectors)
    scaled = x * norms[:, None].astype(np.float32)
    lack = norms * norms / (1 + np.sqrt(np.maximum(0, 1 - norms * norms)))
    lack = lack.astype(np.float32)
    sims = scaled @ scaled.T + (lack[:, None] * lack - lack[:, None] - lack)
    np.fill_diagonal(sims, -np.inf)
    return sims


def best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest finite entries."""
    k = min(k, sims.shape[1])
    cols = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(sims)), k)
    cols = cols.ravel()
    ok = np.isfinite(sims[rows, cols])
    return rows[ok], cols[ok]


def strongest(edges: DataFrame, degree: int) -> DataFrame:
    """The `degree` largest edges of each node; what each task has is cut to that number before the shuffle."""
    w = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    return edges.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= degree).drop("place")


def first_graph(points: DataFrame, degree: int) -> DataFrame:
    """node, nbr, sim, fresh from blocks of neighbours in the order of random sign codes."""
    def codes(batches):
        for b in batches:
            x, _ = unpacked(b["v"].tolist())
            for t in range(TABLES):
                signs = x @ np.random.default_rng(SEED + t).normal(size=(x.shape[1], BITS)).astype(np.float32) > 0
                yield pd.DataFrame({"t": t, "code": signs @ (1 << np.arange(BITS)), "node": b["node"], "v": b["v"]})

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        sims, ids = similarities(rows["v"].tolist()), rows["node"].to_numpy()
        a, c = best(sims, degree)
        return pd.DataFrame({"node": ids[a], "nbr": ids[c], "sim": sims[a, c]})

    def blocks(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            while len(held) >= 2 * BLOCK or (len(held) and held["t"].iloc[0] != held["t"].iloc[-1]):
                same = int((held["t"] == held["t"].iloc[0]).sum())
                size = BLOCK if same >= 2 * BLOCK else same
                yield met(held.iloc[:size])
                held = held.iloc[size:].reset_index(drop=True)
        if held is not None and len(held):
            yield met(held)

    sorted_codes = (points.mapInPandas(codes, "t int, code bigint, node bigint, v binary")
                    .repartitionByRange("t", "code", "node").sortWithinPartitions("t", "code", "node"))
    found = sorted_codes.mapInPandas(blocks, "node bigint, nbr bigint, sim float")
    once = found.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    return stage(strongest(once, degree).withColumn("fresh", F.lit(1)))


def descend(points: DataFrame, graph: DataFrame, degree: int) -> DataFrame:
    """One round of NN-descent: the graph with better edges; `fresh` marks those it did not have."""
    incoming = graph.groupBy(F.col("nbr").alias("centre")).agg(F.count("*").alias("n"))
    parts = incoming.select("centre", F.ceil(F.col("n") / HUB).cast("int").alias("parts"))
    back = graph.select(F.col("nbr").alias("centre"), F.col("node").alias("member"), "fresh").join(parts, "centre").select(
        "centre", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "member", "fresh")
    out = graph.select(F.col("node").alias("centre"), F.col("nbr").alias("member"), "fresh").join(parts, "centre", "left").select(
        "centre", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "member", "fresh")
    weakest = graph.groupBy("node").agg(F.min("sim").alias("least"), F.count("*").alias("n")).select(
        F.col("node").alias("member"), F.when(F.col("n") >= degree, F.col("least")).otherwise(float("-inf")).alias("least"))
    known = points.withColumnRenamed("node", "member").join(weakest, "member", "left")
    met = (back.union(out).groupBy("centre", "part", "member").agg(F.max("fresh").alias("fresh"))
           .join(known, "member").groupBy("centre", "part")
           .agg(F.collect_list(F.struct("member", "fresh", "least", "v")).alias("members"))
           .filter(F.exists("members", lambda m: m["fresh"] == 1)))

    def pairs(batches):
        for b in batches:
            out = []
            for members in b["members"]:
                ids = np.array([m["member"] for m in members])
                fresh = np.array([m["fresh"] for m in members], bool)
                least = np.array([-np.inf if m["least"] is None else m["least"] for m in members], np.float32)
                sims = similarities([m["v"] for m in members])
                ok = (sims > least[:, None]) & (fresh[:, None] | fresh)
                a, c = np.nonzero(ok)
                out.append((ids[a], ids[c], sims[a, c]))
            if out:
                a, c, s = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"node": a, "nbr": c, "sim": s}).drop_duplicates(["node", "nbr"])

    new = met.select("members").mapInPandas(pairs, "node bigint, nbr bigint, sim float").withColumn("fresh", F.lit(1))
    old = graph.withColumn("fresh", F.lit(0))
    once = new.unionByName(old).groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return stage(strongest(once, degree))


def build_graph(points: DataFrame, degree: int = DEGREE, rounds: int = 8, enough: float = 0.005) -> DataFrame:
    """node, nbr of the points (staged): rounds of NN-descent until fewer than `enough` of the edges are new; then each
    node is also linked from its strongest neighbours, so that one which is nobody's neighbour can be found."""
    graph = first_graph(points, degree)
    for _ in range(rounds):
        graph = descend(points, graph, degree)
        fresh, all_edges = graph.select(F.sum("fresh"), F.count("*")).first()
        if (fresh or 0) <= enough * all_edges:
            break
    back = strongest(graph.select("node", "nbr", "sim"), degree // 2).select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))
    return stage(graph.select("node", "nbr").union(back).distinct())


def greedy(points: DataFrame, graph: DataFrame, asked: DataFrame, entries: list[int]) -> DataFrame:
    """q, at: the beam of each asked node (column q) when all of it is expanded. Each round expands the best ones of the
    beam that are not, and is one staged table."""
    def products(batches):
        for b in batches:
            (x, norms), (y, _) = unpacked(b["v"].tolist()), unpacked(b["w"].tolist())  # the query's norm changes no order
            yield pd.DataFrame({"q": b["q"], "at": b["at"], "score": ((x * y).sum(axis=1) * norms).astype(np.float32)})

    wanted = stage(points.join(asked.select(F.col("q").alias("node")), "node", "left_semi").select(F.col("node").alias("q"), F.col("v").alias("w")))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(points.withColumnRenamed("node", "at"), "at").join(wanted, "q")
        return met.select("q", "at", "v", "w").mapInPandas(products, "q bigint, at bigint, score float").withColumn("done", F.lit(False))

    def beam(state: DataFrame) -> DataFrame:
        by_score = Window.partitionBy("q").orderBy(F.desc("score"), "at")
        left = Window.partitionBy("q").orderBy("done", F.desc("score"), "at")
        best_ones = state.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= BEAM).drop("place")
        return stage(best_ones.withColumn("todo", ~F.col("done") & (F.row_number().over(left) <= EXPAND)))

    state = beam(scored(asked.select("q", F.explode(F.array_distinct(F.array(F.col("q"), *map(F.lit, entries)))).alias("at"))))
    while state.filter("todo").limit(1).count():
        reached = (state.filter("todo").select("q", F.col("at").alias("node")).join(graph, "node").select("q", F.col("nbr").alias("at"))
                   .distinct().join(state.select("q", "at"), ["q", "at"], "left_anti"))
        state = beam(state.select("q", "at", "score", (F.col("done") | F.col("todo")).alias("done")).unionByName(scored(reached)))
    return state.select("q", "at")


def search(members: DataFrame, nodes: DataFrame, points: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query (query_id), itself left out.

    Queries with equal vectors are searched once; the beam is scored anew in double precision."""
    asked = stage(queries.join(members.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "node"))
    by_norm = F.desc(dot(F.col("vec"), F.col("vec")))
    entries = [r["node"] for order in (F.xxhash64("node"), by_norm) for r in nodes.select("node", "vec").orderBy(order, "node")
               .limit(ENTRIES).select("node").collect()]
    found = greedy(points, graph, asked.select(F.col("node").alias("q")).distinct(), entries)
    exact = (found.join(nodes.select(F.col("node").alias("at"), "vec"), "at")
             .join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("q_vec")), "q")
             .select("q", "at", dot(F.col("q_vec"), F.col("vec")).alias("score")))
    w = Window.partitionBy("node").orderBy("vec_id")
    smallest = members.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1).select(F.col("node").alias("at"), "vec_id")
    ranked = exact.join(smallest, "at").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    shortlist = ranked.filter(F.col("place") <= k + 1).select("q", "vec_id", "score")
    answers = asked.withColumnRenamed("node", "q").join(shortlist, "q").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """search() for the rows whose id is divisible by `every`, on a graph of all rows."""
    members, nodes = classes(usable(embeddings))
    points = stage(levelled(nodes))
    queries = members.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"))
    return search(members, nodes, points, build_graph(points), queries, k)
