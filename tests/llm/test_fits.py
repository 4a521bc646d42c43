"""The fits of op2, op5 and op8 against plain versions in one process, the registered op3 and op4 queries, and long texts."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthlog.llm import classifier, packing, queries, weak_rules

SF = "/root/testdata/sf0.001"


# --- op2: one ridge solution and one isotonic fit -------------------------------------------

def test_partition_sums_give_the_ridge_solution(spark):
    rng = np.random.default_rng(4)
    size = len(classifier.STATS)
    x = rng.normal(size=(600, size))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, stats array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = classifier.fit(stats, labels, features=40, ridge=1e-2)
    fold = {r.doc_id: r.f for r in labels.select("doc_id", classifier.fold(F.col("doc_id")).alias("f")).collect()}
    known = [i for i in range(600) if fold[i] != 0]
    centre, scale = x[known].mean(axis=0), x[known].std(axis=0)
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale)
    used = [i for i in known if fold[i] != 1]
    f = model.features(x[used])
    assert np.allclose(f[:, :-1], np.cos(np.clip((x[used] - centre) / scale, -6, 6) @ model.directions + model.phases) * np.sqrt(2 / 40))
    want = np.linalg.solve(f.T @ f + 1e-2 * len(used) / 40 * np.eye(41), f.T @ y[used])
    assert np.allclose(model.weights, want, atol=1e-8)
    kept = [i for i in known if fold[i] == 1]
    bins = np.rint(np.clip(model.raw(x[kept]), -1.5, 2.5) * 1000)
    levels = {b: [y[i] for i, c in zip(kept, bins) if c == b] for b in sorted(set(bins))}
    means = [np.mean(v) for v in levels.values()]
    sizes = [len(v) for v in levels.values()]
    iso = [max(min(np.average(means[a:z + 1], weights=sizes[a:z + 1]) for z in range(i, len(means))) for a in range(i + 1)) for i in range(len(means))]
    # A knot stands for its pooled block: within a block every bin has the level of the min-max formula.
    assert sorted(set(np.round(model.levels, 9))) == sorted(set(np.round(iso, 9)))


# --- op5: plain expectation-maximisation ----------------------------------------------------

def test_accuracies_equal_plain_em(spark):
    rng = random.Random(1)
    ballots = [tuple(rng.choice((0, 1, 2)) for _ in range(4)) for _ in range(30)]
    counts = {b: rng.randint(1, 20) for b in ballots}
    table = spark.createDataFrame([(list(b), float(n)) for b, n in counts.items()], "ballot array<int>, n double")
    got, prior = weak_rules.fit_accuracies(table, 4, rounds=5)
    good, bad, p0 = [list(weak_rules.ON_GOOD)] * 4, [list(weak_rules.ON_BAD)] * 4, weak_rules.PRIOR_QUALITY
    for _ in range(5):
        post = {}
        for b in counts:
            odds = p0 / (1 - p0) * math.prod(good[j][o] / bad[j][o] for j, o in enumerate(b))
            post[b] = odds / (1 + odds)
        n_good = sum(post[b] * n for b, n in counts.items())
        n_bad = sum((1 - post[b]) * n for b, n in counts.items())
        w = weak_rules.PRIOR_WEIGHT
        good = [[(sum(post[b] * n for b, n in counts.items() if b[j] == o) + w * weak_rules.ON_GOOD[o]) / (n_good + w) for o in range(3)] for j in range(4)]
        bad = [[(sum((1 - post[b]) * n for b, n in counts.items() if b[j] == o) + w * weak_rules.ON_BAD[o]) / (n_bad + w) for o in range(3)] for j in range(4)]
        p0 = (n_good + weak_rules.PRIOR_QUALITY * w) / (n_good + n_bad + w)
    assert prior == pytest.approx(p0)
    assert got == pytest.approx([math.log(g / b) for gs, bs in zip(good, bad) for g, b in zip(gs, bs)])


# --- op8: non-negative least squares --------------------------------------------------------

def test_projected_gradients_reach_the_least_misfit():
    size = 10
    rng = np.random.default_rng(3)
    histogram = np.concatenate([[0], rng.integers(0, 30, size)]).astype(float)
    rows = packing.patterns(size, histogram > 0)
    want = {(a, b, c) for a, b, c in itertools.combinations_with_replacement(range(size + 1), 3)
            if a + b + c == size and all(v == 0 or histogram[v] > 0 for v in (a, b, c))}
    assert set(map(tuple, rows.tolist())) == want
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0
    matrix = np.zeros((size + 1, len(rows)))
    for k, row in enumerate(rows):
        for v in row:
            matrix[v, k] += weight[v]
    target = histogram * weight
    x = packing.least_squares(rows, histogram)
    gradient = matrix.T @ (matrix @ x - target)
    scale = np.abs(matrix.T @ target).max()
    assert (x >= 0).all() and gradient.min() > -1e-3 * scale and np.abs(gradient * x).max() < 1e-2 * scale * max(x.max(), 1)


# --- registered queries ---------------------------------------------------------------------

def test_neighbours_query_finds_the_nearest(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in queries.QUERIES["op3_nn_descent"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors, hits, all_hits = dict(rows), 0, 0
    asked = [i for i, _ in rows if i % 20 == 0]
    assert set(got) == set(asked)
    for q in asked:
        scores = sorted((-float(vectors[q] @ v), i) for i, v in rows if i != q)[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(scores) + 1))
        assert all(abs(s - float(vectors[q] @ vectors[i])) < 1e-9 for _, i, s in found)
        hits += len({i for _, i in scores} & {i for _, i, _ in found})
        all_hits += len(scores)
    assert hits >= 0.9 * all_hits


def test_archive_query_has_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    data = {p.page_id: (p.html or "").encode() for p in pages}
    largest = {}
    for i, d in data.items():
        largest[d] = max(largest.get(d, i), i)
    got = {r.page_id: r for r in queries.QUERIES["op4_warc_chunks"](spark, SF).collect()}
    assert set(got) == set(data)
    for i, d in data.items():
        again = len(d) >= 1000 and largest[d] != i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (
            len(d), hashlib.sha1(d).hexdigest(), "revisit" if again else "response", largest[d] if again else None)


def test_very_long_texts(spark, docs):
    long = " ".join(f"word{i % 977}" for i in range(120_000))
    table = docs([(1, long), (2, long + " end"), (3, "short text")])
    judged = {r.doc_id: r for r in weak_rules.judge(table).collect()}
    assert judged[1].n_words == 120_000 and judged[1].n_repeat_words == 120_000 and judged[1].base_failed
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id for r in classifier.score_documents(table, labels).collect()} == {1, 2, 3}
