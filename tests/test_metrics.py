import random

import pytest
from pyspark.sql import functions as F

from depthlog.operators import compare as K, metrics as M
from depthlog.schema import CODES

MODELS = {"m": "p", "q": "r"}


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(0)
    classes = [c for c in CODES if c != 93000]
    rows = []
    for i in range(3000):
        t = rng.choice(classes)
        rows.append((i, t, t if rng.random() < 0.75 else rng.choice(classes), 93000 if i < 5 else (t if rng.random() < 0.7 else rng.choice(classes))))
    return spark.createDataFrame(rows + [(9999, None, 30000, 30000)], "i int, TRUE_CODE int, p int, r int").cache()


def test_confusion_has_empty_rows_and_keeps_all_samples(toy):
    cells = M.confusion(M.pair_counts(toy, MODELS), shared=True)
    assert cells.count() == 2 * 12 * 12
    assert [r[1] for r in cells.groupBy("model").agg(F.sum("n")).collect()] == [3000, 3000]
    shares = M.row_shares(cells)
    sums = {(r["model"], r["true_code"]): r["s"] for r in shares.groupBy("model", "true_code").agg(F.sum("share").alias("s")).collect()}
    assert sums[("m", 93000)] == 0 and all(abs(s - 1) < 1e-9 for (_, c), s in sums.items() if c != 93000)


def test_accuracy_is_trace_over_total(toy):
    pairs = M.pair_counts(toy, MODELS)
    trace = {r["model"]: r["a"] for r in pairs.groupBy("model").agg(
        (F.sum(F.when(F.col("true_code") == F.col("pred_code"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a")).collect()}
    for r in M.overall(pairs).collect():
        assert abs(r["accuracy"] - trace[r["model"]]) < 1e-12 and r["samples"] == 3000


def test_macro_class_set_changes_the_denominator(toy):
    pairs = M.pair_counts(toy, {"q": "r"})
    truth, union = (M.overall(pairs, classes=c).first()["macro_f1"] for c in ("truth", "union"))
    fixed = M.overall(pairs, classes=sorted(CODES)).first()["macro_f1"]
    assert abs(truth * 11 / 12 - union) < 1e-12 and abs(fixed - union) < 1e-12


def test_unknown_code_is_an_error_or_ignored(spark):
    df = spark.createDataFrame([(30000, 30000), (30000, 1)], "TRUE_CODE int, p int")
    pairs = M.pair_counts(df, {"m": "p"})
    with pytest.raises(Exception, match="without penalty"):
        M.overall(pairs).collect()
    assert M.overall(pairs, unknown="ignore").first()["cost_score"] == 0


def test_unlabelled_rows_are_neither_right_nor_wrong(toy):
    assert M.model_samples(toy, MODELS).count() == 6002
    assert K.agreement_share(toy, MODELS).first()["wrong_m"] == toy.filter("TRUE_CODE <> p").count()


def test_kappa_needs_twenty_shared_samples(spark):
    df = spark.createDataFrame([(1, 1, 2)] * 19, "TRUE_CODE int, p int, r int")
    got = {(r["left"], r["right"]): r["kappa"] for r in K.pairwise_kappa(df, MODELS).collect()}
    assert got[("m", "q")] is None and got[("m", "m")] == 1.0 and len(got) == 9


def test_consensus_tie_takes_the_lowest_code(spark):
    df = spark.createDataFrame([(70000, 30000, 65000), (65000, 65000, 30000)], "a int, b int, c int")
    rows = df.select(*[c.alias(n) for n, c in K.consensus_columns(["a", "b", "c"]).items()]).collect()
    assert [(r["consensus_code"], round(r["agreement"], 3)) for r in rows] == [(30000, 0.333), (65000, 0.667)]


def test_reliability_edges(spark):
    df = spark.createDataFrame([(0.3,), (1.0,), (0.0,), (-0.1,), (None,)], "c double")
    edges = [i * 0.1 for i in range(10)] + [1.0]
    assert [r[0] for r in df.select(K.bin_index(F.col("c"), edges)).collect()] == [2, 9, 0, 0, None]


def test_threshold_sweep_equals_direct_decision(spark):
    rng = random.Random(1)
    rows = [(rng.choice((30000, 65000, 65030)), rng.random(), rng.random(), rng.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "t int, a double, b double, s double")
    p = {30000: F.col("a"), 65000: F.col("b"), 65030: F.col("s")}
    thresholds = [0.2, 0.35, 0.6]
    got = {(r["model"], r["true_code"], r["pred_code"]): r["n"] for r in M.threshold_sweep(df, "t", p, 65030, thresholds).collect()}
    want = {}
    for t, a, b, s in rows:
        for th in thresholds:
            k = (th, t, 65030 if s >= th else 30000 if a >= b else 65000)
            want[k] = want.get(k, 0) + 1
    assert {k: v for k, v in got.items() if v} == want
