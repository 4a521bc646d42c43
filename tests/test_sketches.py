"""Stored and merged sketches against exact ranks; Spearman against a plain version."""

import contextlib
import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import data
from depthlog.operators import quality as A, quantiles as Q, series, sketches as S, stats as D, whole
from depthlog.schema import INPUT_CURVES, LOG_CURVES


def test_merged_sketches_keep_to_their_bound(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"w{i % 3}", rng.gauss(0, 1), None if i % 5 else rng.random()) for i in range(20_000)] + [("w9", None, float("nan"))]
    df = spark.createDataFrame(rows, "well string, a double, b double").repartition(6)
    for run, part in (("one", df.filter("a > 0")), ("two", df.filter("a <= 0 or a is null")), ("two", df.filter("a <= 0 or a is null"))):
        S.keep(S.sketches(part, "well", ["a", "b"]), str(tmp_path), run)
    whole = S.sketch_quantiles(S.merged(S.kept(spark, str(tmp_path)), "well"), {"q0": 0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1})
    got = {(r.well, r.curve): r for r in whole.collect()}
    assert len(got) == 6
    for at, name in enumerate("ab", 1):
        for w in ("w0", "w1", "w2"):
            values = sorted(r[at] for r in rows if r[0] == w and r[at] is not None)
            r = got[w, name]
            assert r.n == len(values) and (r.q0, r.q100) == (values[0], values[-1])
            for q, v in ((0.1, r.q10), (0.5, r.q50), (0.99, r.q99)):
                assert np.searchsorted(values, v) / len(values) - S.rank_error() <= q <= np.searchsorted(values, v, "right") / len(values) + S.rank_error()


def test_spearman_equals_a_plain_version(spark):
    frame = data.frame()
    extra = pd.DataFrame({"WELL": ["w5", "w5", None, None, None], "GR": [1.0, 2.0, 5.0, 6.0, 6.0], "RHOB": [None, None, 2.0, 2.0, 3.0]})
    frame = pd.concat([frame, extra], ignore_index=True)
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in frame[["WELL", *INPUT_CURVES]].itertuples(index=False)],
                               "WELL string, " + ", ".join(f"{c} double" for c in INPUT_CURVES))
    for by in ([], ["WELL"]):
        got = {tuple(r[:-1]): r["rho"] for r in D.spearman(df, by=by).collect()}
        want = {}
        groups = [((), frame)] if not by else [((None if w == "none" else w,), g) for w, g in frame.assign(WELL=frame["WELL"].fillna("none")).groupby("WELL")]
        for key, g in groups:
            x = g[list(INPUT_CURVES)].astype(float)
            for c in LOG_CURVES:
                x[c] = np.log10(x[c].where(x[c] > 0))
            for a in INPUT_CURVES:
                for b in INPUT_CURVES:
                    both = x[[a, b]].dropna()
                    if a != b and len(both):
                        r = both.rank()
                        da, db = r[a] - r[a].mean(), r[b] - r[b].mean()
                        norm = np.sqrt((da * da).sum() * (db * db).sum())
                        want[(*key, a, b)] = (da * db).sum() / norm if norm else None
        assert set(got) == set(want)
        assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def test_spearman_joins_small_tables_on_values(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("GR"), F.rand(1).alias("DTC"))
    assert D.spearman(df, ["GR", "DTC"]).count() == 2 and D.spearman(df.limit(0), ["GR", "DTC"]).count() == 0


def test_ranks_go_back_to_their_rows_as_numbers(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("double").alias("GR"), F.rand(1).alias("DTC"), F.rand(2).alias("RHOB"))
    plan = D.spearman(df, ["GR", "DTC", "RHOB"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan  # arrays are sorted before they are grouped


def test_curve_quantiles_take_whole_keys_or_cut_them(spark):
    frame = data.frame()
    extra = pd.DataFrame({"WELL": ["w5", "w5", None], "GR": [1.0, -0.0, 5.0]})
    frame = pd.concat([frame, extra], ignore_index=True)
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in frame[["WELL", *INPUT_CURVES]].itertuples(index=False)],
                               "WELL string, " + ", ".join(f"{c} double" for c in INPUT_CURVES)).repartition(5)
    wanted = {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    cells = {c: F.col(c) for c in INPUT_CURVES}
    plain = Q.quantiles(Q.long_form(df, ["WELL"], INPUT_CURVES), ["WELL", "curve"], F.col("value"), wanted)
    want = sorted(map(tuple, plain.collect()))
    assert len(want) == (frame.groupby("WELL")[list(INPUT_CURVES)].count() > 0).to_numpy().sum()
    for most in (1, 50, 100, 1000):  # all wells are cut, some are, none is
        assert sorted(map(tuple, Q.curve_quantiles(df, "WELL", cells, wanted, most).select(plain.columns).collect())) == want
    assert Q.curve_quantiles(df, [], cells, wanted).count() == 5 and Q.curve_quantiles(df.limit(0), "WELL", cells, wanted).count() == 0


def test_spearman_of_cut_and_of_whole_wells_is_the_same(spark):
    rows = [(w, float(i * i % 13), [None, 0.0, -0.0, float(i)][i % 4], None if w == 3 else float(i % 5) if i % 3 else None) for w, n in ((1, 90), (2, 9), (3, 40), (None, 20), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "w int, a double, b double, c double").repartition(3)
    plain, *others = [{tuple(r[:3]): r["rho"] for r in D.spearman(df, ["a", "b", "c"], ["w"], most).collect()} for most in (0, 30, 1000)]
    assert len(plain) == 3 * 6 + 2  # w3 has no c, w4 no complete row
    for got in others:
        assert set(got) == set(plain)
        assert all((got[k] is None) == (plain[k] is None) and (plain[k] is None or abs(got[k] - plain[k]) < 1e-12) for k in plain)


def test_whole_keys_are_not_cut_by_slabs_or_batches(spark, monkeypatch):
    monkeypatch.setattr(whole, "SLAB_ROWS", 7)
    df = spark.range(3000).select((F.col("id") % 40 % 9).alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 4)).alias("b"),
                                  (F.col("id") * 37 % 101).cast("double").alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = whole.per_key(df, ["a", "b"], [F.col("x")], "n long, total double", 3000, lambda group, keys, columns: {
            "n": pa.array(np.bincount(group, minlength=keys)), "total": pa.array(np.bincount(group, columns[0][0], keys))}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, found)) == sorted(map(str, df.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("x").alias("total")).collect()))


def test_tasks_for_quantiles_of_wells_follow_the_rows(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 97).alias("WELL"), *[F.rand(i).alias(c) for i, c in enumerate(INPUT_CURVES)])
    monkeypatch.setattr(series, "PART_ROWS", 100)
    for table in (Q.curve_quantiles(df, "WELL", {c: F.col(c) for c in INPUT_CURVES}, {"q": 0.5}), D.spearman(df, by=["WELL"])):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [WELL" in plan and ", 40" in plan and "Join" not in plan and plan.count("Repartition") == 1
    for summary in (D.curve_summary(df, INPUT_CURVES, ["WELL"]), A.describe(df, INPUT_CURVES, ["WELL"])):
        plan = summary._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Window" not in plan  # values are neither counted nor sorted as rows
    ranked = series.rank_rows(df, "WELL", list(INPUT_CURVES), "at", df.count())
    assert len(ranked.select("GR").inputFiles()) > 30 and sorted(r[0] for r in ranked.filter("WELL = 3").select("at").collect()) == list(range(42))


def test_tasks_need_no_package_on_the_executors(spark, monkeypatch, tmp_path):
    df = spark.range(40).select((F.col("id") % 3).alias("WELL"), *[F.rand(i).alias(c) for i, c in enumerate(INPUT_CURVES)])
    sent = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: sent.append(cloudpickle.dumps(run)) or self)
    for make in (lambda: D.spearman(df, by=["WELL"]), lambda: Q.curve_quantiles(df, "WELL", {c: F.col(c) for c in INPUT_CURVES}, {"q": 0.5})):
        with contextlib.suppress(AnalysisException):
            make()
    assert len(sent) == 2
    for i, task in enumerate(sent):
        (tmp_path / f"{i}").write_bytes(task)
        done = subprocess.run([sys.executable, "-c", f"import pickle, sys; from pyspark import cloudpickle; list(pickle.load(open('{i}', 'rb'))([])); "
                               "sys.exit(any(m.startswith('depthlog') for m in sys.modules))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert done.returncode == 0
