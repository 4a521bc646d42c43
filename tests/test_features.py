import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import data
from depthlog.functions import columns as C
from depthlog.operators import features as X, joins as J, quality as A, quantiles as Q
from depthlog.schema import BASE_FEATURES, LABEL_CURVE, feature_names, penalty_rows, PENALTY_FINE


def labels(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, label string")


def test_labels_decode(spark):
    df = labels(spark, ["65000", "65000.0", "30000", "Shale", " sandstone ", "Marl", "Sandstone/Shale", "12345", "Granite", None, "NaN", "None"])
    got = [r["c"] for r in df.select("i", C.decode_label(F.col("label")).alias("c")).orderBy("i").collect()]
    assert got == [65000, 65000, 30000, 65000, 30000, 80000, 65030, None, None, None, None, None]


def test_label_rounding_is_half_even(spark):
    df = labels(spark, ["64999.5", "65000.5", "65029.5", "65030.5"])
    got = [r["c"] for r in df.select("i", C.decode_label(F.col("label")).alias("c")).orderBy("i").collect()]
    assert got == [65000, 65000, 65030, 65030]


def test_label_diagnostics(spark):
    df = labels(spark, ["None", None, "NaN", "Granite", "Granite", "Shale", "65000", "99999", "", "30000"]).withColumn("WELL", F.lit("w"))
    row = A.label_diagnostics(df, "label").first()
    assert (row["recognised"], row["unrecognised"], row["empty"], row["rows"]) == (3, 3, 4, 10)
    assert [(r["label"], r["n"]) for r in A.unknown_labels(df, "label").collect()] == [("Granite", 2), ("99999", 1)]


def test_empty_set_is_textual(spark):
    df = labels(spark, ["-999.25", "-999.0"]).withColumn("WELL", F.lit("w"))
    row = A.label_diagnostics(df, "label").first()
    assert (row["empty"], row["unrecognised"]) == (1, 1)


def test_detect_label_column():
    assert X.detect_label_column(["DEPT", "gr", " lithology "]) == " lithology "
    assert X.detect_label_column(["DEPT", LABEL_CURVE]) == LABEL_CURVE
    assert X.detect_label_column(["DEPT", "GR", "RHOB"]) is None


def test_label_status(spark):
    df = spark.createDataFrame([("w", 1000 + 0.5 * i, 65000 if i >= 80 else None) for i in range(200)], "WELL string, DEPT double, TRUE_CODE int")
    row = A.label_status(df).first()
    assert (row["status"], row["labelled"], row["depth_min"], row["depth_max"]) == ("partial", 120, 1040.0, 1099.5)
    assert A.label_status(df.filter("TRUE_CODE is not null")).first()["status"] == "full"
    assert A.label_status(df.filter("TRUE_CODE is null")).first()["status"] == "no_valid_labels"
    assert A.label_status(df.drop("TRUE_CODE")).first()["status"] == "no_column"


def test_column_names(spark):
    with pytest.raises(ValueError):
        X.normalise_columns(spark.createDataFrame([(1, 2)], "`gr ` int, GR int"))
    assert X.missing_curves(["gr", "RHOB"]) == ["RDEP", "RMED", "DTC"]


def test_well_names(spark):
    row = spark.range(1).select(C.official_name(F.lit("15/9-13")).alias("a"), C.file_to_well(F.lit("15_9-13_x")).alias("b"),
                                C.file_stem(F.lit("/d/15_9-13.A.las")).alias("c"), C.well_block(F.lit("15/9-13")).alias("d"),
                                C.well_block(F.lit("x15/9")).alias("e")).first()
    assert tuple(row) == ("15_9-13", "15/9-13_x", "15_9-13.A", "15", "Other")


def test_invalid_values_become_flags(spark):
    df = spark.createDataFrame([("w", 0, 50.0, 1.0, 1.0, 80.0, 2.3), ("w", 1, -1.0, 1.0, 1.0, 80.0, 2.3), ("w", 2, 50.0, 0.0, 1.0, 80.0, 2.3),
                                ("w", 3, 50.0, 1.0, 1.0, 0.0, 2.3)], "WELL string, SOURCE_ROW long, GR double, RDEP double, RMED double, DTC double, RHOB double")
    rows = X.feature_table(X.clean_curves(df)).orderBy("SOURCE_ROW").collect()
    assert [r["GR_MISSING"] for r in rows] == [0, 1, 0, 0]
    assert [r["RDEP_LOG10_MISSING"] for r in rows] == [0, 0, 1, 0]
    assert [r["DTC_MISSING"] for r in rows] == [0, 0, 0, 1]


def test_infinity_and_nan_become_null(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 2.0)], "GR double, DTC double, RHOB double")
    assert tuple(X.clean_curves(df, {c: c for c in df.columns}).first()) == (None, None, 2.0)


def test_contract_has_41_unique_features():
    names = feature_names()
    assert len(names) == len(set(names)) == 41 and "DEPT" not in names
    assert {n: len(f) for n, f in X.feature_sets().items()} == {n: int(n.rsplit("_", 1)[1]) for n in X.feature_sets()}
    with pytest.raises(ValueError):
        X.check_features(names[:-1])


@pytest.mark.parametrize("block", [8, 100_000])
def test_rolling_equals_pandas_and_stays_in_the_well(spark, block):
    df = X.clean_curves(spark.createDataFrame(data.rows(), data.SCHEMA).repartition(7))
    got = X.feature_table(df, block_rows=block).toPandas().set_index(["WELL", "SOURCE_ROW"]).sort_index()
    pdf = data.frame()
    for well, g in pdf.groupby("WELL"):
        gr = g.GR.where(~(g.GR < 0)).astype(float)
        for w in (5, 9, 21):
            r = gr.rolling(w, center=True, min_periods=3)
            for stat, want in (("MEAN", r.mean()), ("STD", r.std())):
                have = got.loc[well][f"GR_ROLL{stat}_{w}"].astype(float)
                np.testing.assert_allclose(have.to_numpy(), want.to_numpy()[have.index.to_numpy()], rtol=1e-8, atol=1e-7)


def test_features_do_not_depend_on_labels(spark):
    df = X.clean_curves(spark.createDataFrame(data.rows(), data.SCHEMA))
    with_labels = X.feature_table(df).orderBy("WELL", "SOURCE_ROW").collect()
    without = X.feature_table(df.withColumn("TRUE_CODE", F.lit(None).cast("int"))).orderBy("WELL", "SOURCE_ROW").collect()
    assert with_labels == without


def test_training_scope_skips_unlabelled_rows(spark):
    df = X.clean_curves(spark.createDataFrame(data.rows(), data.SCHEMA))
    got = X.feature_table(df, scope="labelled", block_rows=11).toPandas().set_index(["WELL", "SOURCE_ROW"]).sort_index()
    pdf = data.frame()
    g = pdf[(pdf.WELL == "w4") & pdf.TRUE_CODE.notna()]
    base = pd.DataFrame({"GR": g.GR.where(~(g.GR < 0)), "RDEP": g.RDEP.where(g.RDEP > 0), "RMED": g.RMED.where(g.RMED > 0),
                         "DTC": g.DTC.where(g.DTC > 0), "RHOB": g.RHOB.where(g.RHOB > 0)})
    kept = g[~base.isna().all(axis=1)]
    want = kept.GR.where(~(kept.GR < 0)).astype(float).rolling(9, center=True, min_periods=3).mean()
    np.testing.assert_allclose(got.loc["w4"]["GR_ROLLMEAN_9"].astype(float).to_numpy(), want.to_numpy(), rtol=1e-9)


def test_regular_gradient_tests_the_step_it_spans(spark):
    df = spark.createDataFrame([("w", i, d, float(i * i)) for i, d in enumerate((0.0, 0.152, 0.304, 5.0, 5.152))],
                               "WELL string, SOURCE_ROW long, DEPT double, GR double")
    got = [r["GR_GRAD"] for r in X.forward_gradient(df, ["GR"], regular_only=True).orderBy("SOURCE_ROW").collect()]
    assert [g is None for g in got] == [False, False, True, False, True]


def test_one_to_one_join_rejects_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, b double")
    assert J.attach_one_to_one(a, b.limit(1), ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        J.attach_one_to_one(a, b, ["k"]).collect()
    with pytest.raises(ValueError):
        J.split_rows(a.withColumnRenamed("a", "SPLIT"), "BLIND")


def test_snap_tie_goes_up(spark):
    df = spark.createDataFrame([("w", 0, 0.0, 1), ("w", 1, 0.5, 1), ("w", 2, 1.6, 1), ("w", 3, 2.0, 1)], "WELL string, SOURCE_ROW long, DEPT double, c int")
    assert [r["node"] for r in J.snap_to_grid(df, "c", step=1.0).orderBy("SOURCE_ROW").collect()] == [0, 0, 2, 2]


def test_penalty_tables_are_asymmetric():
    coarse = {(t, p): c for t, p, c in penalty_rows()}
    assert coarse[(88000, 86000)] == 2 and coarse[(86000, 88000)] == 3 and all(coarse[(c, c)] == 0 for c, _ in coarse)
    fine = {(t, p): c for t, p, c in penalty_rows(PENALTY_FINE)}
    assert fine[(88000, 88000)] == 4 and len(fine) == 144
    assert len(BASE_FEATURES) == 5


def test_rolling_over_many_batches_equals_spark_windows(spark):
    """Arrow batches of a few rows cut every window; NULL, NaN, a constant series, and series shorter than the frame."""
    from pyspark.sql import Window
    v = F.when(F.col("id") % 7 == 0, None).when(F.col("id") == 40, float("nan")).when(F.col("id") > 150, 0.1).otherwise(F.sin("id") * 1000)
    df = spark.range(230).select(F.when(F.col("id") < 200, "a").when(F.col("id") > 203, "b").alias("WELL"), F.col("id").alias("SOURCE_ROW"), v.alias("GR"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        got = X.rolling(df, ["GR"], (4, 21), min_valid=2)
        plan = got._jdf.queryExecution().executedPlan().toString()
        got = {(r["WELL"], r["SOURCE_ROW"]): r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "stddev_samp" not in plan  # a frame of w rows is not gone through again for every row
    want = df
    for width in (4, 21):
        w = Window.partitionBy("WELL").orderBy("SOURCE_ROW").rowsBetween(-(width // 2), (width - 1) // 2)
        for name, f in (("MEAN", F.avg), ("STD", F.stddev_samp)):
            want = want.withColumn(f"GR_ROLL{name}_{width}", F.when(F.count("GR").over(w) >= 2, f("GR").over(w)))
    rows = want.collect()
    assert len(rows) == len(got) == 230
    for r in rows:
        for c in want.columns[3:]:
            a, b = got[r["WELL"], r["SOURCE_ROW"]][c], r[c]
            assert (a is None) == (b is None) and (a is None or a == b or (np.isnan(a) and np.isnan(b))), (r, c, a)


def test_medians_bracketed_by_sketches_are_exact(spark):
    rows = spark.range(40_001).select(
        F.col("id"), (F.col("id") * F.col("id") % 39_989 / 7.0).alias("many"), (F.col("id") % 3).cast("double").alias("few"),
        F.when(F.col("id") % 2 == 0, F.log1p("id")).alias("half"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 2, F.col("id").cast("double")).alias("two"))
    columns = ["many", "few", "half", "none", "two"]
    got = {r["curve"]: r["median"] for r in A.medians(rows, columns).collect()}
    want = rows.agg(*[F.median(c).alias(c) for c in columns]).first()
    assert set(got) == set(columns) - {"none"}
    assert all(got[c] == want[c] for c in ("many", "few", "half", "two"))


def test_medians_are_counted_over_batches_without_a_row_per_cell(spark, monkeypatch):
    rng = random.Random(8)
    columns = {"a": [rng.choice([None, float(rng.randrange(5)), rng.gauss(0, 1)]) for _ in range(4001)],
               "b": [float("nan") if i % 9 == 0 else float(i) for i in range(4001)], "c": [None] * 4001,
               "d": [float("inf") if i % 5 == 0 else -float("inf") if i % 7 == 0 else i / 3 for i in range(4001)], "e": [-0.0] * 4001}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    plain = df.agg(*[(F.median(c) + 0.0).alias(c) for c in columns]).first().asDict()
    expected = {c: repr(v) for c, v in plain.items() if v is not None}
    monkeypatch.setattr(A, "MEDIAN_ROWS", 300)
    monkeypatch.setattr(A, "MEDIAN_POINTS", 20)
    monkeypatch.setattr(A, "long_form", lambda df, by, rest: wide.append(rest) or long_form(df, by, rest))
    wide, long_form = [], Q.long_form
    assert {r["curve"]: repr(r["median"]) for r in A.medians(df, list(columns)).collect()} == expected
    assert not wide  # columns are never put below one another

