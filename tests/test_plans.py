"""What the plans look like, and the stored products of the dataset builder."""

import os
import re

import pytest
from pyspark.sql import functions as F

import data
from depthlog.operators import features as X, joins as J, learning as L, metrics as M, quality as A, series as S
from depthlog.plans.dataset import build_training_tables, load_split, report
from depthlog.schema import BASE_FEATURES, INPUT_CURVES, feature_names
from depthlog.sources.sinks import write_splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_path):
    spark.createDataFrame(data.rows(), data.SCHEMA).write.parquet(str(tmp_path / "wells"))
    return spark.read.parquet(str(tmp_path / "wells"))


def test_rolling_is_one_shuffle_by_well_and_block(stored):
    text = plan(X.rolling(X.base_features(X.clean_curves(stored)).select("WELL", "SOURCE_ROW", *BASE_FEATURES)))
    assert re.findall(r"hashpartitioning\(([^)]*)\)", text)[0].startswith("WELL") and text.count("Exchange") == 1
    assert "__block" in re.findall(r"hashpartitioning\(([^)]*)\)", text)[0]


def test_runs_read_the_input_once_and_never_shuffle_by_well_alone(stored):
    text = plan(S.runs(stored, "WELL", "SOURCE_ROW", F.col("TRUE_CODE")))
    assert text.count("FileScan") == 1
    keys = [re.sub(r"#\d+L?", "", k).split(", ")[:2] for k in re.findall(r"hashpartitioning\(([^)]*)\)", text)]
    assert keys and all(len(k) == 2 and k[1].startswith("__") for k in keys)


def test_metrics_read_only_the_codes_and_push_the_label_filter(stored):
    text = plan(M.pair_counts(stored, {"A": "A", "B": "B"}))
    assert re.search(r"ReadSchema: struct<TRUE_CODE:int,A:int,B:int>", text) and "IsNotNull(TRUE_CODE)" in text
    assert "BatchEvalPython" not in text


def test_depth_filter_reaches_the_scan(stored):
    assert "GreaterThanOrEqual(DEPT" in plan(stored.filter(F.col("DEPT").between(1001.0, 1002.0)).select("WELL", "DEPT"))


def test_crop_error_on_disjoint_ranges(stored):
    assert A.crop_to_labels(stored, top=9e6, base=9e7).count() == 0
    with pytest.raises(Exception, match="no labelled depth"):
        A.crop_to_labels(stored, top=9e6, base=9e7, on_empty="error").count()


def test_split_writer_checks_and_partitions(spark, stored, tmp_path):
    manifest = spark.createDataFrame([("w1", "TRAIN"), ("w2", "PUBLIC"), ("w4", "BLIND_TEST")], "WELL string, SPLIT string")
    write_splits(stored.repartition(9), manifest, str(tmp_path / "out"))
    files = [f for _, _, names in os.walk(tmp_path / "out") for f in names if f.endswith(".parquet")]
    assert len(files) == 3  # one for each well, which has one block of rows
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["SPLIT"], r["WELL"]) for r in back.select("SPLIT", "WELL").distinct().collect()} == {
        ("TRAIN", "w1"), ("PUBLIC", "w2"), ("BLIND_TEST", "w4")}
    assert "PartitionFilters: [isnotnull(SPLIT" in plan(back.filter("SPLIT = 'PUBLIC'").select("GR"))
    with pytest.raises(ValueError, match="nowhere"):
        write_splits(stored, manifest.union(spark.createDataFrame([("nowhere", "TRAIN")], "a string, b string")), str(tmp_path / "bad"))


def test_dataset_and_report(spark, stored, tmp_path):
    manifest = spark.createDataFrame([("w1", "TRAIN"), ("w2", "PUBLIC"), ("w3", "TRAIN"), ("w4", "BLIND_TEST")], "WELL string, SPLIT string")
    table = build_training_tables(X.clean_curves(stored), manifest, str(tmp_path / "d"))
    numeric = [c for c in feature_names() if not c.endswith("_MISSING")]
    assert table.filter(" or ".join(f"{c} is null" for c in numeric)).count() == 0
    train = load_split(spark, str(tmp_path / "d"), "TRAIN")
    assert {r[0] for r in train.select("WELL").distinct().collect()} <= {"w1", "w3"}
    with pytest.raises(ValueError):
        load_split(spark, str(tmp_path / "d"), "BLIND")
    model = L.train_forest(train, feature_names(), "TRUE_CODE", trees=2, depth=3, leaf=1)
    blind = load_split(spark, str(tmp_path / "d"), "BLIND_TEST")
    assert report(blind, {"forest": model}, str(tmp_path / "r")).count() == blind.count()
    assert {"overall", "classes", "confusion", "predictions"} <= set(os.listdir(tmp_path / "r"))


def test_raw_features_leave_the_disk_while_features_are_written(spark, stored, tmp_path, monkeypatch):
    from depthlog.plans import dataset
    manifest = spark.createDataFrame([("w1", "TRAIN"), ("w2", "PUBLIC"), ("w3", "TRAIN"), ("w4", "BLIND_TEST")], "WELL string, SPLIT string")
    whole = sorted(map(str, build_training_tables(X.clean_curves(stored), manifest, str(tmp_path / "d")).collect()))
    left, real = [], dataset.write_parquet
    monkeypatch.setattr(dataset, "PART_BYTES", 1)

    def write(df, path, *args):
        left.append(len(list((tmp_path / "e" / "raw_features").rglob("*.parquet"))))
        real(df, path, *args)

    monkeypatch.setattr(dataset, "write_parquet", write)
    table = build_training_tables(X.clean_curves(stored), manifest, str(tmp_path / "e"))
    assert sorted(map(str, table.collect())) == whole and not (tmp_path / "e" / "raw_features").exists()
    assert len(left) > 3 and left[1:] == sorted(left[1:], reverse=True) and left[-1] < left[1]


def test_random_split_is_repeatable_and_complete(spark, stored):
    a = {tuple(r) for r in J.random_split(stored, 3, ("x", "y")).collect()}
    assert a == {tuple(r) for r in J.random_split(stored.repartition(9), 3, ("x", "y")).collect()}
    assert sorted(s for _, s in a) == ["x", "x", "x", "y"] and len(INPUT_CURVES) == 5


def test_learning_queries_take_whole_parameters(spark, monkeypatch, tmp_path):
    from depthlog.operators.training import ModelStore
    from depthlog.plans import learning_queries as Q
    asked, forest = [], L.train_forest
    stores = {"now": ModelStore(spark, str(tmp_path / "one"))}
    monkeypatch.setattr(Q, "store", lambda spark: stores["now"])

    def small_forest(df, features, *args, **kwargs):
        asked.append((len(features), kwargs["trees"], kwargs["depth"], kwargs["leaf"]))
        return forest(df, features, *args, **kwargs | {"trees": 1, "depth": 2})

    def boosted(df, features, label, **kwargs):
        asked.append((len(features), kwargs["rounds"], kwargs["depth"]))
        return small_forest(df, features, label, trees=0, depth=0, leaf=1)

    def permutation(model, df, features, *args, repeats):
        asked.append((len(features), repeats))
        return spark.createDataFrame([("GR", 0.0, 0.0)], "feature string, importance double, deviation double")

    for name, fake in (("train_forest", small_forest), ("train_boosted", boosted), ("permutation_importance", permutation)):
        monkeypatch.setattr(L, name, fake)
    table = Q.feature_set_leaderboard(spark, "/root/testdata/sf0.001")
    assert {r.run for r in table.collect()} == set(X.feature_sets())
    assert sorted(asked) == sorted((len(f), 100, 20, 5) for f in X.feature_sets().values())
    assert table.filter("fit_s > 0 and score_s > 0").count() == len(asked)
    Q.forest_metrics(spark, "/root/testdata/sf0.001")  # the forest of the 41 features is there
    assert len(asked) == len(X.feature_sets())
    asked.clear()
    stores["now"] = ModelStore(spark, str(tmp_path / "two"))
    Q.permutation_importance(spark, "/root/testdata/sf0.001")
    Q.boosted_scores(spark, "/root/testdata/sf0.001")
    assert asked == [(41, 100, 20, 5), (41, 3), (41, 100, 6), (41, 0, 0, 1)]
