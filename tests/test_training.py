"""Bounded, spread training, boosting with probabilities, stored models, cascades."""

import os
import random

import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from depthlog.operators import learning as L, metrics as M, training as T
from depthlog.schema import CODES, feature_names

CLASSES = (30000, 65000, 65030)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        code = CLASSES[0] if i % 3 else CLASSES[1] if i % 9 else CLASSES[2]
        rows.append((f"w{i % 7}", i, code, CLASSES.index(code) + rng.gauss(0, 0.4), rng.random()))
    df = spark.createDataFrame(rows + [("w1", 9999, None, 0.0, 0.0)], "WELL string, SOURCE_ROW long, code int, a double, b double")
    return df.coalesce(1).cache()


def test_shares_fill_the_bound_and_keep_small_classes():
    assert T.class_shares({1: 10, 2: 20}, 1000) == {1: 1.0, 2: 1.0}
    shares = T.class_shares({1: 1_000_000, 2: 90_000, 3: 40}, 10_000)
    taken = sum(n * shares[c] for c, n in {1: 1_000_000, 2: 90_000, 3: 40}.items())
    assert shares[3] == 1.0 and shares[2] > shares[1] and 9_000 < taken < 10_000
    assert T.class_shares({}, 10) == {}


def test_bounded_rows_repeat_and_weights_undo_the_draw(labelled):
    some = T.bounded(labelled, "code", ("WELL", "SOURCE_ROW"), 900)
    again = T.bounded(labelled.repartition(7), "code", ("WELL", "SOURCE_ROW"), 900)
    assert some.count() <= 900 and some.select("SOURCE_ROW").exceptAll(again.select("SOURCE_ROW")).count() == 0
    sums = {r["code"]: r["w"] for r in some.groupBy("code").agg(F.sum("weight").alias("w")).collect()}
    whole = {r["code"]: r["n"] for r in labelled.filter("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()}
    assert set(sums) == set(whole) and all(abs(sums[c] / whole[c] - 1) < 0.25 for c in whole)
    assert T.bounded(labelled, "code", ("WELL", "SOURCE_ROW"), 10_000).agg(F.sum("weight")).first()[0] == 3000


def test_training_rows_are_spread_over_tasks(spark, labelled):
    assert labelled.rdd.getNumPartitions() == 1
    rows, weight = L._training_rows(labelled, ["a", "b"], "code", None, CODES, 1500, ("WELL", "SOURCE_ROW"), 42)
    sizes = [r[1] for r in T.dealt(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * min(sizes) and weight == "__weight"


def test_fit_stages_have_several_full_tasks(spark, labelled, monkeypatch):
    seen = []
    real = T.dealt
    monkeypatch.setattr(T, "dealt", lambda df, *a: seen.append(real(df, *a)) or seen[-1])
    model = L.train_forest(labelled, ["a", "b"], "code", trees=3, depth=4, leaf=1, codes=CLASSES)
    assert [p for p in seen[0].rdd.glom().map(len).collect() if p].__len__() >= 4
    scored = L.score(model, labelled.filter("code is not null"), ["a", "b"], "m", CLASSES)
    assert scored.filter("m_CODE = code").count() > 2400


def test_unknown_codes_and_nothing_to_score_are_errors(spark, labelled):
    with pytest.raises(Exception, match="unknown class code 65030"):
        L.train_forest(labelled, ["a", "b"], "code", trees=1, depth=1, leaf=1, codes=CLASSES[:2])
    rule = L.RuleModel(lambda x: F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.get(x, F.lit(0))))
    with pytest.raises(ValueError, match="no rows"):
        L.predict(labelled.limit(0), {"m": rule}, ["a", "b"], codes=CLASSES)
    with pytest.raises(Exception, match="without class code"):
        L.predict(labelled.filter("a > 1"), {"m": rule}, ["a", "b"], codes=CLASSES).select("m_CODE").collect()


def test_pooling():
    assert T.pooled([(1, 0), (0, 0), (2, 2), (1, 0), (1, 1)]) == [0, 0, 2 / 3, 2 / 3, 1]
    assert T.pooled([(0, 0)] * 3) == [0.0] * 3 and T.pooled([(0, 0), (4, 1), (4, 3)]) == [0.25, 0.25, 0.75]


def test_boosting_has_probabilities_and_is_stored(spark, labelled, tmp_path):
    model = L.train_boosted(labelled, ["a", "b"], "code", rounds=3, depth=2, codes=CLASSES, key=("WELL", "SOURCE_ROW"))
    out = L.score(model, labelled.filter("code is not null"), ["a", "b"], "m", CLASSES, probabilities=True)
    bad = out.filter("m_CONFIDENCE is null or m_CONFIDENCE < 0 or m_CONFIDENCE > 1 or abs(aggregate(m_P, 0D, (s, x) -> s + x) - 1) > 1e-9")
    assert bad.count() == 0 and out.filter("m_CODE = code").count() > 2300
    mean = out.agg(F.avg("m_CONFIDENCE"), F.avg((F.col("m_CODE") == F.col("code")).cast("int"))).first()
    assert abs(mean[0] - mean[1]) < 0.1
    fits = []
    parameters = {"kind": "boosted", "rounds": 3}
    for _ in range(2):
        store = T.ModelStore(spark, str(tmp_path / "models"))  # a new one: only the folder is shared
        for _ in range(2):
            kept = store.get(parameters, lambda: fits.append(1) or model, T.BoostedClasses.load)
    assert fits == [1]
    again = L.score(kept, labelled.filter("code is not null"), ["a", "b"], "m", CLASSES, probabilities=True)
    assert again.select("SOURCE_ROW", "m_CODE", "m_CONFIDENCE").exceptAll(out.select("SOURCE_ROW", "m_CODE", "m_CONFIDENCE")).count() == 0
    L.save_bundle(model, str(tmp_path / "bundle"), ["a", "b"], CLASSES)
    assert L.load_bundle(str(tmp_path / "bundle"), T.BoostedClasses, ["a", "b"])[0].maps == model.maps


def test_unfinished_models_are_not_read(spark, tmp_path):
    store = T.ModelStore(spark, str(tmp_path / "models"))
    os.makedirs(f"{store.folder({'a': 1})}/half/model")
    fits = []
    forest = L.train_forest(spark.createDataFrame([(30000, 1.0), (65000, 2.0)] * 5, "code int, a double"), ["a"], "code", trees=1, depth=1, leaf=1)
    assert store.get({"a": 1}, lambda: fits.append(1) or forest, RandomForestClassificationModel.load) is forest and fits == [1]


def test_cascade_scores_gated_rows_only(spark, labelled):
    df = labelled.withColumn("base", F.when(F.col("SOURCE_ROW") % 4 == 0, 70000).when(F.col("SOURCE_ROW") % 4 == 1, 65030).otherwise(30000))
    df = df.withColumn("base", F.when(F.col("SOURCE_ROW") == 7, None).otherwise(F.col("base")))
    model = L.train_specialist(df, ["a", "b"], "code", CLASSES, trees=5, depth=5, leaf=1)
    for gate, opened in (("group", F.col("base").isin(*CLASSES)), ("special", F.col("base") == 65030)):
        out = L.cascade(df, "base", model, ["a", "b"], CLASSES, 65030, 0.35, gate).cache()
        opened = F.coalesce(opened, F.lit(False))
        assert out.count() == df.count()
        assert out.filter(~opened & ~(F.col("final_code").eqNullSafe(F.col("base")) & F.col("p_30000").isNull() & (F.col("gated") == 0))).count() == 0
        want = F.when(F.col("p_65030") >= 0.35, 65030).when(F.col("p_30000") >= F.col("p_65000"), 30000).otherwise(65000)
        assert out.filter(opened & ((F.col("final_code") != want) | (F.col("gated") != 1))).count() == 0
        assert out.filter(opened & F.col("p_30000").isNull()).count() == 0


def test_permutation_sorts_once_and_equals_a_plain_version(spark, labelled):
    rule = L.RuleModel(lambda x: F.when(F.get(x, F.lit(0)) > 0.6, F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1))).otherwise(F.array(F.lit(0.6), F.lit(0.3), F.lit(0.1))))
    counts = L.permutation_counts(rule, labelled, ["a", "b"], "code", ("WELL", "SOURCE_ROW"), 3, codes=CLASSES)
    assert counts.filter("model = 'b'").groupBy("true_code", "pred_code").agg((F.sum("n") / 3).cast("long").alias("n")).exceptAll(
        counts.filter("model = ''").select("true_code", "pred_code", "n")).count() == 0  # the rule does not look at b
    per = {(r["model"], r["repeat"]): r["n"] for r in counts.groupBy("model", "repeat").agg(F.sum("n").alias("n")).collect()}
    assert per == {("", 0): 3000} | {(m, r): 3000 for m in "ab" for r in range(3)}
    assert len({tuple(sorted(map(tuple, counts.filter(f"model = 'a' and repeat = {r}").select("true_code", "pred_code", "n").collect()))) for r in range(3)}) == 3
    table = {r["feature"]: r for r in L.permutation_importance(rule, labelled, ["a", "b"], "code", ("WELL", "SOURCE_ROW"), codes=CLASSES).collect()}
    assert table["a"]["importance"] > 0.1 and table["b"]["importance"] == 0 == table["b"]["deviation"]
    assert L.permutation_counts(rule, labelled.limit(0), ["a", "b"], "code", ("WELL", "SOURCE_ROW"), codes=CLASSES).count() == 0


def test_permutation_of_a_forest_looks_up_changes_and_equals_scoring_every_row(spark, monkeypatch):
    rng = random.Random(11)
    data = [(f"w{i % 5}", i, rng.choice(CLASSES), rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(3)), 7.0, rng.random()) for i in range(1500)]
    df = spark.createDataFrame(data, "WELL string, SOURCE_ROW long, code int, a double, b double, c double, d double, e double")
    features, key = ["a", "b", "c", "d", "e"], ("WELL", "SOURCE_ROW")
    model = L.train_forest(df, features, "code", codes=CLASSES, trees=12, depth=14, leaf=1)

    def counts():
        found = L.permutation_counts(model, df, features, "code", key, 2, ["a", "c", "d", "e"], CLASSES).collect()
        return {(r["model"], r["repeat"], r["true_code"], r["pred_code"]): r["n"] for r in found}

    with monkeypatch.context() as plain:
        plain.setattr(L, "forest_tables", lambda *_: None)
        expected = counts()
    monkeypatch.setattr(RandomForestClassificationModel, "transform", lambda *_: pytest.fail("rows were scored again"))
    assert counts() == expected and len(expected) > 60
    few = L.train_forest(df, features, "code", codes=CLASSES, trees=2, depth=1, leaf=1)  # many equal sums of votes
    model = few
    now = counts()
    monkeypatch.undo()
    monkeypatch.setattr(L, "forest_tables", lambda *_: None)
    assert counts() == now


def random_features(spark, n):
    """Rows of training wells with three classes and the 41 features."""
    code = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % 3 + 1).cast("int"))
    values = {f: F.pmod(F.xxhash64("id", F.lit(f)), F.lit(1000)) / 1000.0 + (F.col("id") % 3 if f == "GR" else 0.0) for f in feature_names()}
    return spark.range(n).select((F.col("id") % 5 + 2).cast("int").alias("well"), F.col("id").cast("int").alias("pos"), code.alias("true_code"),
                                 F.lit("TRAIN").alias("split"), *[v.alias(f) for f, v in values.items()])


def counted_fit(spark, monkeypatch, tmp_path, fit):
    """The model of a query's fit on 4,000 labelled rows, and how many of them it had."""
    from depthlog.plans import learning_queries as Q
    seen, real = [], T.dealt
    for name, value in {"TREES": 2, "DEPTH": 3, "ROUNDS": 1, "BOOST_DEPTH": 1, "store": lambda _: T.ModelStore(spark, str(tmp_path)), "read": lambda *_: None}.items():
        monkeypatch.setattr(Q, name, value)
    monkeypatch.setattr(T, "data_mark", lambda _: "mark")
    monkeypatch.setattr(T, "dealt", lambda df, *a: seen.append(df.count()) or real(df, *a))
    model = getattr(Q, fit)(spark, "", random_features(spark, 4000))
    return model, seen


def test_forests_of_queries_are_fitted_on_all_labelled_rows(spark, monkeypatch, tmp_path):
    model, seen = counted_fit(spark, monkeypatch, tmp_path, "fitted")
    assert seen == [4000] and model.numFeatures == len(feature_names())


def test_boosting_of_queries_is_fitted_on_all_labelled_rows(spark, monkeypatch, tmp_path):
    model, seen = counted_fit(spark, monkeypatch, tmp_path, "boosted")
    assert seen == [4000] and len(model.models) == 3


def test_a_tree_split_over_tasks_is_the_tree_grown_in_one(spark, labelled, monkeypatch):
    from depthlog.operators import forest_fit
    known = labelled.filter("code is not null")
    out = []
    for most in (10_000, 150):  # the second cuts upper nodes by sums of all tasks
        monkeypatch.setattr(forest_fit, "PIECE_ROWS", most)
        model = L.train_forest(labelled, ["a", "b"], "code", trees=1, depth=12, leaf=3, codes=CLASSES)
        scored = L.score(model, known, ["a", "b"], "m", CLASSES, probabilities=True).select("SOURCE_ROW", "m_CODE", "m_P").collect()
        out.append((sorted(map(tuple, scored)), [round(float(i), 9) for i in model.featureImportances.toArray()]))
    assert out[0] == out[1] and len({str(r[2]) for r in out[0][0]}) > 30


def test_forests_do_not_depend_on_the_order_of_rows(spark, labelled, monkeypatch):
    from depthlog.operators import forest_fit
    monkeypatch.setattr(forest_fit, "PIECE_ROWS", 800)
    monkeypatch.setattr(forest_fit, "ROUND_BYTES", 3000 * 20)  # several rounds
    out = []
    for df in (labelled, labelled.repartition(5)):
        model = L.train_forest(L.add_class_weights(df.filter("code is not null"), "code"), ["a", "b"], "code", "weight", trees=5, depth=9, leaf=2,
                               codes=CLASSES, key=("WELL", "SOURCE_ROW"))
        out.append(sorted(map(tuple, L.score(model, labelled, ["a", "b"], "m", CLASSES).select("SOURCE_ROW", "m_CODE", "m_CONFIDENCE").collect())))
    assert out[0] == out[1]
    assert sum(r["m_CODE"] == r["code"] for r in L.score(model, labelled.filter("code is not null"), ["a", "b"], "m", CLASSES).collect()) > 2400


def test_thresholds_come_from_all_values():
    import numpy as np
    from depthlog.operators import forest_fit
    assert forest_fit.cuts(*forest_fit.compressed(np.array([2.0, 0.0, 1.0, 1.0]), np.ones(4), 10)).tolist() == [0.5, 1.5]
    v, w, exact = forest_fit.compressed(np.arange(10_000.0), np.ones(10_000), 500)
    assert not exact and w.sum() == 10_000 and np.allclose(forest_fit.cuts(v, w, exact), np.arange(1, 32) * 312.5, atol=21)
    rare = np.r_[np.zeros(9_990), np.ones(10)]
    assert forest_fit.cuts(*forest_fit.compressed(rare, np.ones(10_000), 500)).tolist() == [0.5]
    assert forest_fit.cuts(*forest_fit.compressed(np.full(5, 7.0), np.ones(5), 500)).tolist() == []


def test_fits_leave_no_tables_but_the_model(spark, labelled, tmp_path):
    from depthlog.operators.staging import staged
    before = set(staged(spark))
    store = T.ModelStore(spark, str(tmp_path))
    model = store.get({"a": 1}, lambda: L.train_forest(labelled, ["a", "b"], "code", trees=3, depth=4, leaf=1, codes=CLASSES), None)
    assert set(staged(spark)) == before and model.path.startswith(str(tmp_path))
    assert L.score(model, labelled, ["a", "b"], "m", CLASSES).filter("m_CODE = code").count() > 2400
