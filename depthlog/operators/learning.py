"""Imputation, training, scoring and inspection of classifiers with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlog.functions import columns as C
from depthlog.operators import metrics as M, training as T
from depthlog.operators.features import check_features
from depthlog.operators.forest_fit import ROWS_A_TASK, Forest, binned_rows, fit_forest, thresholds_of
from depthlog.operators.forests import forest_tables, substituted_counts
from depthlog.operators.quality import medians
from depthlog.operators.quantiles import quantiles
from depthlog.operators.series import as_list, rank_rows
from depthlog.operators.staging import discard, stage, staged_at
from depthlog.schema import CODES, KEY, ROW


# --- imputation and weights -----------------------------------------------------------------

def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact training median of each column: one number per column reaches the driver."""
    return {r["curve"]: r["median"] for r in medians(train, columns).collect()}


def impute(df: DataFrame, fitted: dict[str, float]) -> DataFrame:
    """Missing values become the fitted medians; add the missing flags before calling."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in fitted.items()})


def add_class_weights(df: DataFrame, label: str, alpha: float = 0.5, out: str = "weight") -> DataFrame:
    """Sample weights (N / (K n_class)) ** alpha; the class table has one row per class."""
    table = {r["code"]: r["weight"] for r in M.class_weights(df, label, (alpha,)).collect()}
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return df.withColumn(out, F.try_element_at(pairs, F.col(label)))


# --- training -------------------------------------------------------------------------------

def _labelled_rows(df: DataFrame, features: Sequence[str], label: str, weight: str | None, codes: Sequence[int],
                   max_rows: int | None, key: Sequence[str] | None, seed: int) -> tuple[DataFrame, str | None]:
    """(rows to fit with __x and __y; name of the weight): labelled rows, at most `max_rows` if that is given."""
    rows = M.known_codes_only(df.filter(F.col(label).isNotNull()), label, codes)
    if max_rows is not None:
        weight = weight or "__weight"
        rows = T.bounded(rows, label, key or features, max_rows, seed, weight)
    rows = rows.withColumn("__y", C.code_to_index(F.col(label), codes).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error").transform(rows), weight


def _training_rows(df: DataFrame, features: Sequence[str], label: str, weight: str | None, codes: Sequence[int],
                   max_rows: int | None, key: Sequence[str] | None, seed: int) -> tuple[DataFrame, str | None]:
    """(__x, __y, weight of the rows to fit, staged; name of the weight)."""
    rows, weight = _labelled_rows(df, features, label, weight, codes, max_rows, key, seed)
    held = T.hashed(key or features, seed + 1)
    return stage(rows.select("__x", "__y", *([weight] if weight else []), held.alias("__draw"))), weight


def train_forest(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, codes: Sequence[int] = CODES,
                 trees: int = 100, depth: int = 20, leaf: int = 5, seed: int = 42, max_rows: int | None = None,
                 key: Sequence[str] | None = None) -> Forest:
    """Random forest over class positions in ascending code order.

    All labelled rows are used, as a byte for each feature, and dealt evenly over tasks (see `forest_fit`). A tree draws
    them by a hash of `key`, or by their place. `max_rows` bounds them by classes, chosen by a hash of `key` (or of the
    features) and weighted by one over the share taken."""
    rows, weight = _labelled_rows(df, features, label, weight, codes, max_rows, key, seed)
    own = F.xxhash64(F.lit(seed), *[F.col(k) for k in key]) if key else F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    rows = rows.select(vector_to_array("__x").alias("__v"), "__y", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), own.alias("__key"))
    thresholds = thresholds_of(rows, len(features))
    path, even = staged_at(T.dealt(binned_rows(rows, thresholds), ROWS_A_TASK))
    model = fit_forest(even, thresholds, len(codes), trees, depth, leaf, seed)
    discard(even.sparkSession, path)
    return model


def train_boosted(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, codes: Sequence[int] = CODES,
                  rounds: int = 20, depth: int = 5, seed: int = 42, max_rows: int | None = None, key: Sequence[str] | None = None,
                  held_out: float = 0.2) -> T.BoostedClasses:
    """One boosted tree classifier per class with calibrated probabilities; a stand-in for native multi-class boosting.

    The share `held_out` of the rows (by a hash of `key`, or of the features) is in no tree: it stops the rounds and
    calibrates the scores."""
    rows, weight = _training_rows(df, features, label, weight, codes, max_rows, key, seed)
    return T.train_boosted_classes(rows, len(codes), F.col("__draw") < held_out, weight, rounds, depth, seed=seed)


class RuleModel:
    """A model given by an expression: class probabilities from the array of features. For rules, and to check what is
    built on top of models."""

    def __init__(self, probabilities):
        self.probabilities = probabilities

    def transform(self, df: DataFrame) -> DataFrame:
        p = F.col("__p")
        chosen = (F.array_position(p, F.array_max(p)) - 1).cast("double")
        return (df.withColumn("__p", self.probabilities(vector_to_array("__x")))
                .withColumns({"prediction": chosen, "probability": array_to_vector(p)}).drop("__p"))


# --- scoring --------------------------------------------------------------------------------

def score(model, df: DataFrame, features: Sequence[str], name: str, codes: Sequence[int] = CODES,
          probabilities: bool = False) -> DataFrame:
    """Add {name}_CODE, {name}_NAME and {name}_CONFIDENCE (the probability of the chosen class, NULL from a model without).

    A position of the model that stands for no class code fails the job.
    """
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error").transform(df))
    code = decoded(F.col("prediction"), codes)
    out = {f"{name}_CODE": code, f"{name}_NAME": C.code_to_name(code)}
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        out[f"{name}_CONFIDENCE"] = F.element_at(p, F.col("prediction").cast("int") + 1)
        if probabilities:
            out[f"{name}_P"] = p
    else:
        out[f"{name}_CONFIDENCE"] = F.lit(None).cast("double")
    return scored.withColumns(out).drop("__x", "prediction", "probability", "rawPrediction")


def decoded(position: Column, codes: Sequence[int] = CODES) -> Column:
    """Class code of a position in the ascending class list; a position outside it fails the job."""
    code = C.index_to_code(position, codes)
    text = F.concat(F.lit("model position without class code: "), F.coalesce(position.cast("string"), F.lit("none")))
    return F.when(code.isNull(), F.raise_error(text).cast("int")).otherwise(code)


def predict(df: DataFrame, models: dict, features: Sequence[str], wanted: Sequence[str] | None = None,
            codes: Sequence[int] = CODES) -> DataFrame:
    """Wide prediction table of several models, or of the wanted ones; no rows, models or features missing is an error."""
    names = list(wanted or models)
    unknown = [n for n in names if n not in models]
    if unknown or not names:
        raise ValueError(f"unknown or no models: {unknown}")
    check_features([c for c in df.columns if c in set(features)], features)
    if df.isEmpty():
        raise ValueError("no rows to score")
    for n in names:
        df = score(models[n], df, features, n, codes)
    return df


def save_bundle(model, path: str, features: Sequence[str], codes: Sequence[int] = CODES) -> None:
    from depthlog.sources.sinks import write_parameters
    T.save_model(model, f"{path}/model")
    write_parameters(_spark(), f"{path}/parameters", json.dumps({"features": list(features), "codes": sorted(codes)}))


def load_bundle(path: str, loader=Forest, expected: Sequence[str] | None = None):
    """(model, features, codes) after checking names, order, uniqueness and classes."""
    from depthlog.sources.sinks import read_parameters
    meta = json.loads(read_parameters(_spark(), f"{path}/parameters"))
    features, codes = meta["features"], meta["codes"]
    if expected is not None and features != list(expected):
        raise ValueError("features differ in name or order from the contract")
    if len(set(features)) != len(features) or not set(codes) <= set(CODES):
        raise ValueError("feature names repeat, or a class code is unknown")
    model = loader.load(f"{path}/model")
    if getattr(model, "numFeatures", len(features)) != len(features):
        raise ValueError("model and parameters disagree on the number of features")
    return model, features, codes


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.active()


# --- decisions on top of a model ------------------------------------------------------------

def specialist_decision(df: DataFrame, base: str, probabilities: dict[int, Column], special: int, threshold: float = 0.35,
                        gate: str = "group", out: str = "final_code") -> DataFrame:
    """Second opinion of a three-class specialist.

    gate="group": where the base model chose any of the three classes; gate="special": only
    where it chose the special one.
    """
    classes = list(probabilities) if gate == "group" else [special]
    opened = F.col(base).isin(*classes)
    return df.withColumns({"gated": opened.cast("int"),
                           out: F.when(opened, M.threshold_choice(probabilities, special, threshold)).otherwise(F.col(base))})


def train_specialist(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], weight: str | None = None,
                     **forest) -> Forest:
    """A forest that knows only the given classes, fitted on the rows of these."""
    return train_forest(df.filter(F.col(label).isin(*classes)), features, label, weight, codes=sorted(classes), **forest)


def cascade(df: DataFrame, base: str, specialist, features: Sequence[str], classes: Sequence[int], special: int, threshold: float = 0.35,
            gate: str = "group", out: str = "final_code") -> DataFrame:
    """Decisions of a base model with a trained specialist behind it.

    Only rows that pass the gate (see specialist_decision) are scored a second time; the class probabilities of the
    specialist are spliced in as p_{code}, NULL for the other rows, which keep the base model's class."""
    ordered = sorted(classes)
    wanted = F.col(base).isin(*(ordered if gate == "group" else [special]))
    # A row whose base class is NULL is not gated, and is kept.
    opened, closed = df.filter(F.coalesce(wanted, F.lit(False))), df.filter(~F.coalesce(wanted, F.lit(False)))
    second = score(specialist, opened, features, "__second", ordered, probabilities=True)
    given = second.withColumns({f"p_{c}": F.get("__second_P", F.lit(i)) for i, c in enumerate(ordered)})
    given = specialist_decision(given.select(*df.columns, *[f"p_{c}" for c in ordered]), base, {c: F.col(f"p_{c}") for c in ordered},
                                special, threshold, gate, out)
    kept = closed.withColumns({f"p_{c}": F.lit(None).cast("double") for c in ordered} | {"gated": F.lit(0), out: F.col(base)})
    return given.unionByName(kept)


# --- inspection -----------------------------------------------------------------------------

def impurity_importance(model, features: Sequence[str]) -> DataFrame:
    """Features by impurity importance (one row per feature of the model)."""
    values = [float(x) for x in model.featureImportances.toArray()]
    table = _spark().createDataFrame(list(zip(features, values)), "feature STRING, importance DOUBLE")
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")))


def permuted(df: DataFrame, column: str, key: Sequence[str], seed: int) -> DataFrame:
    """The table with one column shuffled over all rows: values meet rows by rank."""
    keys = list(key)
    hashed = df.select(F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(f"{column}{seed}"))).alias("__h"),
                       *keys, F.col(column).alias("__value"))
    donors = rank_rows(hashed, [], ["__h", *keys], "__rank").select("__rank", "__value")
    receivers = df if "__rank" in df.columns else rank_rows(df, [], keys, "__rank")
    return receivers.drop(column).join(donors, "__rank").withColumnRenamed("__value", column)


def permutation_counts(model, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = (KEY, ROW), repeats: int = 3,
                       columns: Sequence[str] | None = None, codes: Sequence[int] = CODES, seed: int = 42) -> DataFrame:
    """pair counts per (model, repeat) with one feature's values moved to other rows; model "" is the table as it is.

    Rows are sorted once, by a hash of key and seed. In that order the donor of a row is a fixed number of places further
    on (around the end), another number in each repeat; donors are joined once, with all their features, and every
    feature is substituted and scored from that one row. A forest looks up only what the substituted value changes
    (`forests`); other models score every row so made."""
    keys, names = list(key), list(features)
    order = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    x = F.array(*[F.col(f).cast("double") for f in names])
    tables = forest_tables(model, len(names))
    if tables is not None:  # a byte for each feature travels
        x = tables.bins(x)
    rows = df.filter(F.col(label).isNotNull()).select(order.alias("__h"), *keys, F.col(label).alias("true_code"), x.alias("__own"))
    rows = stage(rank_rows(rows, [], ["__h", *keys], "__at").select("__at", "true_code", "__own"))
    n = rows.count()
    shifts = [max(1, n * (r + 1) // (repeats + 1)) % max(n, 1) for r in range(repeats)]
    donors = rows.select(F.col("__own").alias("__other"), F.inline(F.array(*[
        F.struct(F.lit(r).alias("repeat"), F.pmod(F.col("__at") - s, F.lit(max(n, 1))).alias("__at")) for r, s in enumerate(shifts)])))
    met = rows.join(donors, "__at")
    if tables is not None:
        counts = substituted_counts(met, tables, names, list(dict.fromkeys(columns or names)))
        return (counts.groupBy("model", "repeat", "true_code", decoded(F.col("position"), codes).alias("pred_code"))
                .agg(F.sum("n").alias("n")))
    # One row for each row, repeat and feature: made and scored where the joined row is.
    wanted = F.array(*[F.struct(F.lit(f).alias("model"), F.lit(names.index(f)).alias("__i")) for f in columns or names])
    moved = (met.select("repeat", "true_code", "__own", "__other", F.inline(wanted))
             .select("model", "repeat", "true_code", F.transform(
                 "__own", lambda v, i: F.when(i == F.col("__i"), F.get("__other", i)).otherwise(v)).alias("__v")))
    plain = rows.select(F.lit("").alias("model"), F.lit(0).alias("repeat"), "true_code", F.col("__own").alias("__v"))
    scored = model.transform(plain.unionByName(moved).withColumn("__x", array_to_vector("__v")))
    return (scored.groupBy("model", "repeat", "true_code", decoded(F.col("prediction"), codes).alias("pred_code"))
            .agg(F.count(F.lit(1)).alias("n")))


def permutation_importance(model, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = (KEY, ROW),
                           repeats: int = 3, target: int | None = None, columns: Sequence[str] | None = None,
                           codes: Sequence[int] = CODES, seed: int = 42) -> DataFrame:
    """Mean and deviation of the F1 drop per shuffled feature: macro F1, or that of one class."""
    classes = M.per_class(permutation_counts(model, df, features, label, key, repeats, columns, codes, seed), ["repeat"])
    f1 = F.avg(F.when(F.col("support") > 0, F.col("f1"))) if target is None else F.max(F.when(F.col("code") == target, F.col("f1")))
    table = stage(classes.groupBy("model", "repeat").agg(F.coalesce(f1, F.lit(0.0)).alias("f1")))
    baseline = table.filter(F.col("model") == "").agg(F.max("f1")).scalar()
    return (table.filter(F.col("model") != "").withColumn("drop", baseline - F.col("f1"))
            .groupBy(F.col("model").alias("feature")).agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation")))


def probability_study(df: DataFrame, probabilities: str, pred: str, label: str, target: int, codes: Sequence[int] = CODES) -> DataFrame:
    """P(target) and the largest P for right and wrong samples of one class, with its rivals."""
    at = sorted(codes).index(target) + 1
    rows = (df.filter(F.col(label) == target)
            .select((F.col(pred) == F.col(label)).cast("int").alias("correct"),
                    F.element_at(probabilities, at).alias("p"), F.array_max(probabilities).alias("p_max")))
    basic = rows.groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("p_max").alias("mean_p_max"))
    return basic.join(quantiles(rows, ["correct"], F.col("p"), {"q25": 0.25, "median": 0.5, "q75": 0.75}), "correct", "left")


def rival_classes(df: DataFrame, pred: str, label: str, target: int) -> DataFrame:
    """Classes predicted instead of the target."""
    return (df.filter((F.col(label) == target) & (F.col(pred) != target)).groupBy(F.col(pred).alias("code"))
            .agg(F.count(F.lit(1)).alias("n")))


def leaderboard(results: dict[str, DataFrame], baseline: str, times: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Metric rows of several runs with the change against one of them, and what each run took (`times`: name and seconds)."""
    out = None
    for name, table in results.items():
        part = table.withColumns({"run": F.lit(name)} | {n: F.lit(float(s)) for n, s in (times or {}).get(name, {}).items()})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    base = {c: F.max(F.when(F.col("run") == baseline, F.col(c))).over(Window.partitionBy("model"))
            for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")}
    return out.withColumns({f"{c}_change": F.col(c) - b for c, b in base.items()})
