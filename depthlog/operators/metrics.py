"""Classification metrics, all derived from one small table of (model, true, predicted) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlog.schema import CODES, PENALTY_COARSE, TRUE, penalty_table


def model_samples(df: DataFrame, models: dict[str, str], true: str = TRUE,
                  keep: Sequence[str] = (), confidences: dict[str, str] | None = None) -> DataFrame:
    """One row per (sample, model): `keep`, true_code, model, pred_code and, if asked, confidence."""
    def entry(name, col):
        fields = [F.lit(name).alias("model"), F.col(col).cast("int").alias("pred_code")]
        if confidences is not None:
            conf = F.col(confidences[name]) if name in confidences else F.lit(None)
            fields.append(conf.cast("double").alias("confidence"))
        return F.struct(*fields)
    return df.select(*keep, F.col(true).alias("true_code"),
                     F.inline(F.array(*[entry(n, c) for n, c in models.items()])))


def pair_counts(df: DataFrame, models: dict[str, str], true: str = TRUE, by: Sequence[str] = ()) -> DataFrame:
    """Labelled samples per ([by], model, true_code, pred_code)."""
    return (model_samples(df.filter(F.col(true).isNotNull()), models, true, by)
            .groupBy(*by, "model", "true_code", "pred_code").agg(F.count(F.lit(1)).alias("n")))


def confusion(pairs: DataFrame, by: Sequence[str] = (), classes: Sequence[int] | None = None,
              shared: bool = False) -> DataFrame:
    """Counts for every cell of the class square, zeros included.

    Classes are those seen in truth or prediction of the model (of any model when `shared`),
    or the given fixed list.
    """
    group = [*by, "model"]
    per_model = pairs.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("true_code", "pred_code"), "n"))).alias("cells"),
        F.array_union(F.collect_set("true_code"), F.collect_set("pred_code")).alias("seen"))
    if classes is not None:
        per_model = per_model.withColumn("seen", F.array(*[F.lit(c) for c in classes]))
    elif shared:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        per_model = per_model.withColumn(
            "seen", F.array_distinct(F.flatten(F.collect_list("seen").over(whole))))
    return (per_model.withColumn("true_code", F.explode("seen")).withColumn("pred_code", F.explode("seen"))
            .select(*group, "true_code", "pred_code",
                    F.coalesce(F.try_element_at("cells", F.struct("true_code", "pred_code")), F.lit(0))
                    .cast("long").alias("n")))


def row_shares(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion cells as share of the true class; empty classes give 0."""
    row = Window.partitionBy(*by, "model", "true_code")
    return cells.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(row)), F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support and predicted count per class; division by zero gives 0."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("true_code") == F.col("pred_code"), F.col("n")).otherwise(zero)
    penalty = F.col("n") * F.col("penalty") if "penalty" in pairs.columns else F.lit(None).cast("double")
    known = F.when(penalty.isNotNull(), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("true_code").alias("code"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.alias("hits"), penalty.alias("cost"), known.alias("costed")),
        F.struct(F.col("pred_code").alias("code"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hits"), F.lit(None).cast("double").alias("cost"), zero.alias("costed")))
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return (pairs.select(*by, "model", F.inline(sides)).groupBy(*by, "model", "code")
            .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits", "cost", "costed")])
            .withColumns({"precision": p, "recall": r,
                          "f1": ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))}))


def with_penalty(pairs: DataFrame, table: str = PENALTY_COARSE, unknown: str = "error") -> DataFrame:
    """Add the cost of each (true, predicted) pair; the table has exactly 144 rows."""
    costs = F.broadcast(penalty_table(pairs.sparkSession, table))
    out = pairs.join(costs, ["true_code", "pred_code"], "left")
    if unknown == "error":
        return out.withColumn("penalty", F.when(
            F.col("penalty").isNull(),
            F.raise_error(F.concat(F.lit("class code without penalty: "), F.col("true_code").cast("string"),
                                   F.lit(" -> "), F.col("pred_code").cast("string"))).cast("double"))
            .otherwise(F.col("penalty")))
    if unknown != "ignore":
        raise ValueError("unknown is 'error' or 'ignore'")
    return out


def overall(pairs: DataFrame, by: Sequence[str] = (), classes: str | Sequence[int] = "truth",
            table: str = PENALTY_COARSE, unknown: str = "error") -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1, cost score per ([by], model).

    `classes` decides the macro average: classes in the truth, in truth or prediction
    ("union"), or a fixed list.
    """
    rows = per_class(with_penalty(pairs, table, unknown), by)
    true_class = F.col("support") > 0
    if classes == "truth":
        macro = F.avg(F.when(true_class, F.col("f1")))
    elif classes == "union":
        macro = F.avg("f1")
    else:
        listed = F.col("code").isin(*classes)
        macro = F.sum(F.when(listed, F.col("f1")).otherwise(0.0)) / F.lit(float(len(classes)))
    return rows.groupBy(*by, "model").agg(
        F.sum("support").alias("samples"),
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(true_class, F.col("recall"))).alias("balanced_accuracy"),
        macro.alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        (-F.try_divide(F.sum("cost"), F.sum("costed"))).alias("cost_score"))


def error_pairs(pairs: DataFrame, by: Sequence[str] = (), table: str = PENALTY_COARSE) -> DataFrame:
    """Wrong (true, predicted) pairs with their share of samples and of the total penalty."""
    group = Window.partitionBy(*by, "model")
    ranked = group.orderBy(F.desc("total_penalty"), "true_code", "pred_code").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (with_penalty(pairs, table)
            .withColumn("total_penalty", F.col("n") * F.col("penalty"))
            .withColumn("__samples", F.sum("n").over(group))
            .withColumn("__penalty", F.sum("total_penalty").over(group))
            .filter(F.col("true_code") != F.col("pred_code"))
            .withColumns({"pct_samples": 100.0 * F.col("n") / F.col("__samples"),
                          "pct_penalty": 100.0 * F.try_divide(F.col("total_penalty"), F.col("__penalty"))})
            .withColumn("cumulative_pct", F.sum("pct_penalty").over(ranked))
            .drop("__samples", "__penalty"))


def top_error_pairs(pairs: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The k commonest wrong pairs per model; ties by true, then predicted code."""
    order = Window.partitionBy(*by, "model").orderBy(F.desc("n"), "true_code", "pred_code")
    return (pairs.filter(F.col("true_code") != F.col("pred_code"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def behind_prediction(pairs: DataFrame, code: int, by: Sequence[str] = ()) -> DataFrame:
    """Actual classes among the samples predicted as `code`, with their share."""
    group = Window.partitionBy(*by, "model")
    return (pairs.filter(F.col("pred_code") == code).select(*by, "model", "true_code", "n")
            .withColumn("share", F.col("n") / F.sum("n").over(group)))


def class_f1_table(classes: DataFrame, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F1 per class with one column per model."""
    return classes.groupBy(*by, "code").pivot("model", list(models)).agg(F.first("f1"))


# --- probabilities -------------------------------------------------------------------------

def threshold_choice(probabilities: dict[int, Column], special: int, threshold) -> Column:
    """`special` at or above the threshold, else the larger of the two others (first wins ties)."""
    first, second = [c for c in probabilities if c != special]
    return (F.when(probabilities[special] >= threshold, special)
            .when(probabilities[first] >= probabilities[second], first).otherwise(second))


def threshold_sweep(df: DataFrame, true: str, probabilities: dict[int, Column], special: int,
                    thresholds: Sequence[float]) -> DataFrame:
    """pair counts per threshold (as `model`), from counts per threshold step.

    Samples are first counted by the number of thresholds their probability reaches, so only
    a few hundred rows are expanded over the thresholds.
    """
    first, second = [c for c in probabilities if c != special]
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    counted = (df.filter(F.col(true).isNotNull())
               .select(F.col(true).alias("true_code"),
                       F.when(probabilities[first] >= probabilities[second], first).otherwise(second).alias("other"),
                       F.size(F.filter(steps, lambda t: probabilities[special] >= t)).alias("reached"))
               .groupBy("true_code", "other", "reached").agg(F.count(F.lit(1)).alias("n")))
    return (counted.select("true_code", "other", "reached", "n", F.posexplode(steps).alias("i", "model"))
            .withColumn("pred_code", F.when(F.col("i") < F.col("reached"), special).otherwise(F.col("other")))
            .groupBy("model", "true_code", "pred_code").agg(F.sum("n").alias("n")))


def best_thresholds(sweep: DataFrame, special: int) -> DataFrame:
    """Thresholds with the best F1 of `special` and the best macro F1; the lowest wins ties."""
    classes = per_class(sweep)
    table = classes.groupBy("model").agg(F.avg("f1").alias("macro_f1"),
                                         F.max(F.when(F.col("code") == special, F.col("f1"))).alias("special_f1"))
    best = lambda c: F.max_by("model", F.struct(F.round(c, 9), -F.col("model")))
    return table.agg(best("special_f1").alias("best_special"), F.max("special_f1").alias("special_f1"),
                     best("macro_f1").alias("best_macro"), F.max("macro_f1").alias("macro_f1"))


def class_weights(df: DataFrame, label: str, alphas: Sequence[float] = (1.0,)) -> DataFrame:
    """(N / (K * n_class)) ** alpha per class and alpha."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    base = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return (counts.withColumn("__w", base)
            .select("code", "n", "__w", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
            .withColumn("weight", F.pow("__w", "alpha")).drop("__w"))


def known_codes_only(df: DataFrame, column: str, codes: Sequence[int] = CODES) -> DataFrame:
    """Fail the job on a code outside the vocabulary."""
    return df.withColumn(column, F.when(F.col(column).isNull() | F.col(column).isin(*codes), F.col(column))
                         .otherwise(F.raise_error(F.concat(F.lit("unknown class code "), F.col(column).cast("string"))).cast("int")))
