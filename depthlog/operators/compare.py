"""Comparing models with each other and with the labels, sample by sample."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from depthlog.operators.metrics import model_samples
from depthlog.operators.series import BLOCK_ROWS, UP_TO_HERE, as_list, over_frame, renumber, runs
from depthlog.schema import CODES, KEY, TRUE


def consensus_columns(models: Sequence[str]) -> dict[str, Column]:
    """Majority class of a row and its share of the votes; the lowest code wins ties."""
    votes = F.array(*[F.col(c).cast("int") for c in models])
    tally = F.transform(F.array_distinct(votes),
                        lambda c: F.struct(F.size(F.filter(votes, lambda v: v == c)).alias("n"), (-c).alias("code")))
    best = F.array_max(tally)
    return {"consensus_code": -best["code"], "agreement": best["n"] / F.lit(float(len(models)))}


def pairwise_agreement(df: DataFrame, models: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Share of samples on which two models agree, for every ordered pair."""
    names = list(models)
    means = df.groupBy(*by).agg(*[
        F.avg((F.col(models[a]) == F.col(models[b])).cast("int")).alias(f"{i}_{j}")
        for (i, a), (j, b) in combinations(enumerate(names), 2)])
    cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"),
                      (F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}")).alias("agreement"))
             for i, a in enumerate(names) for j, b in enumerate(names)]
    return means.select(*by, F.inline(F.array(*cells)))


def pairwise_kappa(df: DataFrame, models: dict[str, str], true: str | None = TRUE, by: Sequence[str] = (),
                   minimum: int = 20, original: str = "Original") -> DataFrame:
    """Cohen's kappa for every ordered pair of sources; NULL below `minimum` shared samples."""
    sources = {**({original: true} if true else {}), **models}
    names = list(sources)
    cells = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"),
                               F.col(sources[a]).cast("int").alias("a"), F.col(sources[b]).cast("int").alias("b"))
                      for a, b in combinations(names, 2)])
    counts = (df.select(*by, F.inline(cells)).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
              .groupBy(*by, "left", "right", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    zero = F.lit(0).cast("long")
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(zero)
    sides = F.array(F.struct(F.col("a").alias("code"), F.col("n").alias("na"), zero.alias("nb"), same.alias("same")),
                    F.struct(F.col("b").alias("code"), zero.alias("na"), F.col("n").alias("nb"), zero.alias("same")))
    margins = (counts.select(*by, "left", "right", F.inline(sides)).groupBy(*by, "left", "right", "code")
               .agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same")))
    n = F.sum("na").cast("double")
    observed = F.sum("same") / n
    expected = F.sum(F.col("na").cast("double") * F.col("nb").cast("double")) / (n * n)
    upper = margins.groupBy(*by, "left", "right").agg(
        F.sum("na").alias("samples"),
        F.when(F.sum("na") >= minimum, F.try_divide(observed - expected, 1.0 - expected)).alias("kappa"))
    both = upper.select(*by, F.inline(F.array(
        F.struct("left", "right", "samples", "kappa"),
        F.struct(F.col("right").alias("left"), F.col("left").alias("right"), "samples", "kappa"))))
    own = df.groupBy(*by).agg(*[F.count(c).alias(f"__{i}") for i, c in enumerate(sources.values())]).select(
        *by, F.inline(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(a).alias("right"),
                                         F.col(f"__{i}").alias("samples"), F.lit(1.0).alias("kappa"))
                                for i, a in enumerate(names)])))
    return both.unionByName(own)


def bin_index(c: Column, edges: Sequence[float]) -> Column:
    """0-based bin by explicit edges, left edge included; values outside go to the end bins."""
    reached = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= c)) - 1
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(reached, F.lit(len(edges) - 2))))


def reliability(df: DataFrame, models: dict[str, str], confidences: dict[str, str], true: str = TRUE,
                bins: int = 10, minimum: int = 20) -> DataFrame:
    """Mean confidence, accuracy and size per confidence bin of labelled samples."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    rows = model_samples(df.filter(F.col(true).isNotNull()), models, true, (), confidences)
    return (rows.filter(F.col("confidence").isNotNull())
            .withColumn("bin", bin_index(F.col("confidence"), edges))
            .groupBy("model", "bin")
            .agg(F.avg("confidence").alias("mean_confidence"),
                 F.avg((F.col("pred_code") == F.col("true_code")).cast("int")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= minimum))


def confidence_histogram(df: DataFrame, confidences: dict[str, str], bins: int = 25) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("confidence"))
                      for m, c in confidences.items()])
    return (df.select(F.inline(cells)).filter(F.col("confidence").isNotNull())
            .withColumn("bin", F.greatest(F.lit(0), F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))).cast("int"))
            .groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n")))


def curve_histogram(df: DataFrame, curve: str, label: str, bins: int = 40, log: bool = False) -> DataFrame:
    """Samples per class and equal-width bin between the smallest and largest value.

    With `log`, only positive values count and bins have equal width in log10.
    """
    rows = df.select(F.col(label).alias("code"), F.col(curve).cast("double").alias("x")).dropna()
    if log:
        rows = rows.filter(F.col("x") > 0).withColumn("x", F.log10("x"))
    lo, hi = rows.agg(F.min("x")).scalar(), rows.agg(F.max("x")).scalar()
    at = F.coalesce(F.try_divide((F.col("x") - lo) * bins, hi - lo), F.lit(0.0))
    return (rows.withColumn("bin", F.least(F.floor(at), F.lit(bins - 1)).cast("int"))
            .groupBy("code", "bin").agg(F.count(F.lit(1)).alias("n")))


def model_summary(df: DataFrame, models: dict[str, str], confidences: dict[str, str], true: str = TRUE,
                  by: Sequence[str] = ()) -> DataFrame:
    """Classes predicted, mean confidence and accuracy on labelled rows per model."""
    right = F.when(F.col("true_code").isNotNull(), (F.col("pred_code") == F.col("true_code")).cast("int"))
    return (model_samples(df, models, true, by, confidences)
            .groupBy(*by, "model", "pred_code")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc"),
                 F.sum(right).alias("r"), F.count(right).alias("nr"))
            .groupBy(*by, "model")
            .agg(F.sum("n").alias("samples"), F.count("pred_code").alias("classes"),
                 F.try_divide(F.sum("c"), F.sum("nc")).alias("mean_confidence"),
                 F.try_divide(F.sum("r").cast("double"), F.sum("nr")).alias("accuracy")))


def agreement_share(df: DataFrame, models: dict[str, str], true: str = TRUE, by: Sequence[str] = ()) -> DataFrame:
    """Share of samples where all models agree, and wrong samples per model."""
    cols = [F.col(c) for c in models.values()]
    same = cols[0] == cols[-1]
    for c in cols[1:-1]:
        same = same & (cols[0] == c)
    return df.groupBy(*by).agg(
        F.avg(same.cast("int")).alias("all_agree"),
        *[F.count_if(F.col(true).isNotNull() & (F.col(c) != F.col(true))).alias(f"wrong_{m}") for m, c in models.items()])


def disagreement_intervals(df: DataFrame, models: Sequence[str], key=KEY, order: str = "DEPTH_ROW",
                           depth: str = "DEPT", top: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per key, the `top` thickest stretches on which the models do not all agree.

    The consensus reported is the commonest in the stretch, the lowest code on ties.
    """
    keys = as_list(key)
    rows = df.withColumns(consensus_columns(models))
    aggs = {"top": ("min", F.col(depth)), "base": ("max", F.col(depth)), "lowest_agreement": ("min", F.col("agreement")),
            **{f"__c{c}": ("sum", (F.col("consensus_code") == c).cast("int")) for c in CODES}}
    stretches = runs(rows, keys, order, F.col("agreement") < 1, aggs, block_rows, [depth, "agreement", "consensus_code"], lambda v: v)
    commonest = F.array_max(F.array(*[F.struct(F.col(f"__c{c}").alias("n"), F.lit(-c).alias("code")) for c in CODES]))
    rank = Window.partitionBy(*keys).orderBy(F.desc(F.round("thickness", 6)), "top")
    return (stretches.withColumn("thickness", F.col("base") - F.col("top"))
            .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
            .select(*keys, "rank", "top", "base", "thickness", F.col("n").alias("samples"),
                    (-commonest["code"]).alias("consensus_code"), "lowest_agreement"))


def rolling_accuracy(df: DataFrame, models: dict[str, str], true: str = TRUE, key=KEY, order: str = "DEPTH_ROW",
                     window: int = 200, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred rolling accuracy over labelled rows, NULL below max(10, window // 4) rows.

    Both ends of the frame are looked up in running counts of right answers, so the cost does
    not grow with the window. The counts run inside the block and its edge rows: only their
    differences are used, so the same pass makes and reads them.
    """
    keys = as_list(key)
    back, ahead = window // 2, (window - 1) // 2
    labelled = renumber(df.filter(F.col(true).isNotNull()), keys, order, "__at", block_rows)

    def build(w):
        right = {f"__r_{m}": F.coalesce(F.sum((F.col(c) == F.col(true)).cast("int")).over(w.rowsBetween(*UP_TO_HERE)), F.lit(0))
                 for m, c in models.items()}
        out = {"__hi": F.last("__at").over(w.rowsBetween(0, ahead)),
               "__lo": F.first("__at").over(w.rowsBetween(-back, 0))}
        for m in models:
            r = F.col(f"__r_{m}")
            out[f"__h_{m}"] = F.last(r).over(w.rowsBetween(0, ahead))
            out[f"__l_{m}"] = F.lag(r, back + 1, 0).over(w)
        return [right, out]

    framed = over_frame(labelled, keys, "__at", back + 1, ahead, build, block_rows)
    n = F.col("__hi") - F.col("__lo") + 1
    return framed.select(*keys, order, *[c for c in df.columns if c not in (*keys, order)], *[
        F.when(n >= max(10, window // 4), (F.col(f"__h_{m}") - F.col(f"__l_{m}")) / n).alias(f"rolling_{m}")
        for m in models])


def boundary_analysis(df: DataFrame, models: dict[str, str], true: str = TRUE, key=KEY, order: str = "DEPTH_ROW",
                      tol: int = 5, by: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Accuracy within `tol` labelled rows of a change of the true class, and elsewhere.

    The change sits on the first row of the new bed, so there is one within `tol` rows exactly
    if the classes from tol + 1 rows before to `tol` rows after are not all the same.
    """
    keys = as_list(key)
    labelled = renumber(df.filter(F.col(true).isNotNull()), keys, order, "__at", block_rows)
    frame = lambda w: w.rowsBetween(-tol - 1, tol)
    near = over_frame(labelled, keys, "__at", tol + 1, tol, lambda w: {
        "near": F.min(true).over(frame(w)) != F.max(true).over(frame(w))}, block_rows)
    keep = list(dict.fromkeys([*by, "near"]))
    counts = (model_samples(near, models, true, keep)
              .withColumn("wrong", (F.col("pred_code") != F.col("true_code")).cast("int"))
              .groupBy(*by, "model", "near").agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("wrong")))
    n_near = F.sum(F.when(F.col("near"), F.col("n")).otherwise(0))
    w_near = F.sum(F.when(F.col("near"), F.col("wrong")).otherwise(0))
    return counts.groupBy(*by, "model").agg(
        (1 - F.try_divide(w_near.cast("double"), n_near)).alias("accuracy_near"),
        (1 - F.try_divide((F.sum("wrong") - w_near).cast("double"), F.sum("n") - n_near)).alias("accuracy_inside"),
        (n_near / F.sum("n")).alias("share_near"),
        F.try_divide(w_near.cast("double"), F.sum("wrong")).alias("error_share_near"))
