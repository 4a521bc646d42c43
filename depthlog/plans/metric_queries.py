"""Queries over evaluation metrics and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthlog.functions.columns import rounded
from depthlog.operators import compare as K, metrics as M
from depthlog.plans.fixture import MODELS, on_wells, wells, wells_by_depth
from depthlog.plans.registry import query
from depthlog.schema import CODES, PENALTY_COARSE, PENALTY_FINE, penalty_rows

CONF = {"a": "conf_a"}


def r6(df, *columns, digits=6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def pairs(spark, sf_dir, by=()):
    return M.pair_counts(wells(spark, sf_dir), MODELS, "true_code", by)


def _penalties(table):
    rows = ", ".join(f"({t},{p},{c}::DOUBLE)" for t, p, c in penalty_rows(table))
    return f"pen(true_code, pred_code, penalty) AS (VALUES {rows})"


def _pairs_sql(by=""):
    return f"pairs AS (SELECT {by} model, true_code, pred_code, count(*) AS n FROM samples WHERE true_code IS NOT NULL GROUP BY ALL)"


def _class_ctes(by=""):
    """Per-class sums and ratios from a CTE named pairs."""
    return f"""
sides AS (SELECT {by} model, true_code AS code, n AS support, 0 AS predicted, CASE WHEN true_code = pred_code THEN n ELSE 0 END AS hits FROM pairs
          UNION ALL SELECT {by} model, pred_code, 0, n, 0 FROM pairs),
sums AS (SELECT {by} model, code, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted,
                sum(hits)::DOUBLE AS hits FROM sides GROUP BY ALL),
classes AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p,
                   CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r,
                   CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f FROM sums)"""


def _class_sql(by=""):
    return f"{_pairs_sql(by)}, {_class_ctes(by)}"


def _overall_sql(by="", table=PENALTY_COARSE, macro="avg(CASE WHEN support > 0 THEN f END)"):
    on = "c.well = s.well AND" if by else ""
    return on_wells(f"""
, {_penalties(table)}, {_class_sql(by)},
cost AS (SELECT {by} model, -sum(n * penalty) / sum(n) AS cost FROM pairs JOIN pen USING (true_code, pred_code) GROUP BY ALL)
SELECT {'s.well,' if by else ''} s.model, CAST(sum(support) AS BIGINT) AS samples, round(sum(hits) / sum(support), 6) AS accuracy,
       round(avg(CASE WHEN support > 0 THEN r END), 6) AS balanced_accuracy, round({macro}, 6) AS macro_f1,
       round(sum(f * support) / sum(support), 6) AS weighted_f1, round(any_value(cost), 6) AS cost_score
FROM classes s JOIN cost c ON {on} c.model = s.model GROUP BY {'s.well,' if by else ''} s.model""")


_OVERALL = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "cost_score")


@query("confusion_counts", on_wells(f"""
, {_pairs_sql()}, seen AS (SELECT DISTINCT model, true_code AS code FROM pairs UNION SELECT DISTINCT model, pred_code FROM pairs)
SELECT t.model, t.code AS true_code, p.code AS pred_code, coalesce(n, 0) AS n
FROM seen t JOIN seen p ON p.model = t.model
LEFT JOIN pairs ON pairs.model = t.model AND true_code = t.code AND pred_code = p.code"""))
def confusion_counts(spark, sf_dir):
    return M.confusion(pairs(spark, sf_dir))


@query("confusion_grid", on_wells(f"""
, {_pairs_sql()}, few AS (SELECT model, true_code, CASE WHEN pred_code = 99000 THEN 99999 ELSE pred_code END AS pred_code, n FROM pairs),
seen AS (SELECT DISTINCT true_code AS code FROM few UNION SELECT DISTINCT pred_code FROM few),
grid AS (SELECT ms.model, t.code AS true_code, p.code AS pred_code FROM (SELECT DISTINCT model FROM few) ms, seen t, seen p),
cells AS (SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN few USING (model, true_code, pred_code))
SELECT model, true_code, pred_code, n, CASE WHEN sum(n) OVER r = 0 THEN 0 ELSE round(n / sum(n) OVER r, 6) END AS share
FROM cells WINDOW r AS (PARTITION BY model, true_code)"""))
def confusion_grid(spark, sf_dir):
    """The models write one class by a code that is no true class, so its row is empty."""
    code = F.when(F.col("pred_code") == 99000, 99999).otherwise(F.col("pred_code"))
    cells = M.confusion(pairs(spark, sf_dir).withColumn("pred_code", code), shared=True)
    return r6(M.row_shares(cells), "share")


@query("fixed_class_confusion", on_wells(f"""
, {_pairs_sql("well,")},
grid AS (SELECT ms.*, t.code AS true_code, p.code AS pred_code FROM (SELECT DISTINCT well, model FROM pairs) ms, lith t, lith p)
SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN pairs USING (well, model, true_code, pred_code)"""))
def fixed_class_confusion(spark, sf_dir):
    return M.confusion(pairs(spark, sf_dir, ["well"]), ["well"], sorted(CODES))


@query("class_report", on_wells(f"""
, {_class_sql()} SELECT model, code, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support, predicted FROM classes"""))
def class_report(spark, sf_dir):
    out = M.per_class(pairs(spark, sf_dir)).select("model", "code", "precision", "recall", "f1", "support", "predicted")
    return r6(out, "precision", "recall", "f1")


@query("class_f1_by_model", on_wells(f"""
, {_class_sql()} SELECT code, round(max(f) FILTER (model = 'a'), 6) AS a, round(max(f) FILTER (model = 'b'), 6) AS b,
  round(max(f) FILTER (model = 'c'), 6) AS c FROM classes GROUP BY code"""))
def class_f1_by_model(spark, sf_dir):
    return r6(M.class_f1_table(M.per_class(pairs(spark, sf_dir)), list(MODELS)), *MODELS)


@query("overall_metrics", _overall_sql())
def overall_metrics(spark, sf_dir):
    return r6(M.overall(pairs(spark, sf_dir)), *_OVERALL)


@query("overall_metrics_fine_penalty", _overall_sql(table=PENALTY_FINE, macro="avg(f)"))
def overall_metrics_fine_penalty(spark, sf_dir):
    return r6(M.overall(pairs(spark, sf_dir), classes="union", table=PENALTY_FINE), *_OVERALL)


@query("well_metrics", _overall_sql("well, ", macro="sum(f) / 12"))
def well_metrics(spark, sf_dir):
    return r6(M.overall(pairs(spark, sf_dir, ["well"]), ["well"], classes=sorted(CODES)), *_OVERALL)


@query("cost_score", on_wells(f"""
, {_penalties(PENALTY_COARSE)}
SELECT model, round(-avg(penalty), 6) AS cost_score FROM samples JOIN pen USING (true_code, pred_code) GROUP BY model"""))
def cost_score(spark, sf_dir):
    return r6(M.overall(pairs(spark, sf_dir), unknown="ignore").select("model", "cost_score"), "cost_score")


@query("penalty_lookup", on_wells(f"""
, {_penalties(PENALTY_FINE)}
SELECT well, pos, model, true_code, pred_code, penalty FROM samples JOIN pen USING (true_code, pred_code)"""))
def penalty_lookup(spark, sf_dir):
    rows = M.model_samples(wells(spark, sf_dir).filter(F.col("true_code").isNotNull()), MODELS, "true_code", ["well", "pos"])
    return M.with_penalty(rows, PENALTY_FINE)


@query("error_pairs", on_wells(f"""
, {_penalties(PENALTY_COARSE)}, {_pairs_sql()},
costed AS (SELECT *, n * penalty AS total_penalty, sum(n) OVER (PARTITION BY model) AS s,
                  sum(n * penalty) OVER (PARTITION BY model) AS tp FROM pairs JOIN pen USING (true_code, pred_code)),
wrong AS (SELECT *, 100.0 * n / s AS ps, 100.0 * total_penalty / tp AS pp FROM costed WHERE true_code <> pred_code)
SELECT model, true_code, pred_code, n, penalty, total_penalty, round(ps, 6) AS pct_samples, round(pp, 6) AS pct_penalty,
       round(sum(pp) OVER (PARTITION BY model ORDER BY total_penalty DESC, true_code, pred_code
             ROWS UNBOUNDED PRECEDING), 5) AS cumulative_pct FROM wrong"""))
def error_pairs(spark, sf_dir):
    return r6(r6(M.error_pairs(pairs(spark, sf_dir)), "pct_samples", "pct_penalty"), "cumulative_pct", digits=5)


@query("top_error_pairs", on_wells(f"""
, {_pairs_sql()}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY n DESC, true_code, pred_code) AS INT) AS rank
                             FROM pairs WHERE true_code <> pred_code)
SELECT * FROM ranked WHERE rank <= 10"""))
def top_error_pairs(spark, sf_dir):
    return M.top_error_pairs(pairs(spark, sf_dir))


@query("behind_prediction", on_wells(f"""
, {_pairs_sql()} SELECT model, true_code, n, round(n / sum(n) OVER (PARTITION BY model), 6) AS share FROM pairs WHERE pred_code = 65030"""))
def behind_prediction(spark, sf_dir):
    return r6(M.behind_prediction(pairs(spark, sf_dir), 65030), "share")


@query("pairwise_agreement", on_wells("""
, p AS (SELECT m.well, m.model AS l, n.model AS r, avg(CAST(m.pred_code = n.pred_code AS INT)) AS v
        FROM samples m JOIN samples n ON n.well = m.well AND n.pos = m.pos GROUP BY ALL)
SELECT well, l AS "left", r AS "right", round(v, 6) AS agreement FROM p"""))
def pairwise_agreement(spark, sf_dir):
    return r6(K.pairwise_agreement(wells(spark, sf_dir), MODELS, ["well"]), "agreement")


def _kappa_sql(by, grouped):
    return on_wells(f"""
, m AS (SELECT {by} x.source AS l, y.source AS r, x.code AS a, y.code AS b, count(*) AS n
        FROM sources x JOIN sources y ON y.well = x.well AND y.pos = x.pos
        WHERE x.code IS NOT NULL AND y.code IS NOT NULL GROUP BY ALL),
ma AS (SELECT {grouped} l, r, a AS code, sum(n)::DOUBLE AS na FROM m GROUP BY ALL),
mb AS (SELECT {grouped} l, r, b AS code, sum(n)::DOUBLE AS nb FROM m GROUP BY ALL),
e AS (SELECT {grouped} l, r, sum(na * nb) AS e FROM ma JOIN mb USING ({grouped} l, r, code) GROUP BY ALL),
t AS (SELECT {grouped} l, r, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END)::DOUBLE AS o FROM m GROUP BY ALL)
SELECT {grouped} l AS "left", r AS "right", CAST(n AS BIGINT) AS samples,
       CASE WHEN l = r THEN 1.0 WHEN n >= 20 THEN round((o / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)), 6) END AS kappa
FROM t LEFT JOIN e USING ({grouped} l, r)""")


@query("pairwise_kappa", _kappa_sql("", ""))
def pairwise_kappa(spark, sf_dir):
    return r6(K.pairwise_kappa(wells(spark, sf_dir), MODELS, "true_code"), "kappa")


@query("well_kappa", _kappa_sql("x.well AS well,", "well,"))
def well_kappa(spark, sf_dir):
    return r6(K.pairwise_kappa(wells(spark, sf_dir), MODELS, "true_code", ["well"]), "kappa")


_CONSENSUS = """
tally AS (SELECT well, pos, any_value(dept) AS dept, pred_code, count(*) AS n FROM samples GROUP BY well, pos, pred_code),
cons AS (SELECT well, pos, any_value(dept) AS dept, arg_max(pred_code, n * 1000000 - pred_code) AS code, max(n) / 3.0 AS agreement
         FROM tally GROUP BY well, pos)"""


@query("consensus", on_wells(f", {_CONSENSUS} SELECT well, pos, code AS consensus_code, round(agreement, 6) AS agreement FROM cons"))
def consensus(spark, sf_dir):
    return r6(wells(spark, sf_dir).select("well", "pos", *[c.alias(n) for n, c in K.consensus_columns(list(MODELS.values())).items()]),
              "agreement")


@query("disagreement_intervals", on_wells(f"""
, {_CONSENSUS}, d AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY pos) - row_number() OVER (PARTITION BY well, agreement < 0.999 ORDER BY pos) AS g FROM cons),
i AS (SELECT well, g, min(dept) AS top, max(dept) AS base, count(*) AS samples, min(agreement) AS low FROM d WHERE agreement < 0.999 GROUP BY well, g),
cc AS (SELECT well, g, code, count(*) AS n FROM d WHERE agreement < 0.999 GROUP BY ALL),
best AS (SELECT well, g, arg_max(code, n * 1000000 - code) AS code FROM cc GROUP BY well, g),
ranked AS (SELECT i.*, best.code, row_number() OVER (PARTITION BY i.well ORDER BY round(base - top, 6) DESC, top) AS rank
           FROM i JOIN best ON best.well = i.well AND best.g = i.g)
SELECT well, CAST(rank AS INT) AS rank, round(top, 6) AS top, round(base, 6) AS base, round(base - top, 6) AS thickness, samples,
       code AS consensus_code, round(low, 6) AS lowest_agreement FROM ranked WHERE rank <= 8"""))
def disagreement_intervals(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, *MODELS.values())
    return r6(K.disagreement_intervals(df, list(MODELS.values()), "well", "at", "dept"), "top", "base", "thickness", "lowest_agreement")


_EDGES = ", ".join(f"{i}::DOUBLE * 0.1::DOUBLE" for i in range(1, 10))


@query("reliability", on_wells(f"""
, b AS (SELECT conf_a, pred_a = true_code AS ok, CAST(len(list_filter([{_EDGES}], lambda e: e <= conf_a)) AS INT) AS bin
        FROM wells WHERE true_code IS NOT NULL)
SELECT 'a' AS model, bin, round(avg(conf_a), 6) AS mean_confidence, round(avg(CAST(ok AS INT)), 6) AS accuracy, count(*) AS n
FROM b GROUP BY bin HAVING count(*) >= 20"""))
def reliability(spark, sf_dir):
    return r6(K.reliability(wells(spark, sf_dir), {"a": "pred_a"}, CONF, "true_code"), "mean_confidence", "accuracy")


@query("confidence_histogram", on_wells("""
SELECT 'a' AS model, CAST(least(floor(conf_a * 25), 24) AS INT) AS bin, count(*) AS n FROM wells GROUP BY ALL"""))
def confidence_histogram(spark, sf_dir):
    return K.confidence_histogram(wells(spark, sf_dir), CONF)


def _hist_sql(curve, x, where):
    return on_wells(f"""
, h AS (SELECT true_code AS code, {x} AS x FROM curves WHERE true_code IS NOT NULL AND {where}),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM h)
SELECT code, CAST(least(floor((x - lo) * 40 / (hi - lo)), 39) AS INT) AS bin, count(*) AS n FROM h, e GROUP BY ALL""")


@query("curve_histogram", _hist_sql("GR", "GR", "GR IS NOT NULL"))
def curve_histogram(spark, sf_dir):
    from depthlog.plans.fixture import clean_wells
    return K.curve_histogram(clean_wells(spark, sf_dir), "GR", "true_code")


@query("log_curve_histogram", _hist_sql("RDEP", "log10(RDEP)", "RDEP > 0"))
def log_curve_histogram(spark, sf_dir):
    from depthlog.plans.fixture import clean_wells
    return K.curve_histogram(clean_wells(spark, sf_dir), "RDEP", "true_code", log=True)


@query("model_summary", on_wells("""
SELECT s.well, model, count(*) AS samples, count(DISTINCT pred_code) AS classes,
       CASE WHEN model = 'a' THEN round(avg(conf_a), 9) END AS mean_confidence,
       round(avg(CAST(s.true_code = pred_code AS INT)), 9) AS accuracy
FROM samples s JOIN wells w ON w.well = s.well AND w.pos = s.pos GROUP BY s.well, model"""))
def model_summary(spark, sf_dir):
    return r6(K.model_summary(wells(spark, sf_dir), MODELS, CONF, "true_code", ["well"]), "mean_confidence", "accuracy", digits=9)


@query("agreement_share", on_wells("""
SELECT well, round(avg(CAST(pred_a = pred_b AND pred_a = pred_c AS INT)), 6) AS all_agree,
       count(*) FILTER (WHERE pred_a <> true_code) AS wrong_a, count(*) FILTER (WHERE pred_b <> true_code) AS wrong_b,
       count(*) FILTER (WHERE pred_c <> true_code) AS wrong_c FROM wells GROUP BY well"""))
def agreement_share(spark, sf_dir):
    return r6(K.agreement_share(wells(spark, sf_dir), MODELS, "true_code", ["well"]), "all_agree")


_WIDTH = 200
_FRAME = f"OVER (PARTITION BY well ORDER BY pos ROWS BETWEEN {_WIDTH // 2} PRECEDING AND {(_WIDTH - 1) // 2} FOLLOWING)"


@query("rolling_accuracy", on_wells("SELECT well, pos, " + ", ".join(
    f"CASE WHEN count(*) {_FRAME} >= 50 THEN round(avg(CAST({c} = true_code AS INT)) {_FRAME}, 6) END AS rolling_{m}"
    for m, c in MODELS.items()) + " FROM wells WHERE true_code IS NOT NULL"))
def rolling_accuracy(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, "true_code", *MODELS.values())
    out = K.rolling_accuracy(df, MODELS, "true_code", "well", "at", _WIDTH).select("well", "pos", *[f"rolling_{m}" for m in MODELS])
    return r6(out, *[f"rolling_{m}" for m in MODELS])


@query("boundary_accuracy", on_wells("""
, ch AS (SELECT *, CASE WHEN lag(true_code) OVER (PARTITION BY well ORDER BY pos) <> true_code THEN 1 ELSE 0 END AS change
         FROM wells WHERE true_code IS NOT NULL),
nr AS (SELECT *, max(change) OVER (PARTITION BY well ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM ch),
l AS (SELECT n.well, n.near, s.model, CAST(s.pred_code <> s.true_code AS INT) AS wrong FROM nr n JOIN samples s ON s.well = n.well AND s.pos = n.pos)
SELECT well, model, round(1 - avg(wrong) FILTER (near = 1), 6) AS accuracy_near, round(1 - avg(wrong) FILTER (near = 0), 6) AS accuracy_inside,
       round(avg(near), 6) AS share_near, round(sum(wrong) FILTER (near = 1) / nullif(sum(wrong), 0), 6) AS error_share_near
FROM l GROUP BY well, model"""))
def boundary_accuracy(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, "true_code", *MODELS.values())
    return r6(K.boundary_analysis(df, MODELS, "true_code", "well", "at", by=["well"]),
              "accuracy_near", "accuracy_inside", "share_near", "error_share_near")


# pseudo probabilities of three classes, from columns of the well table
def probabilities():
    special = F.col("rhob_raw") - 2.0
    special = F.coalesce(special, F.lit(0.3))
    rest = 1.0 - special
    return {30000: rest * F.col("conf_a"), 65000: rest * (1.0 - F.col("conf_a")), 65030: special}


_SPECIAL = """
probs AS (SELECT true_code, coalesce(rhob_raw - 2.0, 0.3) AS p, (1 - coalesce(rhob_raw - 2.0, 0.3)) * conf_a AS p0,
                 (1 - coalesce(rhob_raw - 2.0, 0.3)) * (1.0 - conf_a) AS p1 FROM wells WHERE true_code IN (30000, 65000, 65030)),
steps AS (SELECT 0.2::DOUBLE + i * 0.01::DOUBLE AS t FROM range(41) r(i)),
chosen AS (SELECT t, true_code, CASE WHEN p >= t THEN 65030 WHEN p0 >= p1 THEN 30000 ELSE 65000 END AS pred_code FROM probs, steps),
pairs AS (SELECT t AS model, true_code, pred_code, count(*) AS n FROM chosen GROUP BY ALL)"""
_THRESHOLDS = [0.2 + i * 0.01 for i in range(41)]


def sweep(spark, sf_dir):
    three = wells(spark, sf_dir).filter(F.col("true_code").isin(30000, 65000, 65030))
    return M.threshold_sweep(three, "true_code", probabilities(), 65030, _THRESHOLDS)


@query("threshold_sweep", on_wells(f"""
, {_SPECIAL}, {_class_ctes()}
SELECT round(model, 6) AS threshold, round(sum(hits) / sum(support), 6) AS accuracy,
       round(avg(CASE WHEN support > 0 THEN r END), 6) AS balanced_accuracy, round(avg(f), 6) AS macro_f1,
       round(max(p) FILTER (code = 65030), 6) AS special_precision, round(max(r) FILTER (code = 65030), 6) AS special_recall,
       round(max(f) FILTER (code = 65030), 6) AS special_f1 FROM classes GROUP BY model"""))
def threshold_sweep(spark, sf_dir):
    special = lambda c: F.max(F.when(F.col("code") == 65030, F.col(c)))
    out = M.per_class(sweep(spark, sf_dir)).groupBy(F.col("model").alias("threshold")).agg(
        M.ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        special("precision").alias("special_precision"), special("recall").alias("special_recall"), special("f1").alias("special_f1"))
    return r6(out, *out.columns)


@query("best_thresholds", on_wells(f"""
, {_SPECIAL}, {_class_ctes()},
g AS (SELECT model, avg(f) AS m, max(f) FILTER (code = 65030) AS s FROM classes GROUP BY model)
SELECT (SELECT round(model, 6) FROM g ORDER BY round(s, 9) DESC, model LIMIT 1) AS best_special, (SELECT round(max(s), 6) FROM g) AS special_f1,
       (SELECT round(model, 6) FROM g ORDER BY round(m, 9) DESC, model LIMIT 1) AS best_macro, (SELECT round(max(m), 6) FROM g) AS macro_f1"""))
def best_thresholds(spark, sf_dir):
    return r6(M.best_thresholds(sweep(spark, sf_dir), 65030), "best_special", "special_f1", "best_macro", "macro_f1")


@query("class_weights", on_wells("""
, n AS (SELECT true_code AS code, count(*) AS n FROM wells WHERE true_code IS NOT NULL GROUP BY true_code)
SELECT code, n, alpha, round(pow((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), alpha), 6) AS weight
FROM n, (VALUES (1.0::DOUBLE), (0.75), (0.5), (0.25), (0.0)) a(alpha)"""))
def class_weights(spark, sf_dir):
    return r6(M.class_weights(wells(spark, sf_dir), "true_code", (1.0, 0.75, 0.5, 0.25, 0.0)), "weight")
