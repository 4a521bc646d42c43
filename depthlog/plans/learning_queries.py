"""Queries that train and apply classifiers on the feature table. Row checks only: learners differ by engine."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from depthlog.functions.columns import code_to_index, rounded
from depthlog.operators import features as X, joins as J, learning as L, metrics as M, training as T
from depthlog.operators.forest_fit import Forest
from depthlog.operators.staging import shared_folder, stage
from depthlog.plans.fixture import clean_wells, on_wells, prepared, read, split_of
from depthlog.plans.metric_queries import _class_ctes, probabilities, r6, wells
from depthlog.plans.registry import query
from depthlog.schema import CODES, FINE_WINDOWS, INPUT_CURVES, WINDOWS, feature_names

TREES, DEPTH, LEAF = 100, 20, 5
ROUNDS, BOOST_DEPTH = 100, 6
REPEATS = 3
FITS_AT_ONCE = 3

_STORES: dict[str, T.ModelStore] = {}


def store(spark) -> T.ModelStore:
    """Fitted models of this application, and of earlier ones with the same shared folder."""
    return _STORES.setdefault(spark.sparkContext.applicationId, T.ModelStore(spark, f"{shared_folder(spark)}/depthlog-models"))


def training_input(spark, sf_dir):
    """Feature table with split, imputed from the training medians; built once per session."""
    return prepared(spark, sf_dir, "features", lambda: _training_input(spark, sf_dir))


def _training_input(spark, sf_dir):
    df = X.feature_table(clean_wells(spark, sf_dir), "well", "pos", keep=["true_code"])
    df = stage(df.withColumn("split", split_of(F.col("well"))))
    numeric = [c for c in feature_names() if not c.endswith("_MISSING")]
    return L.impute(df, L.fit_medians(J.split_rows(df, "TRAIN", "split"), numeric))


def ablation_input(spark, sf_dir):
    """training_input with the columns of all feature sets; built once per session."""
    return prepared(spark, sf_dir, "ablation", lambda: _ablation_input(spark, sf_dir))


def _ablation_input(spark, sf_dir):
    # Gradients come first, while rows are narrow; one pass makes the windows of both kinds. BLIND_TEST has no part here.
    base = X.base_features(clean_wells(spark, sf_dir)).select("well", "pos", "dept", "true_code", *INPUT_CURVES, "RDEP_LOG10", "RMED_LOG10")
    wide = X.forward_gradient(X.neighbour_gradient(base, key="well", order="pos"), key="well", order="pos", depth="dept")
    more = [c for c in wide.columns if c not in base.columns]
    table = X.feature_table(wide, "well", "pos", keep=["true_code", *more], windows=(*WINDOWS, *FINE_WINDOWS))
    df = stage(table.withColumn("split", split_of(F.col("well"))).filter(F.col("split") != "BLIND_TEST"))
    own = [c for c in feature_names() if not c.endswith("_MISSING")]
    others = [c for c in df.columns if c not in ("well", "pos", "true_code", "split", *feature_names())]
    train, known = J.split_rows(df, "TRAIN", "split"), F.col("well").isNotNull()  # rows without a well count for the first medians only
    return L.impute(df.filter(known), L.fit_medians(train, own) | L.fit_medians(train.filter(known), others))


def train_rows(df, alpha=0.5):
    """Labelled rows of the training wells with their class weights."""
    return L.add_class_weights(J.split_rows(df, "TRAIN", "split").filter(F.col("true_code").isNotNull()), "true_code", alpha)


def marked(spark, sf_dir, kind, **parameters):
    return {"kind": kind, "data": T.data_mark(read(spark, sf_dir, "lineitem"))} | parameters


def fitted(spark, sf_dir, df, features=None, alpha=0.5):
    """The forest of these features: fitted once, then taken from the store."""
    features = features or feature_names()
    parameters = marked(spark, sf_dir, "forest", features=features, alpha=alpha, trees=TREES, depth=DEPTH, leaf=LEAF)
    return store(spark).get(parameters, lambda: L.train_forest(
        train_rows(df, alpha), features, "true_code", "weight", trees=TREES, depth=DEPTH, leaf=LEAF, key=("well", "pos")), Forest.load)


def boosted(spark, sf_dir, df):
    parameters = marked(spark, sf_dir, "boosted", features=feature_names(), rounds=ROUNDS, depth=BOOST_DEPTH)
    return store(spark).get(parameters, lambda: L.train_boosted(
        J.split_rows(df, "TRAIN", "split"), feature_names(), "true_code", rounds=ROUNDS, depth=BOOST_DEPTH,
        key=("well", "pos")), T.BoostedClasses.load)


def unseen(df):
    return df.filter(F.col("split") != "TRAIN")


@query("forest_scores")
def forest_scores(spark, sf_dir):
    df = training_input(spark, sf_dir)
    out = L.predict(unseen(df), {"forest": fitted(spark, sf_dir, df)}, feature_names())
    return out.select("well", "pos", "split", "true_code", "forest_CODE", "forest_NAME", rounded(F.col("forest_CONFIDENCE")).alias("forest_CONFIDENCE"))


@query("boosted_scores")
def boosted_scores(spark, sf_dir):
    df = training_input(spark, sf_dir)
    out = L.score(boosted(spark, sf_dir, df), unseen(df), feature_names(), "boosted")
    return out.select("well", "pos", "true_code", "boosted_CODE", "boosted_NAME", rounded(F.col("boosted_CONFIDENCE")).alias("boosted_CONFIDENCE"))


@query("forest_metrics")
def forest_metrics(spark, sf_dir):
    df = training_input(spark, sf_dir)
    scored = L.score(fitted(spark, sf_dir, df), unseen(df), feature_names(), "forest")
    return r6(M.overall(M.pair_counts(scored, {"forest": "forest_CODE"}, "true_code", ["split"]), ["split"]),
              "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "cost_score")


@query("impurity_importance")
def impurity_importance(spark, sf_dir):
    df = training_input(spark, sf_dir)
    return L.impurity_importance(fitted(spark, sf_dir, df), feature_names())


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    df = training_input(spark, sf_dir)
    return r6(L.permutation_importance(fitted(spark, sf_dir, df), J.split_rows(df, "PUBLIC", "split"), feature_names(), "true_code",
                                       ("well", "pos"), repeats=REPEATS), "importance", "deviation")


@query("probability_study")
def probability_study(spark, sf_dir):
    df = training_input(spark, sf_dir)
    scored = stage(L.score(fitted(spark, sf_dir, df), unseen(df), feature_names(), "forest", probabilities=True)
                   .select("true_code", "forest_CODE", "forest_P"))
    return L.probability_study(scored, "forest_P", "forest_CODE", "true_code", 65030)


@query("rival_classes", on_wells("SELECT pred_b AS code, count(*) AS n FROM wells WHERE true_code = 65030 AND pred_b <> 65030 GROUP BY pred_b"))
def rival_classes(spark, sf_dir):
    return L.rival_classes(wells(spark, sf_dir), "pred_b", "true_code", 65030)


@query("feature_set_leaderboard")
def feature_set_leaderboard(spark, sf_dir):
    df = ablation_input(spark, sf_dir)

    def run(name_and_features):
        name, features = name_and_features
        started = time.perf_counter()
        model = fitted(spark, sf_dir, df, features)
        fit_s = time.perf_counter() - started
        scored = L.score(model, J.split_rows(df, "PUBLIC", "split"), features, "m")
        table = stage(M.overall(M.pair_counts(scored, {"forest": "m_CODE"}, "true_code")))
        return name, table, {"fit_s": fit_s, "score_s": time.perf_counter() - started - fit_s}

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        runs = list(pool.map(run, X.feature_sets().items()))
    return L.leaderboard({n: t for n, t, _ in runs}, "base_5", {n: s for n, _, s in runs})


# --- the same operators on given scores and on a rule, which SQL can follow -----------------

def given_scores():
    """Three class scores of [0, 1] that the well table gives."""
    p = probabilities()
    return F.array(*[p[c] for c in sorted(p)])


GIVEN = (30000, 65000, 65030)
_GIVEN = """
, g AS (SELECT *, coalesce(rhob_raw - 2.0, 0.3) AS p2, (1.0 - coalesce(rhob_raw - 2.0, 0.3)) * conf_a AS p0,
        (1.0 - coalesce(rhob_raw - 2.0, 0.3)) * (1.0 - conf_a) AS p1 FROM wells)"""


@query("given_probability_study", on_wells(f"""{_GIVEN}
SELECT correct, count(*) AS n, round(avg(p2), 6) AS mean_p, round(avg(greatest(p0, p1, p2)), 6) AS mean_p_max, round(quantile_cont(p2, 0.25), 6) AS q25,
  round(median(p2), 6) AS median, round(quantile_cont(p2, 0.75), 6) AS q75
FROM (SELECT *, CAST(pred_a = true_code AS INT) AS correct FROM g WHERE true_code = 65030) GROUP BY correct"""))
def given_probability_study(spark, sf_dir):
    df = stage(wells(spark, sf_dir).select("true_code", "pred_a", given_scores().alias("ps")))
    return r6(L.probability_study(df, "ps", "pred_a", "true_code", 65030, GIVEN), "mean_p", "mean_p_max", "q25", "median", "q75")


@query("given_leaderboard", on_wells(f"""
, pairs AS (SELECT model, true_code, pred_code, count(*) AS n FROM samples WHERE true_code IS NOT NULL GROUP BY ALL),
{_class_ctes()},
lead_of AS (SELECT model AS run, sum(hits) / sum(support) AS accuracy, avg(r) FILTER (support > 0) AS balanced_accuracy,
  avg(f) FILTER (support > 0) AS macro_f1, sum(f * support) / sum(support) AS weighted_f1 FROM classes GROUP BY model)
SELECT o.run, round(o.accuracy, 6) AS accuracy, round(o.accuracy - b.accuracy, 6) AS accuracy_change,
  round(o.balanced_accuracy - b.balanced_accuracy, 6) AS balanced_accuracy_change, round(o.macro_f1 - b.macro_f1, 6) AS macro_f1_change,
  round(o.weighted_f1 - b.weighted_f1, 6) AS weighted_f1_change
FROM lead_of o JOIN (SELECT * FROM lead_of WHERE run = 'a') b ON true"""))
def given_leaderboard(spark, sf_dir):
    df = wells(spark, sf_dir)
    results = {m: M.overall(M.pair_counts(df, {"given": f"pred_{m}"}, "true_code")) for m in "abc"}
    changes = [f"{c}_change" for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")]
    return r6(L.leaderboard(results, "a").select("run", "accuracy", *changes), "accuracy", *changes)


def rule():
    """P(30000), P(65000), P(65030) by gamma ray and density, a stand-in for a trained model."""
    def p(x):
        gr, rhob = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        first = F.when(gr > 30, 0.7).when(gr > 12, 0.4).otherwise(0.1)
        return F.array(first, F.when(rhob > 2.3, (1.0 - first) * 0.75).otherwise((1.0 - first) * 0.25),
                       F.when(rhob > 2.3, (1.0 - first) * 0.25).otherwise((1.0 - first) * 0.75))
    return L.RuleModel(p)


RULE_INPUT = ["gr_raw", "density", "tax"]


def rule_rows(spark, sf_dir):
    """Three inputs (the rule uses two) and labels of the rule's classes."""
    label = F.when(F.col("true_code").isin(*GIVEN), F.col("true_code")).when(F.col("true_code").isNotNull(), 30000)
    return wells(spark, sf_dir).select("well", "pos", "gr_raw", F.coalesce("rhob_raw", F.lit(2.2)).alias("density"),
                                       F.col("dtc_raw").alias("tax"), label.cast("int").alias("true_code"))


_RULE = """
, x AS (SELECT well, pos, gr_raw, coalesce(rhob_raw, 2.2) AS density, CASE WHEN true_code IN (30000, 65000, 65030) THEN true_code
    WHEN true_code IS NOT NULL THEN 30000 END AS true_code FROM wells)"""


def _rule_ctes(source):
    return f"""
f0 AS (SELECT *, CASE WHEN gr_raw > 30 THEN 0.7::DOUBLE WHEN gr_raw > 12 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS a FROM {source}),
f1 AS (SELECT *, CASE WHEN density > 2.3 THEN (1 - a) * 0.75 ELSE (1 - a) * 0.25 END AS b,
    CASE WHEN density > 2.3 THEN (1 - a) * 0.25 ELSE (1 - a) * 0.75 END AS c FROM f0),
f AS (SELECT *, greatest(a, b, c) AS top, CASE WHEN a >= b AND a >= c THEN 30000 WHEN b >= c THEN 65000 ELSE 65030 END AS pred_code FROM f1)"""


@query("rule_scores", on_wells(f"""{_RULE}, {_rule_ctes('x')}
SELECT well, pos, pred_code AS rule_CODE, name AS rule_NAME, round(top, 6) AS rule_CONFIDENCE FROM f JOIN lith ON lith.code = pred_code"""))
def rule_scores(spark, sf_dir):
    """Decoding, names and confidence of predict() on a model whose answers SQL can give too."""
    out = L.predict(rule_rows(spark, sf_dir), {"rule": rule()}, RULE_INPUT, codes=GIVEN)
    return r6(out.select("well", "pos", "rule_CODE", "rule_NAME", "rule_CONFIDENCE"), "rule_CONFIDENCE")


_MOVED = """
, own AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', well, pos, 42)), well, pos) - 1 AS at, count(*) OVER () AS n
    FROM x WHERE true_code IS NOT NULL),
shifts AS (SELECT r AS repeat, greatest(1, n * (r + 1) // 4) % n AS s, n FROM range(3) t(r), (SELECT count(*) AS n FROM x WHERE true_code IS NOT NULL)),
met AS (SELECT repeat, o.true_code, o.gr_raw, o.density, d.gr_raw AS gr_2, d.density AS density_2
    FROM own o JOIN shifts ON true JOIN own d ON d.at = (o.at + s) % o.n),
every AS (SELECT '' AS model, 0 AS repeat, true_code, gr_raw, density FROM own
  UNION ALL SELECT 'gr_raw', repeat, true_code, gr_2, density FROM met
  UNION ALL SELECT 'density', repeat, true_code, gr_raw, density_2 FROM met
  UNION ALL SELECT 'tax', repeat, true_code, gr_raw, density FROM met)"""


@query("rule_permutation_counts", on_wells(f"""{_RULE}{_MOVED}, {_rule_ctes('every')}
SELECT model, CAST(repeat AS INT) AS repeat, true_code, pred_code, count(*) AS n FROM f GROUP BY ALL"""))
def rule_permutation_counts(spark, sf_dir):
    return L.permutation_counts(rule(), rule_rows(spark, sf_dir), RULE_INPUT, "true_code", ("well", "pos"), REPEATS, codes=GIVEN)


@query("rule_permutation_importance", on_wells(f"""{_RULE}{_MOVED}, {_rule_ctes('every')},
cells AS (SELECT model, repeat, true_code, pred_code, count(*) AS n FROM f GROUP BY ALL),
sides AS (SELECT model, repeat, true_code AS code, n AS support, 0 AS predicted, CASE WHEN true_code = pred_code THEN n ELSE 0 END AS hits FROM cells
  UNION ALL SELECT model, repeat, pred_code, 0, n, 0 FROM cells),
c AS (SELECT model, repeat, code, sum(support) AS s, 2 * sum(hits) / (sum(support) + sum(predicted)) AS f1 FROM sides GROUP BY ALL),
m AS (SELECT model, repeat, avg(f1) FILTER (s > 0) AS f1 FROM c GROUP BY ALL)
SELECT model AS feature, round(avg((SELECT f1 FROM m WHERE model = '') - f1), 6) AS importance,
  round(stddev_pop((SELECT f1 FROM m WHERE model = '') - f1), 6) AS deviation FROM m WHERE model <> '' GROUP BY model"""))
def rule_permutation_importance(spark, sf_dir):
    out = L.permutation_importance(rule(), rule_rows(spark, sf_dir), RULE_INPUT, "true_code", ("well", "pos"), REPEATS, codes=GIVEN)
    return r6(out, "importance", "deviation")


BINS = 16


@query("calibrated_reliability", on_wells(f"""{_GIVEN},
raw AS (SELECT well, pos, true_code, unnest([p0, p1, p2]) AS p, unnest([30000, 65000, 65030]) AS code FROM g),
binned AS (SELECT *, CAST(least(floor(p * {BINS}), {BINS - 1}) AS INT) AS bin FROM raw),
t AS (SELECT code, bin, count(*) AS w, count(*) FILTER (true_code = code) AS h FROM binned WHERE true_code IN (30000, 65000, 65030) GROUP BY ALL),
runs AS (SELECT a.code, a.bin AS i, b.bin AS k, sum(c.h) / sum(c.w) AS mean FROM t a JOIN t b ON a.code = b.code AND a.bin <= b.bin
  JOIN t c ON c.code = a.code AND c.bin BETWEEN a.bin AND b.bin GROUP BY ALL),
iso AS (SELECT t.code, t.bin, max(m.low) AS value FROM t JOIN (SELECT r.code, r.i, u.bin, min(r.mean) AS low FROM runs r JOIN t u ON u.code = r.code
  AND u.bin BETWEEN r.i AND r.k GROUP BY ALL) m ON m.code = t.code AND m.bin = t.bin GROUP BY ALL),
full_map AS (SELECT code, b AS bin, coalesce((SELECT value FROM iso WHERE iso.code = cc.code AND iso.bin <= b ORDER BY iso.bin DESC LIMIT 1),
  (SELECT value FROM iso WHERE iso.code = cc.code ORDER BY iso.bin LIMIT 1)) AS value FROM (SELECT unnest([30000, 65000, 65030]) AS code) cc, range({BINS}) r(b)),
each AS (SELECT binned.well, binned.pos, true_code, binned.code, p, value FROM binned JOIN full_map ON full_map.code = binned.code AND full_map.bin = binned.bin),
rows AS (SELECT well, pos, true_code, arg_max(code, (p, -code)) AS pred, CASE WHEN sum(value) > 0 THEN arg_max(value, (p, -code)) / sum(value)
  ELSE max(p) / sum(p) END AS confidence FROM each GROUP BY ALL)
SELECT 'given' AS model, CAST(least(floor(confidence * 10 + 1e-9), 9) AS INT) AS tenth, round(avg(confidence), 6) AS mean_confidence,
  round(avg(CAST(pred = true_code AS INT)), 6) AS accuracy, count(*) AS n FROM rows WHERE true_code IS NOT NULL GROUP BY ALL"""))
def calibrated_reliability(spark, sf_dir):
    """Isotonic calibration of given scores on the rows of their classes, and how reliable the confidences are over all."""
    df = wells(spark, sf_dir).withColumn("ps", given_scores())
    known = df.filter(F.col("true_code").isin(*GIVEN))
    maps = T.fit_calibration(known, "ps", code_to_index(F.col("true_code"), GIVEN), len(GIVEN), bins=BINS)
    at = F.array_position("ps", F.array_max("ps"))
    rows = df.filter(F.col("true_code").isNotNull()).select(
        "true_code", L.decoded(at - 1, GIVEN).alias("pred"), F.get(T.calibrated(F.col("ps"), maps, BINS), (at - 1).cast("int")).alias("confidence"))
    out = rows.groupBy(F.lit("given").alias("model"), F.least(F.floor(F.col("confidence") * 10 + 1e-9), F.lit(9)).cast("int").alias("tenth")).agg(
        F.avg("confidence").alias("mean_confidence"), F.avg((F.col("pred") == F.col("true_code")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return r6(out, "mean_confidence", "accuracy")


def _gate_sql(gate, name):
    return f"""
SELECT '{name}' AS strategy, well, pos, true_code, CASE WHEN {gate} THEN
  CASE WHEN p >= 0.35 THEN 65030 WHEN p0 >= p1 THEN 30000 ELSE 65000 END ELSE pred_a END AS final_code, CAST({gate} AS INT) AS gated FROM sp"""


@query("specialist_decision", on_wells(f"""
, sp AS (SELECT *, coalesce(rhob_raw - 2.0, 0.3) AS p, (1 - coalesce(rhob_raw - 2.0, 0.3)) * conf_a AS p0,
         (1 - coalesce(rhob_raw - 2.0, 0.3)) * (1.0 - conf_a) AS p1 FROM wells)
{_gate_sql('pred_a IN (30000, 65000, 65030)', 'group')} UNION ALL {_gate_sql('pred_a = 65030', 'special')}"""))
def specialist_decision(spark, sf_dir):
    df, parts = wells(spark, sf_dir), []
    for gate in ("group", "special"):
        out = L.specialist_decision(df, "pred_a", probabilities(), 65030, 0.35, gate)
        parts.append(out.select(F.lit(gate).alias("strategy"), "well", "pos", "true_code", "final_code", "gated"))
    return parts[0].unionByName(parts[1])


@query("specialist_metrics", on_wells(f"""
, sp AS (SELECT *, coalesce(rhob_raw - 2.0, 0.3) AS p, (1 - coalesce(rhob_raw - 2.0, 0.3)) * conf_a AS p0,
         (1 - coalesce(rhob_raw - 2.0, 0.3)) * (1.0 - conf_a) AS p1 FROM wells),
dec AS ({_gate_sql('pred_a IN (30000, 65000, 65030)', 'group')} UNION ALL {_gate_sql('pred_a = 65030', 'special')}),
pairs AS (SELECT strategy AS model, true_code, final_code AS pred_code, count(*) AS n FROM dec WHERE true_code IS NOT NULL GROUP BY ALL),
{_class_ctes()}
SELECT model AS strategy, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(r) FILTER (support > 0), 6) AS balanced_accuracy,
  round(avg(f) FILTER (support > 0), 6) AS macro_f1, (SELECT count(*) FROM dec JOIN wells USING (well, pos) WHERE strategy = model AND final_code <> pred_a) AS changed
FROM classes GROUP BY model"""))
def specialist_metrics(spark, sf_dir):
    df, parts = wells(spark, sf_dir), []
    for gate in ("group", "special"):
        out = L.specialist_decision(df, "pred_a", probabilities(), 65030, 0.35, gate)
        changed = out.agg(F.count_if(F.col("final_code") != F.col("pred_a"))).scalar()
        parts.append(M.overall(M.pair_counts(out, {gate: "final_code"}, "true_code")).withColumn("changed", changed))
    table = parts[0].unionByName(parts[1]).select(F.col("model").alias("strategy"), "accuracy", "balanced_accuracy", "macro_f1", "changed")
    return r6(table, "accuracy", "balanced_accuracy", "macro_f1")
