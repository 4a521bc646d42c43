"""Queries over inventory, data quality and descriptive statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from depthlog.functions.columns import rounded
from depthlog.operators import features as X, quality as A, stats as D
from depthlog.operators.quantiles import long_form
from depthlog.operators.staging import shared_folder
from depthlog.plans.feature_queries import raw_labels, _LABELS
from depthlog.plans.fixture import (MODELS, RAW, clean_wells, on_wells, read, split_manifest, split_of, wells, wells_by_depth)
from depthlog.plans.metric_queries import r6
from depthlog.plans.registry import query
from depthlog.schema import BASE_FEATURES, CODES, INPUT_CURVES, SPLITS, WINDOWS

RAW_CURVES = tuple(RAW)


def raw_named(spark, sf_dir):
    """Raw curves under their clean names."""
    return wells(spark, sf_dir).select("well", "pos", "dept", *[F.col(r).alias(c) for c, r in RAW.items()])


_STEPS = "st AS (SELECT *, dept - lag(dept) OVER (PARTITION BY well ORDER BY pos) AS step FROM wells)"
_TYPICAL = """typical AS (SELECT well, coalesce(quantile_cont(CASE WHEN step > 0 THEN step END, 0.5), 1.0) AS typical FROM st GROUP BY well)"""


@query("well_inventory", on_wells(f"""
, {_STEPS}, names AS (SELECT well, string_agg(curve, ', ' ORDER BY curve) AS curves, count(*) AS n_curves
  FROM (SELECT DISTINCT well, curve FROM logs WHERE value IS NOT NULL) GROUP BY well)
SELECT st.well, count(*) AS "rows", round(min(dept), 6) AS depth_min, round(max(dept), 6) AS depth_max, round(avg(step), 6) AS mean_step,
       round(quantile_cont(step, 0.5), 6) AS median_step, any_value(curves) AS curves, any_value(n_curves) AS n_curves
FROM st JOIN names USING (well) GROUP BY st.well"""))
def well_inventory(spark, sf_dir):
    return r6(A.well_inventory(clean_wells(spark, sf_dir), INPUT_CURVES, "well", "pos", "dept"),
              "depth_min", "depth_max", "mean_step", "median_step")


# curves a well lacks altogether, so that availability is not trivially complete
def patchy(df):
    return df.withColumns({"DTC": F.when(F.col("well") % 3 != 0, F.col("DTC")), "RHOB": F.when(F.col("well") % 4 != 1, F.col("RHOB"))})


_PATCHY = """patchy AS (SELECT well, pos, GR, RDEP, RMED, CASE WHEN well % 3 <> 0 THEN DTC END AS DTC, CASE WHEN well % 4 <> 1 THEN RHOB END AS RHOB FROM curves)"""
_HAVE = ", ".join(f"CAST(count({c}) > 0 AS INT) AS {c}" for c in INPUT_CURVES)


@query("curve_availability", on_wells(f", {_PATCHY} SELECT well, {_HAVE} FROM patchy GROUP BY well"))
def curve_availability(spark, sf_dir):
    return A.curve_availability(patchy(clean_wells(spark, sf_dir)), INPUT_CURVES, "well")


@query("availability_summary", on_wells(f", {_PATCHY}, m AS (SELECT well, {_HAVE} FROM patchy GROUP BY well)" + " UNION ALL ".join(
    f" SELECT '{c}' AS curve, CAST(sum({c}) AS BIGINT) AS wells, round(100.0 * sum({c}) / count(*), 6) AS pct FROM m" for c in INPUT_CURVES)))
def availability_summary(spark, sf_dir):
    return r6(A.availability_summary(curve_availability(spark, sf_dir)), "pct")


@query("sampling_audit", on_wells(f"""
, {_STEPS} SELECT well, round(min(step), 6) AS min_step, round(max(step), 6) AS max_step, round(quantile_cont(step, 0.5), 6) AS median_step,
  count(*) FILTER (abs(step - 0.152) > 1e-6) AS odd_steps FROM st GROUP BY well"""))
def sampling_audit(spark, sf_dir):
    return r6(A.sampling_audit(wells(spark, sf_dir), "well", "pos", "dept"), "min_step", "max_step", "median_step")


@query("median_step_counts", on_wells(f"""
, {_STEPS}, m AS (SELECT well, round(quantile_cont(step, 0.5), 6) AS median_step, count(*) FILTER (abs(step - 0.152) > 1e-6) AS odd FROM st GROUP BY well)
SELECT median_step, count(*) AS wells, count(*) FILTER (odd > 0) AS wells_with_odd_steps FROM m GROUP BY median_step"""))
def median_step_counts(spark, sf_dir):
    return sampling_audit(spark, sf_dir).groupBy("median_step").agg(
        F.count(F.lit(1)).alias("wells"), F.count_if(F.col("odd_steps") > 0).alias("wells_with_odd_steps"))


_COVER = """cover AS (SELECT well, count(*) AS total, count(true_code) AS labelled, count(*) - count(true_code) AS missing,
  100.0 * count(true_code) / count(*) AS pct_labelled FROM wells GROUP BY well)"""


@query("label_coverage", on_wells(f", {_COVER} SELECT well, total, labelled, missing, round(pct_labelled, 6) AS pct_labelled FROM cover"))
def label_coverage(spark, sf_dir):
    return r6(A.label_coverage(wells(spark, sf_dir), "true_code", "well"), "pct_labelled")


@query("label_coverage_spread", on_wells(f"""
, {_COVER} SELECT round(min(pct_labelled), 6) AS min, round(avg(pct_labelled), 6) AS mean, round(max(pct_labelled), 6) AS max,
  round(quantile_cont(pct_labelled, 0.5), 6) AS median FROM cover"""))
def label_coverage_spread(spark, sf_dir):
    return r6(A.spread_over(A.label_coverage(wells(spark, sf_dir), "true_code", "well"), "pct_labelled"), "min", "mean", "max", "median")


@query("well_label_summary", on_wells("""
, l AS (SELECT well, dept - lag(dept) OVER (PARTITION BY well ORDER BY pos) AS step FROM wells WHERE true_code IS NOT NULL),
m AS (SELECT well, quantile_cont(step, 0.5) AS ms FROM l GROUP BY well)
SELECT w.well, count(*) AS samples, count(true_code) AS labelled, round(min(dept) FILTER (true_code IS NOT NULL), 6) AS top,
       round(max(dept) FILTER (true_code IS NOT NULL), 6) AS base, count(DISTINCT true_code) AS classes,
       round(100.0 * count(true_code) / count(*), 6) AS pct_labelled, round(any_value(ms), 6) AS median_step
FROM wells w JOIN m USING (well) GROUP BY w.well"""))
def well_label_summary(spark, sf_dir):
    return r6(A.label_summary(wells(spark, sf_dir), "true_code", "well", "pos", "dept"), "top", "base", "pct_labelled", "median_step")


_MISSING = """miss AS (SELECT well, curve, count(*) AS total, count(*) - count(value) AS missing,
  100.0 * (count(*) - count(value)) / count(*) AS pct FROM (SELECT * FROM logs UNION ALL SELECT well, pos, dept, true_code, 'NPHI', NULL FROM wells) GROUP BY well, curve)"""


@query("missingness", on_wells(f", {_MISSING} SELECT well, curve, total, missing, round(pct, 6) AS pct_missing FROM miss"))
def missingness(spark, sf_dir):
    return r6(A.missingness(clean_wells(spark, sf_dir), [*INPUT_CURVES, "NPHI"], "well"), "pct_missing")


@query("missingness_summary", on_wells(f"""
, {_MISSING} SELECT curve, round(min(pct), 6) AS min, round(avg(pct), 6) AS mean, round(max(pct), 6) AS max,
  round(quantile_cont(pct, 0.5), 6) AS median, round(100.0 * sum(missing) / sum(total), 6) AS pooled,
  count(*) FILTER (pct > 50) AS wells_over_limit FROM miss GROUP BY curve"""))
def missingness_summary(spark, sf_dir):
    table = A.missingness(clean_wells(spark, sf_dir), [*INPUT_CURVES, "NPHI"], "well")
    return r6(A.missingness_summary(table), "min", "mean", "max", "median", "pooled")


@query("range_summary", on_wells("""
, m AS (SELECT well, curve, quantile_cont(value, 0.5) AS m FROM raw_logs WHERE value IS NOT NULL GROUP BY ALL),
e AS (SELECT curve, min(value) AS lo, max(value) AS hi FROM raw_logs GROUP BY curve)
SELECT e.curve, round(any_value(lo), 6) AS min, round(any_value(hi), 6) AS max, round(quantile_cont(m, 0.5), 6) AS median_of_medians
FROM e JOIN m USING (curve) GROUP BY e.curve"""))
def range_summary(spark, sf_dir):
    return r6(A.range_summary(raw_named(spark, sf_dir), RAW_CURVES, "well"), "min", "max", "median_of_medians")


@query("anomaly_counts", on_wells("""
SELECT curve, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value = 0) AS zero, count(*) FILTER (abs(value) > 1000) AS over_1000,
       count(*) FILTER (abs(value) > 5000) AS over_5000, round(min(value), 6) AS min, round(max(value), 6) AS max FROM raw_logs GROUP BY curve"""))
def anomaly_counts(spark, sf_dir):
    return r6(A.anomaly_counts(raw_named(spark, sf_dir), RAW_CURVES), "min", "max")


@query("value_locations", on_wells("""
SELECT well, curve, CASE WHEN value < 0 THEN 'negative' ELSE 'zero' END AS kind, count(*) AS n, round(arg_min(dept, pos), 6) AS first_depth,
       round(arg_max(dept, pos), 6) AS last_depth, round(min(value), 6) + 0.0 AS min FROM raw_logs WHERE value <= 0 GROUP BY ALL"""))
def value_locations(spark, sf_dir):
    return r6(A.value_locations(raw_named(spark, sf_dir), RAW_CURVES, "well", "pos", "dept"), "first_depth", "last_depth", "min")


@query("lithology_distribution", on_wells("""
SELECT true_code AS code, n.name, count(*) AS samples, count(DISTINCT well) AS wells,
       round(100.0 * count(*) / (SELECT count(*) FROM wells WHERE true_code IS NOT NULL), 6) AS pct_samples,
       round(100.0 * count(DISTINCT well) / (SELECT count(DISTINCT well) FROM wells), 6) AS pct_wells
FROM wells JOIN lith n ON n.code = true_code GROUP BY true_code, n.name"""))
def lithology_distribution(spark, sf_dir):
    return r6(A.lithology_distribution(wells(spark, sf_dir), "true_code", "well"), "pct_samples", "pct_wells")


@query("class_presence", on_wells("SELECT well, " + ", ".join(
    f"CAST(count(*) FILTER (true_code = {c}) > 0 AS INT) AS has_{c}" for c in (*sorted(CODES), 12345))
    + " FROM wells GROUP BY well"))
def class_presence(spark, sf_dir):
    """One of the classes asked for occurs nowhere."""
    return A.class_presence(wells(spark, sf_dir), [*sorted(CODES), 12345], "true_code", "well")


@query("class_by_split", on_wells("""
, j AS (SELECT well, true_code AS code, CASE WHEN true_code = 93000 THEN 'TRAIN' ELSE split END AS split FROM wells JOIN manifest USING (well)
        WHERE true_code IS NOT NULL),
g AS (SELECT code, s.split, count(j.well) AS samples, count(DISTINCT j.well) AS wells
      FROM (SELECT * FROM (SELECT DISTINCT code AS code FROM j), (VALUES ('TRAIN'), ('PUBLIC'), ('BLIND_TEST')) s(split)) s LEFT JOIN j USING (code, split) GROUP BY ALL)
SELECT code, split, samples, wells, round(100.0 * samples / sum(samples) OVER (PARTITION BY code), 6) AS pct FROM g"""))
def class_by_split(spark, sf_dir):
    split = F.when(F.col("true_code") == 93000, "TRAIN").otherwise(split_of(F.col("well")))
    return r6(A.class_by_split(wells(spark, sf_dir).withColumn("split", split), SPLITS, "true_code", "split", "well"), "pct")


@query("classes_absent_in_split", on_wells("""
SELECT l.code, s.split FROM lith l, (VALUES ('TRAIN'), ('PUBLIC'), ('BLIND_TEST')) s(split)
WHERE NOT EXISTS (SELECT 1 FROM wells JOIN manifest USING (well) WHERE true_code = l.code AND manifest.split = s.split AND (true_code <> 93000 OR manifest.split = 'TRAIN'))"""))
def classes_absent_in_split(spark, sf_dir):
    split = F.when(F.col("true_code") == 93000, "TRAIN").otherwise(split_of(F.col("well")))
    table = A.class_by_split(wells(spark, sf_dir).withColumn("split", split), SPLITS, "true_code", "split", "well")
    return table.filter(F.col("samples") == 0).select("code", "split")


@query("describe_curves", on_wells("""
SELECT well, curve, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(min(value), 9) AS min,
       round(max(value), 9) AS max, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS median,
       round(quantile_cont(value, 0.75), 9) AS q75 FROM logs GROUP BY well, curve"""))
def describe_curves(spark, sf_dir):
    return r6(A.describe(clean_wells(spark, sf_dir), INPUT_CURVES, ["well"]), "mean", "std", "min", "max", "q25", "median", "q75", digits=9)


@query("class_feature_spread", on_wells("""
SELECT true_code AS code, curve, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr
FROM logs WHERE true_code IS NOT NULL GROUP BY true_code, curve"""))
def class_feature_spread(spark, sf_dir):
    return r6(A.class_feature_spread(clean_wells(spark, sf_dir), INPUT_CURVES, "true_code"), "median", "q25", "q75", "iqr")


@query("train_medians", on_wells("""
SELECT curve, round(quantile_cont(value, 0.5), 6) AS median FROM logs JOIN manifest USING (well) WHERE split = 'TRAIN' GROUP BY curve"""))
def train_medians(spark, sf_dir):
    from depthlog.operators.joins import attach_split
    df = attach_split(clean_wells(spark, sf_dir), split_manifest(spark, sf_dir), "well", "split", "pos").filter(F.col("split") == "TRAIN")
    return r6(A.medians(df, INPUT_CURVES), "median")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return A.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_EMPTY = "(label IS NULL OR upper(trim(label)) IN ('', 'NONE', 'NAN', 'NULL', 'NA', 'N/A', '-999', '-999.25', '-9999'))"


@query("label_diagnostics", on_wells(f"""
, {_LABELS} SELECT well, count(*) AS "rows", count(*) FILTER ({_EMPTY}) AS empty, count(code) AS recognised,
  count(*) FILTER (NOT {_EMPTY} AND code IS NULL) AS unrecognised FROM decoded GROUP BY well"""))
def label_diagnostics(spark, sf_dir):
    return A.label_diagnostics(raw_labels(spark, sf_dir), "label", "well")


@query("unknown_labels", on_wells(f"""
, {_LABELS} SELECT trim(label) AS label, count(*) AS n FROM decoded WHERE NOT {_EMPTY} AND code IS NULL GROUP BY trim(label) ORDER BY n DESC, label LIMIT 5"""))
def unknown_labels(spark, sf_dir):
    return A.unknown_labels(raw_labels(spark, sf_dir), "label")


@query("label_status", on_wells("""
, x AS (SELECT well, dept, CASE WHEN well % 4 = 0 THEN NULL WHEN well % 4 = 1 THEN pred_a ELSE true_code END AS t FROM wells)
SELECT well, count(*) AS samples, count(t) AS labelled, round(min(dept) FILTER (t IS NOT NULL), 6) AS depth_min,
       round(max(dept) FILTER (t IS NOT NULL), 6) AS depth_max, round(count(t) / count(*), 6) AS fraction,
       CASE WHEN count(t) = 0 THEN 'no_valid_labels' WHEN count(t) < count(*) THEN 'partial' ELSE 'full' END AS status FROM x GROUP BY well"""))
def label_status(spark, sf_dir):
    df = wells(spark, sf_dir).withColumn("t", F.when(F.col("well") % 4 == 1, F.col("pred_a")).when(F.col("well") % 4 != 0, F.col("true_code")))
    return r6(A.label_status(df, "t", "well", "dept"), "depth_min", "depth_max", "fraction")


@query("first_locations", on_wells("""
SELECT well, round(arg_min(rmed_raw, pos) FILTER (rmed_raw > 0), 6) AS RMED, round(arg_min(RHOB, pos) FILTER (RHOB IS NOT NULL), 6) AS RHOB,
       round(arg_min(GR, pos) FILTER (GR IS NOT NULL), 6) AS GR FROM curves GROUP BY well"""))
def first_locations(spark, sf_dir):
    return r6(A.first_locations(clean_wells(spark, sf_dir), ["RMED", "RHOB", "GR"], "well", "pos"), "RMED", "RHOB", "GR")


@query("block_locations", on_wells("""
, f AS (SELECT well, arg_min(RMED, pos) FILTER (RMED IS NOT NULL) AS x, arg_min(GR, pos) FILTER (GR IS NOT NULL) AS y FROM curves GROUP BY well)
SELECT CAST(well % 7 AS VARCHAR) AS block, count(*) AS wells, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean,
       round(max(x) - min(x), 6) AS x_range, round(max(y) - min(y), 6) AS y_range FROM f GROUP BY ALL"""))
def block_locations(spark, sf_dir):
    from depthlog.functions.columns import well_block
    places = A.first_locations(clean_wells(spark, sf_dir), ["RMED", "GR"], "well", "pos")
    name = F.concat((F.col("well") % 7).cast("string"), F.lit("/"), F.col("well").cast("string"))
    return r6(A.block_locations(places.withColumn("block", well_block(name)), "RMED", "GR", "block"), "x_mean", "y_mean", "x_range", "y_range")


@query("extreme_values", on_wells("SELECT well, pos, rmed_raw, abs(rmed_raw) AS magnitude FROM wells WHERE abs(rmed_raw) > 5000"))
def extreme_values(spark, sf_dir):
    return A.extreme_values(wells(spark, sf_dir).select("well", "pos", "rmed_raw"), "rmed_raw", 5000, "well", "pos")


@query("depth_neighbourhood", on_wells("""
SELECT well, pos, dept FROM wells JOIN (SELECT well, arg_min(pos, abs(dept - 1033.3) * 1e6 + pos) AS near FROM wells GROUP BY well) USING (well)
WHERE pos BETWEEN near - 20 AND near + 20"""))
def depth_neighbourhood(spark, sf_dir):
    return A.around_nearest(wells(spark, sf_dir), 1033.3, 20, "well", "pos", "dept").select("well", "pos", "dept")


@query("largest_values", on_wells("SELECT well, pos, rdep_raw FROM wells ORDER BY rdep_raw DESC, well, pos LIMIT 20"))
def largest_values(spark, sf_dir):
    return wells(spark, sf_dir).select("well", "pos", "rdep_raw").orderBy(F.desc("rdep_raw"), "well", "pos").limit(20)


@query("bottom_wells", on_wells("""
SELECT well, count(DISTINCT true_code) AS classes, count(*) AS n FROM wells GROUP BY well ORDER BY classes, n DESC, well LIMIT 10"""))
def bottom_wells(spark, sf_dir):
    return (wells(spark, sf_dir).groupBy("well").agg(F.countDistinct("true_code").alias("classes"), F.count(F.lit(1)).alias("n"))
            .orderBy("classes", F.desc("n"), "well").limit(10))


# --- statistics -----------------------------------------------------------------------------

@query("curve_summary", on_wells("""
, v AS (SELECT well, curve, CASE WHEN curve NOT IN ('RDEP', 'RMED') OR value > 0 THEN value END AS value FROM raw_logs)
SELECT well, curve, count(*) AS samples, count(value) AS valid, round(100.0 * (1 - count(value) / count(*)), 6) AS pct_missing,
       round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.1), 6) + 0.0 AS p10, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50,
       round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.9), 6) + 0.0 AS p90, round(max(value), 6) + 0.0 AS max,
       round(stddev_samp(value), 6) AS std FROM v GROUP BY well, curve"""))
def curve_summary(spark, sf_dir):
    return r6(D.curve_summary(raw_named(spark, sf_dir), RAW_CURVES, ["well"]), "pct_missing", "min", "p10", "p50", "mean", "p90", "max", "std")


@query("sample_step", on_wells(f", {_STEPS}, {_TYPICAL} SELECT well, round(typical, 6) AS step FROM typical"))
def sample_step(spark, sf_dir):
    return r6(D.sample_step(wells_by_depth(spark, sf_dir), "well", "at", "dept"), "step")


_MIX = f"""{_STEPS}, {_TYPICAL},
mix AS (SELECT well, source, code, count(*) AS samples, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY well, source) AS fraction
        FROM sources WHERE code IS NOT NULL GROUP BY well, source, code)"""


@query("lithology_mix", on_wells(f"""
, {_MIX} SELECT mix.well, source, code, samples, round(fraction, 9) AS fraction, round(samples * typical, 9) AS thickness FROM mix JOIN typical USING (well)"""))
def lithology_mix(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, "true_code", *MODELS.values())
    return r6(D.lithology_mix(df, MODELS, "true_code", "well", "at", "dept"), "fraction", "thickness", digits=9)


@query("mix_entropy", on_wells(f"""
, {_MIX} SELECT well, source, count(*) AS classes, round(-sum(fraction * log2(fraction)), 6) AS entropy, round(log2(12), 6) AS max_entropy FROM mix GROUP BY ALL"""))
def mix_entropy(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, "true_code", *MODELS.values())
    return r6(D.mix_entropy(D.lithology_mix(df, MODELS, "true_code", "well", "at", "dept"), "well"), "entropy", "max_entropy")


@query("distribution_share", on_wells("""
, t AS (SELECT well, pos, CASE WHEN well % 4 <> 0 THEN true_code END AS t FROM wells),
s AS (SELECT s.well, source, CASE WHEN source = 'Original' THEN t ELSE code END AS code FROM sources s JOIN t ON t.well = s.well AND t.pos = s.pos
      WHERE t IS NOT NULL OR s.well % 4 = 0),
c AS (SELECT well, source, code, count(*) AS n FROM s WHERE code IS NOT NULL AND NOT (code = 74000 AND source = 'a') GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT well, source FROM c) JOIN (SELECT DISTINCT well, code FROM c) USING (well))
SELECT g.well, g.source, g.code, coalesce(n, 0) AS samples,
       round(100.0 * coalesce(n, 0) / sum(n) OVER (PARTITION BY g.well, g.source), 6) AS share_pct
FROM g LEFT JOIN c ON c.well = g.well AND c.source = g.source AND c.code = g.code"""))
def distribution_share(spark, sf_dir):
    df = wells(spark, sf_dir).withColumns({"true_code": F.when(F.col("well") % 4 != 0, F.col("true_code")),
                                           "pred_a": F.when(F.col("pred_a") != 74000, F.col("pred_a"))})
    return r6(D.distribution_share(df, MODELS, "true_code", "well"), "share_pct")


@query("depth_composition", on_wells("""
, l AS (SELECT well, dept, true_code AS code, min(dept) OVER w AS lo, max(dept) OVER w AS hi FROM wells WHERE true_code IS NOT NULL WINDOW w AS (PARTITION BY well)),
b AS (SELECT well, code, CAST(least(floor((dept - lo) * 24 / (hi - lo)), 23) AS INT) AS bin FROM l),
n AS (SELECT well, bin, code, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT well, CAST(i AS INT) AS bin, code FROM (SELECT DISTINCT well, code FROM n), range(24) r(i))
SELECT g.well, g.bin, g.code, round(coalesce(n / sum(n) OVER (PARTITION BY g.well, g.bin), 0), 6) AS fraction
FROM g LEFT JOIN n ON n.well = g.well AND n.bin = g.bin AND n.code = g.code"""))
def depth_composition(spark, sf_dir):
    return r6(D.depth_composition(wells(spark, sf_dir), "true_code", "well", "dept", "pos"), "fraction")


@query("interval_stats", on_wells(f"""
, {_STEPS}, {_TYPICAL},
a AS (SELECT well, pred_a IS DISTINCT FROM lag(pred_a) OVER (PARTITION BY well ORDER BY pos) AS ch FROM wells),
t AS (SELECT well, true_code IS DISTINCT FROM lag(true_code) OVER (PARTITION BY well ORDER BY pos) AS ch FROM wells WHERE true_code IS NOT NULL)
SELECT w.well, count(*) AS n, round(min(dept), 6) AS top, round(max(dept), 6) AS base, round(max(dept) - min(dept), 6) AS span,
       (SELECT round(typical, 6) FROM typical y WHERE y.well = w.well) AS step,
       (SELECT count(*) FROM a WHERE a.well = w.well AND ch) AS beds_first_model, (SELECT count(*) FROM t WHERE t.well = w.well AND ch) AS beds_original
FROM wells w GROUP BY w.well"""))
def interval_stats(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, "true_code", "pred_a")
    return r6(D.interval_stats(df, "pred_a", "true_code", "well", "at", "dept"), "top", "base", "span", "step")


_RANKED = """
x AS (SELECT well, pos, 'GR' AS c, GR AS v FROM base UNION ALL SELECT well, pos, 'RDEP', RDEP_LOG10 FROM base UNION ALL SELECT well, pos, 'RMED', RMED_LOG10 FROM base
      UNION ALL SELECT well, pos, 'DTC', DTC FROM base UNION ALL SELECT well, pos, 'RHOB', RHOB FROM base),
p AS (SELECT {by} a.c AS l, b.c AS r, a.v AS a, b.v AS b FROM x a JOIN x b ON a.well = b.well AND a.pos = b.pos
      WHERE a.c <> b.c AND a.v IS NOT NULL AND b.v IS NOT NULL),
rk AS (SELECT {g} l, r, rank() OVER (PARTITION BY {g} l, r ORDER BY a) + (count(*) OVER (PARTITION BY {g} l, r, a) - 1) / 2.0 AS ra,
             rank() OVER (PARTITION BY {g} l, r ORDER BY b) + (count(*) OVER (PARTITION BY {g} l, r, b) - 1) / 2.0 AS rb FROM p)
SELECT {g} l AS "left", r AS "right", round(corr(ra, rb), 6) AS rho FROM rk GROUP BY {g} l, r"""


@query("spearman", on_wells("," + _RANKED.format(by="", g="")))
def spearman(spark, sf_dir):
    return r6(D.spearman(clean_wells(spark, sf_dir)), "rho")


@query("well_spearman", on_wells("," + _RANKED.format(by="a.well,", g="well,")))
def well_spearman(spark, sf_dir):
    return r6(D.spearman(clean_wells(spark, sf_dir), by=["well"]), "rho")


_QUARTERS = {"q25": 0.25, "median": 0.5, "q75": 0.75}


@query("sketch_describe", on_wells("""
SELECT curve, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, 1 AS q25, 1 AS median, 1 AS q75
FROM raw_logs WHERE value IS NOT NULL GROUP BY curve"""))
def sketch_describe(spark, sf_dir):
    """Sketches of every well, stored by two runs and merged over both: 1 where a quantile's exact rank is in the bound."""
    from depthlog.operators import sketches as S
    df = wells(spark, sf_dir).select("well", *[F.col(f"{c.lower()}_raw").alias(c) for c in INPUT_CURVES])
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for run in (0, 1):
        S.keep(S.sketches(df.filter(F.col("well") % 2 == run), "well", INPUT_CURVES), path, str(run))
    table = S.sketch_quantiles(S.merged(S.kept(spark, path)), _QUARTERS)
    met = long_form(df, [], INPUT_CURVES).filter(F.col("value").isNotNull()).join(F.broadcast(table), "curve")  # a row for each curve
    error = S.rank_error()

    def inside(name, q):
        below, upto = F.avg((F.col("value") < F.col(name)).cast("int")), F.avg((F.col("value") <= F.col(name)).cast("int"))
        return ((below <= q + error) & (upto >= q - error)).cast("int").alias(name)
    out = met.groupBy("curve", "n", "low", "high").agg(*[inside(n, q) for n, q in _QUARTERS.items()])
    return r6(out, "low", "high")


_WINDOW_PAIRS = [(f"{c}_ROLLMEAN_{a}", f"{c}_ROLLMEAN_{b}") for c in BASE_FEATURES for a, b in zip(WINDOWS, WINDOWS[1:])]


def rolled(spark, sf_dir):
    base = X.base_features(clean_wells(spark, sf_dir)).select("well", "pos", *BASE_FEATURES)
    return X.rolling(base, key="well", order="pos")


def _window_pairs_sql(expr, out):
    frame = lambda c, w: (f"CASE WHEN count({c}) OVER f{w} >= 3 THEN avg({c}) OVER f{w} END AS {c}_ROLLMEAN_{w}")
    cols = ", ".join(frame(c, w) for c in BASE_FEATURES for w in WINDOWS)
    win = ", ".join(f"f{w} AS (PARTITION BY well ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)" for w in WINDOWS)
    return on_wells(f", rl AS (SELECT well, {cols} FROM base WINDOW {win})" + " UNION ALL ".join(
        f" SELECT '{a}' AS \"left\", '{b}' AS \"right\", round({expr.format(a=a, b=b)}, 6) AS {out} FROM rl" for a, b in _WINDOW_PAIRS))


@query("window_correlation", _window_pairs_sql("corr({a}, {b})", "r"))
def window_correlation(spark, sf_dir):
    return r6(D.pearson(rolled(spark, sf_dir), _WINDOW_PAIRS), "r")


@query("adjacent_window_difference", _window_pairs_sql("avg(abs({a} - {b}))", "mean_abs_diff"))
def adjacent_window_difference(spark, sf_dir):
    return r6(D.mean_absolute_difference(rolled(spark, sf_dir), _WINDOW_PAIRS), "mean_abs_diff")


@query("crossplot_sample", on_wells("""
SELECT well, pos, round(RMED, 6) AS RMED, round(RHOB, 6) AS RHOB, true_code, pred_a FROM curves
WHERE RMED > 0 AND RHOB IS NOT NULL AND true_code IS NOT NULL ORDER BY md5(well || '-' || pos || '-0'), well, pos LIMIT 8000"""))
def crossplot_sample(spark, sf_dir):
    return r6(D.crossplot(clean_wells(spark, sf_dir), "RMED", "RHOB", ["true_code", "pred_a"], 8000, ["well", "pos"]), "RMED", "RHOB")


@query("panel_agreement", on_wells("SELECT model AS panel, round(avg(CAST(true_code = pred_code AS INT)), 6) AS agreement FROM samples GROUP BY model"))
def panel_agreement(spark, sf_dir):
    return r6(D.panel_agreement(wells(spark, sf_dir), "true_code", MODELS), "agreement")


@query("hash_sample", on_wells("SELECT well, pos FROM wells ORDER BY md5(well || '-' || pos || '-42'), well, pos LIMIT 500"))
def hash_sample(spark, sf_dir):
    return D.hash_sample(wells(spark, sf_dir).select("well", "pos"), 500, ["well", "pos"], 42)


@query("wrong_samples", on_wells("""
SELECT well, pos, true_code, pred_a FROM curves WHERE true_code <> pred_a AND RHOB IS NOT NULL AND RMED IS NOT NULL"""))
def wrong_samples(spark, sf_dir):
    return D.wrong_samples(clean_wells(spark, sf_dir), "pred_a", "true_code", ["RHOB", "RMED"]).select("well", "pos", "true_code", "pred_a")
