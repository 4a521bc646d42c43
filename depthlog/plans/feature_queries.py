"""Queries over sources, scalar functions, cleaning, features and gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthlog.functions import columns as C
from depthlog.operators import features as X
from depthlog.operators.series import with_previous
from depthlog.plans.fixture import RAW, clean_wells, on_wells, read, wells, wells_by_depth
from depthlog.plans.registry import query
from depthlog.schema import BASE_FEATURES, FINE_WINDOWS, INPUT_CURVES, SENTINELS, feature_names, rolling_names


def rounded_all(df, columns, digits=6):
    return df.withColumns({c: C.rounded(F.col(c), digits) for c in columns})


def _roll_sql(curve, width, table_window="w"):
    h = width // 2
    frame = f"(PARTITION BY well ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    gate = f"CASE WHEN count({curve}) OVER {frame} >= 3 THEN round({{}}({curve}) OVER {frame}, 6) + 0.0 END"
    return (f"{gate.format('avg')} AS {curve}_ROLLMEAN_{width}, "
            f"{gate.format('stddev_samp')} AS {curve}_ROLLSTD_{width}")


def _rolls(windows):
    return ", ".join(_roll_sql(c, w) for c in BASE_FEATURES for w in windows)


def _rounded(names):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


@query("well_table", on_wells("""
SELECT well, pos, dept, round(gr_raw, 6) AS gr_raw, round(rdep_raw, 6) AS rdep_raw, round(rmed_raw, 6) AS rmed_raw,
       round(dtc_raw, 6) AS dtc_raw, round(rhob_raw, 6) AS rhob_raw, true_code, pred_a, pred_b, pred_c,
       round(conf_a, 6) AS conf_a FROM wells"""))
def well_table(spark, sf_dir):
    return rounded_all(wells(spark, sf_dir), [*RAW.values(), "conf_a"])


@query("parquet_projection", "SELECT l_suppkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def parquet_projection(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").filter(F.col("l_quantity").between(10, 20)).select("l_suppkey", "l_quantity")


@query("clean_curves", on_wells(f"SELECT well, pos, {_rounded(INPUT_CURVES)} FROM curves"))
def clean_curves(spark, sf_dir):
    return rounded_all(clean_wells(spark, sf_dir).select("well", "pos", *INPUT_CURVES), INPUT_CURVES)


@query("absent_curves", """
SELECT event_id, try_cast(regexp_extract(props, '-?[0-9]+', 0) AS DOUBLE) AS GR, value AS DTC,
       try_cast(event_type AS DOUBLE) AS RHOB, CAST(NULL AS DOUBLE) AS RDEP, CAST(NULL AS DOUBLE) AS RMED
FROM events""")
def absent_curves(spark, sf_dir):
    raw = read(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", "-?[0-9]+", 0).alias("gr "),
        F.col("value").alias("dtc"), F.col("event_type").alias("rhob"))
    return (X.add_absent_curves(X.normalise_columns(raw)).withColumnRenamed("EVENT_ID", "event_id"))


@query("depth_fallback", """
WITH e AS (SELECT user_id AS well, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos,
                  CASE WHEN user_id % 3 <> 0 THEN value END AS d FROM events)
SELECT well, pos, CASE WHEN count(d) OVER (PARTITION BY well) = 0 THEN CAST(pos AS DOUBLE) ELSE d END AS DEPT FROM e""")
def depth_fallback(spark, sf_dir):
    from depthlog.operators.series import number_rows
    e = number_rows(read(spark, sf_dir, "events").withColumnRenamed("user_id", "well"), "well",
                    [F.col("ts")], [F.to_date("ts")], "pos")
    e = e.select("well", "pos", F.when(F.col("well") % 3 != 0, F.col("value")).alias("DEPTH"))
    return X.depth_or_row(X.choose_depth(e), "well", "DEPT", "pos").select("well", "pos", "DEPT")


@query("row_numbers", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS source_row FROM events""")
def row_numbers(spark, sf_dir):
    from depthlog.operators.series import rank_rows
    return rank_rows(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id",
                     ["ts", "event_id"], "source_row").select("user_id", "event_id", "source_row")


_LABELS = """
raw_labels AS (
  SELECT well, pos,
         CASE CAST(pos AS INT) % 9 WHEN 0 THEN CAST(true_code AS VARCHAR) WHEN 1 THEN lower(n.name)
              WHEN 2 THEN ' ' || n.name || ' ' WHEN 3 THEN CAST(true_code AS VARCHAR) || '.4' WHEN 4 THEN 'None'
              WHEN 5 THEN '-999.25' WHEN 6 THEN CASE WHEN pos % 2 = 0 THEN 'Granite' ELSE 'Gneiss' END
              WHEN 7 THEN '-999.0' ELSE '' END AS label
  FROM wells LEFT JOIN lith n ON n.code = true_code),
decoded AS (
  SELECT r.*, coalesce(c.code, n.code) AS code FROM raw_labels r
  LEFT JOIN lith c ON c.code = round_even(try_cast(r.label AS DOUBLE), 0)
  LEFT JOIN lith n ON upper(n.name) = upper(trim(r.label)))"""


def raw_labels(spark, sf_dir):
    """Labels as text in many spellings."""
    name = C.code_to_name(F.col("true_code"))
    code = F.col("true_code").cast("string")
    pick = F.col("pos") % 9
    return wells(spark, sf_dir).select(
        "well", "pos", F.when(pick == 0, code).when(pick == 1, F.lower(name))
        .when(pick == 2, F.concat(F.lit(" "), name, F.lit(" "))).when(pick == 3, F.concat(code, F.lit(".4")))
        .when(pick == 4, "None").when(pick == 5, "-999.25")
        .when(pick == 6, F.when(F.col("pos") % 2 == 0, "Granite").otherwise("Gneiss"))
        .when(pick == 7, "-999.0").otherwise("").alias("label"))


@query("decode_labels", on_wells(f", {_LABELS} SELECT well, pos, label, code FROM decoded"))
def decode_labels(spark, sf_dir):
    return raw_labels(spark, sf_dir).withColumn("code", C.decode_label(F.col("label")))


@query("class_names", on_wells("""
SELECT well, pos, n.name AS true_name, n.display_order, p.code AS pred_back,
       CAST((SELECT count(*) FROM lith l WHERE l.code < wells.pred_a) AS INT) AS class_index
FROM wells LEFT JOIN lith n ON n.code = true_code JOIN lith p ON p.code = pred_a"""))
def class_names(spark, sf_dir):
    index = C.code_to_index(F.col("pred_a"))
    return wells(spark, sf_dir).select(
        "well", "pos", C.code_to_name(F.col("true_code")).alias("true_name"),
        C.code_to_display(F.col("true_code")).alias("display_order"),
        C.name_to_code(C.code_to_name(F.col("pred_a"))).alias("pred_back"), index.alias("class_index"))


@query("log10_resistivity", on_wells("""
SELECT well, pos, CASE WHEN rmed_raw > 0 THEN round(log10(rmed_raw), 6) + 0.0 END AS RMED_LOG10,
       round(log10(rdep_raw), 6) + 0.0 AS RDEP_LOG10 FROM wells"""))
def log10_resistivity(spark, sf_dir):
    return wells(spark, sf_dir).select("well", "pos", *[
        C.rounded(C.log10_positive(F.col(raw))).alias(out)
        for raw, out in (("rmed_raw", "RMED_LOG10"), ("rdep_raw", "RDEP_LOG10"))])


@query("missing_flags", on_wells(
    "SELECT well, pos, " + ", ".join(f"CAST({c} IS NULL AS INT) AS {c}_MISSING" for c in BASE_FEATURES) + " FROM base"))
def missing_flags(spark, sf_dir):
    return X.missing_flags(X.base_features(clean_wells(spark, sf_dir))).select(
        "well", "pos", *[f"{c}_MISSING" for c in BASE_FEATURES])


@query("resistivity_separation", on_wells(
    "SELECT well, pos, round(RDEP_LOG10 - RMED_LOG10, 6) + 0.0 AS RESISTIVITY_SEPARATION FROM base"))
def resistivity_separation(spark, sf_dir):
    return X.base_features(clean_wells(spark, sf_dir)).select(
        "well", "pos", C.rounded(F.col("RDEP_LOG10") - F.col("RMED_LOG10")).alias("RESISTIVITY_SEPARATION"))


@query("well_names", """
SELECT s_suppkey, replace(s_nationkey || '/' || s_name, '/', '_') AS official,
       regexp_replace(s_nationkey || '_9_' || s_name, '^([^_]*)_', '\\1/') AS from_file,
       lower(trim(' ' || s_name || ' ')) AS matched,
       CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'Other' END AS block,
       s_name AS stem
FROM supplier""")
def well_names(spark, sf_dir):
    nation, name = F.col("s_nationkey").cast("string"), F.col("s_name")
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", C.official_name(F.concat(nation, F.lit("/"), name)).alias("official"),
        C.file_to_well(F.concat(nation, F.lit("_9_"), name)).alias("from_file"),
        C.match_name(F.concat(F.lit(" "), name, F.lit(" "))).alias("matched"),
        C.well_block(F.concat(F.when(F.col("s_nationkey") % 2 == 0, nation).otherwise("x"), F.lit("/"), name)).alias("block"),
        C.file_stem(F.concat(F.lit("/data/wells/"), name, F.lit(".las"))).alias("stem"))


@query("curve_list", on_wells("""
SELECT well, string_agg(curve, ', ' ORDER BY curve) AS curves, count(*) AS n_curves
FROM (SELECT DISTINCT well, curve FROM logs WHERE value IS NOT NULL) GROUP BY well"""))
def curve_list(spark, sf_dir):
    from depthlog.operators.quality import curve_names
    return curve_names(clean_wells(spark, sf_dir), INPUT_CURVES, "well")


@query("correctness", on_wells("""
SELECT well, pos, model, CASE WHEN true_code IS NOT NULL THEN CAST(true_code = pred_code AS INT) END AS correct FROM samples"""))
def correctness(spark, sf_dir):
    from depthlog.operators.metrics import model_samples
    from depthlog.plans.fixture import MODELS
    return model_samples(wells(spark, sf_dir), MODELS, "true_code", ["well", "pos"]).select(
        "well", "pos", "model", C.correctness(F.col("true_code"), F.col("pred_code")).alias("correct"))


@query("export_columns", on_wells("""
SELECT well, pos, dept, pred_a, pred_b, round(conf_a, 3) AS conf_a, true_code,
       CASE WHEN true_code IS NOT NULL THEN CAST(true_code = pred_a AS INT) END AS a_correct FROM wells"""))
def export_columns(spark, sf_dir):
    from depthlog.sources.sinks import export_projection
    df = wells(spark, sf_dir).withColumn("a_correct", C.correctness(F.col("true_code"), F.col("pred_a")))
    return rounded_all(export_projection(
        df, ["well", "pos", "dept", "pred_a", "pred_a", "pred_b", "conf_a", "conf_b", "true_code", "a_correct"]),
        ["conf_a"], 3)


@query("finite_check", on_wells("""
SELECT curve, count(*) FILTER (WHERE value = 0) AS infinite,
       count(CASE WHEN value <> 0 THEN 1 / value END) AS finite_values
FROM raw_logs GROUP BY curve"""))
def finite_check(spark, sf_dir):
    from depthlog.operators.quality import infinity_counts
    from depthlog.operators.quantiles import long_form
    df = wells(spark, sf_dir)
    inverse = df.select(*[F.when(F.col(raw) == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col(raw))).alias(c)
                          for c, raw in RAW.items()])
    return infinity_counts(long_form(inverse, [], list(RAW)))


@query("sentinel_values", on_wells(f"""
SELECT well, pos, CASE WHEN s NOT IN ({', '.join(str(x) for x in SENTINELS)}) THEN s END AS gr FROM (
  SELECT well, pos, CASE WHEN pos % 11 = 0 THEN -999.25 WHEN pos % 13 = 0 THEN -9999 WHEN pos % 17 = 0 THEN -999
                         ELSE gr_raw END AS s FROM wells)"""))
def sentinel_values(spark, sf_dir):
    s = (F.when(F.col("pos") % 11 == 0, -999.25).when(F.col("pos") % 13 == 0, -9999.0)
         .when(F.col("pos") % 17 == 0, -999.0).otherwise(F.col("gr_raw")))
    return wells(spark, sf_dir).select("well", "pos", C.drop_sentinels(s).alias("gr"))


@query("drop_empty_rows", on_wells("""
SELECT well, pos, round(DTC, 6) AS DTC, round(RHOB, 6) AS RHOB FROM curves WHERE DTC IS NOT NULL OR RHOB IS NOT NULL"""))
def drop_empty_rows(spark, sf_dir):
    df = clean_wells(spark, sf_dir).select("well", "pos", "DTC", "RHOB")
    return rounded_all(X.drop_empty(df, ["DTC", "RHOB"]), ["DTC", "RHOB"])


@query("labelled_rows", on_wells("SELECT well, pos, true_code FROM wells WHERE true_code IN (30000, 65000, 65030)"))
def labelled_rows(spark, sf_dir):
    return wells(spark, sf_dir).filter(F.col("true_code").isin(30000, 65000, 65030)).select("well", "pos", "true_code")


@query("depth_interval", on_wells("SELECT well, pos, dept FROM wells WHERE dept BETWEEN 1010.032 AND 1030.4"))
def depth_interval(spark, sf_dir):
    return wells(spark, sf_dir).filter(F.col("dept").between(1010.032, 1030.4)).select("well", "pos", "dept")


@query("labelled_interval", on_wells("""
, r AS (SELECT well, min(dept) AS top, max(dept) AS base FROM wells WHERE true_code IS NOT NULL GROUP BY well)
SELECT wells.well, pos, dept FROM wells JOIN r ON r.well = wells.well
WHERE dept BETWEEN greatest(top, 1000.0) AND least(base, 1020.0)"""))
def labelled_interval(spark, sf_dir):
    from depthlog.operators.quality import crop_to_labels
    return crop_to_labels(wells(spark, sf_dir).select("well", "pos", "dept", "true_code"), "well", "dept", "true_code",
                          "pos", 1000.0, 1020.0).select("well", "pos", "dept")


@query("depth_sorted", on_wells("""
SELECT well, pos, row_number() OVER (PARTITION BY well ORDER BY value, pos) - 1 AS at FROM logs
WHERE curve = 'RHOB' AND value IS NOT NULL"""))
def depth_sorted(spark, sf_dir):
    from depthlog.operators.series import by_depth
    return by_depth(clean_wells(spark, sf_dir).select("well", "pos", "RHOB"), "well", "RHOB", "pos", "at").select("well", "pos", "at")


@query("positive_log_curves", on_wells("SELECT well, pos, rmed_raw FROM wells WHERE rmed_raw > 0 AND rdep_raw > 0"))
def positive_log_curves(spark, sf_dir):
    return wells(spark, sf_dir).filter((F.col("rmed_raw") > 0) & (F.col("rdep_raw") > 0)).select("well", "pos", "rmed_raw")


@query("rolling_features", on_wells(f"SELECT well, pos, {_rolls((5, 9, 21))} FROM base"))
def rolling_features(spark, sf_dir):
    base = X.base_features(clean_wells(spark, sf_dir)).select("well", "pos", *BASE_FEATURES)
    return rounded_all(X.rolling(base, key="well", order="pos").drop(*BASE_FEATURES), rolling_names())


@query("fine_rolling_features", on_wells(f"SELECT well, pos, {_rolls(FINE_WINDOWS)} FROM base"))
def fine_rolling_features(spark, sf_dir):
    base = X.base_features(clean_wells(spark, sf_dir)).select("well", "pos", *BASE_FEATURES)
    return rounded_all(X.rolling(base, windows=FINE_WINDOWS, key="well", order="pos").drop(*BASE_FEATURES),
                       rolling_names(FINE_WINDOWS))


_FULL = (f"{_rounded(BASE_FEATURES)}, {{rolls}}, round(RDEP_LOG10 - RMED_LOG10, 6) + 0.0 AS RESISTIVITY_SEPARATION, "
         + ", ".join(f"CAST({c} IS NULL AS INT) AS {c}_MISSING" for c in BASE_FEATURES)).format(rolls=_rolls((5, 9, 21)))
_SOME = " OR ".join(f"{c} IS NOT NULL" for c in BASE_FEATURES)


@query("feature_table", on_wells(f"""
, full_set AS (SELECT well, pos, {_FULL} FROM base) SELECT * FROM full_set WHERE {_SOME}"""))
def feature_table(spark, sf_dir):
    full = X.feature_table(clean_wells(spark, sf_dir), "well", "pos")
    X.check_features([c for c in full.columns if c not in ("well", "pos")])
    return rounded_all(full, [c for c in feature_names() if not c.endswith("_MISSING")])


@query("training_feature_table", on_wells(f"""
SELECT well, pos, {_FULL} FROM base WHERE true_code IS NOT NULL AND ({_SOME})"""))
def training_feature_table(spark, sf_dir):
    full = X.feature_table(clean_wells(spark, sf_dir), "well", "pos", scope="labelled", label="true_code")
    return rounded_all(full, [c for c in feature_names() if not c.endswith("_MISSING")])


@query("neighbour_gradient", on_wells("SELECT well, pos, " + ", ".join(
    f"round(lag({c}) OVER w, 6) + 0.0 AS {c}_PREV, round(lead({c}) OVER w, 6) + 0.0 AS {c}_NEXT, "
    f"round((lead({c}) OVER w - lag({c}) OVER w) / 0.304::DOUBLE, 6) + 0.0 AS {c}_GRADIENT" for c in BASE_FEATURES)
    + " FROM base WINDOW w AS (PARTITION BY well ORDER BY pos)"))
def neighbour_gradient(spark, sf_dir):
    base = X.base_features(clean_wells(spark, sf_dir)).select("well", "pos", *BASE_FEATURES)
    out = X.neighbour_gradient(base, key="well", order="pos").drop(*BASE_FEATURES)
    return rounded_all(out, [c for c in out.columns if c not in ("well", "pos")])


def _forward_sql(gate):
    # the depth step is rounded so that floating noise cannot decide the sixth decimal
    return on_wells("SELECT well, pos, " + ", ".join(
        f"CASE WHEN {gate} THEN round((lead({c}) OVER w - {c}) / (lead(dept) OVER w - dept), 5) + 0.0 END AS {c}_GRAD"
        for c in BASE_FEATURES) + " FROM base WINDOW w AS (PARTITION BY well ORDER BY pos)")


@query("forward_gradient", _forward_sql("lead(dept) OVER w - dept > 0"))
def forward_gradient(spark, sf_dir):
    base = X.base_features(clean_wells(spark, sf_dir)).select("well", "pos", "dept", *BASE_FEATURES)
    out = X.forward_gradient(base, key="well", order="pos", depth="dept").drop("dept", *BASE_FEATURES)
    return rounded_all(out, [c for c in out.columns if c.endswith("_GRAD")], 5)


@query("regular_step_gradient", _forward_sql("abs(lead(dept) OVER w - dept - 0.152) <= 1e-6 + 1e-5 * 0.152"))
def regular_step_gradient(spark, sf_dir):
    base = X.base_features(clean_wells(spark, sf_dir)).select("well", "pos", "dept", *BASE_FEATURES)
    out = X.forward_gradient(base, key="well", order="pos", depth="dept", regular_only=True).drop("dept", *BASE_FEATURES)
    return rounded_all(out, [c for c in out.columns if c.endswith("_GRAD")], 5)
