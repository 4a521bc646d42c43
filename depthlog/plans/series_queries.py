"""Queries over runs, beds, contacts, gaps and depth order."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthlog.operators import quality as A, stats as D
from depthlog.operators.series import number_rows, number_runs, runs
from depthlog.plans.fixture import MODELS, clean_wells, on_wells, read, wells, wells_by_depth
from depthlog.plans.metric_queries import r6
from depthlog.plans.quality_queries import RAW_CURVES, _STEPS, _TYPICAL, raw_named
from depthlog.plans.registry import query
from depthlog.schema import CODES, INPUT_CURVES


def _runs_sql(table, keys, value, order="pos", where=""):
    on = ", ".join(keys)
    return f"""g AS (SELECT *, {value} AS v, row_number() OVER (PARTITION BY {on} ORDER BY {order})
  - row_number() OVER (PARTITION BY {on}, {value} ORDER BY {order}) AS grp FROM {table} {where})"""


@query("label_runs", on_wells(f"""
, {_runs_sql('wells', ['well'], 'true_code')},
b AS (SELECT well, v AS value, min(pos) AS first_row, max(pos) AS last_row, count(*) AS n, min(dept) AS top, max(dept) AS base FROM g GROUP BY well, v, grp)
SELECT well, value, CAST(first_row AS BIGINT) AS first_row, CAST(last_row AS BIGINT) AS last_row, n, round(top, 6) AS top, round(base, 6) AS base,
       row_number() OVER (PARTITION BY well ORDER BY first_row) - 1 AS run FROM b"""))
def label_runs(spark, sf_dir):
    found = runs(wells(spark, sf_dir), "well", "pos", F.col("true_code"), {"top": ("first", F.col("dept")), "base": ("last", F.col("dept"))})
    return r6(number_runs(found, "well").withColumns({c: F.col(c).cast("long") for c in ("first_row", "last_row")}), "top", "base")


@query("event_runs", """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS grp FROM e)
SELECT user_id, event_type AS value, min(pos) AS first_row, max(pos) AS last_row, count(*) AS n FROM g GROUP BY user_id, event_type, grp""")
def event_runs(spark, sf_dir):
    return runs(event_series(spark, sf_dir), "user_id", "pos", F.col("event_type"))


def event_series(spark, sf_dir):
    """The irregular second series: key = user, order = time."""
    return number_rows(read(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value"), "user_id",
                       [F.col("ts")], [F.to_date("ts")], "pos")


_BEDS = _runs_sql("sources", ["well", "source"], "code")


@query("bed_thickness", on_wells(f"""
, {_STEPS}, allstep AS (SELECT well, quantile_cont(step, 0.5) AS step FROM st GROUP BY well), {_BEDS},
b AS (SELECT well, source, v AS code, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY well, source, v, grp)
SELECT b.well, source, code, count(*) AS beds, round(avg(n) * any_value(step), 6) AS mean_thickness, round(max(n) * any_value(step), 6) AS max_thickness
FROM b JOIN allstep USING (well) GROUP BY b.well, source, code"""))
def bed_thickness(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, "true_code", *MODELS.values())
    return r6(D.bed_thickness(df, MODELS, "true_code", "well", "at", "dept"), "mean_thickness", "max_thickness")


_BRIDGED = """bridged AS (SELECT well, pos, dept, true_code FROM wells WHERE true_code IS NOT NULL AND pos % 41 <> 0)"""


def holed(df):
    """Labels with single samples knocked out, so that bridging matters."""
    return df.withColumn("true_code", F.when(F.col("pos") % 41 != 0, F.col("true_code")))


@query("run_length_spread", on_wells(f"""
, {_BRIDGED}, {_runs_sql('bridged', ['well'], 'true_code')},
b AS (SELECT v AS code, count(*) AS n FROM g GROUP BY well, v, grp)
SELECT code, count(*) AS runs, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max,
       round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q75,
       round(avg(n) * 0.152, 6) AS mean_m, round(quantile_cont(n, 0.5) * 0.152::DOUBLE, 6) AS median_m FROM b GROUP BY code"""))
def run_length_spread(spark, sf_dir):
    out = D.run_length_spread(holed(wells(spark, sf_dir)), "true_code", "well", "pos")
    return r6(out, "mean", "std", "q25", "median", "q75", "mean_m", "median_m")


_KIND = "CASE WHEN value IS NULL THEN 'missing' WHEN value < 0 THEN 'negative' WHEN value = 0 THEN 'zero' END"
_VALUE_RUNS = f"""
{_runs_sql('raw_logs', ['well', 'curve'], _KIND)},
b AS (SELECT well, curve, v AS kind, CAST(min(pos) AS BIGINT) AS first_row, CAST(max(pos) AS BIGINT) AS last_row, count(*) AS n, min(dept) AS depth_start,
             max(dept) AS depth_end, min(value) AS min, max(value) AS max FROM g WHERE v IS NOT NULL GROUP BY well, curve, v, grp)"""


@query("value_runs", on_wells(f"""
, {_VALUE_RUNS} SELECT well, curve, kind, first_row, last_row, n, round(depth_start, 6) AS depth_start, round(depth_end, 6) AS depth_end,
  round(min, 6) + 0.0 AS min, round(max, 6) + 0.0 AS max FROM b"""))
def value_runs(spark, sf_dir):
    out = A.value_runs(raw_named(spark, sf_dir), RAW_CURVES, "well", "pos", "dept")
    return r6(out, "depth_start", "depth_end", "min", "max")


@query("run_totals", on_wells(f", {_VALUE_RUNS} SELECT well, curve, kind, count(*) AS runs, max(n) AS longest, CAST(sum(n) AS BIGINT) AS samples FROM b GROUP BY ALL"))
def run_totals(spark, sf_dir):
    return A.run_totals(A.value_runs(raw_named(spark, sf_dir), RAW_CURVES, "well", "pos", "dept"), "well")


@query("gap_context", on_wells("""
, h AS (SELECT well, pos, dept, GR, RHOB, CASE WHEN pos % 41 <> 0 THEN true_code END AS t FROM curves),
x AS (SELECT *, lag(t) OVER w AS tb, lead(t) OVER w AS ta, lag(GR) OVER w AS gb, lead(GR) OVER w AS ga, lag(RHOB) OVER w AS rb, lead(RHOB) OVER w AS ra,
             row_number() OVER w - row_number() OVER (PARTITION BY well, t IS NULL ORDER BY pos) AS grp, max(pos) OVER (PARTITION BY well) AS last
      FROM h WINDOW w AS (PARTITION BY well ORDER BY pos))
SELECT well, CAST(min(pos) AS BIGINT) AS first_row, CAST(max(pos) AS BIGINT) AS last_row, count(*) AS n, round(min(dept), 6) AS gap_top, round(max(dept), 6) AS gap_base,
       arg_min_null(tb, pos) AS true_code_before, arg_max_null(ta, pos) AS true_code_after, round(arg_min_null(gb, pos), 6) AS GR_before,
       round(arg_max_null(ga, pos), 6) AS GR_after, round(arg_min_null(rb, pos), 6) AS RHOB_before, round(arg_max_null(ra, pos), 6) AS RHOB_after
FROM x WHERE t IS NULL GROUP BY well, grp HAVING min(pos) > 1 AND max(pos) < any_value(last)"""))
def gap_context(spark, sf_dir):
    df = holed(clean_wells(spark, sf_dir))
    out = A.gap_context(df, "true_code", ["GR", "RHOB"], "well", "pos", "dept")
    return r6(out.withColumns({c: F.col(c).cast("long") for c in ("first_row", "last_row")}),
              "gap_top", "gap_base", "GR_before", "GR_after", "RHOB_before", "RHOB_after")


_CONTACTS = """c AS (SELECT well, lag(true_code) OVER (PARTITION BY well ORDER BY pos) AS f, true_code AS t FROM bridged),
ct AS (SELECT {by} f AS from_code, t AS to_code, count(*) AS contacts FROM c WHERE f <> t GROUP BY ALL)"""


@query("transitions", on_wells(f", {_BRIDGED}, {_CONTACTS.format(by='well,')} SELECT * FROM ct"))
def transitions(spark, sf_dir):
    df = holed(wells_by_depth(spark, sf_dir, "true_code"))
    return D.transitions(df, "true_code", "well", "at")


@query("transition_ranking", on_wells(f"""
, {_BRIDGED}, {_CONTACTS.format(by='')}
SELECT from_code, to_code, contacts, CAST(row_number() OVER (ORDER BY contacts DESC, f.display_order, t.display_order) AS INT) AS rank
FROM ct JOIN lith f ON f.code = from_code JOIN lith t ON t.code = to_code"""))
def transition_ranking(spark, sf_dir):
    """Contacts over all wells, most first, then in display order of the classes."""
    df = holed(wells_by_depth(spark, sf_dir, "true_code"))
    total = D.transitions(df, "true_code", "well", "at").groupBy("from_code", "to_code").agg(F.sum("contacts").alias("contacts"))
    return D.ranked_transitions(total)


@query("transition_matrix", on_wells(f"""
, {_BRIDGED}, {_CONTACTS.format(by='')}, s AS (SELECT from_code FROM ct UNION SELECT to_code FROM ct)
SELECT s.from_code, """ + ", ".join(f"CAST(coalesce(sum(contacts) FILTER (to_code = {c}), 0) AS BIGINT) AS to_{c}" for c in sorted(CODES))
    + " FROM s LEFT JOIN ct USING (from_code) GROUP BY s.from_code"))
def transition_matrix(spark, sf_dir):
    df = holed(wells_by_depth(spark, sf_dir, "true_code"))
    return D.transition_matrix(D.transitions(df, "true_code", "well", "at"))


@query("depth_gap_classes", on_wells(f"""
, {_STEPS} SELECT well, count(step) AS steps, count(*) FILTER (step <= 0) AS not_increasing, count(*) FILTER (step <= 0) = 0 AS monotonic,
  count(*) FILTER (step > 0.152001) AS over_1_step, count(*) FILTER (step > 0.304001) AS over_2_steps, count(*) FILTER (step > 1) AS over_1m,
  count(*) FILTER (step > 10) AS over_10m, count(*) FILTER (step > 100) AS over_100m FROM st GROUP BY well"""))
def depth_gap_classes(spark, sf_dir):
    return A.gap_classes(wells(spark, sf_dir), "well", "pos", "dept")


@query("event_gap_classes", """
WITH e AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events)
SELECT user_id, count(step) AS steps, count(*) FILTER (step <= 0) AS not_increasing, count(*) FILTER (step <= 0) = 0 AS monotonic,
  count(*) FILTER (step > 0.152001) AS over_1_step, count(*) FILTER (step > 0.304001) AS over_2_steps, count(*) FILTER (step > 1) AS over_1m,
  count(*) FILTER (step > 10) AS over_10m, count(*) FILTER (step > 100) AS over_100m FROM e GROUP BY user_id""")
def event_gap_classes(spark, sf_dir):
    return A.gap_classes(event_series(spark, sf_dir), "user_id", "pos", "value")


@query("largest_gaps", on_wells(f"""
, {_STEPS} SELECT well, pos, round(dept, 6) AS dept, round(step, 6) AS step FROM st WHERE step IS NOT NULL ORDER BY round(step, 6) DESC, well, pos LIMIT 20"""))
def largest_gaps(spark, sf_dir):
    found = A.steps(wells(spark, sf_dir), "well", "pos", "dept").filter(F.col("step").isNotNull())
    return r6(found, "dept", "step").orderBy(F.desc("step"), "well", "pos").limit(20)


@query("order_checks", on_wells("""
, h AS (SELECT * FROM (SELECT well, pos, gr_raw, gr_raw - lag(gr_raw) OVER (PARTITION BY well ORDER BY pos) AS step FROM wells))
SELECT well, count(*) AS "rows", CAST(min(pos) AS BIGINT) AS first_row, CAST(max(pos) AS BIGINT) AS last_row,
       CAST(max(pos) - min(pos) + 1 = count(*) AS INT) AS contiguous, count(*) FILTER (step < 0) AS out_of_order FROM h GROUP BY well"""))
def order_checks(spark, sf_dir):
    out = A.order_checks(wells(spark, sf_dir), "well", "pos", "gr_raw")
    return out.withColumns({c: F.col(c).cast("long") for c in ("first_row", "last_row")})


@query("gap_rows", on_wells(f"""
, {_STEPS}, {_TYPICAL},
s AS (SELECT *, lead(dept) OVER (PARTITION BY well ORDER BY pos) - dept AS ahead FROM wells JOIN typical USING (well))
SELECT well, pos, round(dept, 6) AS dept, true_code, pred_a, 0 AS is_gap FROM s
UNION ALL SELECT well, pos, round(dept + typical, 6), NULL, NULL, 1 FROM s WHERE ahead > 5 * typical"""))
def gap_rows(spark, sf_dir):
    df = wells_by_depth(spark, sf_dir, "true_code", "pred_a")
    out = D.insert_gap_rows(df.withColumn("row", F.col("pos")), ["row", "true_code", "pred_a"], "well", "at", "dept")
    return r6(out.withColumn("pos", (F.col("at") + 1).cast("int")).drop("row", "at"), "dept")


@query("depth_edges", on_wells("""
, e AS (SELECT well, pos, dept, lag(dept) OVER w AS u, lead(dept) OVER w AS d FROM wells WINDOW w AS (PARTITION BY well ORDER BY pos))
SELECT well, pos, round(coalesce((u + dept) / 2, dept - (d - dept) / 2), 6) AS upper, round(coalesce((dept + d) / 2, dept + (dept - u) / 2), 6) AS lower FROM e"""))
def depth_edges(spark, sf_dir):
    return r6(D.depth_edges(wells_by_depth(spark, sf_dir), "well", "at", "dept").select("well", "pos", "upper", "lower"), "upper", "lower")
