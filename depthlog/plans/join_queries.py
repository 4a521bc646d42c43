"""Queries over joins, set operations, splits, imputation, the depth grid and well positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from depthlog.operators import features as X, joins as J, learning as L, quality as A
from depthlog.operators.staging import shared_folder
from depthlog.plans.fixture import (MODELS, RAW, clean_wells, on_wells, read, split_manifest, wells, wells_by_depth)
from depthlog.plans.metric_queries import r6
from depthlog.plans.quality_queries import raw_named
from depthlog.plans.registry import query
from depthlog.schema import BASE_FEATURES, INPUT_CURVES
from depthlog.functions.columns import rounded


def with_absent_wells(manifest):
    """The manifest and, below zero, a well without data for each of its wells."""
    return manifest.unionByName(manifest.withColumn("well", -1 - F.col("well")))


_ABSENT = "listed AS (SELECT well, split FROM manifest UNION ALL SELECT -1 - well, split FROM manifest)"


@query("split_attach", on_wells(f"""
, {_ABSENT}, w AS (SELECT CASE WHEN well % 7 = 3 THEN well + 1000000 ELSE well END AS well, pos FROM wells)
SELECT w.well, pos, split FROM w LEFT JOIN listed ON listed.well = w.well"""))
def split_attach(spark, sf_dir):
    """Every seventh well goes by a name that the manifest lacks, and the manifest lists wells without data."""
    well = F.when(F.col("well") % 7 == 3, F.col("well") + 1_000_000).otherwise(F.col("well"))
    df = wells(spark, sf_dir).select(well.alias("well"), "pos")
    return J.attach_split(df, with_absent_wells(split_manifest(spark, sf_dir)), "well", "split", "pos")


@query("gradient_attach", on_wells("""
SELECT well, pos, true_code, CASE WHEN lead(dept) OVER w > dept THEN round((lead(GR) OVER w - GR) / (lead(dept) OVER w - dept), 5) END AS GR_GRAD
FROM base WINDOW w AS (PARTITION BY well ORDER BY pos)"""))
def gradient_attach(spark, sf_dir):
    df = clean_wells(spark, sf_dir).select("well", "pos", "dept", "true_code", "GR")
    grads = X.forward_gradient(df.drop("true_code"), ["GR"], "well", "pos", "dept").select("well", "pos", "GR_GRAD")
    out = J.attach_one_to_one(df.select("well", "pos", "true_code"), grads, ["well", "pos"])
    return r6(out, "GR_GRAD", digits=5)


@query("positional_join", on_wells("""
, a AS (SELECT well, pos, row_number() OVER (PARTITION BY well ORDER BY pos) - 1 AS sample FROM wells WHERE true_code IS NOT NULL),
b AS (SELECT well, pred_b, row_number() OVER (PARTITION BY well ORDER BY pos) - 1 AS sample FROM wells)
SELECT well, sample, pos, pred_b FROM a JOIN b USING (well, sample)"""))
def positional_join(spark, sf_dir):
    df = wells(spark, sf_dir)
    left = df.filter(F.col("true_code").isNotNull()).select("well", "pos")
    right = df.select("well", F.col("pos").alias("at"), "pred_b")
    return J.attach_by_position(left, right, "well", "pos", "at")


@query("wells_without_data", on_wells(f", {_ABSENT} SELECT well FROM listed WHERE well NOT IN (SELECT well FROM wells)"))
def wells_without_data(spark, sf_dir):
    return J.absent_in(with_absent_wells(split_manifest(spark, sf_dir)), wells(spark, sf_dir), "well")


@query("wells_found", on_wells(f", {_ABSENT} SELECT well FROM listed WHERE well IN (SELECT well FROM wells)"))
def wells_found(spark, sf_dir):
    return J.present_in(with_absent_wells(split_manifest(spark, sf_dir)), wells(spark, sf_dir), "well")


@query("split_changes", on_wells(f"""
, {_ABSENT}, n AS (SELECT well, CASE WHEN well % 4 = 0 THEN 'PUBLIC' ELSE split END AS split FROM manifest)
SELECT coalesce(m.well, n.well) AS well, m.split AS old_split, n.split AS new_split
FROM (SELECT CASE WHEN well % 8 = 6 THEN well + 1000000 ELSE well END AS well, split FROM listed) m FULL JOIN n ON n.well = m.well WHERE m.split IS DISTINCT FROM n.split"""))
def split_changes(spark, sf_dir):
    """The old manifest lists wells that the new one lacks, and knows others by another name."""
    old = split_manifest(spark, sf_dir)
    new = old.withColumn("split", F.when(F.col("well") % 4 == 0, "PUBLIC").otherwise(F.col("split")))
    renamed = F.when(F.col("well") % 8 == 6, F.col("well") + 1_000_000).otherwise(F.col("well"))
    return J.split_changes(with_absent_wells(old).withColumn("well", renamed), new, "well", "split")


@query("stack_wells", on_wells("""
SELECT well, pos, gr_raw AS GR, NULL::DOUBLE AS DTC FROM wells WHERE well % 2 = 0
UNION ALL SELECT well, pos, NULL, dtc_raw FROM wells WHERE well % 2 = 1"""))
def stack_wells(spark, sf_dir):
    df = wells(spark, sf_dir)
    return J.stack_wells(df.filter(F.col("well") % 2 == 0).select("well", "pos", F.col("gr_raw").alias("GR")),
                         df.filter(F.col("well") % 2 == 1).select("well", "pos", F.col("dtc_raw").alias("DTC")))


@query("well_set_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def well_set_difference(spark, sf_dir):
    return J.absent_in(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")),
                       read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), "k")


@query("split_overlap", on_wells("""
, s AS (SELECT well, split FROM manifest UNION ALL SELECT well, 'PUBLIC' FROM manifest WHERE well % 5 = 2)
SELECT well FROM s WHERE split = 'TRAIN' INTERSECT SELECT well FROM s WHERE split = 'PUBLIC'"""))
def split_overlap(spark, sf_dir):
    m = split_manifest(spark, sf_dir)
    s = m.unionByName(m.filter(F.col("well") % 5 == 2).withColumn("split", F.lit("PUBLIC")))
    return J.split_rows(s, "TRAIN", "split").select("well").intersect(J.split_rows(s, "PUBLIC", "split").select("well"))


@query("classes_seen", on_wells("SELECT true_code AS code FROM wells WHERE true_code IS NOT NULL UNION SELECT pred_code FROM samples"))
def classes_seen(spark, sf_dir):
    df = wells(spark, sf_dir)
    codes = F.array("true_code", *MODELS.values())
    return df.select(F.explode(codes).alias("code")).filter(F.col("code").isNotNull()).distinct()


@query("split_audit", on_wells(f"""
, {_ABSENT}, s AS (SELECT well, split FROM listed UNION ALL SELECT well, 'PUBLIC' FROM manifest WHERE well % 5 = 2),
l AS (SELECT well, count(DISTINCT split) AS n FROM s GROUP BY well)
SELECT split, count(DISTINCT s.well) AS wells, count(CASE WHEN s.well IN (SELECT well FROM wells) THEN 1 END) AS with_data,
       count(*) FILTER (n > 1) AS in_other_split, any_value(CASE split WHEN 'TRAIN' THEN 8 WHEN 'PUBLIC' THEN 1 ELSE 1 END)::BIGINT AS expected,
       CAST(count(*) FILTER (n > 1) = 0 AND count(DISTINCT s.well) = any_value(CASE split WHEN 'TRAIN' THEN 8 ELSE 1 END) AS INT) AS ok
FROM s JOIN l ON l.well = s.well GROUP BY split"""))
def split_audit(spark, sf_dir):
    m = split_manifest(spark, sf_dir)
    s = with_absent_wells(m).unionByName(m.filter(F.col("well") % 5 == 2).withColumn("split", F.lit("PUBLIC")))
    return J.split_audit(wells(spark, sf_dir), s, {"TRAIN": 8, "PUBLIC": 1, "BLIND_TEST": 1}, "well", "split")


@query("random_split", """
WITH r AS (SELECT s_suppkey AS well, row_number() OVER (ORDER BY md5(s_suppkey || '-42'), s_suppkey) AS n FROM supplier)
SELECT well, CASE WHEN n <= 8 THEN 'DEV_TRAIN' ELSE 'DEV_VALIDATION' END AS split FROM r""")
def random_split(spark, sf_dir):
    wells_ = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well"))
    return J.random_split(wells_, 8, ("DEV_TRAIN", "DEV_VALIDATION"), "well", 42, "split")


@query("well_chunks", "SELECT s_suppkey AS well, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 20 AS BIGINT) AS chunk FROM supplier")
def well_chunks(spark, sf_dir):
    return J.well_chunks(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well")), 20, "well")


def _median_sql(c):
    """Median over the training wells as a scalar."""
    return f"(SELECT quantile_cont({c}, 0.5) FROM base WHERE well % 10 NOT IN (0, 1))"


@query("impute_medians", on_wells("SELECT well, pos, " + ", ".join(
    f"round(coalesce({c}, {_median_sql(c)}), 6) AS {c}, CAST({c} IS NULL AS INT) AS {c}_MISSING" for c in BASE_FEATURES) + " FROM base"))
def impute_medians(spark, sf_dir):
    df = J.attach_split(X.base_features(clean_wells(spark, sf_dir)), split_manifest(spark, sf_dir), "well", "split", "pos")
    out = L.impute(X.missing_flags(df), L.fit_medians(J.split_rows(df, "TRAIN", "split"), BASE_FEATURES))
    flags = [f"{c}_MISSING" for c in BASE_FEATURES]
    return r6(out.select("well", "pos", *BASE_FEATURES, *flags), *BASE_FEATURES)


@query("restore_missing", on_wells("SELECT well, pos, " + ", ".join(f"round({c}, 6) AS {c}" for c in BASE_FEATURES) + " FROM base"))
def restore_missing(spark, sf_dir):
    df = X.missing_flags(X.base_features(clean_wells(spark, sf_dir)))
    out = X.restore_missing(L.impute(df, L.fit_medians(df, BASE_FEATURES))).select("well", "pos", *BASE_FEATURES)
    return r6(out, *BASE_FEATURES)


_SNAP = """
e AS (SELECT min(d) AS lo, max(d) AS hi FROM irregular WHERE true_code IS NOT NULL),
sn AS (SELECT well, pos, d, greatest(0, least(ceil((d - lo) / 0.152::DOUBLE - 0.5), floor((hi - lo) / 0.152::DOUBLE)))::BIGINT AS node, lo FROM irregular, e WHERE true_code IS NOT NULL)"""
_IRREGULAR = "irregular AS (SELECT well, pos, true_code, dept + gr_raw / 500.0 AS d FROM wells)"


def irregular(spark, sf_dir):
    """Depths moved off the regular step."""
    return wells(spark, sf_dir).select("well", "pos", "true_code", (F.col("dept") + F.col("gr_raw") / 500.0).alias("d"))


@query("grid_snap", on_wells(f", {_IRREGULAR}, {_SNAP} SELECT well, pos, node, round(abs(d - (lo + node * 0.152::DOUBLE)), 6) AS error FROM sn"))
def grid_snap(spark, sf_dir):
    return r6(J.snap_to_grid(irregular(spark, sf_dir), "true_code", "well", "d").select("well", "pos", "node", "error"), "error")


@query("grid_snap_report", on_wells(f"""
, {_IRREGULAR}, {_SNAP} SELECT well, count(*) AS samples, round(max(abs(d - (lo + node * 0.152::DOUBLE))), 6) AS max_error,
  round(avg(abs(d - (lo + node * 0.152::DOUBLE))), 6) AS mean_error, count(*) - count(DISTINCT node) AS collisions,
  round(median(abs(d - (lo + node * 0.152::DOUBLE))), 6) AS median_error, round(quantile_cont(abs(d - (lo + node * 0.152::DOUBLE)), 0.95), 6) AS p95_error
FROM sn GROUP BY well"""))
def grid_snap_report(spark, sf_dir):
    return r6(J.snap_report(J.snap_to_grid(irregular(spark, sf_dir), "true_code", "well", "d"), "well"),
              "max_error", "mean_error", "median_error", "p95_error")


_CELLS = f"""{_IRREGULAR}, lo AS (SELECT min(d) AS lo FROM irregular WHERE true_code IS NOT NULL),
cell AS (SELECT round_even((d - lo) / 0.152::DOUBLE, 0)::BIGINT AS node, well, arg_max(true_code, pos) AS code, count(*) AS samples,
         any_value(lo) AS lo FROM irregular, lo WHERE true_code IS NOT NULL GROUP BY ALL)"""


@query("grid_cells", on_wells(f", {_CELLS} SELECT node, well, code, samples, round(lo + node * 0.152::DOUBLE, 3) AS depth FROM cell"))
def grid_cells(spark, sf_dir):
    return r6(J.grid_codes(irregular(spark, sf_dir), "true_code", "well", "pos", "d"), "depth", digits=3)


@query("grid_matrix", on_wells(f", {_CELLS} SELECT node, round(any_value(lo) + node * 0.152::DOUBLE, 3) AS depth, " + ", ".join(
    f"max(code) FILTER (well = {w}) AS \"{w}\"" for w in range(5)) + " FROM cell WHERE well < 5 GROUP BY node"))
def grid_matrix(spark, sf_dir):
    """Wide form for five named wells (the list of columns is the feature; grid_cells is the form for all); their cells come
    from the grid over all wells."""
    cells = J.grid_codes(irregular(spark, sf_dir), "true_code", "well", "pos", "d").filter(F.col("well") < 5)
    return r6(J.grid_matrix(cells, range(5), "well"), "depth", digits=3)


@query("grid_fill_report", on_wells(f", {_CELLS} SELECT well, count(*) AS nodes, CAST(sum(samples) AS BIGINT) AS samples FROM cell GROUP BY well"))
def grid_fill_report(spark, sf_dir):
    return J.grid_fill_report(J.grid_codes(irregular(spark, sf_dir), "true_code", "well", "pos", "d"), "well")


@query("full_grid", on_wells(f"""
, {_IRREGULAR}, e AS (SELECT min(d) AS lo, max(d) AS hi FROM irregular WHERE true_code IS NOT NULL)
SELECT i AS node, round(lo + i * 0.152::DOUBLE, 3) AS depth FROM e, unnest(range(0, floor((hi - lo) / 0.152::DOUBLE)::BIGINT + 1)) u(i)"""))
def full_grid(spark, sf_dir):
    return r6(J.full_grid(irregular(spark, sf_dir), "true_code", "d"), "depth", digits=3)


_PLACES = """f AS (SELECT well, arg_min(RDEP, pos) FILTER (RDEP IS NOT NULL) AS x, arg_min(GR, pos) FILTER (GR IS NOT NULL) AS y FROM curves GROUP BY well)"""


@query("well_density", on_wells(f"""
, {_PLACES}, s AS (SELECT count(*)::DOUBLE AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM f),
h AS (SELECT *, pow(n, -1.0 / 3) AS h, vx * vy - c * c AS det, (x1 - x0) * 0.08 AS px, (y1 - y0) * 0.08 AS py FROM s),
gr AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, x0 - px + i * ((x1 - x0 + 2 * px) / 199) AS gx, y0 - py + j * ((y1 - y0 + 2 * py) / 199) AS gy FROM h, range(200) a(i), range(200) b(j))
SELECT i, j, round(sum(exp(-0.5 * (vy * (gx - x) * (gx - x) - 2 * c * (gx - x) * (gy - y) + vx * (gy - y) * (gy - y)) / (det * h)))
       / any_value(n * 2 * pi() * h * sqrt(det)), 9) AS density FROM gr, f, h GROUP BY i, j"""))
def well_density(spark, sf_dir):
    places = A.first_locations(clean_wells(spark, sf_dir), ["RDEP", "GR"], "well", "pos")
    return r6(J.well_density(places, "RDEP", "GR"), "density", digits=9)


# --- sources and sinks: Spark writes files from the well table, then reads them back --------

def _folder(spark):
    import uuid
    return f"{shared_folder(spark)}/depthlog/{uuid.uuid4().hex}"


_LAS_SQL = on_wells("""
SELECT CAST(well AS VARCHAR) AS well, pos - 1 AS source_row, round(dept, 6) AS dept, round(gr_raw, 6) AS GR, round(rdep_raw, 6) AS RDEP, round(rmed_raw, 6) AS RMED,
       round(dtc_raw, 6) AS DTC, round(rhob_raw, 6) AS RHOB FROM wells""")


@query("las_scan", _LAS_SQL)
def las_scan(spark, sf_dir):
    from depthlog.sources.las import las_lines, read_las, write_las
    path = _folder(spark)
    named = raw_named(spark, sf_dir).withColumn("pos", F.col("pos") - 1)
    write_las(named, path, INPUT_CURVES, key="well", order="pos", depth="dept", block_rows=250)  # several files for each well
    samples, _ = read_las(las_lines(spark, path, glob=None), INPUT_CURVES)
    out = samples.withColumnsRenamed({"WELL": "well", "SOURCE_ROW": "source_row", "DEPT": "dept"})
    return r6(out, "dept", *INPUT_CURVES)


@query("las_headers", on_wells("""
SELECT CAST(well AS VARCHAR) AS well, section, CAST(position AS INT) AS position, mnemonic FROM (SELECT DISTINCT well FROM wells),
 (VALUES ('V',0,'VERS'),('V',1,'WRAP'),('W',0,'NULL'),('W',1,'WELL'),('W',2,'FIRSTROW'),('C',0,'DEPT'),('C',1,'GR'),('C',2,'RDEP'),('C',3,'RMED'),('C',4,'DTC'),('C',5,'RHOB')) h(section, position, mnemonic)"""))
def las_header_table(spark, sf_dir):
    from depthlog.sources.las import las_headers, las_lines, write_las
    path = _folder(spark)
    write_las(raw_named(spark, sf_dir), path, INPUT_CURVES, key="well", order="pos", depth="dept")
    return las_headers(las_lines(spark, path, glob=None)).select("well", "section", "position", "mnemonic")


@query("las_null_census", on_wells("SELECT -999.25::DOUBLE AS null_value, count(DISTINCT well) AS files FROM wells"))
def las_null_census(spark, sf_dir):
    from depthlog.sources.las import las_headers, las_lines, null_census, write_las
    path = _folder(spark)
    write_las(raw_named(spark, sf_dir), path, INPUT_CURVES, key="well", order="pos", depth="dept")
    return null_census(las_headers(las_lines(spark, path, glob=None)))


@query("training_tables", on_wells(f"""
SELECT split, count(*) AS "rows", count(DISTINCT well) AS wells, round(avg(coalesce(RHOB, m_RHOB)), 6) AS mean_RHOB
FROM base JOIN manifest USING (well), (SELECT quantile_cont(RHOB, 0.5) AS m_RHOB FROM base JOIN manifest USING (well)
     WHERE split = 'TRAIN' AND true_code IS NOT NULL) WHERE true_code IS NOT NULL GROUP BY split"""))
def training_tables(spark, sf_dir):
    """Builds and stores the training tables, then summarises what was stored."""
    from depthlog.plans.dataset import build_training_tables
    table = build_training_tables(clean_wells(spark, sf_dir), split_manifest(spark, sf_dir), _folder(spark), "well", "pos", "true_code", "split")
    return r6(table.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("well").alias("wells"),
                                         F.avg("RHOB").alias("mean_RHOB")), "mean_RHOB")


def write_csv_pieces(spark, sf_dir):
    """The wells as CSV files of two layouts (another order of columns, and one curve less), a folder for each well and
    the rows in order; folder, columns."""
    from depthlog.sources.sinks import write_files
    path = _folder(spark)
    df = wells(spark, sf_dir).select(F.col("well").alias("folder"), "well", F.col("pos").alias("at"), F.col("dept").alias("DEPT"),
                                     F.col("gr_raw").alias("GR"), F.col("rhob_raw").alias("RHOB"), F.col("true_code").alias("LITHOLOGY"))
    layouts = {0: ["well", "at", "DEPT", "GR", "RHOB", "LITHOLOGY"], 1: ["LITHOLOGY", "GR", "at", "DEPT", "well"]}
    for layout, columns in layouts.items():
        write_files(df.filter(F.col("well") % 2 == layout).select("folder", *columns), path, "folder", "at", "csv", "append", header=True)
    return path


@query("csv_scan", on_wells("""
SELECT well, pos - 1 AS source_row, pos, round(dept, 6) AS dept, round(gr_raw, 6) AS gr_raw,
       CASE WHEN well % 2 = 0 THEN round(rhob_raw, 6) END AS rhob_raw, true_code FROM wells"""))
def csv_scan(spark, sf_dir):
    """Files of two layouts in one folder, each read by its own header."""
    from depthlog.functions.columns import number
    from depthlog.sources.tabular import read_csv_by_header
    rows, _ = read_csv_by_header(spark, write_csv_pieces(spark, sf_dir))
    cell = lambda n: number(F.try_element_at("cells", F.lit(n)))
    out = rows.select(cell("WELL").cast("int").alias("well"), F.col("SOURCE_ROW").alias("source_row"), cell("AT").cast("int").alias("pos"),
                      cell("DEPT").alias("dept"), cell("GR").alias("gr_raw"), cell("RHOB").alias("rhob_raw"), cell("LITHOLOGY").cast("int").alias("true_code"))
    return r6(out, "dept", "gr_raw", "rhob_raw")


@query("csv_rejects", on_wells("""
SELECT s_name AS "text", 'data line with wrong number of cells' AS error FROM supplier"""))
def csv_rejects(spark, sf_dir):
    """A broken file for each supplier among those of the wells; the wells' files stay."""
    from depthlog.sources.sinks import write_files
    from depthlog.sources.tabular import read_csv_by_header
    path = write_csv_pieces(spark, sf_dir)
    bad = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("folder"), F.explode(F.array(F.lit("a,b"), F.lit("1,2,3"))).alias("line"))
    bad = bad.withColumn("__first", (F.col("line") != "a,b").cast("int"))
    write_files(bad, path, "folder", "__first", "text", "append")
    _, rejects = read_csv_by_header(spark, path, glob="*.*")
    return rejects.select(F.url_decode(F.url_decode(F.regexp_extract("file", "folder=([^/]*)/", 1))).alias("text"), "error")


@query("split_partitions", on_wells("SELECT well, pos, split, round(gr_raw, 6) AS gr_raw FROM wells JOIN manifest USING (well) WHERE split = 'PUBLIC'"))
def split_partitions(spark, sf_dir):
    """Written by split and well, read back with partition pruning."""
    from depthlog.sources.sinks import write_splits
    path = _folder(spark)
    write_splits(wells(spark, sf_dir).select("well", "pos", "gr_raw"), split_manifest(spark, sf_dir), path, "well", "split", "pos")
    return r6(spark.read.parquet(path).filter(F.col("split") == "PUBLIC"), "gr_raw")


@query("table_shape", "SELECT count(*) AS \"rows\", 11::BIGINT AS columns FROM lineitem")
def table_shape(spark, sf_dir):
    from depthlog.sources.tabular import table_shape as shape
    return shape(read(spark, sf_dir, "lineitem"))
