import os

import pytest
from pyspark.sql import functions as F

import data
from depthlog.operators import features as X, learning as L
from depthlog.schema import BASE_FEATURES, INPUT_CURVES, feature_names
from depthlog.sources.las import header_availability, las_headers, las_lines, null_census, read_las, write_las
from depthlog.sources.sinks import read_parameters, write_parameters
from depthlog.sources.tabular import csv_wells, ingest, table_shape
from depthlog.streaming.landing import score_landing

HEAD = """~Version information
 VERS.   2.0 : CWLS log ASCII standard
 WRAP.   {wrap} : one line per depth step
~Well information
# comment
 STRT.M  1000.0 : start
 NULL.   {null} : null value
 WELL.   {well} : well
~Curve information
{curves}
~A  depth and curves
"""


def las(folder, name, well, curves, lines, null="-999.25", wrap="NO"):
    os.makedirs(folder, exist_ok=True)
    text = HEAD.format(well=well, null=null, wrap=wrap, curves="\n".join(f" {c}.unit : {i} {c}" for i, c in enumerate(curves)))
    with open(f"{folder}/{name}", "w") as f:
        f.write(text + "\n".join(lines) + "\n")


@pytest.fixture()
def folder(tmp_path):
    d = str(tmp_path / "wells")
    las(d, "one.las", "15/9-1", ["DEPT", "gr", "RDEP", "RMED", "DTC", "RHOB"],
        [f"{1000 + 0.5 * i} {40 + i} 1.5 2.5 80 -999.25" for i in range(300)])
    las(d, "two.las", "15/9-2", ["DEPTH", "RHOB", "GR"], ["10 2.5 -9999", "11 -9999 50"], null="-9999")
    las(d, "uneven.las", "u", ["DEPT", "GR"], ["1 2", "2 3 4"])
    las(d, "wrapped.las", "w", ["DEPT", "GR"], ["1", "2"], wrap="YES")
    las(d, "twice.las", "t", ["DEPT", "GR", "gr"], ["1 2 3"])
    with open(f"{d}/broken.las", "w") as f:
        f.write("this is no log file\n")
    return d


def test_las_scan_keeps_good_files_and_reports_bad_ones(spark, folder):
    samples, rejects = read_las(las_lines(spark, folder), INPUT_CURVES)
    rows = {w: samples.filter(F.col("WELL") == w).orderBy("SOURCE_ROW").collect() for w in ("15/9-1", "15/9-2")}
    assert samples.count() == 303 and [tuple(r)[2:4] for r in samples.filter("WELL = 'w'").collect()] == [(1.0, 2.0)]
    assert [r["SOURCE_ROW"] for r in rows["15/9-1"]] == list(range(300))
    assert rows["15/9-1"][299]["GR"] == 339 and rows["15/9-1"][0]["RHOB"] is None
    assert [tuple(r) for r in rows["15/9-2"]] == [("15/9-2", 0, 10.0, None, None, None, None, 2.5), ("15/9-2", 1, 11.0, 50.0, None, None, None, None)]
    assert {os.path.basename(r["file"]): r["error"] for r in rejects.collect()} == {
        "uneven.las": "data line with wrong number of values", "twice.las": "duplicate curve name",
        "broken.las": "no data section"}


def test_big_file_is_read_in_splits_in_order(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = las_lines(spark, folder)
        assert lines.filter(F.col("file").contains("one.las")).select("at.split").distinct().count() > 3
        samples, _ = read_las(lines, INPUT_CURVES)
        one = samples.filter("WELL = '15/9-1'").orderBy("SOURCE_ROW").collect()
        assert [r["DEPT"] for r in one] == [1000 + 0.5 * i for i in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_headers(spark, folder):
    heads = las_headers(las_lines(spark, folder, "two.las")).collect()
    assert {(h["section"], h["mnemonic"], h["unit"], h["value"]) for h in heads} >= {
        ("W", "NULL", "", "-9999"), ("C", "RHOB", "unit", ""), ("V", "VERS", "", "2.0")}
    everything = las_headers(las_lines(spark, folder))
    assert {r["null_value"]: r["files"] for r in null_census(everything).collect()} == {-999.25: 4, -9999.0: 1}
    assert {r["mnemonic"]: r["wells"] for r in header_availability(everything).collect()}["GR"] == 5


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "c"
    path.mkdir()
    (path / "w9.csv").write_text("gr;Depth;rhob;Lithology\n50;1.5;x;Shale\n-1;2.5;2.3;\n")
    rows = csv_wells(spark, str(path), sep=";")[0].orderBy("SOURCE_ROW").collect()
    assert [(r["WELL"], r["SOURCE_ROW"], r["DEPT"], r["GR"], r["RHOB"], r["LABEL"]) for r in rows] == [
        ("w9", 0, 1.5, 50.0, None, "Shale"), ("w9", 1, 2.5, -1.0, 2.3, None)]
    (path / "no_depth.csv").write_text("gr\n1\n2\n")
    alone, _ = ingest(spark, str(path / "no_depth.csv"))
    filled = X.depth_or_row(alone, "WELL", "DEPT", "SOURCE_ROW").orderBy("SOURCE_ROW").collect()
    assert [r["DEPT"] for r in filled] == [0.0, 1.0]
    with pytest.raises(ValueError):
        ingest(spark, "well.xlsx")
    assert tuple(table_shape(alone).first()) == (2, len(alone.columns))


def test_las_write_and_read_back_in_several_files(spark, tmp_path):
    df = spark.createDataFrame(data.rows(), data.SCHEMA).select("WELL", "SOURCE_ROW", "DEPT", *INPUT_CURVES)
    write_las(df, str(tmp_path / "out"), INPUT_CURVES, block_rows=50)
    samples, rejects = read_las(las_lines(spark, str(tmp_path / "out"), None), INPUT_CURVES)
    assert rejects.count() == 0
    columns = ["WELL", "SOURCE_ROW", "DEPT", *INPUT_CURVES]
    assert samples.select(columns).exceptAll(df.select(columns)).count() == 0
    assert df.select(columns).exceptAll(samples.select(columns)).count() == 0


def test_a_row_in_two_files_of_a_well_is_rejected(spark, tmp_path):
    d = str(tmp_path / "w")
    las(d, "a.las", "w", ["DEPT", "GR"], ["1 2", "2 3"])
    las(d, "b.las", "w", ["DEPT", "GR"], ["1 9"])
    samples, rejects = read_las(las_lines(spark, d), INPUT_CURVES)
    assert [r["GR"] for r in samples.orderBy("SOURCE_ROW").collect()] == [2, 3]
    assert [(os.path.basename(r["file"]), r["error"]) for r in rejects.collect()] == [("b.las", "rows of the well are in another file")]


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    d = tmp_path / "c"
    d.mkdir()
    (d / "w1.csv").write_text("DEPT,GR,RHOB\n1,50,2.5\n2,,2.6\n")
    (d / "w2.csv").write_text("RHOB,DEPT,GR,EXTRA\r\n2.1,7,70,\"a,b\"\r\n2.2,8,80,c\r\n")
    (d / "w3.csv").write_text("depth,gr\n3,30\n")
    (d / "broken.csv").write_text("DEPT,GR\n1,2\n1,2,3\n")
    (d / "twice.csv").write_text("DEPT,GR,gr\n1,2,3\n")
    las(str(d), "l.las", "wl", ["DEPT", "GR"], ["5 6"])
    samples, rejects = ingest(spark, str(d))
    got = {(r["WELL"], r["SOURCE_ROW"]): (r["DEPT"], r["GR"], r["RHOB"]) for r in samples.collect()}
    assert got == {("w1", 0): (1, 50, 2.5), ("w1", 1): (2, None, 2.6), ("w2", 0): (7, 70, 2.1), ("w2", 1): (8, 80, 2.2),
                   ("w3", 0): (3, 30, None), ("wl", 0): (5, 6, None)}
    assert {os.path.basename(r["file"]): r["error"] for r in rejects.collect()} == {
        "broken.csv": "data line with wrong number of cells", "twice.csv": "duplicate column name"}
    (tmp_path / "none").mkdir()
    assert csv_wells(spark, str(tmp_path / "none"))[0].count() == 0


def test_parameters_round_trip(spark, tmp_path):
    write_parameters(spark, str(tmp_path / "p"), '{"a": [1, 2]}')
    assert read_parameters(spark, str(tmp_path / "p")) == '{"a": [1, 2]}'


@pytest.fixture(scope="module")
def training(spark):
    df = X.clean_curves(spark.createDataFrame(data.rows(), data.SCHEMA))
    flagged = X.feature_table(df, keep=["TRUE_CODE"])
    numeric = [c for c in feature_names() if not c.endswith("_MISSING")]
    return L.impute(flagged, L.fit_medians(flagged, numeric)).cache()


def test_forest_scores_and_bundle(spark, training, tmp_path):
    model = L.train_forest(L.add_class_weights(training.filter("TRUE_CODE is not null"), "TRUE_CODE"), feature_names(), "TRUE_CODE", "weight",
                           trees=3, depth=3, leaf=1)
    scored = L.predict(training, {"forest": model}, feature_names())
    assert scored.count() == training.count()
    assert scored.filter("forest_CONFIDENCE < 0 or forest_CONFIDENCE > 1 or forest_CODE is null or forest_NAME is null").count() == 0
    with pytest.raises(ValueError):
        L.predict(training, {"forest": model}, feature_names(), ["other"])
    path = str(tmp_path / "bundle")
    L.save_bundle(model, path, feature_names())
    again, features, _ = L.load_bundle(path, expected=feature_names())
    same = L.score(again, training, features, "forest").select("WELL", "SOURCE_ROW", "forest_CODE")
    assert same.exceptAll(scored.select("WELL", "SOURCE_ROW", "forest_CODE")).count() == 0
    with pytest.raises(ValueError):
        L.load_bundle(path, expected=feature_names()[::-1])


def test_permutation_keeps_the_values(training):
    once = L.permuted(training.select("WELL", "SOURCE_ROW", "GR"), "GR", ("WELL", "SOURCE_ROW"), 1)
    assert once.select("GR").exceptAll(training.select("GR")).count() == 0 and once.count() == training.count()
    assert once.join(training.select("WELL", "SOURCE_ROW", F.col("GR").alias("g")), ["WELL", "SOURCE_ROW"]).filter("GR <> g").count() > 0


@pytest.mark.parametrize("files", [1, 1000])
def test_pieces_of_a_well_land_in_any_batches(spark, tmp_path, files):
    df = spark.createDataFrame([("w", i, 1000.0 + i, 40.0 if i < 10 else 90.0) for i in range(20)], "WELL string, SOURCE_ROW long, DEPT double, GR double")
    write_las(df, str(tmp_path / "land"), ["GR"], block_rows=10)
    q = score_landing(spark, str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "check"), lambda x: x, str(tmp_path / "bad"), "*.txt", files)
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("SOURCE_ROW").collect()
    assert [r["SOURCE_ROW"] for r in rows] == list(range(20))
    assert [r["GR_ROLLMEAN_5"] for r in rows[8:12]] == [50, 60, 70, 80]


def test_staged_tables_are_released(spark):
    from depthlog.operators.staging import scope, stage, staged
    before = staged(spark)
    with scope(spark):
        stage(spark.range(5).toDF("a")).count()
        assert len(staged(spark)) == len(before) + 1
        path = staged(spark)[-1]
    assert staged(spark) == before and not os.path.exists(path.removeprefix("file:"))


def test_rounding_keeps_large_and_odd_numbers(spark):
    from depthlog.functions.columns import rounded
    values = [1e13, 2e10, float("inf"), float("-inf"), None, -0.0, 0.5, 1.0000005, -1.0000005]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 6)).collect()]
    assert got[:5] == values[:5] and str(got[5]) == "0.0" and got[6] == 0.5 and got[7] == -got[8]
    assert spark.range(1).select(rounded(F.lit(float("nan"))).alias("x")).filter("isnan(x)").count() == 1


def test_null_keys_are_numbered_and_kept(spark):
    from depthlog.operators.series import attach, number_rows
    df = spark.createDataFrame([(None, 1), ("a", 1), (None, 2)], "k string, v int")
    got = number_rows(df, "k", [F.col("v")], [F.col("v")], "n")
    assert sorted((str(r["k"]), r["n"]) for r in got.collect()) == [("None", 0), ("None", 1), ("a", 0)]
    stats = df.groupBy("k").agg(F.sum("v").alias("s"))
    assert sorted(r["s"] for r in attach(df, stats, "k", spread="v").collect()) == [1, 3, 3]
    assert sorted(r["s"] for r in attach(df, stats, "k", spread="v", broadcast_rows=0).collect()) == [1, 3, 3]


def test_landing_folder_is_scored_and_a_well_is_replaced(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    line = lambda i, gr: f"{1000 + i} {gr} 1.5 2.5 80 2.3"
    curves = ["DEPT", *INPUT_CURVES]
    las(land, "a.las", "wa", curves, [line(i, 40) for i in range(10)])
    las(land, "b.las", "wb", curves, [line(i, 60) for i in range(5)])
    with open(f"{land}/bad.las", "w") as f:
        f.write("nothing\n")
    rule = lambda df: df.withColumn("CODE", F.when(F.col("GR") > 50, 65000).otherwise(30000))

    def run():
        q = score_landing(spark, land, out, str(tmp_path / "check"), rule, str(tmp_path / "rejects"))
        q.awaitTermination()
        return {(r["WELL"], r["CODE"]): r["n"] for r in spark.read.parquet(out).groupBy("WELL", "CODE").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert run() == {("wa", 30000): 10, ("wb", 65000): 5}
    las(land, "a2.las", "wa", curves, [line(i, 90) for i in range(7)])
    assert run() == {("wa", 65000): 7, ("wb", 65000): 5}
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1
    assert len(BASE_FEATURES) == 5


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    """Bytes would bring all of them into one task; each stays one file with its rows in order."""
    from depthlog.sources.sinks import write_files
    df = spark.range(400).select((F.col("id") % 40).alias("folder"), (400 - F.col("id")).alias("at"), F.col("id").alias("GR"))
    write_files(df, str(tmp_path / "out"), "folder", "at", "csv", header=True)
    files = list((tmp_path / "out").glob("group=*/folder=*/part-*.csv"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    for f in files:
        places = [int(line.split(",")[0]) for line in f.read_text().splitlines()[1:]]
        assert len(places) == 10 and places == sorted(places)


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    from depthlog.sources.las import packed, place_lines
    for i in range(200):
        (tmp_path / f"{i}.las").write_text(f"~A\n{i}\n")
    text = spark.read.text(str(tmp_path))
    some = packed(place_lines, text)
    assert some.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert some.count() == 400 and some.select("file", "at").distinct().count() == 400
