"""Pieces of wells in any batches, wrapped LAS files, declared delimiters, quoted line feeds, equal file names."""

import os

import pytest
from pyspark.sql import functions as F

from depthlog.schema import INPUT_CURVES
from depthlog.sources import tabular
from depthlog.sources.las import las_lines, read_las
from depthlog.sources.tabular import csv_wells, ingest, read_csv_by_header
from depthlog.streaming.landing import score_landing
from test_sources import las

CURVES = ["DEPT", *INPUT_CURVES]


# --- landing --------------------------------------------------------------------------------

def piece(folder, name, well, first, n, gr, at=None):
    lines = [f"{1000 + first + i} {gr} 1.5 2.5 80 2.3" for i in range(n)]
    las(folder, name, well, CURVES, lines)
    path = f"{folder}/{name}"
    if first is not None:
        text = open(path).read().replace("~Curve", f" FIRSTROW. {first} : first row\n~Curve")
        open(path, "w").write(text)
    if at:
        os.utime(path, (at, at))


def test_results_do_not_depend_on_batches(spark, tmp_path):
    land = str(tmp_path / "land")
    pieces = [("a.las", "over", 0, 10, 40), ("b.las", "over", 5, 10, 50),       # b begins inside a
              ("c.las", "again", 0, 8, 40), ("d.las", "again", 8, 4, 45), ("e.las", "again", 0, 6, 90),  # e is c sent again, shorter
              ("h.las", "freed", 0, 9, 40), ("i.las", "freed", 4, 3, 41), ("j.las", "freed", 0, 4, 42)]  # j replaces h, so i counts
    for i, p in enumerate(pieces):
        piece(land, *p, at=1_700_000_000 + 10 * i)
    for i, name in enumerate(("k.las", "l.las")):  # two pieces that state no first row
        las(land, name, "bare", CURVES, [f"{i} {70 + i} 1.5 2.5 80 2.3"] * (3 - i))
        os.utime(f"{land}/{name}", (1_700_001_000 + i * 10,) * 2)
    with open(f"{land}/bad.las", "w") as f:
        f.write("nothing\n")
    found = []
    for files in (2, 1000):
        out = str(tmp_path / f"out{files}")
        score_landing(spark, land, out, str(tmp_path / f"check{files}"), lambda x: x, out + "_bad", files_per_batch=files).awaitTermination()
        rows = sorted((r.WELL, r.SOURCE_ROW, r.GR, r.GR_ROLLMEAN_5) for r in spark.read.parquet(out).collect())
        rejects = sorted((r.file.rsplit("/", 1)[1], r.error) for r in spark.read.parquet(out + "_bad").collect())
        found.append((rows, rejects))
    assert found[0] == found[1]
    rows, rejects = found[0]
    at = lambda w: [(r[1], r[2]) for r in rows if r[0] == w]
    assert at("over") == [(i, 40.0) for i in range(10)]
    assert at("again") == [(i, 90.0) for i in range(6)] + [(i, 45.0) for i in range(8, 12)]
    assert at("freed") == [(i, 42.0) for i in range(4)] + [(i, 41.0) for i in range(4, 7)]
    assert at("bare") == [(0, 71.0), (1, 71.0)]
    assert rejects == [("b.las", "rows of the well are in another file"), ("bad.las", "no data section")]


# --- wrapped lines and delimiters -----------------------------------------------------------

def test_wrapped_file_equals_its_twin(spark, tmp_path):
    n = 400
    cells = [[1000 + i, 40 + i % 7, -999.25 if i % 5 == 0 else 1.5, 2.5, 80 + i % 3, 2.3] for i in range(n)]
    las(str(tmp_path / "flat"), "x.las", "w/1", CURVES, [" ".join(map(str, c)) for c in cells])
    lines = []
    for i, c in enumerate(cells):  # the depth on a line of its own, then lines of changing length
        cut = 1 + i % 4
        lines += [str(c[0]), " ".join(map(str, c[1:1 + cut])), "", " ".join(map(str, c[1 + cut:]))]
    las(str(tmp_path / "wrapped"), "x.las", "w/1", CURVES, lines, wrap="YES")
    las(str(tmp_path / "wrapped"), "short.las", "w/2", CURVES, lines[:-1], wrap="YES")
    las(str(tmp_path / "wrapped"), "plain.las", "w/3", CURVES, ["1 2 3 4 5 6"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # cut into many splits
    try:
        flat, _ = read_las(las_lines(spark, str(tmp_path / "flat")), INPUT_CURVES)
        wrapped, rejects = read_las(las_lines(spark, str(tmp_path / "wrapped")), INPUT_CURVES)
        want = sorted(map(tuple, flat.collect()))
        assert sorted(map(tuple, wrapped.filter("WELL = 'w/1'").select(flat.columns).collect())) == want and len(want) == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert wrapped.filter("WELL = 'w/3'").count() == 1
    assert [(r.file.rsplit("/", 1)[1], r.error) for r in rejects.collect()] == [("short.las", "data line with wrong number of values")]


def test_declared_delimiters(spark, tmp_path):
    folder = str(tmp_path / "d")
    for name, mark, declared in (("c", ",", "COMMA"), ("t", "\t", "TAB"), ("s", "  ", "SPACE"), ("n", " ", None), ("x", ";", "SEMICOLON")):
        las(folder, f"{name}.las", name, ["DEPT", "GR", "RDEP"], [mark.join(["1", "2.5", "3"]), mark.join(["2", "" if mark in ",\t" else "-999.25", "4"])])
        if declared:
            path = f"{folder}/{name}.las"
            text = open(path).read().replace("~Well", f" DLM. {declared} : delimiting character\n~Well", 1)
            open(path, "w").write(text)
    samples, rejects = read_las(las_lines(spark, folder), ("GR", "RDEP"))
    for well in "ctsn":
        assert [(r.DEPT, r.GR, r.RDEP) for r in samples.filter(F.col("WELL") == well).orderBy("SOURCE_ROW").collect()] == [(1.0, 2.5, 3.0), (2.0, None, 4.0)], well
    assert [(r.file[-5:], r.error) for r in rejects.collect()] == [("x.las", "unknown delimiter")]


# --- CSV ------------------------------------------------------------------------------------

def put(folder, name, text):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(text)


def test_quoted_line_feeds(spark, tmp_path):
    folder = str(tmp_path / "q")
    note = "first line\n\nthird, with \"\"marks\"\"\n" * 3
    body = "".join(f'{i},"{note}{i}",{i * 2}\n' if i % 3 == 0 else f"{i},plain {i},{i * 2}\n" for i in range(200))
    put(folder, "a.csv", "DEPT,NOTE,GR\n" + body)
    put(folder, "head.csv", 'DEPT,"NO\nTE",GR\r\n1,x,2\r\n2,"y\r\nz",3\r\n')
    put(folder, "open.csv", 'DEPT,GR\n1,2\n2,"3\n4,5\n')
    put(folder, "only.csv", '"DEPT,GR\n')
    put(folder, "plain.csv", 'DEPT,GR\n\n1,"2"\n')
    for size in ("134217728", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows, rejects = read_csv_by_header(spark, folder)
            got = sorted((r.FILE.rsplit("/", 1)[1], r.SOURCE_ROW, r.cells) for r in rows.collect())
            bad = sorted((r.file.rsplit("/", 1)[1], r.error) for r in rejects.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        plain = note.replace('""', '"')
        assert [g[2] for g in got if g[0] == "a.csv"] == [
            {"DEPT": str(i), "NOTE": f"{plain}{i}" if i % 3 == 0 else f"plain {i}", "GR": str(i * 2)} for i in range(200)]
        assert [g[2] for g in got if g[0] == "head.csv"] == [{"DEPT": "1", "NO\nTE": "x", "GR": "2"}, {"DEPT": "2", "NO\nTE": "y\nz", "GR": "3"}]
        assert [g[2] for g in got if g[0] == "plain.csv"] == [{"DEPT": "1", "GR": "2"}]
        assert bad == [("only.csv", "quote left open"), ("open.csv", "quote left open")]


def test_records_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tabular, "RECORD_CHARS", 50)
    put(str(tmp_path), "a.csv", 'X,Y\n1,"' + "long\n" * 30 + '"\n')
    put(str(tmp_path), "b.csv", 'X,Y\n1,"short\n"\n')
    rows, rejects = read_csv_by_header(spark, str(tmp_path))
    assert [(r.file[-5:], r.error) for r in rejects.collect()] == [("a.csv", "record too long")]
    assert [r.cells["Y"] for r in rows.collect()] == ["short\n"]


def test_equal_names_are_one_well(spark, tmp_path):
    for folder, gr in (("a", 1), ("b", 2)):
        put(str(tmp_path), f"{folder}/w1.csv", "DEPT,GR\n" + "".join(f"{i},{gr}\n" for i in range(5)))
    put(str(tmp_path), "c/w2.csv", "DEPT,GR\n1,3\n")
    put(str(tmp_path), "0/w2.csv", "DEPT,GR,GR\n1,3,4\n")  # unreadable, so the other one is the well
    for samples, rejects in (csv_wells(spark, str(tmp_path)), ingest(spark, str(tmp_path))):
        got = sorted((r.WELL, r.SOURCE_ROW, r.GR) for r in samples.collect())
        assert got == [("w1", i, 1.0) for i in range(5)] + [("w2", 0, 3.0)]
        assert sorted((r.file[-8:], r.error) for r in rejects.collect()) == [
            ("0/w2.csv", "duplicate column name"), ("b/w1.csv", "another file has the name of the well")]
