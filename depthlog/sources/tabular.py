"""CSV and parquet scans, format choice by file name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from depthlog.functions import columns as C
from depthlog.operators.features import detect_label_column
from depthlog.operators.series import attach, number_rows, running_totals
from depthlog.operators.staging import stage
from depthlog.schema import INPUT_CURVES, LABEL_CURVE
from depthlog.sources.las import las_lines, packed, read_las


RECORD_CHARS = 1 << 20


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """CSV with header; without a schema every column is text (cast with `number`)."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).csv(path, header=True, sep=sep)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv_by_header(spark: SparkSession, path: str, sep: str = ",", glob: str | None = "*.{csv,CSV}",
                       one_well: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files, each read by its own header line.

    rows: FILE, SOURCE_ROW (from 0 in each file), `cells`, a map from the upper-case column name to the text of the cell
    (NULL where it is empty). rejects: file and error of files without a header, with a name twice, with a data line of
    another number of cells, with a quote left open or with a record of over RECORD_CHARS characters; with `one_well`
    also all but the first by path of the readable files that have one name in several folders. Cells may be quoted, and
    hold line feeds then. The width of the widest header and nothing else reaches the driver.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob and not path.lower().endswith(".csv") else reader
    physical = stage(packed(lambda text: text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "[\r\ufeff]", "").alias("text")), reader.text(path)))
    lines, open_files = _records(physical)
    lines = lines.filter(F.trim("text") != "")
    first = lines.groupBy("file").agg(F.min(F.struct("split", "line", "text")).alias("head"))
    width = first.select(F.max(F.size(F.split(F.col("head.text"), _literal(sep))))).first()[0] or 0
    unusable = open_files.select("file", F.col("open").alias("error"))
    if not width:
        return spark.createDataFrame([], "FILE string, SOURCE_ROW long, cells map<string,string>"), unusable
    schema = ", ".join(f"c{i} string" for i in range(width + 1))  # one more shows a line that is too long

    def cells(text):
        parsed = F.from_csv(text, schema, {"sep": sep, "mode": "PERMISSIVE", "escape": "\"", "maxCharsPerColumn": "-1"})
        return F.array(*[parsed[f"c{i}"] for i in range(width + 1)])

    names = first.select("file", F.struct("head.split", "head.line").alias("head_at"),
                         F.filter(F.transform(cells(F.col("head.text")), lambda c: F.upper(F.trim(c))), lambda c: c.isNotNull()).alias("names"))
    files = names.join(unusable, "file", "left_anti").withColumn("error", F.when(F.size("names") == 0, "no header")
                             .when(F.size(F.array_distinct("names")) < F.size("names"), "duplicate column name"))
    if one_well:
        same = Window.partitionBy(C.file_stem(F.col("file")), F.col("error").isNull()).orderBy("file")
        files = files.withColumn("error", F.when((F.row_number().over(same) > 1) & F.col("error").isNull(), "another file has the name of the well")
                                 .otherwise(F.col("error")))
    placed = attach(lines, files, "file", spread=F.col("split"))
    data = placed.filter(F.col("error").isNull() & (F.struct("split", "line") > F.col("head_at"))).withColumn("cells", cells(F.col("text")))
    given = F.size(F.split("text", _literal(sep)))
    uneven = stage(data.filter(F.when(F.col("text").contains('"'), F.get("cells", F.size("names")).isNotNull()).otherwise(given != F.size("names")))
                   .select("file").distinct().withColumn("error", F.lit("data line with wrong number of cells")))
    good = attach(data.drop("error"), uneven, "file", "left", spread=F.col("split")).filter(F.col("error").isNull())
    numbered = number_rows(good, "file", [F.col("split"), F.col("line")], [F.col("split")], "SOURCE_ROW")
    rows = numbered.select(F.col("file").alias("FILE"), "SOURCE_ROW",
                           F.map_from_arrays("names", F.slice("cells", 1, F.size("names"))).alias("cells"))
    return rows, files.filter(F.col("error").isNotNull()).select("file", "error").unionByName(uneven).unionByName(unusable)


def _records(physical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, split, line, text of the records; file and why its quotes are unusable) from the lines of text files.

    A line that begins inside quotes belongs to the record before. Whether it does is the parity of the quotes before it in
    its file, a running total over blocks of lines, so a file may be cut anywhere. Only files with a line of an odd number
    of quotes are looked at, and only lines of records of several lines are brought together, after their sizes are known."""
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    odd = stage(physical.filter(quotes % 2 == 1).select("file").distinct().withColumn("error", F.lit("quotes")))
    none = odd.select("file", F.col("error").alias("open")).limit(0)
    if odd.isEmpty():
        return physical, none
    marked = attach(physical, odd, "file", "left", spread=F.col("split"))
    plain = marked.filter(F.col("error").isNull()).select("file", "split", "line", "text")
    numbered = number_rows(marked.filter(F.col("error").isNotNull()).drop("error"), "file", [F.col("split"), F.col("line")], [F.col("split")], "__at")
    begins = (F.col("__upto") - quotes) % 2 == 0
    counted = running_totals(numbered, "file", "__at", {"__upto": quotes.cast("long")})
    placed = stage(running_totals(counted.withColumn("__begins", begins), "file", "__at", {"__record": F.col("__begins").cast("long")}))
    left_open = placed.groupBy("file").agg((F.max("__upto") % 2 == 1).alias("left")).filter("left").select("file", F.lit("quote left open").alias("open"))
    single = F.col("__begins") & (F.col("__upto") % 2 == 0)
    several = placed.filter(~single)
    sizes = several.groupBy("file", "__record").agg(F.sum(F.length("text") + 1).alias("chars"))
    too_long = sizes.filter(F.col("chars") > RECORD_CHARS).select("file", F.lit("record too long").alias("open")).distinct()
    unusable = stage(left_open.unionByName(too_long.join(left_open, "file", "left_anti")))
    sound = attach(several, unusable, "file", "left", spread="__at").filter(F.col("open").isNull())
    joined = (sound.groupBy("file", "__record").agg(F.array_sort(F.collect_list(F.struct("__at", "split", "line", "text"))).alias("parts"))
              .select("file", F.col("parts")[0]["split"].alias("split"), F.col("parts")[0]["line"].alias("line"),
                      F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))
    whole = placed.filter(single).select("file", "split", "line", "text")
    return plain.unionByName(whole).unionByName(joined), unusable


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def csv_wells(spark: SparkSession, path: str, curves: Sequence[str] = INPUT_CURVES, sep: str = ",",
              label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of CSV files: WELL (the file's name without its ending), SOURCE_ROW, DEPT, curves, LABEL.

    Each file is read by its own header, so files may differ in columns and in their order; a curve a file lacks is NULL.
    One file is one well: of files with one name in several folders the first by path is read, the others are rejects.
    """
    rows, rejects = read_csv_by_header(spark, path, sep, one_well=True)
    columns = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect()]
    label = (label or detect_label_column(sorted(columns)) or "").strip().upper()
    if label in curves:
        raise ValueError(f"{label} is an input curve and cannot be the label")
    if label and label not in columns:
        raise ValueError(f"no label column {label}")
    cell = lambda name: F.try_element_at("cells", F.lit(name))
    depth = F.coalesce(*[C.number(cell(n)) for n in ("DEPT", "DEPTH")])
    text = cell(label).cast("string") if label else F.lit(None).cast("string")
    samples = rows.select(C.file_stem(F.col("FILE")).alias("WELL"), "SOURCE_ROW", depth.alias("DEPT"),
                          *[C.number(cell(c)).alias(c) for c in curves], text.alias("LABEL"))
    return samples, rejects


def ingest(spark: SparkSession, path: str, fmt: str | None = None, curves: Sequence[str] = INPUT_CURVES) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of a LAS or CSV file, or of all such files of a folder."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = (fmt or (name.rsplit(".", 1)[-1] if "." in name else "folder")).lower()

    def las():
        samples, rejects = read_las(las_lines(spark, path, None if name.lower().endswith(".las") else "*.{las,LAS}"), (*curves, LABEL_CURVE))
        return samples.withColumn("LABEL", F.col(LABEL_CURVE).cast("string")).drop(LABEL_CURVE), rejects

    if suffix == "csv":
        return csv_wells(spark, path, curves)
    if suffix == "las":
        return las()
    if suffix == "folder":
        (a, bad_a), (b, bad_b) = las(), csv_wells(spark, path, curves)
        return a.unionByName(b), bad_a.unionByName(bad_b)
    raise ValueError(f"unsupported file type: {path}")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns of a table as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))
