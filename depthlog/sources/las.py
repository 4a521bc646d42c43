"""LAS well-log files as DataFrames, line by line.

Files are read as plain text, so a big file is split like any other. A line is placed by the
start of its split and its order inside the split; the few header lines of each file give
curve positions and the null value, and data lines are decoded with column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from depthlog.functions import columns as C
from depthlog.operators.series import attach, number_rows, running_totals
from depthlog.operators.staging import stage
from depthlog.sources.sinks import write_files
from depthlog.schema import INPUT_CURVES, LABEL_CURVE, LAS_NULL, LOCATION_CURVES

FIRST_ROW = "FIRSTROW"
PART_BYTES = 32 << 20
# --- fixed values: names of delimiters in the version section -----------------------------
DELIMITERS = {"SPACE": None, "COMMA": ",", "TAB": "\t"}
STATED = ("WELL", FIRST_ROW, "null_value", "positions", "curves")
DEFAULT_CURVES = (*INPUT_CURVES, *LOCATION_CURVES, LABEL_CURVE)


def las_lines(spark: SparkSession, path: str, glob: str | None = "*.{las,LAS}") -> DataFrame:
    """file, at (place of the line in the file), text."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return packed(place_lines, reader.text(path))


def packed(place: Callable[[DataFrame], DataFrame], text: DataFrame) -> DataFrame:
    """The placed lines of `text` in parts of PART_BYTES, but no fewer than a few for each core.

    Spark counts a small file as several megabytes, so many small files would each be nearly a task of their own."""
    size = int(str(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return place(text).coalesce(max(4 * text.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES))


def place_lines(text: DataFrame) -> DataFrame:
    """Add file and place to lines of a text source; also works on one batch of a stream."""
    return text.select(F.col("_metadata.file_path").alias("file"),
                       F.struct(F.col("_metadata.file_block_start").alias("split"),
                                F.monotonically_increasing_id().alias("line")).alias("at"),
                       F.trim("value").alias("text"))


def _sections(lines: DataFrame) -> DataFrame:
    """Per file: the section marks in order, and the place of the data mark."""
    marks = lines.filter(F.col("text").startswith("~")).select("file", "at", F.upper(F.substring("text", 2, 1)).alias("letter"))
    return marks.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("at", "letter"))).alias("marks"),
        F.min(F.when(F.col("letter") == "A", F.col("at"))).alias("data_at"))


def las_headers(lines: DataFrame) -> DataFrame:
    """One row per header line: file, well, section, position, mnemonic, unit, value, descr.

    The lines are staged: their places are compared, and must be the same in both uses.
    """
    return _headers(stage(lines))


def _headers(lines: DataFrame) -> DataFrame:
    """las_headers of staged lines. Header lines carry a colon, data lines rarely do, so few lines meet the section marks."""
    own = lines.filter(F.col("text").contains(":") & ~F.col("text").startswith("#") & ~F.col("text").startswith("~"))
    placed = (attach(own, _sections(lines), "file", spread=F.col("at.split"))
              .filter(F.col("data_at").isNull() | (F.col("at") < F.col("data_at")))
              .withColumn("section", F.element_at(F.filter("marks", lambda m: m["at"] < F.col("at")), -1)["letter"]))
    pattern = r"^\s*([^.]*?)\s*\.([^\s:]*)\s*(.*?)\s*:\s*([^:]*)$"
    fields = {n: F.trim(F.regexp_extract("text", pattern, i)) for i, n in enumerate(("mnemonic", "unit", "value", "descr"), 1)}
    within = Window.partitionBy("file", "section").orderBy("at")
    table = (placed.withColumns(fields).filter(F.col("section").isin("V", "W", "P", "C") & (F.col("mnemonic") != ""))
             .withColumns({"mnemonic": F.upper("mnemonic"), "position": F.row_number().over(within) - 1}))
    name = F.max(F.when((F.col("section") == "W") & (F.col("mnemonic") == "WELL") & (F.col("value") != ""), F.col("value")))
    return (table.withColumn("well", F.coalesce(name.over(Window.partitionBy("file")), C.file_stem(F.col("file"))))
            .select("file", "well", "section", "position", "mnemonic", "unit", "value", "descr"))


def las_files(lines: DataFrame) -> DataFrame:
    """Per file of staged lines: well, null value, curve positions, start of the data, and why it is unreadable."""
    heads = stage(_headers(lines))

    def of(section, mnemonic):
        return F.max(F.when((F.col("section") == section) & (F.col("mnemonic") == mnemonic), F.col("value")))
    named = (heads.filter(F.col("section") == "C").groupBy("file", "mnemonic")
             .agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("n")))
    columns = named.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("mnemonic", "position"))).alias("positions"),
                                        F.max("n").alias("most"), F.sum("n").alias("curves"))
    general = heads.groupBy("file").agg(F.max("well").alias("WELL"), F.coalesce(of("W", FIRST_ROW).try_cast("long"), F.lit(0).cast("long")).alias(FIRST_ROW), C.number(of("W", "NULL")).alias("null_value"),
                                        F.upper(of("V", "WRAP")).alias("wrap"), F.upper(of("V", "DLM")).alias("delimiter"))
    starts = lines.groupBy("file").agg(F.min(F.when(F.upper(F.substring("text", 1, 2)) == "~A", F.col("at"))).alias("data_at"))
    return stage(starts.join(general, "file", "left").join(columns, "file", "left")
                 .withColumn("error", F.when(F.col("data_at").isNull(), "no data section")
                             .when(F.col("curves").isNull(), "no curve section")
                             .when(F.col("most") > 1, "duplicate curve name")
                             .when(~F.col("delimiter").isin("", *DELIMITERS), "unknown delimiter")))


def _cells(text: Column, delimiter: Column) -> Column:
    """Cells of a data line by the delimiter its file declares; blanks where it declares none."""
    split = F.split(F.trim(text), r"\s+")
    for name, mark in DELIMITERS.items():
        if mark:
            split = F.when(delimiter == name, F.transform(F.split(text, mark), lambda c: F.trim(c))).otherwise(split)
    return split


def _unwrapped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, files with a cell too many or too few) of wrapped files: file, what it states, sample, values.

    A sample's cells may lie on any lines. The cells before a line, counted over blocks of lines, divided by the number of
    curves give the sample and the curve of each cell, wherever the file is split and however long it is."""
    width = F.size("values").cast("long")
    lines = number_rows(rows, "file", [F.col("at")], [F.col("at.split")], "__line")
    counted = stage(running_totals(lines, "file", "__line", {"__upto": width}))
    odd = (counted.groupBy("file").agg(F.max("__upto").alias("cells"), F.max("curves").alias("curves"))
           .filter(F.col("cells") % F.col("curves") != 0).select("file"))
    cells = counted.select("file", *STATED, (F.col("__upto") - width).alias("__before"), F.posexplode("values").alias("__i", "value"))
    place = F.col("__before") + F.col("__i")
    whole = cells.select("file", *STATED, F.floor(place / F.col("curves")).cast("long").alias("sample"), F.pmod(place, F.col("curves")).alias("curve"), "value")
    # The file's own statements are equal in all its cells; the map of positions cannot be a grouping key.
    samples = whole.groupBy("file", "sample").agg(
        *[F.first(c).alias(c) for c in STATED],
        F.transform(F.array_sort(F.collect_list(F.struct("curve", "value"))), lambda c: c["value"]).alias("values"))
    return samples, odd


def read_las(lines: DataFrame, curves: Sequence[str] = DEFAULT_CURVES, pieces: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects).

    samples: WELL, SOURCE_ROW, DEPT (the first curve) and `curves`; a curve the file lacks is
    NULL. A well may be cut into several files: SOURCE_ROW counts on from the row that a file
    states in its well section (0 if it states none). Data lines may be wrapped, and cells
    separated as the version section says (blanks, commas or tabs).
    rejects: file and error of every file that cannot be read, also of one whose rows another
    file of the well (with an earlier first row, or name) has already; its rows are left out
    and all others kept. With `pieces`, FILE and FIRSTROW come too and files may overlap: the
    caller decides between them.
    """
    lines = stage(lines)  # one pass over the text; places of lines are fixed from here on
    files = las_files(lines)
    split = F.col("at.split")
    data = lines.filter((F.col("text") != "") & ~F.col("text").startswith("#") & ~F.col("text").startswith("~"))
    good_files = files.filter(F.col("error").isNull()).drop("error", "most")
    rows = (attach(data, good_files, "file", spread=split).filter(F.col("at") > F.col("data_at"))
            .withColumn("values", _cells(F.col("text"), F.col("delimiter"))))
    wrapped = F.coalesce(F.col("wrap") == "YES", F.lit(False))
    flat = rows.filter(~wrapped)
    bad = (flat.groupBy("file").agg(F.count_if(F.size("values") != F.col("curves")).alias("bad")).filter(F.col("bad") > 0).select("file"))
    counts = flat.groupBy("file", "WELL", FIRST_ROW).agg(F.count(F.lit(1)).alias("n"))
    any_wrapped = not good_files.filter(wrapped).isEmpty()
    if any_wrapped:
        whole, odd = _unwrapped(rows.filter(wrapped))
        whole = stage(whole)
        bad = bad.unionByName(odd)
        counts = counts.unionByName(whole.groupBy("file", "WELL", FIRST_ROW).agg(F.count(F.lit(1)).alias("n")))
    uneven = stage(bad.withColumn("error", F.lit("data line with wrong number of values")))
    if not pieces:
        pieces_of = Window.partitionBy("WELL").orderBy(FIRST_ROW, "file").rowsBetween(Window.unboundedPreceding, -1)
        taken = F.max(F.col(FIRST_ROW) + F.col("n")).over(pieces_of)
        double = counts.join(uneven, "file", "left_anti").withColumn("taken", taken).filter(F.col("taken") > F.col(FIRST_ROW))
        uneven = stage(uneven.unionByName(double.select("file", F.lit("rows of the well are in another file").alias("error"))))
    good = attach(flat, uneven, "file", "left", spread=split).filter(F.col("error").isNull())
    placed = number_rows(good, "file", [F.col("at")], [split], "SOURCE_ROW").select("file", *STATED, "values", "SOURCE_ROW")
    if any_wrapped:
        kept = attach(whole, uneven, "file", "left", spread="sample").filter(F.col("error").isNull())
        placed = placed.unionByName(kept.select("file", *STATED, "values", F.col("sample").alias("SOURCE_ROW")))

    def pick(index):
        v = C.number(F.try_element_at("values", index + 1))
        return F.when(v != F.coalesce("null_value", F.lit(LAS_NULL)), C.drop_las_null(v))
    samples = placed.select("WELL", (F.col("SOURCE_ROW") + F.col(FIRST_ROW)).alias("SOURCE_ROW"), *([F.col("file").alias("FILE"), FIRST_ROW] if pieces else []), pick(F.lit(0)).alias("DEPT"),
                            *[pick(F.try_element_at("positions", F.lit(c))).alias(c) for c in curves])
    return samples, files.filter(F.col("error").isNotNull()).select("file", "error").unionByName(uneven)


def null_census(headers: DataFrame) -> DataFrame:
    """Files per declared null value."""
    return (headers.filter((F.col("section") == "W") & (F.col("mnemonic") == "NULL"))
            .groupBy(C.number(F.col("value")).alias("null_value")).agg(F.count(F.lit(1)).alias("files")))


def header_availability(headers: DataFrame) -> DataFrame:
    """Wells that list each curve."""
    return headers.filter(F.col("section") == "C").groupBy("mnemonic").agg(F.countDistinct("well").alias("wells"))


def las_text(df: DataFrame, curves: Sequence[str], key: str = "WELL", order: str = "SOURCE_ROW", depth: str = "DEPT",
             block_rows: int = 1_000_000, null_value: float = LAS_NULL) -> DataFrame:
    """Lines of LAS files, at most `block_rows` samples each: file, place, text."""
    file = F.concat(F.col(key).cast("string"), F.lit("-"), F.floor(F.col(order) / block_rows).cast("string"))
    cell = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit(str(null_value)))
    body = df.select(file.alias("file"), F.col(order).cast("long").alias("place"),
                     F.concat_ws(" ", *[cell(c) for c in (depth, *curves)]).alias("text"))
    fixed = ["~Version", " VERS. 2.0 : version", " WRAP. NO : one line per step", "~Well", f" NULL. {null_value} : null value"]
    first = F.concat(F.lit(f" {FIRST_ROW}. "), F.col("first").cast("string"), F.lit(" : row of the well in the first data line"))
    after = ["~Curve", f" {depth}.M : depth", *[f" {c}. : {c}" for c in curves], "~ASCII"]
    names = df.groupBy(file.alias("file"), F.col(key).cast("string").alias("well")).agg(F.min(F.col(order).cast("long")).alias("first"))
    head = names.select("file", F.posexplode(F.concat(
        F.array(*[F.lit(x) for x in fixed]), F.array(F.concat(F.lit(" WELL. "), F.col("well"), F.lit(" : well")), first),
        F.array(*[F.lit(x) for x in after]))).alias("p", "text")).select("file", (F.col("p") - 1000).cast("long").alias("place"), "text")
    return head.unionByName(body)


def write_las(df: DataFrame, path: str, curves: Sequence[str], **names) -> None:
    """One folder per file; the lines of a file are sorted inside one task of bounded size."""
    write_files(las_text(df, curves, **names).withColumnRenamed("place", "__place"), path, "file", "__place", "text", "errorifexists")
