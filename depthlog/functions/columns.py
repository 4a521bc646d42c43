"""Column expressions: decoding, cleaning, rounding. All JVM-side, none touches Python rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from depthlog.schema import EMPTY_LABEL_TEXT, LAS_NULL, LITHOLOGY, SENTINELS


def number(c: Column) -> Column:
    """To DOUBLE; text that is no number, NaN and infinities become NULL."""
    return finite(c.try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def drop_sentinels(c: Column, sentinels=SENTINELS) -> Column:
    return F.when(c.isin(*sentinels), None).otherwise(c)


def drop_las_null(c: Column) -> Column:
    return drop_sentinels(c, (LAS_NULL,))


def physical(curve: str, c: Column) -> Column:
    """Null out impossible readings: negative gamma ray, non-positive other curves."""
    impossible = c < 0 if curve == "GR" else c <= 0
    return F.when(impossible, None).otherwise(c)


def log10_positive(c: Column) -> Column:
    return finite(F.log10(F.when(c > 0, c)))


def _lookup(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def code_to_name(c: Column) -> Column:
    return F.try_element_at(_lookup((code, name) for code, name, _ in LITHOLOGY), c.cast("int"))


def name_to_code(c: Column) -> Column:
    names = _lookup((name.upper(), code) for code, name, _ in LITHOLOGY)
    return F.try_element_at(names, F.upper(F.trim(c)))


def code_to_display(c: Column) -> Column:
    return F.try_element_at(_lookup((code, pos) for code, _, pos in LITHOLOGY), c.cast("int"))


def code_to_index(c: Column, codes=None) -> Column:
    """Position of the code in the ascending class list, NULL for an unknown code."""
    codes = sorted(codes or (code for code, _, _ in LITHOLOGY))
    return F.try_element_at(_lookup((code, i) for i, code in enumerate(codes)), c.cast("int"))


def index_to_code(c: Column, codes=None) -> Column:
    codes = sorted(codes or (code for code, _, _ in LITHOLOGY))
    return F.try_element_at(F.array(*[F.lit(x) for x in codes]), c.cast("int") + 1)


def decode_label(c: Column) -> Column:
    """Numeric class code (rounded half-even) or class name to a class code, else NULL."""
    text = c.cast("string")
    rounded = F.rint(number(text))
    codes = [float(code) for code, _, _ in LITHOLOGY]
    return F.coalesce(F.when(rounded.isin(*codes), rounded.cast("int")), name_to_code(text))


def is_empty_label(c: Column) -> Column:
    text = F.upper(F.trim(c.cast("string")))
    return text.isNull() | text.isin(*EMPTY_LABEL_TEXT)


def correctness(true: Column, pred: Column) -> Column:
    """1 right, 0 wrong, NULL where there is no label."""
    return F.when(true.isNotNull(), (true == pred).cast("int"))


def official_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def file_to_well(c: Column) -> Column:
    """Only the first underscore stands for a slash."""
    return F.regexp_replace(c, r"^([^_]*)_", "$1/")


def match_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def well_block(c: Column) -> Column:
    found = F.regexp_extract(c, r"^(\d+)/", 1)
    return F.when(found == "", F.lit("Other")).otherwise(found)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounding of reported doubles to the nearest, halves away from zero, never -0.0; NaN and infinities stay."""
    return F.round(c.cast("double"), digits) + 0.0  # NaN and infinities pass round as they are


def order_bucket(c: Column, resolution: int) -> Column:
    """Non-decreasing integer function of a double, independent of the data.

    Buckets have equal width on a log scale, `resolution` of them per factor e; equal values
    always share one.
    """
    magnitude = F.floor(F.ln(F.abs(c)) * resolution) + F.lit(800 * resolution)
    return F.when(c == 0, F.lit(0)).otherwise(F.signum(c).cast("long") * magnitude).cast("long")
