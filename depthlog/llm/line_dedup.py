"""Line dedup by winnowing: later copies of runs of lines are deleted.

The lines of a document that hold more than blanks are its content lines, compared without blanks at their ends. A
run of RUN content lines in a row (blank lines between them do not matter), or of fewer that hold WORDS or more words
together, that equals a run of an earlier document, or one that starts earlier in the same document, is a repeat; every
line of a repeat is deleted. Documents are ordered by doc_id, then by a hash of the text.

Each run selects its smallest line digest (the last one of equals), so two equal runs select the same line: the selected
lines are guaranteed fingerprints, and only they are written, each with the RUN - 1 lines before and after it. A selected
line joins the first position of its fingerprint, and the match is extended there line by line both ways; where it grows to
RUN lines or WORDS words, the later one's lines are deleted. Runs that the first position does not match take the lines of
the whole run as fingerprint and go through the same step once more, where the first position always matches. No pairs are
made: a position meets the first of its kind, minima are summed up before any shuffle, and both sides of a join are
written tables, so that a fingerprint many rows share is split over tasks.

Defined cases: null and empty texts and texts of fewer than RUN content lines and WORDS words stay as they are; rows with the same
doc_id and the same text are one document and get one result; a null doc_id comes before all others; an empty table
gives an empty result; extra columns are kept by `clean` and never read.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from depthlog.operators.staging import stage

RUN, WORDS = 3, 50
BLANKS = " \t\n\v\f\r"
ROWS = 20_000


def content_lines(text: str) -> list[tuple[int, str]]:
    """Number and stripped form of each line with more than blanks."""
    return [(i, line) for i, line in ((i, x.strip(BLANKS)) for i, x in enumerate(text.split("\n"))) if line]


def selected(text: str, run: int = RUN, words: int | None = WORDS):
    """pos, before, here, after, runs of every selected line: its place among the content lines, the lines around it (nearest
    first), each as (digest, words, number), and the runs that select it, as numbers of lines before and after it."""
    lines = [(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")), len(x.split()), i) for i, x in content_lines(text)]
    chosen: dict[int, list] = {}
    for p in range(len(lines)):
        held = 0
        for z in range(p + 1, min(p + run, len(lines)) + 1):
            held += lines[z - 1][1]
            if z == p + run or (words and held >= words):
                at = p
                for i in range(p + 1, z):
                    if lines[i][0] <= lines[at][0]:
                        at = i
                chosen.setdefault(at, []).append((at - p, z - 1 - at))
    for at, found in chosen.items():
        yield at, lines[max(at - run + 1, 0):at][::-1], lines[at], lines[at + 1:at + run], found


def key():
    """doc_id and a hash of the text: orders documents and tells rows of one doc_id apart."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def positions(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """key, pos, before, here, after, runs of every selected line of every document."""
    keyed = docs.select(key().alias("key"), "text")
    kind = keyed.schema["key"].dataType.simpleString()
    line = "struct<digest: binary, words: int, line: int>"
    schema = f"key {kind}, pos int, before array<{line}>, here {line}, after array<{line}>, runs array<struct<before: int, after: int>>"
    names = ["key", "pos", "before", "here", "after", "runs"]

    def find(batches):
        rows = []
        for b in batches:
            for k, text in zip(b["key"], b["text"]):
                for at, before, here, after, found in selected(text or "", run, words):
                    rows.append((k, at, [named(x) for x in before], named(here), [named(x) for x in after],
                                 [{"before": x, "after": y} for x, y in found]))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return keyed.mapInPandas(find, schema)


def named(line: tuple) -> dict:
    return dict(zip(("digest", "words", "line"), line))


def equal_lines(side: str, run: int):
    """How many lines on this side equal those of the first position, counted outwards."""
    n = F.lit(0)
    for i in reversed(range(run - 1)):
        n = F.when(F.get(f"{side}.digest", F.lit(i)) == F.get(f"first_{side}", F.lit(i)), n + 1).otherwise(F.lit(0))
    return n


def extended(found: DataFrame, run: int) -> DataFrame:
    """The positions that are not the first of their fingerprint, with n_before and n_after: how many lines around them equal
    those around the first."""
    at = F.struct("key", "pos")
    firsts = stage(found.groupBy("fingerprint").agg(F.min(at).alias("first"), F.max(at).alias("last"))
                   .filter("first <> last").select("fingerprint", "first"))
    shared = stage(found.join(firsts, "fingerprint"))
    # Rows of one key are one document, so any of them stands for the first position.
    leads = stage(shared.filter(at == F.col("first")).dropDuplicates(["fingerprint"])
                  .select("fingerprint", F.col("before.digest").alias("first_before"), F.col("after.digest").alias("first_after")))
    return stage(shared.filter(at > F.col("first")).join(leads, "fingerprint")
                 .withColumn("n_before", equal_lines("before", run)).withColumn("n_after", equal_lines("after", run))
                 .drop("first", "first_before", "first_after"))


def around(before, after):
    """The lines from so many before the selected one to so many after it, in order."""
    return F.concat(F.reverse(F.slice("before", 1, before)), F.array("here"), F.slice("after", 1, after))


def repeats(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """key, gone: the numbers of the lines to delete, for the documents that have any."""
    found = stage(positions(docs, run, words))
    by_line = extended(found.withColumn("fingerprint", F.array("here.digest")), run)
    left = (by_line.withColumn("run", F.explode(F.filter("runs", lambda r: (r["before"] > F.col("n_before")) | (r["after"] > F.col("n_after")))))
            .withColumn("fingerprint", F.transform(around(F.col("run.before"), F.col("run.after")), lambda x: x["digest"]))
            .drop("run", "n_before", "n_after"))
    match = by_line.unionByName(extended(stage(left), run)).select("key", around(F.col("n_before"), F.col("n_after")).alias("lines"))
    enough = F.size("lines") >= run
    if words:
        enough |= F.aggregate("lines", F.lit(0), lambda n, x: n + x["words"]) >= words
    later = match.filter(enough).select("key", F.col("lines.line").alias("lines"))
    return later.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


@pandas_udf(StringType())
def without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(text, numbers):
        if text is None or numbers is None:
            return text
        drop = set(numbers)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

    return pd.Series([cut(t, g) for t, g in zip(texts, gone)], dtype=object)


def marked(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """The documents with __gone, the numbers of the lines to delete (null: none). Without `words` runs are only counted
    in lines."""
    gone = repeats(docs, run, words).select(F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    return docs.withColumn("__here", key()).join(gone, F.col("__here") == F.col("__key"), "left").drop("__here", "__key")


def clean(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """The documents, all columns kept, without repeated lines; n_chars, where there is one, follows the text."""
    out = marked(docs, run, words).withColumn("text", without_lines("text", "__gone"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
