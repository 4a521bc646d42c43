"""WARC archives as a chunked record table.

Writing: payloads are streamed as rows of record identifier and chunk number; each row carries the SHA-1 of the payload
so far, so the last row of a record carries the payload's digest. A chunk becomes one WARC record, the first a
response, the others continuations with segment numbers, so no record in an archive is larger than a chunk. Chunks
end at whole characters, and also inside every "WARC/1.1" of a payload: that text never stands whole in a chunk, so it
marks nothing but record starts, and an archive that is not compressed can be split and read anywhere.

Reading: records are split at that mark, parsed with column functions and put together again as a chunk table. Records
of one chunk are digested where they are read; the others are dealt by record, sorted by chunk number and streamed
through an incremental digest, one chunk in memory at a time.

Of records with equal payloads of at least `least` bytes, that of the largest page_id is the response and the others
are revisits without payload. Defined cases: null html is an empty payload; rows that share the largest page_id are all
responses, so a repeated page is archived each time; a null page_id is the smallest; urls may hold any characters
(blanks and marks are escaped); a record whose length is not the stated one is no record: `read_archive` leaves it to
`damaged`; an empty table gives an empty archive; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

MARK, CHUNK, LEAST = b"WARC/1.1", 1 << 13, 1000
DATE = "2000-01-01T00:00:00Z"
BATCH = 1 << 20


def cuts(payload: bytes, size: int = CHUNK):
    """start, end of each chunk: at most `size` bytes, whole characters, no mark inside."""
    at, mark = 0, payload.find(MARK)
    while True:
        end = min(at + size, len(payload))
        while mark >= 0 and mark < at:
            mark = payload.find(MARK, mark + 1)
        if 0 <= mark < end:
            end = mark + 1
        elif end < len(payload):
            back = end
            while back > at and payload[back] & 0xC0 == 0x80:
                back -= 1
            end = back if back > at else end
        yield at, end
        at = end
        if at >= len(payload):
            return


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, refers_to (null for responses), one row for each page_id and payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marks = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    largest = (marks.filter(F.col("bytes") >= least).groupBy("digest", "bytes")
               .agg(F.max("page_id").alias("largest")))
    return (marks.join(largest, ["digest", "bytes"], "left").groupBy("page_id", "digest").agg(F.first("largest").alias("largest"))
            .select("page_id", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to")))


def chunk_table(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """record, page_id, url, refers_to, chunk, n_chunks_so_far digest rows of records (page_id, url, html, refers_to).

    A revisit has one empty chunk; its payload_bytes and digest are those of the full payload."""
    kind = records.schema["page_id"].dataType.simpleString()
    schema = (f"record string, page_id {kind}, url string, refers_to {kind}, chunk int, last boolean, "
              "payload_bytes bigint, digest string, data binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = records.schema["page_id"].dataType

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        if kinds.typeName() in ("long", "integer"):
            out = out.astype({"page_id": "Int64", "refers_to": "Int64"})
        return out

    def stream(batches):
        rows, held = [], 0
        for b in batches:
            for page, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["refers_to"]):
                payload, record, so_far = (html or "").encode("utf-8", "replace"), str(uuid.uuid4()), hashlib.sha1()
                page, refers = (None if pd.isna(x) else x for x in (page, refers))
                if refers is not None:
                    rows.append((record, page, url, refers, 0, True, len(payload), hashlib.sha1(payload).hexdigest(), b""))
                    continue
                for k, (a, z) in enumerate(cuts(payload, size)):
                    so_far.update(payload[a:z])
                    rows.append((record, page, url, None, k, z == len(payload), z, so_far.hexdigest(), payload[a:z]))
                    held += z - a
                    if held >= BATCH:
                        yield frame(rows)
                        rows, held = [], 0
        if rows:
            yield frame(rows)

    return records.select("page_id", "url", "html", "refers_to").mapInPandas(stream, schema)


def as_records(chunks: DataFrame) -> DataFrame:
    """One column, a whole WARC record for each chunk, but for its last line feed, which the text writer adds."""
    def line(name, value, there=None):
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if there is None else F.when(there, text).otherwise("")

    url = F.replace(F.coalesce("url", F.lit("")), F.lit("WARC/1.1"), F.lit("WARC%2F1.1"))
    for bad, good in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        url = F.replace(url, F.lit(bad), F.lit(good))
    first, revisit = F.col("chunk") == 0, F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(MARK.decode() + "\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record", F.when(first, "").otherwise(
            F.concat(F.lit("/"), F.col("chunk").cast("string"))), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", url),
        line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"), ~first | ~F.col("last")),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:uuid:"), "record", F.lit(">")), ~first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), F.col("last")),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("X-Digest-So-Far", F.concat(F.lit("sha1:"), "digest"), ~F.col("last")),
        line("X-Page-ID", F.col("page_id").cast("string"), F.col("page_id").isNotNull()),
        line("X-Refers-To-Page-ID", F.col("refers_to").cast("string"), revisit),
        line("X-Payload-Length", F.col("payload_bytes").cast("string"), F.col("last")),
        line("Content-Length", F.octet_length("data").cast("string")), F.lit("\r\n"))
    return chunks.select(F.concat(head, F.col("data").cast("string"), F.lit("\r\n\r")).alias("value"))


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, size: int = CHUNK, compression: str = "gzip",
                  chunks_per_file: int = 20_000) -> None:
    """Write the pages (page_id, url, html) as WARC files into a new folder. With compression "none" archives can be
    read in splits; compressed ones are read a file at a time, so files are kept small."""
    choice = decide(pages, least).select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    rows = pages.select("page_id", "url", "html")
    records = rows.join(choice, F.col("page_id").eqNullSafe(F.col("__page")) & (
        F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")) == F.col("__digest")), "left")
    as_records(chunk_table(records, size)).write.option("lineSep", "\n").option(
        "compression", compression).option("maxRecordsPerFile", chunks_per_file).text(folder)


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Header fields and block of each record of the archives in a folder."""
    raw = (spark.read.option("lineSep", MARK.decode() + "\r\n").text(folder).filter(F.octet_length("value") > 0)
           .select(F.substring_index("value", "\r\n\r\n", 1).alias("head"), F.col("value").cast("binary").alias("raw")))

    def field(name):
        found = F.regexp_extract(F.concat(F.lit("\n"), "head"), rf"\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    start = F.octet_length("head") + 4
    origin = F.regexp_extract(F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")), "<urn:uuid:([^/>]*)", 1)
    return raw.select(
        origin.alias("record"), field("WARC-Type").alias("type"), field("X-Page-ID").alias("page"),
        field("X-Refers-To-Page-ID").alias("refers"), field("WARC-Target-URI").alias("url"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk"),
        field("WARC-Payload-Digest").isNotNull().alias("last"), field("WARC-Payload-Digest").alias("stated"),
        field("X-Payload-Length").cast("long").alias("length"),
        F.expr("try_cast(regexp_extract(concat('\\n', head), '\\nContent-Length: ([0-9]+)', 1) AS INT)").alias("content"),
        (F.octet_length("raw") - start - 4).alias("there"), F.col("raw"), start.alias("start"))


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of the sound records: header fields, chunk number and data."""
    sound = parsed(spark, folder).filter("content = there")
    return sound.withColumn("data", F.expr("substring(raw, start + 1, content)")).drop("raw", "start", "content", "there")


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose block is not as long as stated."""
    return parsed(spark, folder).filter("content is null or content <> there").select("record", "type", "content", "there")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """record, page, type, refers, url, payload_bytes, payload_digest of each response and revisit; those of responses
    are counted and digested anew from the chunks."""
    chunks = read_chunks(spark, folder)
    single = chunks.filter("chunk = 0 and last").select(
        "record", "page", "type", "refers", "url",
        F.when(F.col("type") == "revisit", F.col("length")).otherwise(F.octet_length("data").cast("long")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.substring_index("stated", ":", -1)).otherwise(F.sha1("data")).alias("payload_digest"))

    names, schema = single.columns, single.schema

    def stream(batches):
        at, size, sha, head = None, 0, hashlib.sha1(), None
        for b in batches:
            done = []
            for r in b.itertuples(index=False):
                if r.record != at:
                    at, size, sha, head = r.record, 0, hashlib.sha1(), (r.record, r.page, r.type, r.refers, r.url)
                sha.update(r.data)
                size += len(r.data)
                if r.last:
                    done.append((*head, size, sha.hexdigest()))
            if done:
                yield pd.DataFrame(done, columns=names)

    several = (chunks.filter("not (chunk = 0 and last)").repartition("record").sortWithinPartitions("record", "chunk")
               .mapInPandas(stream, schema))
    return single.unionByName(several)
