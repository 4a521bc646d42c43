"""SentencePiece encoding with a table of distinct chunks, and decoding.

A marked word is a run of whitespace markers and the characters up to the next marker. Where no piece of the model holds
a marker after another character, no merge crosses from one marked word to the next, so each can be segmented alone; the
model is asked for that, and for a normaliser that changes nothing but the markers.

All marked words of the corpus are counted (in the task first, then by the word). The most frequent ones, as many as fit
in `table_rows` rows and `table_bytes` bytes, are segmented once, over tasks; that table is of bounded size and goes to
every task, which joins ids back by the position of the word in its text. A word beyond the table occurs less often than
any in it; moving its positions to its ids and back would move the texts themselves, so it is segmented where it stands,
once for all its places in a batch.

Defined cases: a null or empty text has the begin and end ids only; a repeated row is encoded each time; doc_id may be
null or repeated; words of any length are segmented (those over 64 characters never enter the table); an empty table gives
an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from depthlog.operators.staging import stage

MARK = "▁"
TABLE_ROWS, TABLE_BYTES, LONGEST = 200_000, 8 << 20, 64
BATCH_CHARS, COUNTED = 1 << 20, 250_000
MARKED = re.compile(r" +[^ ]*")


class Pieces:
    """The model and the ids of chunks; a chunk is written without its first marker."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = next((p for p in pieces if re.search(f"[^{MARK}]{MARK}", p)), None)
        if crossing or self.model.normalize(" ﬁ  Ａ a\n ") != f"{MARK}{MARK}ﬁ{MARK}{MARK}Ａ{MARK}a\n{MARK}":
            raise ValueError("pieces of this model cross whitespace markers, or its normaliser changes texts")
        self.bos, self.eos = (array("I", [i]).tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.alone = array("I", [self.model.piece_to_id(MARK)]).tobytes()

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit numbers; the library puts the first marker back."""
        return [array("I", ids).tobytes() if chunk else self.alone
                for chunk, ids in zip(chunks, self.model.encode(chunks, num_threads=1))]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def chunks_of(text: str) -> list[str]:
    """The marked words of a text in order, each without its first marker."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [chunk[1:] for chunk in MARKED.findall(" " + text)]


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """chunk, n of all chunks of up to LONGEST characters."""
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b[text]:
                seen.update(chunks_of(t or ""))
            if len(seen) > COUNTED:
                yield from rows(seen)
                seen = Counter()
        yield from rows(seen)

    def rows(seen):
        kept = [(c, n) for c, n in seen.items() if len(c) <= LONGEST]
        for at in range(0, len(kept), 50_000):
            yield pd.DataFrame(kept[at:at + 50_000], columns=["chunk", "n"])

    return docs.select(text).mapInPandas(run, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, path: str, text: str = "text", table_rows: int = TABLE_ROWS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """chunk, ids of the most frequent chunks that fit in the bounds, each segmented once."""
    counts = stage(chunk_counts(docs, text))
    # Counts by steps of a quarter of a power of two: a few hundred rows whatever the corpus.
    steps = (counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step"))
             .agg(F.count("*").alias("rows"), F.sum(F.octet_length("chunk") * 5).alias("bytes"), F.min("n").alias("least"))
             .orderBy(F.desc("step")).collect())
    least, rows, size = None, 0, 0
    for s in steps:  # ids take at most four bytes for each byte of a chunk
        rows, size = rows + s["rows"], size + s["bytes"]
        if rows > table_rows or size > table_bytes:
            break
        least = s["least"]
    frequent = counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)

    def run(batches):
        own = pieces(path)
        for b in batches:
            yield pd.DataFrame({"chunk": b["chunk"], "ids": own.segment(b["chunk"].tolist())})

    return frequent.select("chunk").mapInPandas(run, "chunk string, ids binary")


def carried(table: DataFrame):
    """The table of bounded size as one broadcast variable, packed in the tasks."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"part": [pickle.dumps((b["chunk"].tolist(), b["ids"].tolist()))]})

    return table.sparkSession.sparkContext.broadcast([r["part"] for r in table.mapInPandas(run, "part binary").collect()])


_HELD: list = [None, {}]  # the last table a worker has unpacked, and the variable it came in


def held(sent) -> dict[str, bytes]:
    if _HELD[0] is not sent:
        _HELD[:] = [sent, dict(chain.from_iterable(zip(*pickle.loads(part)) for part in sent.value))]
    return _HELD[1]


def joined(own: Pieces, table: dict[str, bytes], texts: list[str]):
    """Ids of each text: those of its chunks by position, between begin and end."""
    split = [chunks_of(t) for t in texts]
    rest = list({c for chunks in split for c in chunks if c not in table})
    here = dict(zip(rest, own.segment(rest)))
    for chunks in split:
        if here.keys().isdisjoint(chunks):
            body = b"".join(map(table.__getitem__, chunks))
        else:
            body = b"".join([table[c] if c in table else here[c] for c in chunks])
        yield own.bos + body + own.eos


def _parts(texts: list[str]):
    """Runs of texts of bounded size together, a longer text alone."""
    start = size = 0
    for at, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield start, at
            start, size = at, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _each(docs: DataFrame, sent, path: str, make, kinds: str) -> DataFrame:
    """doc_id and what `make` gives for the ids of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches):
        own, table = pieces(path), held(sent)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            for start, stop in _parts(texts):
                columns = zip(*[make(own, ids) for ids in joined(own, table, texts[start:stop])])
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(start, stop - start), *map(pa.array, columns)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {kinds}")


def encode(docs: DataFrame, path: str, **bounds) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text, with begin and end ids."""
    return _each(docs, carried(chunk_table(docs, path, **bounds)), path, lambda own, ids: (ids,), "ids binary")


def decoded(own: Pieces, ids: bytes) -> str:
    numbers = array("I")
    numbers.frombytes(ids)
    return own.model.decode(numbers.tolist())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids."""
    def run(batches):
        own = pieces(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [decoded(own, i) for i in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str, **bounds) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids of encode(), decoded again in the task that has them."""
    def make(own, ids):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded(own, ids).encode()).hexdigest()

    return _each(docs, carried(chunk_table(docs, path, **bounds)), path, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
