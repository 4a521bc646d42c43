"""Byte-level BPE by monoid tree reduction: halves are encoded apart and joined by re-encoding a boundary window.

A node is the ids of a stretch of text. Some places always start a match of the pattern, whatever stands further away,
because matches run left to right and no alternative goes across them: a space between two characters that are not
blank, a line feed or tab after one that is not, a mark after a letter (SEAM takes letters and marks that are so in every
version of the character tables). Such a place is a seam: ids before and after it do not depend on one another. To join
two nodes, the window from the last seam of the left one to the first seam of the right one is encoded anew; it grows,
doubling, until both seams are inside, or it holds a whole side. Ids outside are provably final. A stretch without any
seam is one leaf, however long; otherwise leaves have at most LEAF_CHARS characters.

Texts over `task_chars` are dealt out in halves of halves over tasks and reduced level by level; shorter ones are
reduced inside the task that reads them. Decoding puts the bytes of halves together up the same kind of tree.

Defined cases: a null or empty text has no ids; a repeated row is encoded each time; doc_id may be null or repeated;
an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from array import array
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F

LEAF_CHARS, TASK_CHARS, WINDOW, LEAF_IDS = 512, 65536, 16, 4096
SEAM = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=[\n\t])|(?<=[A-Za-z\u4e00-\u9fa5])(?=[!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
TWO_BLANKS = re.compile(r"\s\s")
BLANKS_THEN_WORD = r"\s+(?!\S)|"


class Codec:
    """Ranks, pattern and byte strings of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # Without the look-ahead the pattern is a plain automaton; it differs only where two blanks meet.
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(BLANKS_THEN_WORD, ""),
                                       mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i).encode() for i in range(len(self.bytes))]

    def direct(self, text: str) -> list[int]:
        return (self.full if TWO_BLANKS.search(text) else self.plain).encode_ordinary(text)

    def decode(self, ids, leaf: int = LEAF_IDS) -> bytes:
        """Bytes of the ids by halves."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> list[int]:
        """Ids of a text by halves."""
        if len(text) <= leaf or SEAM.search(text) is None:
            return self.direct(text)
        half = len(text) // 2
        return self.joined(self.encode(text[:half], leaf), self.encode(text[half:], leaf))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenated text of two nodes."""
        if not left or not right:
            return left or right
        size = WINDOW
        while (tail := self.tail(left, size)) is None:
            size *= 2
        size = WINDOW
        while (head := self.head(right, size)) is None:
            size *= 2
        window = self.direct(tail + head)
        return left[:len(left) - len(self.direct(tail))] + window + right[len(self.direct(head)):]

    def tail(self, ids: list[int], size: int) -> str | None:
        """Text after the last seam within the last `size` ids; all of it if there are no more ids; else None."""
        raw = self.decode(ids[-size:])
        text = raw.decode("utf-8", "ignore")
        if size >= len(ids):
            seams = [m.start() for m in SEAM.finditer(text)]
            return text[seams[-1]:] if seams else text
        text = text[1:] if text else text  # the first character may be a part of one
        seams = [m.start() for m in SEAM.finditer(text)]
        return text[seams[-1]:] if seams else None

    def head(self, ids: list[int], size: int) -> str | None:
        text = self.decode(ids[:size]).decode("utf-8", "ignore")
        found = SEAM.search(text)
        return text[:found.start()] if found else text if size >= len(ids) else None


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def unpacked(data: bytes) -> list[int]:
    out = array("I")
    out.frombytes(data)
    return out.tolist()


def digests(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(b" ".join(map(c.decimal.__getitem__, ids))).hexdigest(),
            hashlib.sha256(c.decode(ids)).hexdigest())


def encode_short(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of texts that one task reduces."""
    def run(batches):
        c = codec(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [packed(c.encode(t or "")) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def encode_long(docs: DataFrame, path: str, longest: int, task_chars: int = TASK_CHARS) -> DataFrame:
    """doc_id, ids of texts of up to `longest` characters: leaves over tasks, then one join of neighbours per level."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    deepest = max(1, math.ceil(math.log2(longest / task_chars)))

    def leaves(batches):
        for b in batches:
            for key, doc, text in zip(b["key"], b["doc_id"], b["text"]):
                n = 1 << deepest if len(text) > task_chars else 1
                cuts = [len(text) * i // n for i in range(n + 1)]
                for i in range(n):  # one row at a time: a long text is never held twice
                    yield pd.DataFrame({"key": [key], "doc_id": pd.Series([doc], dtype=b["doc_id"].dtype),
                                        "node": [i], "text": [text[cuts[i]:cuts[i + 1]]]})

    def encoded(batches):
        c = codec(path)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "doc_id": b["doc_id"], "node": b["node"],
                                "ids": [packed(c.encode(t or "")) for t in b["text"]]})

    def reduced(batches):
        c = codec(path)
        for b in batches:
            ids = [pair[0]["ids"] if len(pair) == 1 else packed(c.joined(unpacked(pair[0]["ids"]), unpacked(pair[1]["ids"])))
                   for pair in b["pair"]]
            yield pd.DataFrame({"key": b["key"], "doc_id": b["doc_id"], "node": b["node"], "ids": ids})

    schema = f"key bigint, doc_id {kind}, node int, ids binary"
    level = (docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
             .mapInPandas(leaves, f"key bigint, doc_id {kind}, node int, text string")
             .repartition("key", "node").mapInPandas(encoded, schema))
    for _ in range(deepest):
        level = (level.groupBy("key", "doc_id", F.shiftright("node", 1).alias("node"))
                 .agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("at"), "ids"))).alias("pair"))
                 .mapInPandas(reduced, schema))
    return level.select("doc_id", "ids")


def encode(docs: DataFrame, path: str, task_chars: int = TASK_CHARS) -> DataFrame:
    """doc_id, ids of every whole text, as the tiktoken library encodes it without special tokens."""
    size = F.coalesce(F.char_length("text"), F.lit(0))
    longest = docs.select(F.max(size)).first()[0] or 0
    short = encode_short(docs.filter(size <= task_chars), path)
    return short if longest <= task_chars else short.unionByName(
        encode_long(docs.filter(size > task_chars), path, longest, task_chars))


def decode(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """`keep` and decoded (bytes) of rows with ids."""
    kinds = ", ".join(f"{k} {encoded.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        c = codec(path)
        for b in batches:
            yield b[list(keep)].assign(decoded=[c.decode(unpacked(i)) for i in b["ids"]])

    return encoded.select(*keep, "ids").mapInPandas(run, f"{kinds}, decoded binary")


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids are decoded again for the last."""
    def run(batches):
        c = codec(path)
        for b in batches:
            rows = [digests(c, unpacked(i)) for i in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [r[0] for r in rows],
                                "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInPandas(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
