"""Best-fit packing by patterns: short lists of lengths that fill a sequence exactly are repeated as often as a
non-negative least-squares fit to the histogram of lengths says; what is left over is packed best-fit.

The histogram has at most `size` entries whatever the corpus holds, so fitting it on the driver is bounded: at most
`size` lengths and about size^2 / 12 + size / 2 + 1 patterns. Documents meet their places by their rank among the
documents of the same length.

With added_tokens texts are split at the added tokens of the tokenizers file, which get their own ids; without, their
strings are ordinary text.

Defined cases: a null or empty text is the closing id alone; a repeated row is packed each time; a null doc_id is
packed like any other; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from depthlog.llm.tree_bpe import BLANKS_THEN_WORD, TWO_BLANKS
from depthlog.operators.series import rank_rows
from depthlog.operators.staging import stage

SIZE, CLOSING, ROUNDS = 1024, 2, 400


def unicode_bytes() -> dict[str, int]:
    """How byte-level vocabularies write bytes as characters: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def fast_encoders(path: str):
    """Two encoders with the ids of a byte-level tokenizers file, special strings being ordinary text: one for the
    whole pattern, and one without look-ahead for texts in which no two blanks meet."""
    tok = Tokenizer.from_file(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values() if t.special}
    back = unicode_bytes()
    ranks = {bytes(map(back.__getitem__, word)): i for word, i in tok.get_vocab().items() if word not in special}
    pattern = public_tokenizers.PATTERN
    return [tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for name, p in (("full", pattern), ("plain", pattern.replace(BLANKS_THEN_WORD, "")))]


@lru_cache(maxsize=2)
def added_ids(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file and their ids."""
    added = Tokenizer.from_file(path).get_added_tokens_decoder()
    if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
        raise ValueError("added tokens that take in what is around them are not handled")
    return {t.content: i for i, t in added.items()}


def encoder(path: str, added_tokens: bool = False):
    """text -> ids of the tokenizers file, as its own encode has them without the tokens around a text."""
    full, plain = fast_encoders(path)
    added = added_ids(path) if added_tokens else {}

    def ordinary(text):
        return (full if TWO_BLANKS.search(text) else plain)(text)

    if not added:
        return ordinary
    parts_of = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text):
        parts = parts_of.split(text)  # every second part is an added token
        if len(parts) == 1:
            return ordinary(text)
        return [i for k, part in enumerate(parts) for i in ([added[part]] if k % 2 else ordinary(part))]

    return encode


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """start, length of the pieces of n tokens: full ones, the first taking what is over."""
    first = n % size or size
    return [(0, min(first, n))] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, path: str, size: int = SIZE, closing: int = CLOSING, with_ids: bool = False,
           added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document's pieces."""
    def run(batches):
        encode = encoder(path, added_tokens)
        for b in batches:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = np.array(encode(text or "") + [closing], "<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start:4 * (start + length)]
                    for name, value in zip(out, (doc, k, start, length, zlib.crc32(part), part)):
                        out[name].append(value)
            frame = pd.DataFrame(out).astype({"piece": "int32"})
            frame["doc_id"] = pd.Series(out["doc_id"], dtype=b["doc_id"].dtype)
            yield frame if with_ids else frame.drop(columns="ids")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def patterns(size: int, present: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths a <= b <= c with a + b + c = size, zeros first, only lengths that are present."""
    here = np.flatnonzero(present)
    here = here[(here > 0) & (here <= size)]
    a, b = (x.ravel() for x in np.meshgrid(np.concatenate([[0], here]), np.concatenate([[0], here]), indexing="ij"))
    c = size - a - b
    ok = (a <= b) & (b <= c) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    return np.column_stack([a, b, c])[present[c] > 0]


def least_squares(rows: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x minimising the squared misfit of lengths used and lengths there, long lengths
    weighing more, by accelerated projected gradients on the sparse pattern matrix."""
    size = len(histogram) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0

    def used(x):
        return sum(np.bincount(rows[:, k], x, size + 1) for k in range(3)) * weight

    def back(r):
        r = r * weight
        return r[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(30):
        v = back(used(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(np.linalg.norm(back(used(v))) * 1.05, 1e-9)
    target, x, y, t = histogram * weight, np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(used(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]) using up the histogram (index: length, 0 unused) exactly."""
    left = np.asarray(histogram, np.int64).copy()
    left[0] = 0
    out = []

    def take(slots: list[tuple[int, int]], most: int | None = None) -> None:
        n = int(min(left[length] // times for length, times in slots))
        n = n if most is None else min(n, most)
        if n > 0:
            out.append((n, slots))
            for length, times in slots:
                left[length] -= n * times

    def slots_of(lengths) -> list[tuple[int, int]]:
        values, times = np.unique([x for x in lengths if x], return_counts=True)
        return list(zip(values[::-1].tolist(), times[::-1].tolist()))

    rows = patterns(size, left)
    if len(rows):
        x = least_squares(rows, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            take(slots_of(rows[i]), int(x[i]))
    while (here := np.flatnonzero(left)).size:  # best fit: the longest left, then always the longest that still fits
        free, slots, at = size, [], here[-1]
        while True:
            times = int(min(free // at, left[at]))
            slots.append((int(at), times))
            free -= times * int(at)
            fits = here[(here <= free) & (here < at)]
            if not len(fits):
                break
            at = fits[-1]
        take(slots)
    return out


def place(cut_up: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces (staged, with length) with sequence_id and offset."""
    counts = cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = np.zeros(size + 1, np.int64), 0
    for repeats, parts in plan(histogram, size):
        offset = 0
        for length, times in parts:
            slots.setdefault(length, []).append((int(used[length]), times, sequence, offset))
            used[length] += repeats * times
            offset += length * times
        sequence += repeats
    table = {length: np.array(rows, np.int64).T for length, rows in slots.items()}
    ranked = rank_rows(cut_up, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "__rank")

    def run(batches):
        for b in batches:
            where = np.zeros((2, len(b)), np.int64)
            for length, at in b.groupby("length").indices.items():
                first, times, base, offset = table[length]
                rank = b["__rank"].to_numpy()[at]
                i = np.searchsorted(first, rank, "right") - 1
                nth, slot = np.divmod(rank - first[i], times[i])
                where[:, at] = base[i] + nth, offset[i] + slot * length
            yield b.drop(columns="__rank").assign(sequence_id=where[0], offset=where[1])

    kind = cut_up.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInPandas(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, size: int = SIZE, closing: int = CLOSING, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place(stage(pieces(docs, path, size, closing, added_tokens=added_tokens)), size)
