"""Exact substring dedup: every byte covered by a LENGTH-byte string that also starts earlier is removed.

The suffixes are compared through a difference cover that the content defines. A periodic cover (every first and
second of three positions) sorts two thirds of all bytes as rows, several times; here a window of LENGTH bytes is
represented by the smallest of its GRAM-byte grams (the last one of equals). Equal windows choose the same gram at the
same distance, which is the property a difference cover is for: at that distance both have a sampled position. About
one byte in 39 is sampled.

1. The sampled triples (gram, context, position) are sorted. The context of a sampled position is the string under all
   windows that it represents; its hash is the position's name. Positions with an equal name have equal windows all
   over, so all but the first are repeats; grams found once can have no repeats. Both are settled here.
2. What is left, first positions of names that share a gram with other names, recurs on longer strings: the contexts
   themselves. They are sorted from the gram to the right and from the gram to the left; the longest common prefixes
   of neighbours in both orders tell which windows can be shared at all.
3. Those remaining windows are merged in order of position, and one that was there before is a repeat.

Grams with very many names (above LIMIT) are not held together: each of their windows becomes a row and the first one
of equals is found by partial minima. Repeats met inside one batch are settled there, so copies of a hot text are not
sent to one task. Texts are sent to their repeats once for contexts and once for the cut, by doc_id.

Documents are ordered by doc_id, then, where rows of one doc_id differ, by a hash of the text. Defined cases: null and
empty texts have no bytes; rows with one doc_id and one text are one document and get one result; a null doc_id comes
before all others; an empty table gives an empty result; extra columns are kept by `clean` and never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from depthlog.operators.staging import stage

LENGTH, GRAM, LIMIT = 100, 24, 50_000
SLICE = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
KEY = ["some", "id", "text_hash"]


def key_columns(docs: DataFrame) -> list[Column]:
    """some (0: null id), id, text_hash (0 unless rows of one doc_id differ)."""
    kind = docs.schema["doc_id"].dataType
    some = F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    key = [some, F.coalesce("doc_id", F.lit(0).cast(kind)), F.xxhash64("text")]
    clash = (docs.select(*[c.alias(k) for c, k in zip(key, KEY)]).groupBy("some", "id")
             .agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).filter("a <> b"))
    return key if clash.limit(1).count() else [*key[:2], F.lit(0).cast("bigint")]


def keyed(docs: DataFrame, key: list[Column]) -> DataFrame:
    """KEY and text of the documents."""
    return docs.select(*[c.alias(k) for c, k in zip(key, KEY)], "text")


# --- sampled positions ---------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the `size` bytes from each position on, put together from hashes of halves."""
    part = mixed((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    width, whole, done = 1, None, 0
    while size:
        if size & 1:
            if whole is None:
                whole, done = part, width
            else:
                n = len(part) - done
                whole = mixed(whole[:n] * np.uint64(0x2545F4914F6CDD1D) + part[done:done + n])
                done += width
        size >>= 1
        if size:
            n = len(part) - width
            part = mixed(part[:n] * np.uint64(0x2545F4914F6CDD1D) + part[width:width + n])
            width *= 2
    return whole


def sampled(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first window, windows, distance from the first window to the gram, gram hash of each sampled position."""
    n = len(raw) - LENGTH + 1
    grams = gram_hashes(raw)[:len(raw) - GRAM + 1]
    least = (grams & ~PLACE) | (PLACE - np.arange(len(grams), dtype=np.uint64))
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:width - span], least[span - width:])
    at = (PLACE - (least[:n] & PLACE)).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return starts, np.diff(np.append(starts, n)), at[starts] - starts, grams[at[starts]]


def in_parts(batch: pd.DataFrame, chars: int = 1 << 22):
    """Rows in a row with about `chars` characters of text."""
    number = np.cumsum([len(t or "") for t in batch["text"]]) // chars
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(batch)]
    return (batch.iloc[a:z] for a, z in zip(cuts, cuts[1:]) if z > a)


NAMES = ["settled", "gram", "name", *KEY, "start", "windows", "distance"]


def samples(batches):
    """Rows of NAMES; settled rows are repeats of a row of the same part of a batch, under a gram of their own."""
    for b in (part for whole in batches for part in in_parts(whole)):
        parts = []
        for k, text in enumerate(b["text"]):
            data = (text or "").encode("utf-8", "replace")
            for base in range(0, max(0, len(data) - LENGTH + 1), SLICE):
                piece = data[base:base + SLICE + LENGTH - 1]
                start, windows, distance, gram = sampled(np.frombuffer(piece, np.uint8))
                name = [xxhash.xxh3_64_intdigest(piece[s:s + n + LENGTH - 1]) for s, n in zip(start.tolist(), windows.tolist())]
                parts.append((np.full(len(start), k), gram.view(np.int64), np.array(name, np.uint64).view(np.int64),
                              start + base, windows, distance))
        if not parts:
            continue
        row, gram, name, start, windows, distance = (np.concatenate(x) for x in zip(*parts))
        out = pd.DataFrame({"settled": False, "gram": gram, "name": name, **{c: b[c].to_numpy()[row] for c in KEY},
                            "start": start, "windows": windows, "distance": distance})
        twice = out.duplicated(["gram", "name"], keep=False).to_numpy()
        if twice.any():
            again = out[twice].sort_values(["gram", "name", *KEY, "start"], kind="stable")
            again = again.assign(settled=again.duplicated(["gram", "name"]))
            spread = mixed((again["name"].to_numpy() + again["start"].to_numpy()).view(np.uint64)).view(np.int64)
            again["gram"] = np.where(again["settled"], spread, again["gram"])
            out = pd.concat([out[~twice], again], ignore_index=True)
        yield out


def settle(batches):
    """From rows sorted by gram, name and position: repeats (settled) and first positions of names whose gram has
    several (not settled). Holds one pending row across batches."""
    held = last = None  # last: gram, name, and whether an earlier name of the gram went before it
    for b in batches:
        done = b[b["settled"]]
        if len(done):
            yield done
        b = b[~b["settled"]]
        if not len(b):
            continue
        gram, name = b["gram"].to_numpy(), b["name"].to_numpy()
        before_gram = np.concatenate([[gram[0] if last is None else last[0]], gram[:-1]])
        before_name = np.concatenate([[name[0] if last is None else last[1]], name[:-1]])
        new_gram, new_name = gram != before_gram, name != before_name
        if last is None:
            new_gram[0] = True
        first = new_gram | new_name
        last = gram[-1], name[-1]
        yield b[~first].assign(settled=True)
        firsts = b[first]
        if not len(firsts):
            continue
        firsts = firsts if held is None else pd.concat([held, firsts], ignore_index=True)
        g = firsts["gram"].to_numpy()
        same = g[1:] == g[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if held is not None and held_several:
            several[0] = True
        held, held_several = firsts.iloc[-1:], bool(several[-1])
        yield firsts[:-1][several[:-1]]
    if held is not None and held_several:
        yield held


# --- contexts ------------------------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def longest_shared(strings: list[bytes]) -> list[int]:
    """For each string the longest prefix that it has in common with another one: that of a neighbour in order."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for a, b in zip(order, order[1:]):
        n = common(strings[a], strings[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def merged(contexts: list[bytes], distances: list[int], windows: list[int]):
    """index, first window, number of windows: runs of windows that were in an earlier context of one gram, the
    contexts being in order of position."""
    right = longest_shared([c[d + GRAM:] for c, d in zip(contexts, distances)])
    left = longest_shared([c[:d][::-1] for c, d in zip(contexts, distances)])
    seen: set[bytes] = set()
    for i, (c, d, n) in enumerate(zip(contexts, distances, windows)):
        run = 0
        low, high = max(0, d - left[i]), min(n, right[i] - (LENGTH - GRAM) + d + 1)
        for j in range(low, high):
            w = c[j:j + LENGTH]
            if w in seen:
                run += 1
                continue
            seen.add(w)
            if run:
                yield i, j - run, run
                run = 0
        if run:
            yield i, high - run, run


def spans_schema(kind: str) -> str:
    return f"some int, id {kind}, text_hash bigint, start bigint, windows bigint"


def contexts_of(texts: DataFrame, open_rows: DataFrame, kind: str) -> DataFrame:
    """gram, KEY, start, windows, distance, context of the open rows: their texts are cut where they are."""
    asked = open_rows.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "start", "windows", "distance")).alias("asked"))

    def cut(batches):
        for b in batches:
            rows = []
            for some, doc, mark, text, asked in zip(b["some"], b["id"], b["text_hash"], b["text"], b["asked"]):
                data = (text or "").encode("utf-8", "replace")
                for a in asked:
                    s, n = a["start"], a["windows"]
                    rows.append((a["gram"], some, doc, mark, s, n, a["distance"], data[s:s + n + LENGTH - 1]))
            if rows:
                yield pd.DataFrame(rows, columns=["gram", *KEY, "start", "windows", "distance", "context"])

    return texts.join(asked, KEY).select(*KEY, "text", "asked").mapInPandas(
        cut, f"gram bigint, some int, id {kind}, text_hash bigint, start bigint, windows bigint, distance bigint, context binary")


def compared(contexts: DataFrame, kind: str) -> DataFrame:
    """Repeats among the contexts of one gram, of which there are at most LIMIT."""
    columns = [*KEY, "start", "windows"]

    def run(batches):
        held, gram = [], None

        def finish():
            for i, first, n in merged([r.context for r in held], [r.distance for r in held], [r.windows for r in held]):
                r = held[i]
                yield r.some, r.id, r.text_hash, r.start + first, n

        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.gram != gram:
                    rows.extend(finish())
                    held, gram = [], r.gram
                held.append(r)
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        rows = list(finish())
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return contexts.repartition("gram").sortWithinPartitions("gram", *KEY, "start").mapInPandas(run, spans_schema(kind))


def exploded(contexts: DataFrame, kind: str) -> DataFrame:
    """Repeats among the windows of very common grams, a row for each window."""
    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"window": [xxhash.xxh3_128_digest(r.context[j:j + LENGTH]) for j in range(r.windows)],
                                    "some": r.some, "id": r.id, "text_hash": r.text_hash,
                                    "start": np.arange(r.start, r.start + r.windows), "windows": 1})

    rows = contexts.mapInPandas(run, "window binary, " + spans_schema(kind))
    place = F.struct(*KEY, "start")
    first = rows.groupBy("window").agg(F.min(place).alias("first"))
    return rows.join(first, "window").filter(place > F.col("first")).select(*KEY, "start", "windows")


def repeats(texts: DataFrame) -> DataFrame:
    """KEY, spans: array of (start, windows) whose windows all start earlier somewhere; texts as made by `keyed`."""
    kind = texts.schema["id"].dataType.simpleString()
    schema = (f"settled boolean, gram bigint, name bigint, some int, id {kind}, text_hash bigint, "
              "start bigint, windows bigint, distance bigint")
    sorted_triples = (texts.mapInPandas(samples, schema).repartition("gram")
                      .sortWithinPartitions("gram", "name", *KEY, "start"))
    rows = stage(sorted_triples.mapInPandas(settle, schema).drop("name"))
    still_open = rows.filter(~F.col("settled")).select("gram", *KEY, "start", "windows", "distance")
    common_grams = stage(still_open.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > LIMIT).select("gram"))
    found = rows.filter("settled").select(*KEY, "start", "windows")
    if common_grams.limit(1).count():
        found = found.unionByName(exploded(contexts_of(texts, still_open.join(common_grams, "gram", "left_semi"), kind), kind))
        still_open = still_open.join(common_grams, "gram", "left_anti")
    found = found.unionByName(compared(contexts_of(texts, still_open, kind), kind))
    return found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def kept_bytes(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed."""
    if spans is None or not len(spans):
        return data, 0, 0
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for start, n in sorted((s["start"], s["windows"]) for s in spans):
        stop = start + n + LENGTH - 1
        if start > end:
            kept.append(data[at:start])
            runs += 1
        removed += stop - max(start, at)
        at = end = max(end, stop)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts = keyed(docs, key_columns(docs))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for some, doc, text, spans in zip(b["some"], b["id"], b["text"], b["spans"]):
                data = (text or "").encode("utf-8", "replace")
                kept, removed, runs = kept_bytes(data, spans)
                rows.append((some, doc, len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["some", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = texts.join(repeats(texts), KEY, "left").select("some", "id", "text", "spans").mapInPandas(
        run, f"some int, id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.select(F.when(F.col("some") == 1, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pandas_udf(StringType())
def without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The text that is left; of a character cut through nothing stays."""
    return pd.Series([t if t is None or s is None else kept_bytes(t.encode("utf-8", "replace"), s)[0].decode("utf-8", "ignore")
                      for t, s in zip(texts, spans)], dtype=object)


def clean(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, without repeated bytes; n_chars, where there is one, follows the text."""
    key = key_columns(docs)
    found = repeats(keyed(docs, key)).select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("spans").alias("__spans"))
    here = docs.withColumns({f"__here_{k}": c for c, k in zip(key, KEY)})
    joined = here.join(found, [F.col(f"__here_{k}") == F.col(f"__{k}") for k in KEY], "left")
    out = joined.withColumn("text", without_spans("text", "__spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
