"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations,
isotonic calibration.

Input: documents with an id and a text, labels with an id and `quality` (1 good, 0 bad). Defined cases: a null or
empty text has statistics zero and is scored like any other; a repeated row is scored each time; labels that are null
or neither 0 nor 1 are ignored, and an id labelled more than once counts once with its smallest label; without any
usable label the score is 0.5; extra columns are never read. Only texts enter a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from depthlog.operators.staging import stage

STATS = ("log_bytes", "log_words", "word_bytes", "word_bytes_spread", "distinct_words", "commonest_word",
         "equal_neighbours", "distinct_pairs", "log_lines", "repeated_lines", "upper", "digits", "blanks", "stops",
         "exclamations", "symbols", "bars", "other_marks", "beyond_ascii", "short_words", "long_words")
MAX_ROWS = 400_000  # labelled rows that a fit sees
BYTES = [set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"0123456789"), set(b" \t\n\r\v\f"), set(b".,;:"), set(b"!?"),
         set(b"#*$%&<>"), set(b"|"), set(b"\"'()[]{}-_/\\@+=~^`"), set(range(128, 256))]
CLASSES = np.array([[float(b in group) for group in BYTES] for b in range(256)])


def text_stats(text: str | None) -> list[float]:
    """The numbers of one whole text, in the order of STATS."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, size = text.split(), max(len(raw), 1)
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counts = Counter(words)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / size
    return [np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), len(counts) / n,
            max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
            len(set(zip(words, words[1:]))) / n, np.log1p(len(lines)),
            (len(lines) - len(set(lines))) / max(len(lines), 1), *shares,
            (lengths <= 2).mean(), (lengths >= 16).mean()]


def stats_matrix(texts) -> np.ndarray:
    return np.array([text_stats(t) for t in texts], float).reshape(-1, len(STATS))


@pandas_udf(ArrayType(DoubleType()))
def stats_column(texts: pd.Series) -> pd.Series:
    return pd.Series(list(stats_matrix(texts)))


@dataclass(frozen=True)
class Model:
    """A fitted model of bounded size: (statistics + 1) x features numbers and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.features(part) @ self.weights for part in in_parts(stats)]])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.knots, self.levels)


def in_parts(rows: np.ndarray, size: int = 1024):
    """Some rows at a time: their features are far wider than their statistics."""
    return (rows[i:i + size] for i in range(0, len(rows), size))


def pool_adjacent(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of positives / counts over ascending x: centres and levels of the pooled blocks."""
    blocks: list[list[float]] = []  # positives, count, sum of x * count
    for at, p, c in zip(x, positives, counts):
        blocks.append([p, c, at * c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5: rows of fold 0 are held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def document_stats(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    return docs.select(*keep, stats_column(F.col(text)).alias("stats"))


def labelled(labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 7) -> DataFrame:
    """doc_id, y of the rows to fit: about `max_rows` at most, chosen by a hash of the id, none of fold 0."""
    known = (labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
             .filter(fold(F.col("doc_id")) != 0))
    share = min(1.0, max_rows / max(1, known.count()))
    return known.filter(F.abs(F.xxhash64("doc_id", F.lit(seed)) % 1_000_000) < int(share * 1_000_000))


def fit(stats: DataFrame, labels: DataFrame, features: int = 384, ridge: float = 1e-3, width: float = 0.6,
        max_rows: int = MAX_ROWS, seed: int = 7) -> Model:
    """Fit on labelled rows that are not held out; fold 1 calibrates, folds 2-4 give the ridge weights.

    stats: doc_id, stats. At most about `max_rows` labelled rows are used, chosen by a hash of the id; what reaches
    the driver is one row of moments, a features x features matrix and at most 4,001 calibration bins.
    """
    known = labelled(labels, max_rows, seed)
    train = stage(stats.join(known, "doc_id").select("y", fold(F.col("doc_id")).alias("fold"), "stats"))
    size = len(STATS)
    moments = train.select(*[f(F.col("stats")[i]) for i in range(size) for f in (F.avg, F.stddev_pop)]).first()
    nothing = np.zeros(0)
    if moments[0] is None:
        return Model(nothing, nothing, nothing, nothing, nothing, nothing, nothing)
    centre, scale = np.array(moments[::2]), np.array(moments[1::2])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    blank = Model(centre, scale, rng.normal(0, width / np.sqrt(size), (size, features)),
                  rng.uniform(0, 2 * np.pi, features), nothing, nothing, nothing)

    def sums(batches):
        """One row of X'[X y] per feature and partition."""
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            for part in in_parts(np.column_stack([np.vstack(b["stats"]), b["y"].to_numpy(float)])):
                x = blank.features(part[:, :-1])
                total += x.T @ np.column_stack([x, part[:, -1]])
        yield pd.DataFrame({"i": np.arange(len(total)), "part": [r.tobytes() for r in total]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p) for p in rows["part"]], axis=0)
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "part": [total.tobytes()]})

    weighed = train.filter("fold <> 1") if train.filter("fold <> 1").limit(1).count() else train
    parts = weighed.mapInPandas(sums, "i int, part binary").groupBy("i").applyInPandas(added, "i int, part binary")
    matrix = np.vstack([np.frombuffer(r.part) for r in parts.orderBy("i").collect()])
    gram = matrix[:, :-1] + ridge * max(matrix[-1, -2], 1.0) / features * np.eye(features + 1)
    weights = np.linalg.solve(gram, matrix[:, -1])
    unscaled = Model(centre, scale, blank.directions, blank.phases, weights, nothing, nothing)

    def binned(batches):
        for b in batches:
            raw = np.clip(unscaled.raw(np.vstack(b["stats"])), -1.5, 2.5)
            yield pd.DataFrame({"bin": np.rint(raw * 1000).astype(int), "y": b["y"].astype(int)})

    kept = train.filter("fold = 1") if train.filter("fold = 1").limit(1).count() else train
    bins = (kept.mapInPandas(binned, "bin int, y int").groupBy("bin")
            .agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas())
    knots, levels = pool_adjacent(bins["bin"].to_numpy() / 1000, bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    return Model(centre, scale, blank.directions, blank.phases, weights, knots, levels)


def score_stats(stats: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`keep`, score of rows with `stats`."""
    @pandas_udf(DoubleType())
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(s)) if len(s) else np.zeros(0))

    return stats.select(*keep, score("stats").alias("score"))


def text_score(model: Model):
    """A column function: the calibrated score of a text column, for filtering documents in place."""
    @pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(stats_matrix(texts)))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; statistics are computed once and staged."""
    stats = stage(document_stats(docs, "text", "doc_id"))
    scored = score_stats(stats, fit(stats, labels), "doc_id")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
