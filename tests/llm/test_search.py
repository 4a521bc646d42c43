"""Hard negatives, SentencePiece chunks and ranked search: op11, op12, op13."""

import hashlib
import math
import random
import re
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from depthlog.llm import chunk_pieces, hard_negatives, queries, treap_search

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_four_russians", "op13_treap_search"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})")
    want = sorted(res.fetchall())
    assert want and sorted(map(tuple, df.collect())) == want


# --- op11 ----------------------------------------------------------------------------------

def plain_negatives(rows, every=50):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        ok[i] = min(ok.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in ok.items():
        if a % every:
            continue
        scored = sorted((-dot(q, r), i, l) for i, (l, r) in ok.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(i, -m) for m, i, l in scored if l != label and 50 * -minus <= 100 * -m <= 95 * -minus]
            out += [(a, p, rank, i, -minus, s) for rank, (i, s) in enumerate(inside[:3], 1)]
    return sorted(out)


def mined(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, block string")
    return sorted(map(tuple, hard_negatives.mine(df, **kwargs).collect()))


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=11) + 1).tolist(), int(rng.integers(0, 3)) if i % 3 else 7) for i in range(400)]
    rows += [(i, [1.0] * 11, i % 4) for i in range(400, 520)]  # copies: ties everywhere
    rows += [(-50, [-1.5] * 11, 1), (1000, [-0.001, 3.7], 2), (1050, [], 1), (1100, [1.0], None), (None, [1.0] * 11, 1), (1150, None, 1),
             (1200, [1.0, None], 1), (1250, [float("nan")] * 11, 1), (1300, [float("inf")] * 11, 1), (1350, [2.0] * 11, 99),
             (50, [9.0] * 11, 0), (50, [9.0] * 11, 0), (1400, [-20000.5] * 11, 3), (1401, [-10000.5] * 11, 3), (1402, [-9000.0] * 11, 0)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and len(got) > 50


def test_negatives_of_little(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1)]) == []
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark, [(0, [1e17], 1), (1, [1.0], 1)])


def test_lookups_give_inner_products():
    rng = np.random.default_rng(0)
    a, c = rng.integers(-300, 300, (5, 24)), rng.integers(-512, 512, (700, 24))
    planes = hard_negatives.planes_of(c, 10)
    assert planes.shape == (10, 700, 3) and (hard_negatives.scores(planes, hard_negatives.subset_sums(a, np.int32)) == c @ a.T).all()


# --- op12 ----------------------------------------------------------------------------------

TEXTS = [None, "", " ", "  ", "a", " a", "a ", "  two  blanks ", "▁", "▁a▁▁b", "line\nfeeds\n\n and\ttabs \r\n", "\x00nul \x00", "<s> </s> <unk> <0x41>",
         "中文没有空格" * 50, "ﬁ ﾊﾝｶｸ é é ​  x", "word " * 3000, "x" * 70_000, "🙂 🙂🙂", "Hello Hello hello", " leading", "a" * 65 + " " + "b" * 64]


@pytest.mark.parametrize("bounds", [{}, {"table_rows": 3}, {"table_rows": 0}])
def test_chunks_equal_the_library(spark, docs, bounds):
    rng = random.Random(1)
    letters = ["a", "b", "é", " ", " ", "  ", "\n", "▁", "the", "中", "𝄞", ".", "'", "\t"]
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = docs(list(enumerate(texts)) + [(None, "no id"), (None, "no id")])
    got = {r.doc_id: r for r in chunk_pieces.digest(table, MODEL, **bounds).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, t
    assert chunk_pieces.digest(table, MODEL).filter("doc_id IS NULL").count() == 2


def test_chunks_round_trip_and_nothing(spark, docs):
    encoded = chunk_pieces.encode(docs([(1, "plain words here"), (2, None)]), MODEL)
    assert {r.doc_id: r.text for r in chunk_pieces.decode(encoded, MODEL).collect()} == {1: "plain words here", 2: ""}
    assert chunk_pieces.digest(docs([]), MODEL).count() == 0


def test_table_holds_the_most_frequent_chunks(spark, docs):
    table = docs([(i, "often often now " + f"rare{i}") for i in range(40)])
    held = chunk_pieces.chunk_table(table, MODEL, table_rows=2)
    assert {r.chunk for r in held.collect()} == {"often", "now"}


# --- op13 ----------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k=20):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in plain_terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, d if there else None, -s) for rank, (s, there, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(rows):
    return sorted(((-1 if r[0] is None else r[0]), r[1], (-1 if r[2] is None else r[2]), r[3]) for r in rows)


@pytest.mark.parametrize("table_rows", [1000, 0])
def test_ranking_equals_brute_force(spark, docs, monkeypatch, table_rows):
    monkeypatch.setattr(treap_search, "BLOCK_DOCS", 16)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "ABC", "abc", "中文", "x_y", "a-b"]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.7 else words[int(rng.random() ** 3 * 20)] for _ in range(n))
    rows = [(i, text(rng.randrange(1, 40))) for i in range(150)] + [(i, "Same copy of w1 w2 w3") for i in range(500, 580)]
    rows += [(None, "w1 w2"), (None, "w1 w2"), (7, "w5 w5 w5"), (900, None), (901, ""), (902, " .,-"), (903, "w9 " * 30_000), (-4, "w1 w2 w3")]
    items = [(i, text(12)) for i in range(9)] + [(20, "w1 w2 w3"), (21, "nothing known"), (22, None), (23, ""), (None, "w4 w4 w4 ABC abc"), (24, "w0 " * 5000)]
    table = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, term string")
    got = [tuple(r) for r in treap_search.search(docs(rows), table, table_rows=table_rows).select("item_id", "rank", "doc_id", "score").collect()]
    assert key(got) == key(plain_ranking(rows, items))


def test_ranking_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap_search.search(docs([]), items).count() == 0
    assert treap_search.search(docs([(1, "a")]), items.limit(0)).count() == 0


def test_treap_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    for n_rows, n_cols in ((1, 1), (5, 40), (70, 9)):
        grid = rng.integers(0, 50, (n_rows, n_cols)) * (rng.random((n_rows, n_cols)) < 0.4)
        grid[0, 0] = 3
        r, c = np.nonzero(grid)
        levels = max(1, int(max(n_rows, n_cols) - 1).bit_length())
        treap = treap_search.Treap(*treap_search.build(r, c, grid[r, c], levels), levels)
        for _ in range(20):
            rows = rng.choice(n_rows, min(n_rows, 6), replace=False)
            weights = rng.integers(1, 9, len(rows))
            sums = weights @ grid[rows]
            want = sorted((-s, i) for i, s in enumerate(sums) if s > 0)[:4]
            cols, scores = treap.search(rows, weights, 4)
            assert list(zip(-scores, cols)) == want
