"""Operators on texts against plain versions: op1, op2, op5, op7, op8."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from depthlog.llm import classifier, packing, queries, quotes, tree_bpe, weak_rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, ""), (2, None), (3, "one"), (4, "  \n \t "), (5, "a  b\n\n c  d 'll 're don't 12 3456 ..!? \U0001f600 été"), (5, "again"),
       (6, "x" * 500), (7, " ".join(f"w{i}" for i in range(400))), (8, "<|endoftext|> and more"), (None, "no id"), (3, "one")]


# --- op7 -----------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 'slt.\n\t1é中 \U0001f600", max_size=120), st.integers(1, 9))
def test_halves_give_the_ids_of_the_whole(text, leaf):
    c = tree_bpe.codec(RANKS)
    assert c.encode(text, leaf) == c.full.encode_ordinary(text)
    assert c.decode(c.encode(text, leaf)).decode() == text


def test_windows_grow_over_a_text_without_seams():
    c = tree_bpe.codec(RANKS)
    for text in ("x" * 5000, " " * 3000, "ab\n" * 2000, "中" * 1500):
        assert c.encode(text, 700) == c.full.encode_ordinary(text)


def test_most_texts_are_joined_from_leaves(monkeypatch):
    joins = []
    real = tree_bpe.Codec.joined
    monkeypatch.setattr(tree_bpe.Codec, "joined", lambda self, a, b: joins.append(1) or real(self, a, b))
    c = tree_bpe.codec(RANKS)
    for text in ("plain words in a row " * 60, "中文字，" * 400, "x;\n" * 400):
        joins.clear()
        assert c.encode(text) == c.full.encode_ordinary(text) and len(joins) >= 1
    assert c.decode(list(range(3000)) * 5) == b"".join(c.bytes[i] for i in range(3000)) * 5


def test_encoding_over_tasks(docs):
    long = " ".join(random.Random(1).choice(["alpha", "beta,", "x\ny", "12"]) for _ in range(3000))
    rows = ODD + [(9, long), (9, "z" * 900), (10, long + "  " + long)]
    got = tree_bpe.digest(tree_bpe.encode(docs(rows), RANKS, task_chars=700), RANKS).collect()
    full = tree_bpe.codec(RANKS).full

    def plain(i, t):
        ids = full.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((t or "").encode()).hexdigest())

    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(*r)) for r in rows)
    assert tree_bpe.encode(docs([]), RANKS).count() == 0


def test_decoding_is_the_inverse(docs):
    back = tree_bpe.decode(tree_bpe.encode(docs(ODD), RANKS), RANKS, "doc_id").collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in ODD)


# --- op8 -----------------------------------------------------------------------------------

def test_packing_places_every_piece_once(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    rng = random.Random(2)
    rows = ODD + [(100 + i, " ".join(rng.choice(["the", "cat", "sat.", "Zebra"]) for _ in range(rng.choice([3, 30, 70])))) for i in range(150)]
    size = 64
    got = packing.pack(docs(rows), JSON, size).collect()
    plain = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), size)):
            plain.append((i, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
    assert sorted(map(str, plain)) == sorted(str(tuple(r)[:5]) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    bins = []
    for n in sorted((p[3] for p in plain), reverse=True):  # first fit, longest first
        i = next((i for i, free in enumerate(bins) if free >= n), len(bins))
        bins[i:i + 1] = [(bins[i] if i < len(bins) else size) - n]
    assert len(sequences) <= len(bins)
    assert packing.pack(docs([]), JSON, size).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plans_use_up_any_histogram(lengths):
    histogram = np.bincount(lengths, minlength=33)
    used = np.zeros(33, int)
    for repeats, parts in packing.plan(histogram, 32):
        assert sum(length * times for length, times in parts) <= 32
        for length, times in parts:
            used[length] += repeats * times
    assert (used[1:] == histogram[1:]).all()


def test_added_tokens_get_their_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(JSON)
    mark = "<|endoftext|>"
    rows = ODD + [(20, mark), (21, mark * 3), (22, f"a  {mark}  b\n{mark}\n\n"), (23, f"{mark[:-1]} {mark}{mark[1:]} it{mark}'ll"), (24, mark.upper())]
    want = sorted(str((i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()))) for i, t in rows)
    assert tok.encode(rows[8][1], add_special_tokens=False).ids == [50256, 290, 517]
    got = packing.pack(docs(rows), JSON, added_tokens=True).collect()
    assert sorted(str((r.doc_id, r.ids_crc32)) for r in got) == want
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.QUERIES["op8_pattern_packing"](spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, docs(rows), str(tmp_path))):
        assert sorted(str((r.doc_id, r.ids_crc32)) for r in out.collect()) == want


def test_pieces_can_carry_their_ids(docs):
    rows = packing.pieces(docs([(1, "hello world")]), JSON, with_ids=True).collect()
    assert zlib.crc32(bytes(rows[0].ids)) == rows[0].ids_crc32 and rows[0].length == 3


# --- op5 -----------------------------------------------------------------------------------

def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_of_weak_rules(docs):
    rows = ODD + [(20, "a b c d e f g h " * 5), (21, "r " * 40), (22, "l1\nl1\n\n \nl2\r\nl1"), (23, "# * x|y <b> é&")]
    rows += [(24, " ".join(f"w{i % 23}" for i in range(90)) + " \x0b\x0c end")]
    got = weak_rules.judge(docs(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    plain = [(i, *counts(t)) for i, t in rows]
    assert sorted(map(str, plain)) == sorted(str(tuple(r)[:6]) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert weak_rules.judge(docs([])).count() == 0


def test_the_posterior_finds_junk_and_keeps_prose(docs):
    rng = random.Random(3)
    prose = ["river", "stone", "walks", "the", "of", "under", "light", "morning", "and", "quiet", "harbour", "wind"]
    good = [(i, " ".join(rng.choice(prose) + rng.choice(["", "", "", ".", ","]) for _ in range(150))) for i in range(60)]
    junk = [(100 + i, " ".join(rng.choice(prose) + "###$" for _ in range(150))) for i in range(6)]
    kept = {r.doc_id for r in weak_rules.judge(docs(good + junk)).filter("kept").collect()}
    assert kept == set(range(60))


def test_weak_rules_are_native(docs):
    plan = weak_rules.judge(docs(ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# --- op2 -----------------------------------------------------------------------------------

def test_classifier_on_held_out_rows(docs, spark):
    rng = random.Random(4)
    words = ["river", "stone", "walks", "the", "of", "under", "light"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)) + "." if i % 4 else "JUNK!! " * 60) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)] + [(0, 0, 0), (None, 1, 0), (5, None, 0), (6, 7, 1)],
                                   "doc_id long, quality int, toxic int")
    rows += [(900, ""), (901, None), (None, "no id here"), (1, rows[1][1])]
    got = classifier.score_documents(docs(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20 and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)


def test_classifier_without_labels(docs, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in classifier.score_documents(docs([(1, "a")]), empty).collect()] == [0.5]
    assert classifier.score_documents(docs([]), empty).count() == 0


def test_pooling_of_adjacent_violators():
    x, y = classifier.pool_adjacent(np.array([0., 1, 2, 3]), np.array([0., 3, 1, 4]), np.array([4., 4, 4, 4]))
    assert list(y) == sorted(y) and list(y) == [0, 0.5, 1]
    assert list(x) == [0, 1.5, 3]


# --- op1 -----------------------------------------------------------------------------------

def threads(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, own string")
    return {(r.conv_id, r.turn): r for r in quotes.threads(df).collect()}


def test_parsing_of_nested_quotes():
    own, quoted, _ = quotes.parse("Hi\nOn Monday, A wrote:\n> first  Line\n> second\n>> deep\n> > deep too\nReply\n")
    assert own == "Hi\nReply"
    assert [q[0] for q in quoted] == [1, 2]
    assert quoted[0][1] == quotes.mark("first line second") and quoted[1][1] == quotes.mark("deep deep too")
    assert quotes.parse(None) == ("", [], []) and quotes.parse(">\n> \n") == ("", [], [])


def test_replies_follow_their_quotes(spark):
    got = threads(spark, [
        (1, 0, "user", "Where is it?"), (1, 1, "assistant", "Here.\nAnd there."), (1, 2, "user", "> where is it?\n\nTell me"),
        (1, 3, "user", "> and there.\nWhy?"), (2, 0, "user", "> Here.\n> And there.\nseen elsewhere"), (2, 1, "user", ""), (2, 2, "user", None)])
    assert {k: r.parent_turn for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (2, 0): None, (2, 1): 0, (2, 2): 1}
    assert [got[1, t].place for t in range(4)] == [0, 1, 2, 3] and [got[1, t].depth for t in range(4)] == [0, 1, 1, 2]
    assert got[1, 2].own == "Tell me" and got[1, 2].chat == "<|im_start|>user\nTell me<|im_end|>"
    assert got[2, 0].n_origins == 1 and not got[2, 0].linked and got[2, 0].own == "seen elsewhere"


def test_conversations_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "a"), (None, 1, "user", "a"), (3, 5, "user", "> a\nb")],
                               "conv_id long, turn long, role string, text string")
    got = quotes.threads(df).collect()
    assert len(got) == 4 and sorted(r.place for r in got if r.conv_id is None) == [0, 1, 2]
    assert quotes.threads(df.limit(0)).count() == 0


def test_long_reply_chains_are_climbed(spark):
    got = threads(spark, [(1, t, "user", f"message number {t}" + (f"\n> message number {t - 1}" if t else "")) for t in range(70)])
    assert got[1, 69].depth == 69 and got[1, 69].thread_turn == 0


def test_mail_view_quotes_two_back(spark):
    df = spark.createDataFrame([(1, 0, "u", "a\nb"), (1, 1, "v", "c"), (1, 2, "u", "d")], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.text for r in quotes.as_mail(df).collect()}
    assert got == {0: "a\nb", 1: "> a\n> b\nc", 2: "> > a\n> c\nd"}


def test_answers_quote_further_back(spark):
    long = "one two three four five six seven eight nine ten eleven\nsecond"
    df = spark.createDataFrame([(1, 0, "u", long), (1, 1, "v", "c\nd"), (1, 2, "u", "e"), (1, 3, "v", "f"), (1, 4, "u", None)],
                               "conv_id long, turn long, role string, text string")
    got = {r.turn: r.text for r in quotes.as_answers(df).collect()}
    wrapped = "> one two three four five six seven eight nine\n> ten eleven\n> second"
    assert got[0] == long and got[1] == f"{wrapped}\nc\nd" and got[3] == "> > " + long.replace("\n", "\n> > ") + "\n> c\nf"
    assert got[2] == "> > " + long.replace("\n", "\n> > ") + "\n> c\n> d\ne" and got[4] == "> > c\n> > d\n> e"


def test_links_decide_the_query(spark, monkeypatch):
    import duckdb
    from depthlog.llm import queries
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")

    def rows():
        df = queries.QUERIES["op1_quotation_links"](spark, "/root/testdata/sf0.001")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op1_quotation_links']})").fetchall()
        return sorted(map(str, map(tuple, df.collect()))), sorted(map(str, want))
    got, want = rows()
    assert got == want
    real = quotes.origins
    monkeypatch.setattr(quotes, "origins", lambda r: real(r).limit(0))
    got, want = rows()
    assert got != want


@pytest.mark.parametrize("name", ["op2", "op5", "op7", "op8"])
def test_text_queries_cover_all_documents(spark, name):
    from depthlog.llm import queries
    full = next(k for k in queries.QUERIES if k.startswith(name + "_"))
    out = queries.QUERIES[full](spark, "/root/testdata/sf0.001")
    assert out.select("doc_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert not out.filter(F.col("doc_id").isNull()).count()
