"""Archives, neighbours and the pipeline: op3, op4, pipeline."""

import hashlib

import numpy as np

import corpus_pipeline
from depthlog.llm import neighbours, warc


# --- op4 -----------------------------------------------------------------------------------

def archived(spark, tmp_path, rows, **kwargs):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archive(df, f"{tmp_path}/a", **kwargs)
    return f"{tmp_path}/a"


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 700 + " WARC/1.1\r\n\r\nWARC/1.1" + "z" * 3000
    rows = [(1, "http://a", big), (2, "http://b c\r\nWARC/1.1\r\n", big), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1"),
            (6, "u", "WARC/1.1\r\n" * 5), (7, "u", "short"), (8, "u", "short"), (None, "u", big), (2, "u", big), (9, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nx")]
    folder = archived(spark, tmp_path, rows, size=97)
    assert warc.damaged(spark, folder).count() == 0
    got = sorted((int(r.page) if r.page else -1, r.payload_bytes, r.payload_digest, r.type, r.refers) for r in warc.read_archive(spark, folder).collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        later = html == big and page != 2
        want.append((-1 if page is None else page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", "2" if later else None))
    assert got == sorted(want, key=lambda r: r[:4])
    chunks = warc.read_chunks(spark, folder).filter("type <> 'revisit'").collect()
    assert max(len(c.data) for c in chunks) <= 97
    payloads = {}
    for c in sorted(chunks, key=lambda c: (c.record, c.chunk)):
        payloads[c.record] = payloads.get(c.record, b"") + bytes(c.data)
    assert sorted(payloads.values()) == sorted((h or "").encode() for p, _, h in rows if not (h == big and p != 2))


def test_archive_of_nothing_and_damage(spark, tmp_path):
    folder = archived(spark, tmp_path, [])
    assert warc.read_archive(spark, folder).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Page-ID: 1\r\n"
                                        b"WARC-Payload-Digest: sha1:0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    assert warc.damaged(spark, f"{tmp_path}/b").count() == 1 and warc.read_archive(spark, f"{tmp_path}/b").count() == 0


def test_cuts_keep_characters_and_break_marks():
    for payload in (b"", b"x" * 10, "中".encode() * 9, b"aWARC/1.1b" * 3, warc.MARK, b"W" + warc.MARK):
        for size in (4, 5, 8, 50):
            parts = [payload[a:z] for a, z in warc.cuts(payload, size)]
            assert b"".join(parts) == payload and all(len(p) <= size and warc.MARK not in p for p in parts)


# --- op3 -----------------------------------------------------------------------------------

def searched(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int")
    return neighbours.nearest(df, **kwargs).collect()


def exact(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in ids[ids % every == 0]:
        s = np.round(x @ x[ids == q][0], 12)  # equal vectors have equal products
        out[q] = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return out


def test_recall_with_copies_and_unequal_norms(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=16)) * rng.uniform(0.5, 1.5)) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in rows]
    want = exact(rows, 20, 20)
    got = {}
    for r in searched(spark, rows):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    assert all(len(v) == 20 and [x[0] for x in sorted(v)] == list(range(1, 21)) for v in got.values())
    recall = np.mean([len({x[1] for x in got[q]} & set(want[q])) / 20 for q in want])
    assert recall >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    assert all(abs(vectors[q] @ vectors[i] - s) < 1e-9 for q, v in got.items() for _, i, s in v)


def test_recall_with_norms_a_thousand_times_apart(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(40, 64))[np.arange(2000) % 40] + 0.5 * rng.normal(size=(2000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(2000)]
    x[1234] *= 1000
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    want = exact(rows, 20, 20)
    got = {}
    for r in searched(spark, rows):
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.95
    points = neighbours.stage(neighbours.levelled(spark.createDataFrame(rows, "node long, vec array<double>")))
    linked = {}
    for r in neighbours.build_graph(points).collect():
        linked.setdefault(r.node, set()).add(r.nbr)
    near = {q: set(v) - {1234} for q, v in want.items() if q != 1234}
    held = np.mean([len(linked[q] & v) / len(v) for q, v in near.items()])
    assert held >= 0.95, held


def test_few_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]),
            (100, [None, 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (2, [0.0, 1.0])]
    got = {}
    for r in searched(spark, rows):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {0: [1, 20, 2], 20: [0, 1, 2]}
    assert searched(spark, []) == [] and searched(spark, [(0, [1.0])]) == []


# --- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {d for d, q in labels.items() if q == 1}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        rows = out.collect()
        counts.append(len(rows))
        assert all(r.n_chars == len(r.text) for r in rows)
        if name == "quality_classifier":
            kept = {r.doc_id for r in rows}
            assert len(good - kept) <= 1 and len({d for d, q in labels.items() if q == 0} & kept) <= 3
        docs = spark.createDataFrame(rows, docs.schema)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_pipeline_runs_as_one(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 150 and "sequence_id" in out.columns
