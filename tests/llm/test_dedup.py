"""Duplicate finding against plain versions: op6, op9, op10."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from depthlog.llm import line_dedup, queries, simhash, suffix_dedup
from depthlog.llm.components import components


# --- op6 -----------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(keys, linked):
    """Smallest id reachable; keys in order."""
    group = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for a in range(len(keys)):
            for b in range(a):
                low = min(group[a], group[b])
                if linked(a, b) and (group[a], group[b]) != (low, low):
                    group[a] = group[b] = low
                    changed = True
    return [keys[g] for g in group]


def test_fingerprints_and_components(docs):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(300)) for _ in range(12)]
    rows = []
    for t in base:
        words = t.split()
        for _ in range(4):
            w = list(words)
            w[rng.randrange(300)] = "changed"
            rows.append(" ".join(w))
    rows += base + ["", None, "   ", "ONE Two", "one two", "x", base[0].upper(), "État d'ame un deux"]
    rows = list(enumerate(rows))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    assert all(got[i].fp % (1 << 64) == p for (i, _), p in zip(rows, prints))
    want = grouped([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert [got[i].component_id for i, _ in rows] == want
    assert len(set(want)) < len(rows) - 10
    kept = sorted(r.doc_id for r in simhash.keep_first(docs(rows)).collect())
    assert kept == sorted(set(want))


def test_links_are_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(6)
    seeds = rng.integers(-2**63, 2**63, 30)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for s in seeds for k in range(6)]
    values = sorted(set(map(int, near)))
    got = {(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}


def test_near_duplicates_odd_rows(docs):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (8, "other text here now"), (8, "a b c d")]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id != 8} == {7}
    kept = simhash.keep_first(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8] and kept.columns == docs(rows).columns
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_first(docs([])).count() == 0
    alone = simhash.keep_first(docs([(None, "only"), (None, "only")])).collect()
    assert len(alone) == 1


def test_each_component_keeps_one_document(docs):
    rng = random.Random(12)
    texts = [" ".join(f"{rng.random():.9f}" for _ in range(40)) for _ in range(6)]
    prints = [plain_fingerprint(t) for t in texts]
    assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 3
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]),
            (None, texts[4]), (9, texts[4]), (5, texts[5]), (3, texts[5])]
    kept = simhash.keep_first(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[4]), (3, texts[5])], key=str)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))
    assert got[200] == 200 and got[300] == 299
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- op9 -----------------------------------------------------------------------------------

def plain_lines(rows, run=3):
    """Line numbers to delete by document, in order of doc_id."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        at = [(n, x.strip(line_dedup.BLANKS)) for n, x in enumerate((text or "").split("\n"))]
        at = [(n, x) for n, x in at if x]
        gone = set()
        for p in range(len(at) - run + 1):
            key = tuple(x for _, x in at[p:p + run])
            if key in seen:
                gone.update(n for n, _ in at[p:p + run])
            seen.add(key)
        out[i] = gone
    return out


def test_repeated_runs_of_lines(docs):
    rng = random.Random(7)
    shared = [[f"shared {k} line {i}" for i in range(rng.randint(2, 7))] for k in range(6)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(shared)[rng.randint(0, 1):] if rng.random() < 0.6 else [f"own {i} {rng.random()}"]
            if rng.random() < 0.3:
                lines += ["", "  "]
        rows.append((i, "\n".join(lines)))
    rows += [(50, "a\na\na\na\na\na"), (51, None), (52, ""), (53, "\n\n"), (54, " a \n\na\n\ta")]
    want = plain_lines(rows)
    out = line_dedup.clean(docs(rows))
    assert out.columns == docs(rows).columns
    got = {r.doc_id: r for r in out.collect()}
    for i, text in rows:
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[i])
        assert got[i].text == kept and (kept is None or got[i].n_chars == len(kept))
    assert sum(map(len, want.values())) > 40


def test_matches_beyond_the_first_position_of_a_line(docs, monkeypatch):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(200, "p\nhot\nq"), (201, "r\nhot\ns"), (202, "x\nr\nhot\ns\ny"), (203, "\n".join(["hot"] * 3000))]
    want = plain_lines(rows)
    got = {r.doc_id: r["__gone"] for r in line_dedup.marked(docs(rows)).collect()}
    assert {i: set(g or []) for i, g in got.items()} == want
    assert want[202] == {1, 2, 3} and want[203] == set(range(1, 3000))
    # The rows come from the extension: with lines that never extend, nothing is a repeat.
    monkeypatch.setattr(line_dedup, "equal_lines", lambda side, run: F.lit(0))
    assert not any(r["__gone"] for r in line_dedup.marked(docs(rows)).collect())


def test_every_run_selects_one_line():
    rng = random.Random(3)
    for _ in range(50):
        lines = [rng.choice(["a", "b", "c d", "e " * 30]) for _ in range(rng.randint(0, 8))]
        found = list(line_dedup.selected("\n".join(lines)))
        runs = {(at - x, at + y) for at, _, _, _, around in found for x, y in around}
        want = {(p, p + 2) for p in range(len(lines) - 2)}
        want |= {(p, z) for p in range(len(lines)) for z in (p, p + 1) if z < len(lines) and len(" ".join(lines[p:z + 1]).split()) >= 50}
        assert runs == want and sum(len(x[4]) for x in found) == len(want)


def test_lines_of_odd_rows(docs):
    same = "x1\nx2\nx3"
    got = line_dedup.clean(docs([(1, same), (1, same), (None, same), (2, "y"), (2, "z")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", ""), ("1", ""), ("2", "y"), ("2", "z"), ("None", same)]
    assert line_dedup.clean(docs([])).count() == 0


def test_long_passages_on_few_lines_are_repeats(docs):
    long, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25))
    rows = [(1, f"{long}\na\n{half}\n\n{half} "), (2, f"b\n {long}\nc"), (3, f"{half}\n{half}"), (4, f"d\n{half}\ne"), (5, long[:-4])]
    got = {r.doc_id: r.text for r in line_dedup.clean(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "b\nc", 3: "", 4: rows[3][1], 5: rows[4][1]}
    counted = {r.doc_id: r.text for r in line_dedup.clean(docs(rows), words=None).collect()}
    assert counted == dict(rows)


# --- op10 ----------------------------------------------------------------------------------

def plain_bytes(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    rows = []
    for i in range(30):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(parts)
            a = rng.randint(0, 30)
            text += p[a:] if rng.random() < 0.5 else p[:len(p) - a]
            text += "".join(rng.choice("xyz ") for _ in range(rng.choice([0, 1, 3, 150])))
        rows.append((i, text))
    return rows + [(40, "ab" * 300), (41, "a" * 450), (42, "ab" * 300 + "c"), (43, ""), (44, None), (45, "short"), (46, "q" * 99), (47, "q" * 100), (48, "q" * 100)]


@pytest.mark.parametrize("seed, limit, slice_bytes", [(8, None, None), (9, 1, None), (10, None, 130)])
def test_repeated_substrings(docs, monkeypatch, seed, limit, slice_bytes):
    if limit:
        monkeypatch.setattr(suffix_dedup, "LIMIT", limit)  # every shared gram goes the way of very common ones
    rows = corpus(seed)
    if slice_bytes:  # workers import the module themselves, so the sliced way is tried in this process
        frame = docs(rows).toPandas().sort_values("doc_id")
        frame = frame.assign(some=1, id=frame["doc_id"], text_hash=0)
        monkeypatch.setattr(suffix_dedup, "SLICE", slice_bytes)
        whole = list(suffix_dedup.samples([frame]))[0]
        covered = {(r.id, r.start + j) for r in whole.itertuples() for j in range(r.windows)}
        assert covered == {(i, p) for i, t in rows for p in range(len((t or "").encode()) - 99)}
        return
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(docs(rows)).collect()}
    assert got == plain_bytes(rows)


def test_substrings_of_odd_rows(docs):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    got = suffix_dedup.clean(docs([(None, text), (1, text), (1, text), (2, "é" + text), (2, "other"), (3, None)])).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == [("1", ""), ("1", ""), ("2", "other"), ("2", "é"), ("3", ""), ("None", text)]
    assert suffix_dedup.digest(docs([])).count() == 0 and suffix_dedup.clean(docs([])).columns == docs([]).columns


def test_settling_holds_across_batches():
    import pandas as pd
    rows = pd.DataFrame([(1, 1), (1, 1), (1, 2), (2, 5), (3, 7), (3, 7), (4, 1), (4, 2), (4, 3)], columns=["gram", "name"])
    rows = rows.assign(settled=False, some=1, id=range(9), text_hash=0, start=0, windows=1, distance=0)
    want = {("open", 0), ("done", 1), ("open", 2), ("done", 5), ("open", 6), ("open", 7), ("open", 8)}
    for size in range(1, 10):
        out = pd.concat(list(suffix_dedup.settle([rows[i:i + size] for i in range(0, 9, size)])))
        assert {("done" if s else "open", i) for s, i in zip(out["settled"], out["id"])} == want, size


def test_dedup_queries_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op10_suffix_dedup"](spark, sf).collect()}
    assert got == plain_bytes(rows)
    six = queries.QUERIES["op6_simhash_near_dedup"](spark, sf)
    assert six.count() == len(rows)
    assert all(r.fingerprint == f"{plain_fingerprint(t):016x}" for (i, t) in rows[:40] for r in six.filter(F.col("doc_id") == i).collect()[:1])
