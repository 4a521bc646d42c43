import pandas as pd
import pytest
from pyspark.sql import functions as F

import data
from depthlog.operators import compare as K, quality as A, series as S, stats as D
from depthlog.operators.quantiles import quantiles

MODELS = {"A": "A", "B": "B", "C": "C"}


@pytest.fixture(scope="module")
def wells(spark):
    return spark.createDataFrame(data.rows(), data.SCHEMA).repartition(5).cache()


def key(df):
    return sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())))


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_runs_equal_brute_force(wells, block):
    expected = []
    for well, g in data.frame().groupby("WELL"):
        code = g.TRUE_CODE.fillna(-1)
        for _, h in g.groupby((code != code.shift()).cumsum()):
            value = None if pd.isna(h.TRUE_CODE.iloc[0]) else int(h.TRUE_CODE.iloc[0])
            expected.append((well, value, int(h.SOURCE_ROW.min()), int(h.SOURCE_ROW.max()), len(h), round(float(h.DEPT.iloc[-1]), 6)))
    got = S.runs(wells, "WELL", "SOURCE_ROW", F.col("TRUE_CODE"), {"base": ("last", F.col("DEPT"))}, block)
    assert key(got) == sorted(map(str, expected))


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_run_counts_equal_brute_force(spark, wells, block):
    def beds(codes, bridge):
        codes = [c for c in codes if c is not None] if bridge else codes
        return sum(i == 0 or c != codes[i - 1] for i, c in enumerate(codes))

    odd = spark.createDataFrame([("x", i, c) for i, c in enumerate([None, None, 1, None, 1, None, None, 2, 2, None])] + [(None, 0, 5), ("y", 0, None)],
                                "WELL string, SOURCE_ROW int, TRUE_CODE int")
    for df in (wells, odd, odd.limit(0)):
        want = {}
        for r in sorted(df.collect(), key=lambda r: r.SOURCE_ROW):
            want.setdefault(r.WELL, []).append(r.TRUE_CODE)
        got = S.run_counts(df, "WELL", "SOURCE_ROW", {"plain": (F.col("TRUE_CODE"), False), "bridged": (F.col("TRUE_CODE"), True)}, block,
                           {"n": ("sum", F.lit(1)), "last": ("max", F.col("SOURCE_ROW"))}).collect()
        assert {r.WELL: (r.plain, r.bridged, r.n, r.last + 1) for r in got} == {
            w: (beds(c, False), beds(c, True), len(c), len(c)) for w, c in want.items()}


@pytest.mark.parametrize("block", [2, 1000])
def test_boundary_equals_brute_force(wells, block):
    got = {r.WELL: r for r in K.boundary_analysis(wells, {"A": "A"}, "TRUE_CODE", "WELL", "SOURCE_ROW", 2, ["WELL"], block).collect()}
    for well, g in data.frame().dropna(subset=["TRUE_CODE"]).groupby("WELL"):
        true = g.sort_values("SOURCE_ROW").TRUE_CODE.tolist()
        changes = [i for i in range(1, len(true)) if true[i] != true[i - 1]]
        near = [any(abs(i - c) <= 2 for c in changes) for i in range(len(true))]
        pred = g.sort_values("SOURCE_ROW").A.tolist()
        known = [(n, p == t) for n, p, t in zip(near, pred, true) if not pd.isna(p)]
        assert got[well].share_near == pytest.approx(sum(n for n, _ in known) / len(known))
        inside = [ok for n, ok in known if not n]
        assert not inside or got[well].accuracy_inside == pytest.approx(sum(inside) / len(inside))


@pytest.mark.parametrize("block", [3, 1000])
def test_positions_and_totals(wells, block):
    assert S.running_totals(wells, "WELL", "SOURCE_ROW", {"n": F.lit(1)}, block).filter("n <> SOURCE_ROW + 1").count() == 0
    packed = S.renumber(wells.filter("GR is not null"), "WELL", "SOURCE_ROW", "at", block).orderBy("WELL", "SOURCE_ROW").toPandas()
    assert (packed["at"] == packed.groupby("WELL").cumcount()).all()


def test_rank_by_value_with_heavy_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("WELL"),
                                  (F.col("id") * 7919 % 5003).alias("x"))
    got = S.rank_rows(df, "WELL", ["x"], "r").toPandas().sort_values(["WELL", "x"])
    assert len(got) == 5000 and (got["r"] == got.groupby("WELL").cumcount()).all()


def test_attach_gives_the_same_with_and_without_broadcast(wells):
    stats = wells.groupBy("WELL").agg(F.max("DEPT").alias("deepest"), F.max("SOURCE_ROW").alias("last"))
    a = S.attach(wells, stats.drop("last"), "WELL")
    b = S.attach(wells, stats.drop("last"), "WELL", broadcast_rows=0, block_rows=10)
    c = S.attach(wells, stats, "WELL", last="last", broadcast_rows=0, block_rows=10)
    cols = ["WELL", "SOURCE_ROW", "deepest"]
    assert key(a.select(cols)) == key(b.select(cols)) == key(c.select(cols))
    assert a.count() == wells.count()


@pytest.mark.parametrize("name,build", [
    ("rolling accuracy", lambda w, b: K.rolling_accuracy(w, MODELS, "TRUE_CODE", "WELL", "SOURCE_ROW", 40, b).drop("GR")),
    ("boundary", lambda w, b: K.boundary_analysis(w, MODELS, "TRUE_CODE", "WELL", "SOURCE_ROW", 2, ["WELL"], b)),
    ("disagreement", lambda w, b: K.disagreement_intervals(w, list(MODELS), "WELL", "SOURCE_ROW", "DEPT", 5, b)),
    ("beds", lambda w, b: D.bed_thickness(w, MODELS, "TRUE_CODE", "WELL", "SOURCE_ROW", "DEPT", block_rows=b)),
    ("run lengths", lambda w, b: D.run_length_spread(w, "TRUE_CODE", "WELL", "SOURCE_ROW", block_rows=b)),
    ("transitions", lambda w, b: D.transitions(w, "TRUE_CODE", "WELL", "SOURCE_ROW", block_rows=b)),
    ("interval", lambda w, b: D.interval_stats(w, "A", "TRUE_CODE", "WELL", "SOURCE_ROW", "DEPT", b)),
    ("value runs", lambda w, b: A.value_runs(w, ["GR", "RDEP"], "WELL", "SOURCE_ROW", "DEPT", b)),
    ("gap context", lambda w, b: A.gap_context(w, "TRUE_CODE", ["GR"], "WELL", "SOURCE_ROW", "DEPT", b)),
    ("gap rows", lambda w, b: D.insert_gap_rows(w, ["A"], "WELL", "SOURCE_ROW", "DEPT", block_rows=b)),
    ("edges", lambda w, b: D.depth_edges(w, "WELL", "SOURCE_ROW", "DEPT", b)),
    ("steps", lambda w, b: A.gap_classes(w, "WELL", "SOURCE_ROW", "DEPT", block_rows=b)),
])
def test_block_length_does_not_matter(wells, name, build):
    assert key(build(wells, 7)) == key(build(wells, 10_000))


def test_rolling_accuracy_equals_pandas(wells):
    got = K.rolling_accuracy(wells, MODELS, "TRUE_CODE", "WELL", "SOURCE_ROW", 40, 16).toPandas().set_index(["WELL", "SOURCE_ROW"])
    pdf = data.frame()
    for _, g in pdf[pdf.TRUE_CODE.notna()].groupby("WELL"):
        want = (g.A == g.TRUE_CODE).astype(float).rolling(40, center=True, min_periods=10).mean()
        have = got.loc[list(zip(g.WELL, g.SOURCE_ROW)), "rolling_A"].to_numpy(dtype=float)
        assert pd.Series(have).round(9).equals(pd.Series(want.to_numpy()).round(9))


@pytest.mark.parametrize("parallelism", ["1", "64"])
def test_quantiles_equal_pandas(spark, wells, parallelism):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parallelism)
    try:
        got = quantiles(wells, "WELL", F.col("GR"), {"lo": 0.1, "mid": 0.5, "hi": 0.9}).toPandas().set_index("WELL")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = data.frame().dropna(subset=["GR"]).groupby("WELL").GR.quantile([0.1, 0.5, 0.9]).unstack()
    for well in want.index:
        assert list(got.loc[well].round(9)) == list(want.loc[well].round(9))


def test_bed_samples_sum_to_labelled_rows(wells):
    beds = D.bed_runs(wells, MODELS, "TRUE_CODE", "WELL", "SOURCE_ROW", block_rows=9).filter("source = 'Original'")
    assert beds.agg(F.sum("n")).first()[0] == wells.filter("TRUE_CODE is not null").count()


def test_mix_fractions_sum_to_one(wells):
    mix = D.lithology_mix(wells, MODELS, "TRUE_CODE", "WELL", "SOURCE_ROW", "DEPT")
    assert mix.groupBy("WELL", "source").agg(F.sum("fraction").alias("f")).filter("abs(f - 1) > 1e-9").count() == 0


def test_spearman_equals_pandas(wells):
    pdf = data.frame()
    full = pdf.dropna(subset=["GR", "DTC", "RHOB"])
    want = full[["GR", "DTC", "RHOB"]].rank().corr()
    got = D.spearman(wells.dropna(subset=["GR", "DTC", "RHOB"]), ["GR", "DTC", "RHOB"]).collect()
    assert all(abs(r["rho"] - want.loc[r["left"], r["right"]]) < 1e-9 for r in got) and len(got) == 6


def test_runs_of_several_values_are_windowed_once_and_cut_at_any_block(spark):
    rows = [(w, i, 10.0 + i, [None, -1.0, 0.0, 0.0, 5.0, 5.0][(i * i // 7 + w) % 6], [0.0, 0.0, None, 2.0][(i // 3) % 4]) for w in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows + [(None, i, 1.0, None, 0.0) for i in range(9)], "w int, i long, d double, a double, b double")
    expected = set()
    for w in (1, 2, None):
        for c, at in (("a", 3), ("b", 4)):
            own = sorted((r for r in df.collect() if r[0] == w), key=lambda r: r[1])
            kinds = ["missing" if r[at] is None else "negative" if r[at] < 0 else "zero" if r[at] == 0 else None for r in own]
            begun = 0
            for i in range(1, len(own) + 1):
                if i == len(own) or kinds[i] != kinds[begun]:
                    if kinds[begun]:
                        expected.add((w, c, kinds[begun], begun, i - 1, i - begun, own[begun][2], own[i - 1][2], own[begun][at], own[begun][at]))
                    begun = i
    for block in (1, 4, 1000):
        found = A.value_runs(df, ["a", "b"], "w", "i", "d", block)
        assert found.columns == ["w", "curve", "kind", "first_row", "last_row", "n", "depth_start", "depth_end", "min", "max"]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("Window") > plan.rindex("inline(")  # a row for each value only above the windows
