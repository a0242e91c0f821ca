"""Drift, sketches, correlation, target encoding and quality scores: error bounds, skew, leakage, increments."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators import correlation as corr, drift as dr, encode as en, ordering, scores as sc

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def _release():
    yield
    ordering.release_positions()


# ---- sketches and drift

def test_sketch_rank_error_is_within_its_bound(spark):
    """Merged sketches of 40 groups, one with a third of all rows, on a skewed distribution."""
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 2, 60_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": np.where(np.arange(len(x)) % 3 == 0, 0, np.arange(len(x)) % 40)})).repartition(6)
    k = 256
    one = dr.merged(dr.sketches(df, ["x"], ["g"], k)).first()
    assert (one.rows, one.present) == (60_000, 60_000) and len(one.sketch) < 40_000
    got = spark.createDataFrame([(bytearray(one.sketch),)], "s binary").select(F.expr(f"kll_sketch_get_quantile_double(s, {dr._numbers([i / 100 for i in range(1, 100)])})").alias("q")).first().q
    ranks = np.searchsorted(np.sort(x), got, "right") / len(x)
    assert np.abs(ranks - np.arange(1, 100) / 100).max() <= dr.rank_error(k)


def brute_drift(b, c, bins=10):
    b, c = b[~np.isnan(b)], c[~np.isnan(c)]
    edges = np.quantile(b, np.arange(1, bins) / bins)
    share = lambda x: np.maximum(np.diff(np.concatenate([[0], [(x <= e).mean() for e in edges], [1]])), dr.LEAST_SHARE)
    sb, sc_ = share(b), share(c)
    at = np.union1d(b, c)
    ks = np.abs(np.searchsorted(np.sort(b), at, "right") / len(b) - np.searchsorted(np.sort(c), at, "right") / len(c)).max()
    return float(((sc_ - sb) * np.log(sc_ / sb)).sum()), float(ks)


@pytest.mark.parametrize("case", ["same", "moved", "ties", "gone"])
def test_drift_exact_and_sketched(spark, case):
    rng = np.random.default_rng(2)
    b = rng.normal(0, 1, 20_000)
    c = {"same": rng.normal(0, 1, 9_000), "moved": rng.normal(1, 2, 9_000), "ties": rng.integers(0, 3, 9_000).astype(float), "gone": np.where(rng.random(9_000) < 0.5, np.nan, rng.normal(0, 1, 9_000))}[case]
    if case == "ties":
        b = rng.integers(0, 2, 20_000).astype(float)
    left, right = (spark.createDataFrame(pd.DataFrame({"x": v, "other": 1.0})).repartition(4) for v in (b, c))
    psi, ks = brute_drift(b, c)
    exact, near = (dr.drift_report(left, right, ["x"], exact=e, k=512).first() for e in (True, False))
    assert math.isclose(exact.psi, psi, abs_tol=1e-9) and math.isclose(exact.ks, ks, abs_tol=1e-12) and exact.ks_error == 0
    assert abs(near.ks - ks) <= near.ks_error < 0.03 and abs(near.psi - psi) < 0.02 + 0.1 * psi
    assert exact.drifted == near.drifted == (case in ("moved", "ties"))
    assert (near.rows_base, near.rows_current) == (20_000, 9_000)
    assert math.isclose(near.missing_current, np.isnan(c).mean()) and near.missing_base == 0


def test_drift_edges(spark):
    a = spark.createDataFrame([(1.0, "x", True), (2.0, None, False)], "n double, t string, f boolean")
    none = a.limit(0)
    for exact in (True, False):
        rows = {r.column: r for r in dr.drift_report(a, none, exact=exact).collect()}
        assert set(rows) == {"n", "t", "f"} and all(r.psi is None and r.ks is None for r in rows.values()) and rows["n"].rows_current == 0
    same = {r.column: r for r in dr.drift_report(a, a).collect()}
    assert same["t"].missing_base == 0.5 and same["t"].psi == same["n"].psi == 0.0 and not same["f"].drifted
    assert dr.drift_report(a.select(F.array("n").alias("z")), a).collect() == []
    with pytest.raises(ValueError):
        dr.drift_report(a, a, bins=1)


# ---- correlation

def correlation_rows():
    """One date with a third of all rows, a ticker with every date, a constant one, one that is constant where it meets others."""
    rng = random.Random(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(40)]
    rows = [("ALL", d, rng.gauss(0, 1)) for d in days] + [("FLAT", d, 0.1) for d in days]
    common = {d: rng.gauss(0, 1) for d in days}
    for t in range(30):
        for d in rng.sample(days, 12):
            rows.append((f"T{t:02}", d, common[d] * (t % 3 - 1) + rng.gauss(0, 0.5)))
    rows += [(f"S{i:03}", days[7], float(i)) for i in range(200)]
    rows += [("ALL", None, 1.0), (None, days[0], 1.0), ("ALL", days[0], float("nan")), ("T01", days[3], None), ("ALL", days[5], float("inf"))]
    rows += [("TWICE", d, v) for d in days[:6] for v in (1.0, 2.0 + d.day)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile,chunk", [(256, 512), (16, 8), (7, 5)])
def test_correlation_against_pandas(spark, tile, chunk):
    rows = correlation_rows()
    df = spark.createDataFrame(rows, "ticker string, date date, value double").repartition(5)
    out = corr.ticker_correlation(df, least=4, tile=tile, chunk=chunk)
    got = {(r.ticker_a, r.ticker_b): (r.dates, r.correlation) for r in out.collect()}
    p = pd.DataFrame([r for r in rows if None not in r and math.isfinite(r[2])], columns=["t", "d", "v"]).groupby(["d", "t"]).v.mean().unstack()
    exp = {}
    names = sorted(p.columns)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = p[[a, b]].dropna()
            if len(both) >= 4:
                r = np.corrcoef(both[a], both[b])[0, 1] if both[a].nunique() > 1 and both[b].nunique() > 1 else None
                exp[(a, b)] = (len(both), r)
    assert set(got) == set(exp)
    for k, (n, r) in exp.items():
        assert got[k][0] == n and (got[k][1] is None) == (r is None) and (r is None or math.isclose(got[k][1], r, abs_tol=1e-9))


def test_correlation_tiles_are_bounded(spark):
    """No tile gets more rows than two blocks of tickers have in a chunk of dates, although one date holds a third of the rows."""
    df = spark.createDataFrame(correlation_rows(), "ticker string, date date, value double").repartition(5)
    seen = []
    real = corr._tile

    def counted(size, chunk):
        seen.append((size, chunk))
        return lambda t: __import__("pyarrow").table({"i": [t.num_rows], "j": [0], "n": [1], "sx": [0.0], "sy": [0.0], "sxx": [0.0], "syy": [0.0], "sxy": [0.0]})

    try:
        corr._tile = counted
        plan = corr.ticker_correlation(df, least=1, tile=16, chunk=8)
    finally:
        corr._tile = real
    assert seen == [(16, 8)] and "CartesianProduct" not in plan._jdf.queryExecution().toString()
    assert corr.ticker_correlation(df.limit(0)).collect() == []


def test_daily_returns(spark):
    rows = [("A", T0, 1, 10.0), ("A", T0, 2, 20.0), ("A", T0 + dt.timedelta(days=2), 3, 30.0), ("A", T0 + dt.timedelta(days=3), 4, 0.0), ("A", T0 + dt.timedelta(days=4), 5, 15.0), ("B", T0, 6, 1.0), (None, T0, 7, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, timestamp timestamp_ntz, seq int, close double")
    got = corr.daily_returns(df, order=("timestamp", "seq")).orderBy("date").collect()
    assert [(r.ticker, r.date.day, r.value) for r in got] == [("A", 3, 0.5), ("A", 5, -0.5)]


# ---- target encoding

def test_encoding_against_a_loop(spark):
    """A category with a third of all rows, NULL categories, targets and folds, a category of one fold only."""
    rng = random.Random(4)
    rows = [(i, "HOT" if i % 3 == 0 else rng.choice(["a", "b", None, f"r{i}"]), rng.choice([None, float("nan"), 1.0, float(i % 7)]), rng.choice([0, 1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, y double, f int").repartition(4)
    for smoothing in (0.0, 20.0):
        got = {r.i: r.k_target for r in en.encode_target(df, "k", "y", F.col("f"), smoothing=smoothing).collect()}
        ok = [(k, y, f) for _, k, y, f in rows if y is not None and not math.isnan(y)]
        for i, k, _, f in rows:
            rest = [y for _, y, ff in ok if ff != f]
            own = [y for kk, y, ff in ok if ff != f and kk == k]
            mean = sum(rest) / len(rest)
            exp = (sum(own) + smoothing * mean) / (len(own) + smoothing) if len(own) + smoothing else None
            assert (got[i] is None) == (exp is None) and (exp is None or math.isclose(got[i], exp))


def test_encoding_does_not_leak(spark):
    """Each category in one row: its target says nothing about its own encoding. With random targets the two do not correlate."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 4000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"i": range(4000), "rare": [f"c{i // 2}" for i in range(4000)], "y": y, "fold": rng.integers(0, 5, 4000)}))
    out = en.encode_target(df, "rare", "y", F.col("fold"), "e", smoothing=1.0).orderBy("i").select("e").toPandas().e
    assert abs(np.corrcoef(out, y)[0, 1]) < 0.1
    flipped = df.withColumn("y", F.when(F.col("i") == 17, 1 - F.col("y")).otherwise(F.col("y")))
    again = en.encode_target(flipped, "rare", "y", F.col("fold"), "e", smoothing=1.0).orderBy("i").select("e").toPandas().e
    assert again[17] == out[17] and (again != out).any()  # a row's own target leaves its encoding alone
    leaky = en.apply_target(df, en.target_totals(df, "rare", "y"), "rare", "e", 1.0).orderBy("i").select("e").toPandas().e
    assert np.corrcoef(leaky, y)[0, 1] > 0.4  # what the folds prevent


def test_encoding_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0)], "k string, y double, f int")
    assert [r.k_target for r in en.encode_target(df, "k", "y", F.col("f")).collect()] == [None, None]
    assert en.encode_target(df.limit(0), "k", "y", F.col("f")).collect() == []
    new = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert [r.k_target for r in en.apply_target(new, en.target_totals(df, "k", "y"), "k").collect()] == [1.5, 1.5, 1.5]
    assert [r.k_target for r in en.apply_target(new, en.target_totals(df.limit(0), "k", "y"), "k").collect()] == [None] * 3
    with pytest.raises(ValueError):
        en.encode_target(df, "k", "y", F.col("f"), smoothing=-1)


# ---- scores

def test_scores_after_two_ingests_equal_a_full_run(spark, tmp_dir):
    """Files arrive in two runs of the stream; states are added, the first files are not read again."""
    import os
    import shutil

    from barspark.sources.readers import load
    from barspark.streaming.ingest import ingest_files
    src, later = f"{tmp_dir}/src", f"{tmp_dir}/later"
    for k, folder in enumerate((src, src, later)):
        rows = [(f"T{k}", T0 + dt.timedelta(hours=i), 5.0, 6.0 if i % 4 else 3.0, 4.0, None if i % 5 == k else 5.0, float(i - 2), 0.0, "x") for i in range(20)]
        df = spark.createDataFrame(rows, "ticker string, timestamp timestamp_ntz, open double, high double, low double, close double, vol double, openint double, format string")
        df.coalesce(1).write.mode("append").option("header", True).csv(folder)
    table, ckpt, log, states = (f"{tmp_dir}/{n}" for n in ("table", "ckpt", "log", "states"))
    assert ingest_files(spark, src, table, ckpt, "csv", 1, log, states) == 2
    first = sc.scores(sc.current_states(spark, states), None).first()
    assert first.files == 2 and first.rows == 40
    taken = [f for f in os.listdir(src) if f.endswith(".csv")]
    for f in os.listdir(later):
        if f.endswith(".csv"):
            shutil.copy(f"{later}/{f}", f"{src}/new-{f}")
    kept = {f: open(f"{src}/{f}", "rb").read() for f in taken}
    for f in taken:  # files already counted could as well be unreadable
        open(f"{src}/{f}", "wb").close()
    assert ingest_files(spark, src, table, ckpt, "csv", 1, log, states) == 1
    for f, raw in kept.items():
        open(f"{src}/{f}", "wb").write(raw)
    full = sc.states(load(spark, [f"{src}/{f}" for f in os.listdir(src) if f.endswith(".csv")], "csv", with_source=True), "_source")
    got = sc.current_states(spark, states)
    assert sorted(map(tuple, sc.scores(got).drop("source").collect())) == sorted(map(tuple, sc.scores(full).drop("source").collect()))
    assert sc.scores(got, None).collect() == sc.scores(full, None).collect()
    assert sorted(map(tuple, sc.rule_report(got).collect())) == sorted(map(tuple, sc.rule_report(full).collect()))


def test_scores_by_hand(spark, tmp_dir):
    rows = [("f", "A", T0, 1.0, 2.0, 0.5, 1.5, 3.0), ("f", "A", None, 1.0, 0.9, None, float("nan"), -1.0), (None, None, T0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "source string, ticker string, timestamp timestamp_ntz, open double, high double, low double, close double, vol double")
    out = {r.source: r for r in sc.scores(sc.states(df)).collect()}
    # f: 7 of 9 columns in the first row, 4 in the second; the first keeps five rules, the second keeps one and breaks the volume's and, its open above its high, another
    assert out["f"].completeness == 11 / 18 and out["f"].consistency == 6 / 8 and math.isclose(out["f"].score, (11 / 18 + 6 / 8) / 2)
    assert (out[None].completeness, out[None].consistency) == (1 / 9, 1.0)
    rules = {r.rule: (r.kept, r.broken) for r in sc.rule_report(sc.states(df)).collect()}
    assert rules["volume_not_negative"] == (1, 1) and rules["prices_positive"] == (2, 0) and rules["high_low"] == (1, 0)
    assert sc.scores(sc.states(df.limit(0))).collect() == [] and sc.scores(sc.states(df.limit(0)), None).first().score is None
    # a retried run replaces its states, a later run those of the same source
    for run, part in ((1, df), (1, df), (2, df.where("timestamp is not null"))):
        sc.add_states(sc.states(part), f"{tmp_dir}/s", run)
    assert {r.source: r.rows for r in sc.current_states(spark, f"{tmp_dir}/s").collect()} == {"f": 1, None: 1}
