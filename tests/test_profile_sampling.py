"""Profiling, gaps, size classes, balance and scaling."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators import features as ft
from barspark.operators import profile as pf
from barspark.operators.sampling import balance_tickers


def test_gap_days_missing_tuesday_and_weekend(spark):
    # Mon 2024-01-01 .. Fri 2024-01-05 without Tuesday; second source only Sat+Sun
    rows = [("A", dt.datetime(2024, 1, d)) for d in (1, 3, 4, 5)] + [("B", dt.datetime(2024, 1, d)) for d in (6, 7)]
    df = spark.createDataFrame(rows, "source string, timestamp timestamp")
    gaps = {r["source"]: r["gap_count"] for r in pf.gap_count(df).collect()}
    assert gaps == {"A": 1, "B": 0}
    assert [r["missing_date"] for r in pf.gap_days(df).collect()] == [dt.date(2024, 1, 2)]


@pytest.mark.parametrize("n,cls", [(0, "empty"), (49, "very_small"), (50, "small"), (499, "small"),
                                   (500, "medium"), (1999, "medium"), (2000, "large")])
def test_size_class_bounds(spark, n, cls):
    out = spark.range(1).select(pf.size_class(F.lit(n)).alias("c")).first()["c"]
    assert out == cls


def test_categories_and_estimates(spark):
    paths = ["data/daily/us/nasdaq stocks/1/aapl.us.txt", "data/daily/us/stocks/x.txt", "data/world/bonds/b.txt",
             "data/world/cryptocurrencies/btc.txt", "data/world/money market/m.txt", "data/world/indices/i.txt",
             "data/world/other/o.txt", "data/pl/x.txt"]
    df = spark.createDataFrame([(p, 1024 * 1024) for p in paths], "path string, length long")
    cats = [r["category"] for r in pf.file_categories(df).collect()]
    assert cats == ["other", "us_stocks", "world_bonds", "cryptocurrencies", "money_market", "indices", "other",
                    "other"]
    est = pf.processing_estimate(df).first()
    assert (est["total_files"], est["total_size_mb"], est["estimated_seconds"]) == (8, 8.0, 0.8)
    batches = [r["batch"] for r in pf.batch_assign(df, 3).orderBy("file_idx").collect()]
    assert batches == [0, 0, 0, 1, 1, 1, 2, 2]


def test_timestamp_analysis_first_rows(spark):
    rows = [("f", i, "20240101" if i not in (2, 5, 6, 7, 8, 9, 11) else "bad", "0") for i in range(12)]
    raw = spark.createDataFrame(rows, "source string, seq long, `<DATE>` string, `<TIME>` string")
    out = pf.timestamp_analysis(raw, "source", ("seq",), as_of="2030-01-01").first()
    assert out["invalid_dates"] == 7 and out["first_invalid_rows"] == "2,5,6,7,8"
    # tiny blocks: the first invalid rows come from several blocks and are merged per source
    tiny = pf.timestamp_analysis(raw, "source", ("seq",), as_of="2030-01-01", block_rows=3).first()
    assert tiny["first_invalid_rows"] == "2,5,6,7,8"


def _random_bars(spark, n=20000, seed=42):
    rng = np.random.default_rng(seed)
    t = rng.choice([f"T{i}" for i in range(10)], size=n, p=[0.34] + [0.66 / 9] * 9)  # one hot ticker
    days = rng.integers(0, 1460, size=n)
    pdf = pd.DataFrame({"ticker": t, "timestamp": pd.Timestamp("2020-01-01") + pd.to_timedelta(days, "D"),
                        "close": rng.uniform(50, 500, size=n), "seq": np.arange(n)})
    twice = pd.concat([pdf, pdf])  # loaded twice, like the reference's performance test
    return spark.createDataFrame(twice), twice


def _pandas_balance(pdf, target, minimum):
    out = []
    for _, g in pdf.groupby("ticker"):
        if len(g) < minimum:
            continue
        if len(g) > target:
            g = g.sort_values(["timestamp", "seq"], kind="stable")
            g = g.iloc[::len(g) // target].head(target)
        out.append(g)
    return pd.concat(out)


@pytest.mark.parametrize("target,minimum", [(None, None), (2000, 3000), (500, 10)])
def test_balance_matches_pandas_rule(spark, target, minimum):
    df, pdf = _random_bars(spark)
    counts = pdf.groupby("ticker").size()
    t = int(counts.median()) if target is None else target
    m = t // 2 if minimum is None else minimum
    exp = _pandas_balance(pdf, t, m)
    got = balance_tickers(df, target, minimum, order=("timestamp", "seq"), block_rows=1024).toPandas()
    key = ["ticker", "seq"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, exp[key].values.tolist()))


def test_balance_nothing_left(spark):
    df, _ = _random_bars(spark, 200)
    with pytest.raises(ValueError):
        balance_tickers(df, 10, 10_000)


def test_normalize_rules(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (2.0, 5.0, "b"), (4.0, 5.0, None)], "x double, c double, s string")
    mm = ft.normalize(df, "minmax").toPandas()
    assert mm["x"].tolist() == [0.0, 1 / 3, 1.0] and mm["c"].tolist() == [0.0, 0.0, 0.0]
    assert mm["s"].tolist() == ["a", "b", None]
    sd = ft.normalize(df, "standard").toPandas()
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(sd["x"], (x - x.mean()) / x.std())
    rb = ft.normalize(df, "robust").toPandas()
    q25, q50, q75 = np.percentile(x, [25, 50, 75])
    assert np.allclose(rb["x"], (x - q50) / (q75 - q25))
    with pytest.raises(ValueError):
        ft.normalize(df, "zscore")


def test_sequences(spark):
    pdf = pd.DataFrame({"ticker": ["A"] * 70 + ["B"] * 5, "t": list(range(70)) + list(range(5)),
                        "close": np.arange(75, dtype=float), "vol": np.arange(75, dtype=float) * 2})
    s = ft.sequences(spark.createDataFrame(pdf), ["close", "vol"], "close", 60, order=("t",), block_rows=64)
    rows = s.orderBy("t").collect()
    assert len(rows) == 10 and all(r["ticker"] == "A" for r in rows)
    first = rows[0]
    assert first["y"] == 60.0 and first["X"][0] == [0.0, 0.0] and first["X"][-1] == [59.0, 118.0]


def test_describe_quartiles(spark):
    df = spark.createDataFrame([(float(v), t, dt.datetime(2024, 1, v)) for v, t in [(1, "x"), (2, "x"), (3, "y"),
                                                                                   (10, "y")]],
                               "v double, t string, ts timestamp")
    d = {r["column_name"]: r for r in pf.describe(df).collect()}
    assert d["ts"]["count"] == 4 and d["ts"]["min_time"] == dt.datetime(2024, 1, 1)
    assert d["ts"]["max_time"] == dt.datetime(2024, 1, 10)
    assert d["v"]["p25"] == pytest.approx(1.75) and d["v"]["p50"] == pytest.approx(2.5)
    assert d["t"]["top"] == "x" and d["t"]["freq"] == 2 and d["t"]["unique"] == 2
