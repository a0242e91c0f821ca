"""Filter, search and paging cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark.operators import filters as flt
from barspark.operators import paging as pg

TICKERS = ["AAPL", "GOOGL", "MSFT", "TSLA", "AMZN", "META", "NVDA", "NFLX"]


@pytest.fixture()
def view(spark):
    rows = [(t, f"2024-01-0{i + 1}", 100.0 + i, 105.0 + i, 95.0 + i, 102.0 + i, 1_000_000 + i, f"{t} shares")
            for i, t in enumerate(TICKERS)]
    rows[0] = rows[0][:-1] + ("Apple Inc.",)
    return spark.createDataFrame(rows, "ticker string, timestamp string, open double, high double, low double, "
                                       "close double, volume long, description string")


def test_search_counts(view):
    assert flt.search(view, "AAPL").count() == 1
    assert flt.search(view, "").count() == 8
    assert flt.search(view, "apple").count() == 1              # case-insensitive by default
    assert flt.search(view, "apple", case_sensitive=True).count() == 0
    c = flt.search_count(view, "AAPL").first()
    assert (c["matched"], c["total"]) == (1, 8)


def test_condition_sets(spark):
    rows = [(t, dt.datetime(2024, 1, 1 + i), 50.0 + 40 * i, 1e6 * (i + 1), None if i % 2 else 0.0)
            for i, t in enumerate(TICKERS)]
    df = spark.createDataFrame(rows, "ticker string, timestamp timestamp, close double, vol double, openint double")
    c = flt.apply_conditions
    assert c(df, [{"column": "ticker", "operator": "equals", "value": "AAPL"},
                  {"column": "close", "operator": "greater_than", "value": "100"}]).count() == 0
    assert c(df, [{"column": "close", "operator": "between", "value": ["100", "200"]}]).count() == 2
    assert c(df, [{"column": "ticker", "operator": "in", "value": ["AAPL", "GOOGL"]},
                  {"column": "vol", "operator": "greater_than", "value": 1500000}]).count() == 1
    assert c(df, [{"column": "ticker", "operator": "contains", "value": "AAP"}]).count() == 1
    assert c(df, [{"column": "openint", "operator": "is_not_null"}]).count() == 4
    assert c(df, [{"column": "ticker", "operator": "not_in", "value": "AAPL, GOOGL"}]).count() == 6
    assert c(df, []).count() == 8
    with pytest.raises(ValueError):
        c(df, [{"column": "ticker", "operator": "like", "value": "x"}])
    with pytest.raises(ValueError):
        c(df, [{"column": "nope", "operator": "equals", "value": "x"}])
    conds = [{"column": "close", "operator": "less_than", "value": 100}]
    assert flt.conditions_from_json(flt.conditions_to_json(conds)) == conds
    assert flt.date_range(df, "2024-01-02", "2024-01-04").count() == 3
    assert flt.column_filter(df, {"ticker": "a"}).count() == 5


def test_contains_keeps_wildcards(spark):
    df = spark.createDataFrame([("A_B",), ("AXB",)], "t string")
    assert flt.apply_conditions(df, [{"column": "t", "operator": "contains", "value": "A_B"}]).count() == 2


def test_row_access_5000(spark):
    rows = [(TICKERS[i % 5], dt.datetime(2023, 1, 1) + dt.timedelta(hours=i), 150 + 0.1 * i) for i in range(5000)]
    df = spark.createDataFrame(rows, "ticker string, timestamp timestamp, close double")
    rng = pg.row_range(df, ["timestamp"], 100, 110).orderBy("row_idx").collect()
    assert len(rng) == 10 and rng[0]["row_idx"] == 100
    assert pg.row_range(df, ["timestamp"], 6000, 6010).count() == 0
    assert pg.page_count(df, 100).first()["total_pages"] == 50
    assert pg.page(df, ["timestamp"], 3, 1000).first()["close"] == pytest.approx(150 + 0.1 * 2000)
    assert pg.page(df, ["timestamp"], 5, 100, shallow_rows=10).first()["close"] == pytest.approx(150 + 0.1 * 400)


def test_sort_and_neighbours(spark):
    df = spark.createDataFrame([("b", "10"), ("a", "9"), ("c", "x")], "t string, v string")
    assert not pg.is_numeric_column(df, "v")
    assert pg.is_numeric_column(df.filter(F.col("v") != "x"), "v")
    nums = pg.sort_column(df.filter(F.col("v") != "x"), "v").collect()
    assert [r["v"] for r in nums] == ["9", "10"]
    nb = {r["ticker"]: (r["prev_ticker"], r["next_ticker"]) for r in pg.ticker_neighbors(df, "t").collect()}
    assert nb == {"a": ("c", "b"), "b": ("a", "c"), "c": ("b", "a")}
    assert pg.next_ticker(df, "zzz", "t") == "a" and pg.next_ticker(df, "zzz", "t", -1) == "c"
    assert [r["ticker"] for r in pg.top_tickers(df, 2, "t").collect()] == ["a", "b"]


def test_big_integers_sort_by_value(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740992,), (-5,), (None,)], "n long")
    assert [r["n"] for r in pg.sort_column(df, "n").collect()] == [None, -5, 9007199254740992, 9007199254740993]


def test_backslash_is_an_ordinary_character(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",), ("a%b",)], "s string")
    got = flt.apply_conditions(df, [{"column": "s", "operator": "contains", "value": "a\\b"}]).collect()
    assert [r["s"] for r in got] == ["a\\b"]


def test_next_ticker_and_files_by_records(spark):
    df = spark.createDataFrame([("B", "y"), ("A", "x"), ("C", "x"), (None, "z")], "ticker string, _source string")
    assert [pg.next_ticker(df, t) for t in ("A", "B", "C", "Z", None)] == ["B", "C", "A", "A", "A"]
    assert [pg.next_ticker(df, t, step=-1) for t in ("A", "B", "C", None)] == ["C", "A", "B", "C"]
    assert [tuple(r) for r in pg.files_by_records(df).collect()] == [("x", 2), ("y", 1), ("z", 1)]
