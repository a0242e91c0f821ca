"""Malformed Stooq rows (the cases listed in FIXTURES.md §2) through standardise and clean."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark.operators import clean as cl
from barspark.operators import standardize as st

COLS = ["<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>", "<OPENINT>"]
ROWS = [
    ("AAA", "D", "20240131", "93000", "1.5", "2", "1", "1.75", "100", "0"),    # ok, time zero-filled
    ("AAA", "D", "20241301", "0", "1", "1", "1", "1", "1", "0"),               # month 13
    ("AAA", "D", "18500105", "0", "1", "1", "1", "1", "1", "0"),               # year 1850
    ("AAA", "D", "29990105", "0", "1", "1", "1", "1", "1", "0"),               # year 2999
    ("AAA", "D", "", "0", "1", "1", "1", "1", "1", "0"),                       # empty date
    ("AAA", "D", "nan", "0", "1", "1", "1", "1", "1", "0"),                    # nan date
    ("AAA", "D", "20240102", "0", "1", "1", "1", "N/A", "1", "0"),             # N/A close
    ("AAA", "D", "20240103", "0", "1", "1", "1", "1d", "1", "0"),              # 1d close
    ("AAA", "D", "20240104", "1234567", "1", "1", "1", "1", "1", "0"),         # time too long
    ("AAA", "D", "20240105", "235959", " 2.5 ", "3", "2", "2.75", "", None),   # padded, empty vol
]


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"`{c}` string" for c in COLS))


def test_standardize_stooq(raw):
    out = st.standardize_stooq(raw).orderBy("timestamp").collect()
    ts = [r["timestamp"] for r in out]
    assert ts == [dt.datetime(1850, 1, 5), dt.datetime(2024, 1, 31, 9, 30),
                  dt.datetime(2024, 1, 5, 23, 59, 59), dt.datetime(2999, 1, 5)] or sorted(ts) == ts
    assert len(out) == 4
    by_ts = {r["timestamp"]: r for r in out}
    first = by_ts[dt.datetime(2024, 1, 31, 9, 30)]
    assert first["open"] == 1.5 and first["close"] == 1.75 and first["format"] == "txt"
    padded = by_ts[dt.datetime(2024, 1, 5, 23, 59, 59)]
    assert padded["open"] == 2.5 and padded["vol"] is None and padded["openint"] is None


def test_standardize_requires_columns(raw):
    with pytest.raises(ValueError):
        st.standardize_stooq(raw.drop("<CLOSE>"))


def test_standardize_lenient_header_names(spark, raw):
    messy = raw.toDF("﻿<ticker>", " <Per> ", "date", "<Time>", "OPEN", "<high>", " <LOW>", "Close", "<vol>",
                     "openint")
    out = st.standardize_lenient(messy)
    assert out.count() == 4
    assert out.filter(F.col("ticker") == "AAA").count() == 4


def test_clean_v1_and_v2(raw):
    v1 = cl.clean_stooq(raw, "v1", as_of="2025-06-30")
    v2 = cl.clean_stooq(raw, "v2", as_of="2025-06-30")
    # kept: 20240131, 20240104 (long time is not checked by the cleaners), 20240105
    assert sorted(r["<DATE>"] for r in v1.collect()) == ["20240104", "20240105", "20240131"]
    assert v2.count() == 3
    counts = cl.clean_counts(raw, "v1", as_of="2025-06-30").first()
    assert (counts["original_rows"], counts["after_year_filter"], counts["after_date_parse"],
            counts["after_numeric_check"]) == (10, 6, 5, 3)


def test_conform_schema(spark):
    df = spark.createDataFrame([("X", "2024-01-02 03:04:05", "1.5", 7, "junk")],
                               "ticker string, timestamp string, close string, vol long, extra string")
    out = st.conform_schema(df, fmt="csv").first()
    assert out["timestamp"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert out["close"] == 1.5 and out["vol"] == 7.0 and out["open"] is None and out["format"] == "csv"
    assert "extra" not in st.conform_schema(df).columns


def test_column_profile(spark):
    df = spark.createDataFrame([("AAPL", dt.datetime(2024, 1, 1), 1.0, True)],
                               "ticker string, timestamp timestamp, close double, flag boolean")
    prof = {r["column_name"]: r for r in st.column_profile(df).collect()}
    assert prof["ticker"]["width"] == 32 and prof["ticker"]["anchor"] == "w"
    assert prof["timestamp"]["width"] == 120 and prof["close"]["anchor"] == "e"
    assert prof["flag"]["width"] == 100


def test_dedupe_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "t string, v double")
    assert cl.dedupe(df).count() == 2
    c = cl.dedupe_count(df).first()
    assert (c["rows_before"], c["rows_after"], c["duplicates_removed"]) == (3, 2, 1)
    assert cl.drop_nulls(df).count() == 2
    assert cl.drop_nulls_count(df).first()["rows_dropped"] == 1


def test_issue_hints(spark):
    df = spark.createDataFrame([("File not found",), ("File is empty",), ("Bad FORMAT",), ("Permission denied",),
                                ("boom",)], "error string")
    kinds = [r["hint_kind"] for r in cl.issue_hints(df).collect()]
    assert kinds == ["not_found", "empty", "format", "permission", "other"]


def test_standardize_empty_raises(raw):
    with pytest.raises(ValueError):
        st.standardize_stooq(raw.filter(F.col("`<DATE>`") == "nan"), require_rows=True)
