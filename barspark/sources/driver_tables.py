"""Bars and raw Stooq text derived from the driver's parquet tables.

``events`` is the main bar source (one ticker per user); ``orders`` gives bars whose
timestamps tie (one ticker per customer). ``seq`` is a unique tie-breaker carried
next to the nine bar columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.schema import BAR_COLUMNS
from barspark.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bars(ticker: Column, ts: Column, price: Column, key: Column, fmt: Column) -> list[Column]:
    return [
        ticker.alias("ticker"),
        ts.alias("timestamp"),
        price.alias("open"),
        (price * F.lit(1.05)).alias("high"),
        (price * F.lit(0.95)).alias("low"),
        price.alias("close"),
        (key % 1000).cast("double").alias("vol"),
        F.when(key % 10 == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)).alias("openint"),
        fmt.alias("format"),
        key.alias("seq"),
    ]


def events_bars(spark: SparkSession, sf_dir: str, with_seq: bool = True) -> DataFrame:
    """``events`` as bars: ticker ``U<user_id>``, price ``value``, tie-breaker ``event_id``."""
    ev = table(spark, sf_dir, "events")
    df = ev.select(*_bars(F.concat(F.lit("U"), F.col("user_id").cast("string")), F.col("ts"),
                          F.col("value"), F.col("event_id"), F.col("event_type")))
    return df if with_seq else df.select(*BAR_COLUMNS)


def orders_bars(spark: SparkSession, sf_dir: str, with_seq: bool = True) -> DataFrame:
    """``orders`` as bars: ticker ``C<o_custkey>``, price ``o_totalprice``; timestamps tie."""
    o = table(spark, sf_dir, "orders")
    df = o.select(*_bars(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.col("o_orderdate"),
                         F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_orderstatus")))
    return df if with_seq else df.select(*BAR_COLUMNS)


def events_stooq_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as raw Stooq text columns (all strings), with damaged rows.

    Damage follows ``event_id % 97``: 1 month 13, 2 year 1850, 3 year 2999, 4 close
    ``N/A``, 5 empty date, 6 date ``nan``, 7 close with a trailing ``d``, 8 open ``nan``, 9 year 2026
    (which only the first cleaner keeps as of 2025).
    ``<TIME>`` carries no leading zeros, as in the raw files. ``seq`` is the row order.
    """
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id") % 97
    ymd = F.date_format("ts", "yyyyMMdd")
    mmdd = F.date_format("ts", "MMdd")
    date = (F.when(k == 1, F.concat(F.date_format("ts", "yyyy"), F.lit("13"), F.date_format("ts", "dd")))
            .when(k == 2, F.concat(F.lit("1850"), mmdd))
            .when(k == 3, F.concat(F.lit("2999"), mmdd))
            .when(k == 9, F.concat(F.lit("2026"), mmdd))
            .when(k == 5, F.lit(""))
            .when(k == 6, F.lit("nan"))
            .otherwise(ymd))
    time = F.date_format("ts", "HHmmss").cast("int").cast("string")
    v = F.col("value")
    close = (F.when(k == 4, F.lit("N/A"))
             .when(k == 7, F.concat(F.col("value").cast("string"), F.lit("d")))
             .otherwise(v.cast("string")))
    opn = F.when(k == 8, F.lit("nan")).otherwise(v.cast("string"))
    return ev.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("<TICKER>"),
        F.lit("5").alias("<PER>"),
        date.alias("<DATE>"),
        time.alias("<TIME>"),
        opn.alias("<OPEN>"),
        (v * F.lit(1.05)).cast("string").alias("<HIGH>"),
        (v * F.lit(0.95)).cast("string").alias("<LOW>"),
        close.alias("<CLOSE>"),
        (F.col("event_id") % 1000).cast("string").alias("<VOL>"),
        F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.lit("0")).alias("<OPENINT>"),
        F.col("event_id").alias("seq"),
    )
