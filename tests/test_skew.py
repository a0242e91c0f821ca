"""A ticker holding a third of all rows is spread over many tasks and window blocks."""

from pyspark.sql import functions as F

from barspark.operators.indicators import technical_indicators
from barspark.operators.ordering import _cols, _tagged, release_positions, with_blocks


def _hot_bars(spark, n=30000):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), (F.col("id") % 50).cast("string")))
        .alias("ticker"),
        F.col("id").alias("t"), (F.lit(100.0) + F.sin(F.col("id"))).alias("close"))
    return df


def test_hot_ticker_spans_range_partitions(spark):
    df = _hot_bars(spark)
    tagged = _tagged(df, _cols(["ticker", "t"]))
    per_pid = {r["_pid"]: r["n"] for r in tagged.filter(F.col("ticker") == "HOT").groupBy("_pid")
               .agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(per_pid.values())
    assert total == 10000
    assert len(per_pid) >= 2 and max(per_pid.values()) < total
    release_positions()


def test_hot_ticker_spans_window_blocks(spark):
    df = _hot_bars(spark)
    b = with_blocks(df, ["ticker"], ["t"], block_rows=2048, halo=64)
    blocks = b.filter((F.col("ticker") == "HOT") & ~F.col("_halo")).select("_blk").distinct().count()
    assert blocks >= 5
    biggest = b.groupBy("ticker", "_blk").count().agg(F.max("count")).first()[0]
    assert biggest <= 2048 + 64
    out = technical_indicators(df, order=("t",), block_rows=2048, which=("sma",))
    assert out.filter(F.col("ticker") == "HOT").count() == 10000
    release_positions()


def test_group_of_copies_is_split(spark, tmp_dir):
    import os

    import pandas as pd

    from barspark.operators.sampling import balance_tickers
    rows = [("HOT", 0, 1.0)] * 3000 + [(f"T{i % 30}", i, float(i)) for i in range(6000)]
    path = os.path.join(tmp_dir, "copies")
    spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "t", "close"])).repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    tagged = _tagged(df, _cols(["ticker", "t"]), split_copies=True)
    hot_parts = tagged.filter(F.col("ticker") == "HOT").select("_pid").distinct().count()
    assert hot_parts >= 2
    out = balance_tickers(df, target=100, minimum=10, order=("t",), split_copies=True)
    counts = {r["ticker"]: r["count"] for r in out.groupBy("ticker").count().collect()}
    assert counts["HOT"] == 100 and all(v == 100 for v in counts.values()) and len(counts) == 31
    release_positions()
