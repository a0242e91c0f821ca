"""Row positions and ranks stay exact with many partitions, tiny blocks and one hot key."""

import pandas as pd

from barspark.operators.ordering import global_position, with_blocks, with_key_rank


def _hot(spark, n=3000):
    # key "HOT" carries a third of the rows
    rows = [("HOT" if i % 3 == 0 else f"K{i % 37}", i, float(i % 11)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, t long, v double").repartition(7)


def test_global_position_is_dense_and_ordered(spark):
    df = _hot(spark)
    g = global_position(df, ["key", "t"]).toPandas()
    assert sorted(g["_g"]) == list(range(len(g)))
    expected = g.sort_values(["key", "t"])["_g"].tolist()
    assert expected == list(range(len(g)))


def test_key_rank_matches_pandas_with_small_blocks(spark):
    df = _hot(spark)
    r = with_key_rank(df, ["key"], ["t"], block_rows=64).toPandas()
    pdf = df.toPandas().sort_values(["key", "t"])
    pdf["rank"] = pdf.groupby("key").cumcount()
    pdf["n"] = pdf.groupby("key")["t"].transform("size")
    m = pdf.merge(r, on=["key", "t"])
    assert len(m) == len(pdf) == len(r)
    assert (m["rank"] == m["_r"]).all() and (m["n"] == m["_n"]).all()


def test_halo_rows_precede_block(spark):
    df = _hot(spark, 600)
    b = with_blocks(df, ["key"], ["t"], block_rows=128, halo=16).toPandas()
    halo = b[b["_halo"]]
    assert len(halo) > 0
    assert ((halo["_g"] // 128) + 1 == halo["_blk"]).all()
    assert len(b[~b["_halo"]]) == 600


def test_null_keys_drop_from_rank(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "key string, t long")
    r = with_key_rank(df, ["key"], ["t"]).orderBy("t").toPandas()
    assert r["_r"].tolist() == [0, 1]
