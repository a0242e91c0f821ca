"""Column helpers and small listing operators."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barspark.functions.columns import base_name, file_extension, file_stem, numeric, parent_dir, rounded, rounded_many, stooq_timestamp
from barspark.operators import profile as pf
from barspark.sources import sinks as sk


def test_numeric_rules(spark):
    vals = ["1.5", " 2 ", "-3e2", ".5", "nan", "1d", "N/A", "", None, "inf", "1e999"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r["n"] for r in df.select(numeric("x").alias("n")).collect()]
    assert got[:4] == [1.5, 2.0, -300.0, 0.5]
    assert got[4:10] == [None] * 6
    assert got[10] == float("inf")


def test_stooq_timestamp(spark):
    rows = [("20240131", "93000"), ("20240131", "0"), ("20240131", None), ("20240131", "1234567"), ("2024013", "0")]
    df = spark.createDataFrame(rows, "d string, t string")
    got = [r["ts"] for r in df.select(stooq_timestamp("d", "t").alias("ts")).collect()]
    assert got == [dt.datetime(2024, 1, 31, 9, 30), dt.datetime(2024, 1, 31), None, None, None]


def test_rounding_of_many_rows(spark):
    """The same doubles, near ties, of large ones and of what is no number too; few take the decimal way."""
    near = spark.range(-4000, 4000).selectExpr("explode(array(id / 1e6, id / 2e6, id / 1e6 + 5e-7, id / 1e6 + 5e-7 - 5e-9, id / 1e6 + 4.99e-7, id / 1e3 + 1e-10, id * 1e9 + 0.1234565, id / 7)) x")
    odd = spark.createDataFrame([(x,) for x in (None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -5e-9, -1e-9, 1e300, 5e-324, 0.99999949, -1.0)], "x double")
    for places in (6, 2):
        got = near.unionByName(odd).select(rounded("x", places).alias("a"), rounded_many("x", places).alias("b")).collect()
        assert len(got) == 64_012 and [repr(r.a) for r in got] == [repr(r.b) for r in got]


def test_path_parts(spark):
    df = spark.createDataFrame([("/data/daily/us/aapl.us.txt",), ("x",)], "p string")
    r = df.select(base_name("p").alias("b"), file_stem("p").alias("s"), file_extension("p").alias("e"),
                  parent_dir("p").alias("d")).collect()
    assert (r[0]["b"], r[0]["s"], r[0]["e"], r[0]["d"]) == ("aapl.us.txt", "aapl", ".txt", "/data/daily/us")
    assert (r[1]["b"], r[1]["s"], r[1]["e"], r[1]["d"]) == ("x", "x", "", "")


def test_directory_rollup(spark):
    df = spark.createDataFrame([("/r/a/x.txt", 1048576), ("/r/a/y.csv", 2097152), ("/r/z.txt", 0)],
                               "path string, length long")
    out = {(r["group_kind"], r["group"]): (r["files"], r["total_size_mb"])
           for r in pf.directory_rollup(df, "/r").collect()}
    assert out[("extension", ".txt")] == (2, 1.0) and out[("extension", ".csv")] == (1, 2.0)
    assert out[("directory", "a")] == (2, 3.0) and out[("directory", ".")] == (1, 0.0)
    assert out[("total", "")] == (3, 3.0)


def test_export_and_convert(spark, tmp_dir):
    rows = [("T", dt.datetime(2024, 1, 1 + i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "ticker string, timestamp timestamp, close double")
    with pytest.raises(ValueError):
        sk.export_view(df, os.path.join(tmp_dir, "x.xlsx"), "excel")
    out = os.path.join(tmp_dir, "exp")
    sk.export_view(df, out, "json", [{"column": "close", "operator": "greater_equal", "value": 3}])
    assert spark.read.json(out).count() == 2
    dst = os.path.join(tmp_dir, "conv")
    conv = sk.convert(spark, out, dst, "json", "parquet", tag="json")
    back = spark.read.parquet(dst)
    assert back.count() == 2 and back.first()["format"] == "json" and conv.columns == back.columns
