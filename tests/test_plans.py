"""Plan shape: filters and column pruning reach the Parquet scan; one range shuffle for positions."""

import os

from barspark.operators import filters as flt
from barspark.operators.ordering import global_position
from barspark.sources import readers as rd
from barspark.sources.driver_tables import events_bars
from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_parquet_scan(spark, tmp_dir):
    out = os.path.join(tmp_dir, "bars")
    events_bars(spark, SF001, with_seq=False).write.parquet(out)
    bars = rd.read_parquet(spark, out)
    q = flt.apply_conditions(bars, [{"column": "format", "operator": "equals", "value": "view"},
                                    {"column": "ticker", "operator": "equals", "value": "U42"}]).select("ticker", "close")
    plan = _plan(q)
    assert "PushedFilters: [IsNotNull(ticker), IsNotNull(format), EqualTo(format,view), EqualTo(ticker,U42)]" in plan \
        or "EqualTo(ticker,U42)" in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<ticker:string,close:double,format:string>" in plan
    d = flt.date_range(bars, "2024-01-03", "2024-01-07").select("timestamp")
    assert "GreaterThanOrEqual(timestamp" in _plan(d)


def test_number_conditions_reach_parquet_scan(spark, tmp_dir):
    """Stored doubles, floats and integers; NaN, infinities and NULL; the rows are those of filtering afterwards."""
    from pyspark.sql import functions as F
    out = os.path.join(tmp_dir, "bars")
    raw = spark.range(400).select(F.concat(F.lit("T"), F.col("id") % 3).alias("ticker"), F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"),
                                  F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 7 == 0, float("inf")).when(F.col("id") % 11 != 0, F.col("id").cast("double")).alias("close"),
                                  (F.col("id") / 2).cast("float").alias("open"), F.col("id").cast("int").alias("vol"), F.col("id").cast("string").alias("high"))
    raw.write.parquet(out)
    for conds, pushed in [([("close", "greater_than", 100)], "GreaterThan(close,100.0)"), ([("close", "less_equal", 50)], "LessThanOrEqual(close,50.0)"), ([("close", "equals", 12)], "EqualTo(close,12.0)"),
                          ([("close", "between", "10,20")], "GreaterThanOrEqual(close,10.0)"), ([("close", "in", [1, 2, 5])], "In(close"), ([("vol", "greater_equal", 390)], "GreaterThanOrEqual(vol,390)"),
                          ([("open", "less_than", 4.5)], "LessThan(open,4.5)"), ([("close", "not_equals", 3)], ""), ([("close", "is_null", None)], ""), ([("close", "is_not_null", None)], "IsNotNull(close)"),
                          ([("high", "greater_than", 395)], ""), ([("close", "greater_than", 300), ("ticker", "equals", "T1")], "EqualTo(ticker,T1)"), ([("low", "greater_than", 1)], "")]:
        conditions = [{"column": c, "operator": o, "value": v} for c, o, v in conds]
        df = rd.read_parquet(spark, out, conditions=conditions)
        assert pushed in _plan(df).split("PushedFilters: ")[1].split("], ReadSchema")[0] if "PushedFilters" in _plan(df) else not pushed
        assert sorted(map(str, df.collect())) == sorted(map(str, flt.apply_conditions(rd.read_parquet(spark, out), conditions).collect()))


def test_positions_use_one_range_shuffle(spark):
    b = events_bars(spark, SF001)
    g = global_position(b, ["ticker", "timestamp", "seq"])
    g.collect()
    final = _plan(g).split("== Initial Plan ==")[0]
    # both consumers (row counts and rows) read one materialised range-partitioned relation
    assert "TableCacheQueryStage" in final and "InMemoryTableScan" in final
    assert "REPARTITION_BY_NUM" in final
    pos = sorted(r["_g"] for r in g.select("_g").collect())
    assert pos == list(range(len(pos)))


def test_quality_figures_scan_once(spark):
    from barspark.operators import profile as pf
    bars = events_bars(spark, SF001)
    for out in (pf.file_quality(bars, "ticker", as_of="2024-01-15"), pf.gap_count(bars, "ticker"), pf.gap_days(bars, "ticker")):
        out.collect()
        final = _plan(out).split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") == 1


def test_business_days_match_a_calendar(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from barspark.operators.profile import _business_days
    start = dt.date(2024, 1, 1)
    pairs = [(start + dt.timedelta(a), start + dt.timedelta(a + n)) for a in range(9) for n in range(25)]
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", _business_days(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        days = [r["a"] + dt.timedelta(k) for k in range((r["b"] - r["a"]).days + 1)]
        assert r["n"] == sum(d.weekday() < 5 for d in days)
