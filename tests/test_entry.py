"""The driver contract: entry runs, every oracle has a query, and a sample of oracles agree."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "macd_signal" in df.columns and df.count() > 0


def test_oracles_have_queries():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat") and not isinstance(v, str):
        return str(v)
    return v


@pytest.mark.parametrize("name", ["technical_indicators", "balance_tickers", "timestamp_analysis", "gap_days",
                                  "describe", "prepare_dataset", "clean_v2", "ticker_neighbors", "page_deep",
                                  "sequences", "normalize_robust", "filter_conjunction"])
def test_query_matches_oracle(spark, name):
    sdf = entry.queries()[name](spark, SF0001)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    idx = sorted(range(len(names)), key=lambda i: names[i])
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert cols == sorted(names)
    assert got == exp


def test_oracle_column_types_match(spark):
    from scripts.check_types import MAP, TABLES as T2
    con = duckdb.connect()
    for t in T2:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    qs, orc = entry.queries(), entry.oracle_sql()
    bad = {}
    for name in sorted(orc):
        s = {f.name: MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in qs[name](spark, SF0001).schema}
        d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {orc[name]}").fetchall()}
        if s != d:
            bad[name] = (s, d)
    assert not bad
