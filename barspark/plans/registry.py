"""Named queries over the driver tables: Spark side and DuckDB oracle side.

Each query reads the whole table(s) it names from ``sf_dir`` and returns a DataFrame
whose column names match the oracle SQL of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` as query ``name`` with an optional DuckDB oracle SQL string."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from barspark.plans import q_clean, q_files, q_indicators, q_layouts, q_learning, q_ml, q_quality, q_relational, q_timeseries  # noqa: F401
