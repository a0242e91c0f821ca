"""End-to-end jobs: files → clean merged bars (§3 A) and file → scaled features (§3 D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators.clean import dedupe, drop_nulls
from barspark.operators.features import normalize, numeric_columns
from barspark.operators.filters import date_range
from barspark.operators.sampling import balance_tickers
from barspark.schema import BAR_COLUMNS
from barspark.sources.readers import load
from barspark.sources.sinks import save


def prepare_bars(bars: DataFrame, start: str | None = None, end: str | None = None,
                 target: int | None = None, minimum: int | None = None, drop_null_rows: bool = False,
                 order: Sequence[str] = ("timestamp",), split_copies: bool = False) -> tuple[DataFrame, dict]:
    """Date range (both ends given) → balance (a bound given) → dedupe → optional NULL drop.

    Balancing runs before dedupe, so duplicates count towards the targets. Returns the
    plan and the steps applied; counts are left to the caller (each is a job).
    """
    steps = {}
    df = bars
    if start and end:
        df = date_range(df, start, end)
        steps["date_range"] = (start, end)
    if target is not None or minimum is not None:
        df = balance_tickers(df, target, minimum, order=order, split_copies=split_copies)
        steps["balance"] = (target, minimum)
    df = dedupe(df.select(*BAR_COLUMNS))
    steps["dedupe"] = True
    if drop_null_rows:
        df = drop_nulls(df)
        steps["drop_nulls"] = True
    return df, steps


def prepare_files(spark: SparkSession, paths, out: str, fmt: str | None = None, out_fmt: str | None = None,
                  **kw) -> DataFrame:
    """Load files, prepare them and write the result (one job for the write)."""
    df, _ = prepare_bars(load(spark, paths, fmt), **kw)
    save(df, out, out_fmt)
    return df


def preprocess_file(spark: SparkSession, path: str, out: str, fmt: str | None = None,
                    method: str = "minmax") -> DataFrame:
    """Load → numeric columns → scale → save (§3 D)."""
    df = load(spark, path, fmt)
    cols = numeric_columns(df)
    scaled = normalize(df.select(*[F.col(c) for c in cols]), method)
    save(scaled, out, "parquet")
    return scaled
