"""Balanced sampling across tickers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, with_key_rank
from barspark.operators.paging import ticker_counts
from barspark.operators.stats import exact_median


def balance_bounds(df: DataFrame, target: int | None = None, minimum: int | None = None,
                   ticker: str = "ticker", counted: bool = False) -> tuple[int, int]:
    """Default target = int(median of per-ticker counts); default minimum = target // 2.

    ``counted``: ``df`` already holds one ``ticker, records`` row per ticker.
    """
    if target is None:
        med = exact_median(df if counted else ticker_counts(df, ticker), "records")
        if med is None:
            raise ValueError("no tickers to balance")
        target = int(med)
    if minimum is None:
        minimum = target // 2
    return target, minimum


def balance_tickers(df: DataFrame, target: int | None = None, minimum: int | None = None,
                    order: Sequence[str] = ("timestamp",), ticker: str = "ticker",
                    block_rows: int = DEFAULT_BLOCK_ROWS, check_empty: bool = True,
                    split_copies: bool = False) -> DataFrame:
    """Even out rows per ticker.

    Tickers below ``minimum`` rows drop; tickers above ``target`` keep every
    ``n // target``-th row in time order, at most ``target`` rows; the rest stay whole.
    NULL tickers drop. Raises when no ticker reaches the minimum (``check_empty``).

    Row ranks come from :func:`with_key_rank`, so a ticker with a third of all rows is
    ranked by many tasks, not one; the per-ticker counts decide which rows need a rank.
    """
    # one row per ticker, aggregated once and reused by the median and the empty check
    counts = ticker_counts(df, ticker).cache()
    try:
        target, minimum = balance_bounds(counts, target, minimum, "ticker", counted=True)
        if target <= 0:
            raise ValueError("target must be positive")
        if check_empty and counts.filter(F.col("records") >= minimum).limit(1).count() == 0:
            raise ValueError("No tickers met the minimum record requirement")
    finally:
        counts.unpersist()
    # tickers at or below the target stay whole; only the rows of larger ones are ranked
    cols, records = df.columns, F.col("records")
    of = lambda keep: ticker_counts(df, ticker).where(keep).select(F.col("ticker").alias(ticker))
    whole = df.join(of((records >= minimum) & (records <= target)), ticker, "left_semi")
    large = df.join(of((records >= minimum) & (records > target)), ticker, "left_semi")
    ranked = with_key_rank(large, [ticker], list(order), block_rows, split_copies=split_copies)
    n, r = F.col("_n"), F.col("_r")
    step = (n / F.lit(target)).cast("long")
    keep = ((r % step) == 0) & (r < step * target)
    return whole.select(*cols).unionByName(ranked.filter(keep).select(*cols))
