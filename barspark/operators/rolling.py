"""Rolling median and median absolute deviation, and outliers by them.

Blocks carry a halo of the window's earlier rows. Rows stream through a task in order; each Arrow batch is
joined to the last rows of the one before, and order statistics of all its windows are selected (not sorted) by numpy at
once, so memory is one batch of windows and the work grows with rows, whatever the length of a ticker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, with_blocks

#: Values held in windows at once, and what makes a median absolute deviation comparable to a standard deviation.
WINDOW_VALUES, NORMAL = 1 << 20, 1.4826


def _middle(windows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the ``n`` numbers of each row; the others are NaN. NaN where n is 0."""
    width = windows.shape[1]
    out = np.full(len(windows), np.nan)
    full = n == width
    if full.any():
        low, high = (width - 1) // 2, width // 2
        part = np.partition(windows[full], sorted({low, high}), axis=1)
        out[full] = (part[:, low] + part[:, high]) / 2
    some = np.flatnonzero(~full & (n > 0))
    if len(some):
        part, k = np.sort(windows[some], axis=1), n[some]  # NaN sorts last
        rows = np.arange(len(some))
        out[some] = (part[rows, (k - 1) // 2] + part[rows, k // 2]) / 2
    return out


def rolling_mad(x: np.ndarray, group: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of the last ``window`` values of the same (contiguous) group, up to each; NaN with fewer than ``least``."""
    median, mad = np.full(len(x), np.nan), np.full(len(x), np.nan)
    padded = np.concatenate([np.full(window - 1, np.nan), x])
    start = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1]) if len(x) else np.zeros(0, np.int64)
    first = np.repeat(start, np.diff(np.append(start, len(x))))
    step = max(1, WINDOW_VALUES // window)
    back = np.arange(window - 1, -1, -1)
    for a in range(0, len(x), step):
        at = np.arange(a, min(a + step, len(x)))
        w = np.lib.stride_tricks.sliding_window_view(padded, window)[at].copy()
        w[at[:, None] - back < first[at][:, None]] = np.nan
        n = (~np.isnan(w)).sum(1)
        m = _middle(w, n)
        d = _middle(np.abs(w - m[:, None]), n)
        enough = n >= least
        median[at[enough]], mad[at[enough]] = m[enough], d[enough]
    return median, mad


def with_rolling_mad(df: DataFrame, window: int, key: str = "ticker", order: Sequence[str] = ("timestamp",), price: str = "close",
                     least: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Add ``rolling_median`` and ``rolling_mad`` of ``price`` over the ticker's last ``window`` rows, the row itself included.

    NULL and NaN prices take a place in the window but no part in its statistics, which are NULL with fewer than ``least``
    prices (default: the whole window). Infinite prices take part; a MAD that is not finite is NULL. ``order``
    must make a ticker's rows distinct, else tied rows are interchangeable. NULL tickers are a ticker of their own.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    least = window if least is None else max(1, least)
    columns = df.columns
    value = F.nanvl(F.col(f"`{price}`").cast("double"), F.lit(None).cast("double"))
    b = with_blocks(df, [key], list(order), max(block_rows, window), window - 1).withColumn("_x", value)
    b = b.withColumn("_same", F.xxhash64(F.col(f"`{key}`"), F.col("_blk")))
    b = b.repartition("_blk").sortWithinPartitions("_blk", "_g")
    keep = [b.columns.index(c) for c in columns]
    x_at, same_at, halo_at = (b.columns.index(c) for c in ("_x", "_same", "_halo"))
    schema = T.StructType([*[b.schema.fields[i] for i in keep], T.StructField("rolling_median", T.DoubleType()), T.StructField("rolling_mad", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_x, held_same = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            x = np.concatenate([held_x, batch.column(x_at).to_numpy(zero_copy_only=False).astype(np.float64)])
            same = np.concatenate([held_same, batch.column(same_at).to_numpy()])
            with np.errstate(invalid="ignore"):
                median, mad = (v[len(held_x):] for v in rolling_mad(x, same, window, least))
            held_x, held_same = (v[max(0, len(v) - window + 1):] if window > 1 else v[:0] for v in (x, same))
            own = ~batch.column(halo_at).to_numpy(zero_copy_only=False).astype(bool)
            added = [pa.array(v, from_pandas=True) for v in (median, np.where(np.isfinite(mad), mad, np.nan))]
            out = pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *added], [f.name for f in schema.fields])
            yield out.filter(pa.array(own))

    return b.mapInArrow(run, schema)


def outliers(df: DataFrame, window: int = 101, limit: float = 5.0, key: str = "ticker", order: Sequence[str] = ("timestamp",),
             price: str = "close", least: int | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``df`` with ``rolling_median``, ``rolling_mad`` and ``is_outlier``: further from the median than ``limit`` scaled deviations.

    Where the deviation is 0 (most of the window is one value), every other value is an outlier. NULL where the window
    has no statistics or the price is NULL or NaN.
    """
    x = F.nanvl(F.col(f"`{price}`").cast("double"), F.lit(None).cast("double"))
    away = F.abs(x - F.col("rolling_median"))
    return with_rolling_mad(df, window, key, order, price, least, block_rows).withColumn("is_outlier", away > F.col("rolling_mad") * F.lit(limit * NORMAL))
