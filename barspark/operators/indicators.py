"""Technical indicators per ticker: SMA, EMA, MACD, RSI, Bollinger bands.

Semantics follow pandas on one ticker's rows in time order:

* SMA(n): mean of the last n closes, NULL until n non-null values are in the frame.
* EMA(span): ``ewm(span, adjust=True)`` – the ratio of two decaying sums with
  ``q = 1 - 2/(span+1)``; NULL rows keep their place (weights still decay); defined from
  the first non-null value on.
* MACD = EMA12 - EMA26; signal = EMA9 of MACD; histogram = MACD - signal.
* RSI(14): simple means of gains and losses over 14 rows (the first delta counts as 0);
  zero loss with positive gain gives 100, both zero give NULL.
* Bollinger(20, 2): SMA20 ± 2 · sample standard deviation over 20 rows.

Execution: :func:`barspark.operators.ordering.with_blocks` numbers rows globally and cuts
them into bounded ``(ticker, _blk)`` partitions with a halo of preceding rows, so no
ticker, however large, lands in one task. The EMA is built from native window sums:
rows are grouped in runs of 64 (``_b``); inside a run the prefix sums of ``x·q^-p`` give
the local part, and the K previous runs' end values (read with ``rangeBetween(-k,-k)``
frames on ``_b``) give the carry, truncated once ``q^(64K)`` is below 1e-17. A NULL price
repeats the average of the last row that has one, however far back: within a block by a
window, across blocks by a table of one row per (ticker, block) (:func:`_filled`). That step
runs only if some price is NULL.
NaN prices count as NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, into_blocks, with_blocks

RUN = 64  # rows per EMA run; keeps q^-p within double range for spans >= 3


def ema_runs_needed(span: float) -> int:
    """Number of previous 64-row runs whose weight is still above 1e-17."""
    q = 1.0 - 2.0 / (span + 1.0)
    if q <= 0.0:
        return 1
    return max(1, math.ceil(math.log(1e-17) / (RUN * math.log(q))))


def indicator_halo(spans: Sequence[float] = (12, 26, 9), windows: Sequence[int] = (50,)) -> int:
    """Rows of history a block needs so every indicator is exact after the block start."""
    ema = RUN * (ema_runs_needed(max(spans[:2])) + ema_runs_needed(spans[-1]) + 1)
    return max(ema, max(windows) - 1 if windows else 0)


def _ema(x: Column, span: float, part: Sequence[str]) -> Column:
    """EMA expression; needs columns ``_g`` and ``_b`` and partitions ``part`` (+ ``_b``)."""
    q = 1.0 - 2.0 / (span + 1.0)
    p = (F.col("_g") % F.lit(RUN)).cast("double")
    scale = F.pow(F.lit(q), -p)
    xv = F.coalesce(x, F.lit(0.0)) * scale
    wv = F.when(x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)) * scale
    in_run = Window.partitionBy(*part, "_b").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    whole_run = Window.partitionBy(*part, "_b")
    num_local = F.sum(xv).over(in_run)
    den_local = F.sum(wv).over(in_run)
    end_factor = q ** (RUN - 1)
    num_end = F.sum(xv).over(whole_run) * F.lit(end_factor)
    den_end = F.sum(wv).over(whole_run) * F.lit(end_factor)
    k_runs = ema_runs_needed(span)
    big_q = q ** RUN
    num_carry = F.lit(0.0)
    den_carry = F.lit(0.0)
    for k in range(1, k_runs + 1):
        back = Window.partitionBy(*part).orderBy("_b").rangeBetween(-k, -k)
        w = big_q ** (k - 1)
        num_carry = num_carry + F.coalesce(F.first(num_end).over(back), F.lit(0.0)) * F.lit(w)
        den_carry = den_carry + F.coalesce(F.first(den_end).over(back), F.lit(0.0)) * F.lit(w)
    num = num_local + F.lit(q) * num_carry
    den = den_local + F.lit(q) * den_carry
    return F.when(x.isNotNull(), num / den)


def _filled(own: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """NULLs of ``columns`` take the ticker's last value before them: within the block by a window, else the last
    value of the nearest earlier block that has one. ``own`` holds each row once (no halo)."""
    ends = own.groupBy(key, "_blk").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_g"))).alias(f"_end{i}") for i, c in enumerate(columns)])
    older = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col(key).alias("_ck"), F.col("_blk").alias("_cb"), *[
        F.last(f"_end{i}", True).over(older).alias(f"_carry{i}") for i in range(len(columns))])
    seen = Window.partitionBy(key, "_blk").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(carry, F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_blk") == F.col("_cb")), "left")
    return (out.withColumns({c: F.coalesce(F.last(c, True).over(seen), F.col(f"_carry{i}")) for i, c in enumerate(columns)})
            .drop("_ck", "_cb", *[f"_carry{i}" for i in range(len(columns))]))


def _rolling(part: Sequence[str], n: int) -> Window:
    return Window.partitionBy(*part).orderBy("_b", "_g").rowsBetween(-(n - 1), 0)


def _full(agg: Column, x: Column, part: Sequence[str], n: int) -> Column:
    """``agg`` over the last n rows, NULL unless all n carry a value (pandas min_periods=n)."""
    return F.when(F.count(x).over(_rolling(part, n)) == n, agg.over(_rolling(part, n)))


def technical_indicators(df: DataFrame, key: str = "ticker", order: Sequence[str] = ("timestamp",),
                         price: str = "close", block_rows: int = DEFAULT_BLOCK_ROWS,
                         sma_windows: Sequence[int] = (20, 50), ema_spans: Sequence[float] = (12, 26),
                         signal_span: float = 9, rsi_window: int = 14, bb_window: int = 20,
                         bb_k: float = 2.0, which: Sequence[str] | None = None,
                         split_copies: bool = False) -> DataFrame:
    """Add indicator columns to ``df`` (all input columns are kept).

    ``which`` limits the output to some of ``sma``, ``ema``, ``macd``, ``rsi``, ``bollinger``.
    ``order`` must order each ticker's rows; add a unique tie-breaker when timestamps tie.
    """
    which = set(which or ("sma", "ema", "macd", "rsi", "bollinger"))
    cols = df.columns
    spans = (*ema_spans, signal_span)
    halo = indicator_halo(spans, (*sma_windows, rsi_window + 1, bb_window))
    halo = int(math.ceil(halo / RUN) * RUN)
    block_rows = max(block_rows, halo)
    block_rows = int(math.ceil(block_rows / RUN) * RUN)
    part = [key, "_blk"]
    x = F.nanvl(F.col(price).cast("double"), F.lit(None).cast("double"))
    gaps = bool({"ema", "macd"} & which) and df.filter(x.isNull()).limit(1).count() > 0
    b = (with_blocks(df, [key], list(order), block_rows, halo, split_copies)
         .repartition(key, "_blk")
         .withColumn("_b", F.floor(F.col("_g") / F.lit(RUN)).cast("long")))
    # Columns are added in four dependency stages (withColumns analyses each stage once).
    stages: list[dict[str, Column]] = [{}, {}, {}, {}]
    out = []
    if "sma" in which:
        for n in sma_windows:
            stages[0][f"sma_{n}"] = _full(F.avg(x), x, part, n)
            out.append(f"sma_{n}")
    if {"ema", "macd"} & which:
        fast, slow = ema_spans
        ef, es = f"ema_{fast:g}", f"ema_{slow:g}"
        stages[0][ef] = _ema(x, fast, part)
        stages[0][es] = _ema(x, slow, part)
        if "ema" in which:
            out += [ef, es]
        if "macd" in which:
            out += ["macd", "macd_signal", "macd_histogram"]
            if not gaps:
                stages[1]["macd"] = F.col(ef) - F.col(es)
                stages[2]["macd_signal"] = _ema(F.col("macd"), signal_span, part)
                stages[3]["macd_histogram"] = F.col("macd") - F.col("macd_signal")
    if "rsi" in which:
        prev = F.lag(x, 1).over(Window.partitionBy(*part).orderBy("_b", "_g"))
        stages[0]["_delta"] = x - prev
        stages[1]["_gain"] = F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(F.lit(0.0))
        stages[1]["_loss"] = F.when(F.col("_delta") < 0, -F.col("_delta")).otherwise(F.lit(0.0))
        stages[2]["_ag"] = _full(F.avg("_gain"), F.col("_gain"), part, rsi_window)
        stages[2]["_al"] = _full(F.avg("_loss"), F.col("_loss"), part, rsi_window)
        stages[3]["rsi"] = (F.when(F.col("_al") > 0,
                                   F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("_ag") / F.col("_al")))
                            .when(F.col("_ag") > 0, F.lit(100.0)))
        out.append("rsi")
    if "bollinger" in which:
        stages[0]["bb_middle"] = _full(F.avg(x), x, part, bb_window)
        stages[0]["_sd"] = _full(F.stddev_samp(x), x, part, bb_window)
        stages[1]["bb_upper"] = F.col("bb_middle") + F.lit(bb_k) * F.col("_sd")
        stages[1]["bb_lower"] = F.col("bb_middle") - F.lit(bb_k) * F.col("_sd")
        out += ["bb_middle", "bb_upper", "bb_lower"]
    for stage in stages:
        if stage:
            b = b.withColumns(stage)
    b = b.filter(~F.col("_halo"))
    if gaps:
        b = _filled(b, [ef, es], key)
        if "macd" in which:
            # the signal looks back over filled values, so blocks get their halo anew
            b = into_blocks(b.withColumn("macd", F.col(ef) - F.col(es)).drop("_blk", "_halo"), block_rows, halo).repartition(key, "_blk")
            b = b.withColumn("macd_signal", _ema(F.col("macd"), signal_span, part)).filter(~F.col("_halo"))
            b = b.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return b.select(*cols, *out)


def sma(df: DataFrame, **kw) -> DataFrame:
    return technical_indicators(df, which=("sma",), **kw)


def ema(df: DataFrame, **kw) -> DataFrame:
    return technical_indicators(df, which=("ema",), **kw)


def macd(df: DataFrame, **kw) -> DataFrame:
    return technical_indicators(df, which=("macd",), **kw)


def rsi(df: DataFrame, **kw) -> DataFrame:
    return technical_indicators(df, which=("rsi",), **kw)


def bollinger(df: DataFrame, **kw) -> DataFrame:
    return technical_indicators(df, which=("bollinger",), **kw)
