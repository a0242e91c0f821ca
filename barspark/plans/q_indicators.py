"""Indicator queries (W1–W6) over bars from ``events``."""

from __future__ import annotations

from barspark.operators import indicators as ind
from barspark.plans.registry import query
from barspark.functions.columns import rounded
from barspark.plans.sql_fragments import EVENTS_BARS, ORDERS_BARS, ema_sql, rnd
from barspark.sources.driver_tables import events_bars, orders_bars

ORDER = ("timestamp", "seq")
KEYS = ["ticker", "timestamp", "seq", "close"]
R = 4  # decimals kept for compared window results

def _base(bars_sql: str) -> str:
    return f"""
WITH bars AS ({bars_sql}),
r AS (SELECT ticker, "timestamp", seq, close,
             row_number() OVER (PARTITION BY ticker ORDER BY "timestamp", seq) - 1 AS rn
      FROM bars),
w AS (SELECT *,
        CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma_20,
        CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_50,
        CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS sd_20,
        close - lag(close) OVER (PARTITION BY ticker ORDER BY rn) AS delta
      FROM r
      WINDOW w20 AS (PARTITION BY ticker ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
             w50 AS (PARTITION BY ticker ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0.0 END AS gain,
                CASE WHEN delta < 0 THEN -delta ELSE 0.0 END AS loss FROM w),
rs AS (SELECT *,
         CASE WHEN count(*) OVER w14 = 14 THEN avg(gain) OVER w14 END AS ag,
         CASE WHEN count(*) OVER w14 = 14 THEN avg(loss) OVER w14 END AS al
       FROM g WINDOW w14 AS (PARTITION BY ticker ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
e12 AS ({ema_sql('r', 'close', 12, 'ema_12')}),
e26 AS ({ema_sql('r', 'close', 26, 'ema_26')}),
m AS (SELECT e12.ticker, e12.rn, ema_12, ema_26, ema_12 - ema_26 AS macd
      FROM e12 JOIN e26 ON e12.ticker = e26.ticker AND e12.rn = e26.rn),
s AS ({ema_sql('m', 'macd', 9, 'macd_signal')}),
allx AS (
  SELECT rs.ticker, rs."timestamp", rs.seq, rs.close, sma_20, sma_50, ema_12, ema_26, m.macd,
         s.macd_signal, m.macd - s.macd_signal AS macd_histogram,
         CASE WHEN al > 0 THEN 100.0 - 100.0 / (1.0 + ag / al) WHEN ag > 0 THEN 100.0 END AS rsi,
         sma_20 AS bb_middle, sma_20 + 2.0 * sd_20 AS bb_upper, sma_20 - 2.0 * sd_20 AS bb_lower
  FROM rs JOIN m ON rs.ticker = m.ticker AND rs.rn = m.rn
          JOIN s ON rs.ticker = s.ticker AND rs.rn = s.rn)
"""


_BASE = _base(EVENTS_BARS)

_GROUPS = {
    "sma": ["sma_20", "sma_50"],
    "ema": ["ema_12", "ema_26"],
    "macd": ["macd", "macd_signal", "macd_histogram"],
    "rsi": ["rsi"],
    "bollinger": ["bb_middle", "bb_upper", "bb_lower"],
}
_ALL = [c for g in _GROUPS.values() for c in g]


def _oracle(cols: list[str], base: str = _BASE, places: int = R) -> str:
    sel = ", ".join(f"{rnd(c, places)} AS {c}" for c in cols)
    return f"{base} SELECT ticker, \"timestamp\", seq, close, {sel} FROM allx"


def _spark(spark, sf_dir, which, cols, block_rows=ind.DEFAULT_BLOCK_ROWS):
    bars = events_bars(spark, sf_dir)
    out = ind.technical_indicators(bars, order=ORDER, which=which, block_rows=block_rows)
    return out.select(*KEYS, *[rounded(c, R).alias(c) for c in cols])


def technical_indicators_query(spark, sf_dir, block_rows=ind.DEFAULT_BLOCK_ROWS):
    return _spark(spark, sf_dir, None, _ALL, block_rows)


query("technical_indicators", _oracle(_ALL))(technical_indicators_query)

for _name, _cols in _GROUPS.items():
    def _make(which=_name, cols=_cols):
        return lambda spark, sf_dir: _spark(spark, sf_dir, (which,), cols)
    query(_name, _oracle(_cols))(_make())


R_TIED = 2  # order prices are ~1e5, so fewer decimals keep the same relative precision


@query("indicators_tied_timestamps", _oracle(_ALL, _base(ORDERS_BARS), R_TIED))
def q_indicators_tied(spark, sf_dir):
    """Bars from ``orders``: many share a timestamp; ``seq`` (the order key) breaks ties."""
    out = ind.technical_indicators(orders_bars(spark, sf_dir), order=ORDER)
    return out.select(*KEYS, *[rounded(c, R_TIED).alias(c) for c in _ALL])
