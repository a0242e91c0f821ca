"""SQL text shared by the DuckDB oracles (same derivations as ``sources.driver_tables``)."""

EVENTS_BARS = """
SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, ts AS "timestamp", value AS open,
       value * 1.05 AS high, value * 0.95 AS low, value AS close,
       CAST(event_id % 1000 AS DOUBLE) AS vol,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE 0.0::DOUBLE END AS openint,
       event_type AS format, event_id AS seq
FROM events
"""

ORDERS_BARS = """
SELECT 'C' || CAST(o_custkey AS VARCHAR) AS ticker, o_orderdate AS "timestamp", o_totalprice AS open,
       o_totalprice * 1.05 AS high, o_totalprice * 0.95 AS low, o_totalprice AS close,
       CAST(o_orderkey % 1000 AS DOUBLE) AS vol,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 0.0::DOUBLE END AS openint,
       o_orderstatus AS format, o_orderkey AS seq
FROM orders
"""


def ema_sql(src: str, value: str, span: float, out: str, key: str = "ticker", pos: str = "rn",
            carry: str = "") -> str:
    """Exact pandas EMA by self-join on the position within the key (oracle only)."""
    q = 1.0 - 2.0 / (span + 1.0)
    extra = ", ".join(f"a.{c}" for c in carry.split(",") if c.strip())
    extra = (extra + ", ") if extra else ""
    return f"""
SELECT a.{key}, a.{pos}, {extra}
       SUM(power({q!r}, a.{pos} - b.{pos}) * b.{value})
         / NULLIF(SUM(CASE WHEN b.{value} IS NULL THEN 0.0 ELSE power({q!r}, a.{pos} - b.{pos}) END), 0) AS {out}
FROM {src} a JOIN {src} b ON a.{key} = b.{key} AND b.{pos} <= a.{pos}
GROUP BY ALL
"""


NUDGE = 5e-9  # moves exact decimal ties (common with 2-decimal prices) off the rounding edge


def rnd(expr: str, places: int = 6) -> str:
    """Rounded double as compared by the oracle; ``+ 0.0`` turns -0.0 into 0.0."""
    return f"(round(({expr}) + {NUDGE}, {places}) + 0.0)"


EVENTS_STOOQ = r"""
SELECT 'U' || CAST(user_id AS VARCHAR) AS "<TICKER>", '5' AS "<PER>",
  CASE event_id % 97 WHEN 1 THEN strftime(ts, '%Y') || '13' || strftime(ts, '%d')
                     WHEN 2 THEN '1850' || strftime(ts, '%m%d')
                     WHEN 3 THEN '2999' || strftime(ts, '%m%d')
                     WHEN 9 THEN '2026' || strftime(ts, '%m%d')
                     WHEN 5 THEN '' WHEN 6 THEN 'nan' ELSE strftime(ts, '%Y%m%d') END AS "<DATE>",
  CAST(CAST(strftime(ts, '%H%M%S') AS INTEGER) AS VARCHAR) AS "<TIME>",
  CASE WHEN event_id % 97 = 8 THEN 'nan' ELSE CAST(value AS VARCHAR) END AS "<OPEN>",
  CAST(value * 1.05 AS VARCHAR) AS "<HIGH>", CAST(value * 0.95 AS VARCHAR) AS "<LOW>",
  CASE event_id % 97 WHEN 4 THEN 'N/A' WHEN 7 THEN CAST(value AS VARCHAR) || 'd'
                     ELSE CAST(value AS VARCHAR) END AS "<CLOSE>",
  CAST(event_id % 1000 AS VARCHAR) AS "<VOL>",
  CASE WHEN event_id % 10 = 0 THEN '' ELSE '0' END AS "<OPENINT>",
  event_id AS seq
FROM events
"""


def num_sql(x: str) -> str:
    """Text → DOUBLE when it is a plain number, else NULL (same rule as ``functions.numeric``)."""
    return (f"(CASE WHEN regexp_full_match({x}, '\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END)")


def stooq_ts_sql(date: str = '"<DATE>"', time: str = '"<TIME>"') -> str:
    t = f"(CASE WHEN length(trim({time})) >= 6 THEN trim({time}) ELSE lpad(trim({time}), 6, '0') END)"
    text = f"(trim({date}) || {t})"
    return f"(CASE WHEN length({text}) = 14 THEN try_strptime({text}, '%Y%m%d%H%M%S') END)"


def stooq_bars_sql(src: str = "raw", keep: str = ", seq", openint: bool = True) -> str:
    oi = num_sql('"<OPENINT>"') if openint else "NULL::DOUBLE"
    return f"""SELECT * FROM (SELECT "<TICKER>" AS ticker, {stooq_ts_sql()} AS "timestamp",
  {num_sql('"<OPEN>"')} AS open, {num_sql('"<HIGH>"')} AS high, {num_sql('"<LOW>"')} AS low,
  {num_sql('"<CLOSE>"')} AS close, {num_sql('"<VOL>"')} AS vol, {oi} AS openint, 'txt' AS format{keep}
  FROM {src}) WHERE "timestamp" IS NOT NULL AND close IS NOT NULL"""
