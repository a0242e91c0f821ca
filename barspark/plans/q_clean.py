"""Standardisation, cleaning, dedupe, balance and the prepare job (T*, V*, W8, §3 A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import clean as cl
from barspark.operators import standardize as st
from barspark.operators.sampling import balance_tickers
from barspark.plans.prepare import prepare_bars
from barspark.plans.registry import query
from barspark.plans.sql_fragments import EVENTS_BARS, EVENTS_STOOQ, num_sql, stooq_bars_sql
from barspark.sources.driver_tables import events_bars, events_stooq_text, table

BAR_SQL = 'ticker, "timestamp", open, high, low, close, vol, openint, format, seq'
BAR9_SQL = 'ticker, "timestamp", open, high, low, close, vol, openint, format'
W = f"WITH bars AS ({EVENTS_BARS})"
WR = f"WITH raw AS ({EVENTS_STOOQ})"
AS_OF = "2025-06-30"


@query("standardize_stooq", f"{WR} {stooq_bars_sql()}")
def q_standardize_stooq(spark, sf_dir):
    return st.standardize_stooq(events_stooq_text(spark, sf_dir), keep=["seq"])


# Messy header names as found in hand-made files.
_MESSY = {"<TICKER>": "﻿<ticker>", "<PER>": " <Per> ", "<DATE>": "date", "<TIME>": "<Time>",
          "<OPEN>": "OPEN", "<HIGH>": "<high>", "<LOW>": " <LOW>", "<CLOSE>": "Close", "<VOL>": "<vol>"}


@query("standardize_lenient", f"{WR} {stooq_bars_sql(openint=False)}")
def q_standardize_lenient(spark, sf_dir):
    raw = events_stooq_text(spark, sf_dir).drop("<OPENINT>")
    messy = raw.select(*[F.col(f"`{c}`").alias(_MESSY.get(c, c)) for c in raw.columns])
    return st.standardize_lenient(messy, keep=["seq"])


@query("conform_schema", """SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, ts AS "timestamp",
NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, value AS close,
CAST(event_id AS DOUBLE) AS vol, NULL::DOUBLE AS openint, 'csv' AS format FROM events""")
def q_conform_schema(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    loose = ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
                      F.col("ts").cast("string").alias("timestamp"), F.col("value").cast("string").alias("close"),
                      F.col("event_id").alias("vol"), F.col("props").alias("extra"))
    return st.conform_schema(loose, fmt="csv")


@query("column_profile", f"""{W}
SELECT 'ticker' AS column_name, 'text' AS kind, 'w' AS anchor, CAST(least(max(length(ticker)) * 8, 200) AS INTEGER) AS width FROM bars
UNION ALL SELECT 'timestamp', 'datetime', 'center', 120
UNION ALL SELECT 'open', 'numeric', 'e', 80 UNION ALL SELECT 'high', 'numeric', 'e', 80
UNION ALL SELECT 'low', 'numeric', 'e', 80 UNION ALL SELECT 'close', 'numeric', 'e', 80
UNION ALL SELECT 'vol', 'numeric', 'e', 80 UNION ALL SELECT 'openint', 'numeric', 'e', 80
UNION ALL SELECT 'format', 'text', 'w', CAST(least(max(length(format)) * 8, 200) AS INTEGER) FROM bars
UNION ALL SELECT 'seq', 'numeric', 'e', 80""")
def q_column_profile(spark, sf_dir):
    return st.column_profile(events_bars(spark, sf_dir))


def _year_sql(top: int) -> str:
    y = "substr(trim(\"<DATE>\"), 1, 4)"
    return (f"(CASE WHEN regexp_full_match({y}, '\\s*[+-]?\\d+\\s*') THEN TRY_CAST(trim({y}) AS INTEGER) END) "
            f"BETWEEN 1900 AND {top}")


_DATE_OK = "try_strptime(trim(\"<DATE>\"), '%Y%m%d') IS NOT NULL AND length(trim(\"<DATE>\")) = 8"
_NUM_OK = " AND ".join(f"{num_sql(q)} IS NOT NULL" for q in ['"<OPEN>"', '"<HIGH>"', '"<LOW>"', '"<CLOSE>"'])
_CLEAN_SEL = ('"<TICKER>", "<PER>", "<DATE>", "<TIME>", ' + ", ".join(
    f'{num_sql(q)} AS {q}' for q in ['"<OPEN>"', '"<HIGH>"', '"<LOW>"', '"<CLOSE>"', '"<VOL>"', '"<OPENINT>"'])
    + ", seq")
_PRESENT = "\"<DATE>\" IS NOT NULL AND \"<DATE>\" != '' AND \"<DATE>\" != 'nan'"


@query("clean_v1", f"{WR} SELECT {_CLEAN_SEL} FROM raw WHERE {_year_sql(2026)} AND {_DATE_OK} AND {_NUM_OK}")
def q_clean_v1(spark, sf_dir):
    return cl.clean_stooq(events_stooq_text(spark, sf_dir), "v1", as_of=AS_OF)


@query("clean_v2", f"""{WR} SELECT {_CLEAN_SEL} FROM raw
WHERE {_PRESENT} AND {_year_sql(2025)} AND {_DATE_OK} AND {_NUM_OK}""")
def q_clean_v2(spark, sf_dir):
    return cl.clean_stooq(events_stooq_text(spark, sf_dir), "v2", as_of=AS_OF)


@query("clean_counts", f"""{WR} SELECT count(*) AS original_rows,
count(*) FILTER (WHERE {_year_sql(2026)}) AS after_year_filter,
count(*) FILTER (WHERE {_year_sql(2026)} AND {_DATE_OK}) AS after_date_parse,
count(*) FILTER (WHERE {_year_sql(2026)} AND {_DATE_OK} AND {_NUM_OK}) AS after_numeric_check FROM raw""")
def q_clean_counts(spark, sf_dir):
    return cl.clean_counts(events_stooq_text(spark, sf_dir), "v1", as_of=AS_OF)


@query("drop_nulls", f"{W} SELECT {BAR_SQL} FROM bars WHERE openint IS NOT NULL AND ticker IS NOT NULL "
                     "AND \"timestamp\" IS NOT NULL AND close IS NOT NULL")
def q_drop_nulls(spark, sf_dir):
    return cl.drop_nulls(events_bars(spark, sf_dir))


@query("drop_nulls_count", f"""{W} SELECT count(*) AS rows_before, count(*) FILTER (WHERE openint IS NOT NULL)
AS rows_after, count(*) FILTER (WHERE openint IS NULL) AS rows_dropped FROM bars""")
def q_drop_nulls_count(spark, sf_dir):
    return cl.drop_nulls_count(events_bars(spark, sf_dir))


@query("dedupe", f"{W} SELECT DISTINCT {BAR9_SQL} FROM (SELECT * FROM bars UNION ALL SELECT * FROM bars)")
def q_dedupe(spark, sf_dir):
    b = events_bars(spark, sf_dir, with_seq=False)
    return cl.dedupe(b.unionByName(b))


@query("dedupe_count", f"""{W} SELECT 2 * count(*) AS rows_before, count(*) AS rows_after,
count(*) AS duplicates_removed FROM (SELECT DISTINCT {BAR9_SQL} FROM bars)""")
def q_dedupe_count(spark, sf_dir):
    b = events_bars(spark, sf_dir, with_seq=False)
    return cl.dedupe_count(b.unionByName(b))


def _balance_sql(src: str, target: str, minimum: str, cols: str = BAR_SQL) -> str:
    return f"""c AS (SELECT ticker, count(*) AS n FROM {src} WHERE ticker IS NOT NULL GROUP BY ticker),
tg AS (SELECT {target} AS target, {minimum} AS minimum{' FROM c' if 'quantile' in target else ''}),
rk AS (SELECT s.*, row_number() OVER (PARTITION BY s.ticker ORDER BY "timestamp", seq) - 1 AS rn, c.n
       FROM {src} s JOIN c ON s.ticker = c.ticker),
bal AS (SELECT {cols} FROM rk, tg WHERE n >= minimum
        AND (n <= target OR (rn % (n // target) = 0 AND rn < (n // target) * target)))"""


@query("balance_tickers", f"""{W}, {_balance_sql('bars', 'CAST(floor(quantile_cont(n, 0.5)) AS BIGINT)',
                                                 'CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) // 2')}
SELECT * FROM bal""")
def q_balance_tickers(spark, sf_dir):
    return balance_tickers(events_bars(spark, sf_dir), order=("timestamp", "seq"))


@query("balance_explicit", f"""{W}, {_balance_sql('bars', '50', '70')} SELECT * FROM bal""")
def q_balance_explicit(spark, sf_dir):
    return balance_tickers(events_bars(spark, sf_dir), target=50, minimum=70, order=("timestamp", "seq"))


@query("prepare_dataset", f"""{W}, twice AS (SELECT * FROM bars UNION ALL SELECT * FROM bars),
f AS (SELECT * FROM twice WHERE "timestamp" >= TIMESTAMP '2024-01-02' AND "timestamp" <= TIMESTAMP '2024-01-28'),
{_balance_sql('f', '40', '20', BAR9_SQL)}
SELECT DISTINCT * FROM bal WHERE ticker IS NOT NULL AND "timestamp" IS NOT NULL AND open IS NOT NULL
AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND vol IS NOT NULL AND openint IS NOT NULL
AND format IS NOT NULL""")
def q_prepare_dataset(spark, sf_dir):
    b = events_bars(spark, sf_dir)
    out, _ = prepare_bars(b.unionByName(b), start="2024-01-02", end="2024-01-28", target=40, minimum=20,
                          drop_null_rows=True, order=("timestamp", "seq"))
    return out
