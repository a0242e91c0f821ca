"""Per-source quality queries (A6–A13, V9) over ``events`` bars and raw Stooq text.

The source key is the ticker: each ticker stands for one file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions.columns import rounded
from barspark.operators import clean as cl
from barspark.operators import profile as pf
from barspark.plans.registry import query
from barspark.plans.sql_fragments import EVENTS_BARS, EVENTS_STOOQ, rnd, stooq_ts_sql
from barspark.sources.driver_tables import events_bars, events_stooq_text, table

AS_OF = "2024-01-29 12:00:00"
W = f"WITH bars AS ({EVENTS_BARS})"
WR = f"WITH raw AS ({EVENTS_STOOQ}), t AS (SELECT \"<TICKER>\" AS source, seq, {stooq_ts_sql()} AS ts FROM raw)"
FUT = f"ts > TIMESTAMP '{AS_OF}'"

_GAPS = """span AS (SELECT ticker AS source, min(CAST("timestamp" AS DATE)) AS d0, max(CAST("timestamp" AS DATE)) AS d1
          FROM bars WHERE "timestamp" IS NOT NULL GROUP BY ticker),
cal AS (SELECT source, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
pres AS (SELECT DISTINCT ticker AS source, CAST("timestamp" AS DATE) AS d FROM bars WHERE "timestamp" IS NOT NULL),
gaps AS (SELECT cal.source, cal.d AS missing_date FROM cal LEFT JOIN pres ON cal.source = pres.source AND cal.d = pres.d
         WHERE pres.source IS NULL AND isodow(cal.d) <= 5),
gc AS (SELECT s.source, count(g.missing_date) AS gap_count FROM span s LEFT JOIN gaps g ON s.source = g.source
       GROUP BY s.source)"""


def _bars(spark, sf_dir):
    return events_bars(spark, sf_dir)


@query("gap_days", f"{W}, {_GAPS} SELECT source, missing_date FROM gaps")
def q_gap_days(spark, sf_dir):
    return pf.gap_days(_bars(spark, sf_dir), source="ticker")


@query("gap_count", f"{W}, {_GAPS} SELECT source, gap_count, gap_count > 0 AS has_gaps FROM gc")
def q_gap_count(spark, sf_dir):
    return pf.gap_count(_bars(spark, sf_dir), source="ticker")


@query("file_quality", f"""{W}, {_GAPS},
st AS (SELECT ticker AS source, count(*) AS records, count(DISTINCT CAST("timestamp" AS DATE)) AS trading_days,
       min("timestamp") AS start_date, max("timestamp") AS end_date, min(close) AS close_min,
       max(close) AS close_max, {rnd('avg(close)')} AS close_avg,
       bool_or("timestamp" > TIMESTAMP '{AS_OF}') AS has_future_dates
       FROM bars WHERE "timestamp" IS NOT NULL GROUP BY ticker)
SELECT st.*, gc.gap_count, gc.gap_count > 0 AS has_gaps FROM st JOIN gc ON st.source = gc.source""")
def q_file_quality(spark, sf_dir):
    return pf.file_quality(_bars(spark, sf_dir), source="ticker", as_of=AS_OF).withColumn(
        "close_avg", rounded("close_avg"))


@query("size_classes", f"""{W}, per AS (SELECT ticker, count("timestamp") AS records FROM bars GROUP BY ticker)
SELECT CASE WHEN records = 0 THEN 'empty' WHEN records < 50 THEN 'very_small' WHEN records < 500 THEN 'small'
            WHEN records < 2000 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS files
FROM per GROUP BY ALL""")
def q_size_classes(spark, sf_dir):
    return pf.size_classes(_bars(spark, sf_dir), source="ticker")


@query("feed_summary", f"""{W} SELECT count(DISTINCT ticker) AS total_files, count(DISTINCT ticker) AS total_tickers,
count(*) AS total_records, min("timestamp") AS earliest_date, max("timestamp") AS latest_date,
{rnd('count(*) / count(DISTINCT ticker)')} AS avg_records_per_ticker FROM bars WHERE "timestamp" IS NOT NULL""")
def q_feed_summary(spark, sf_dir):
    return pf.feed_summary(_bars(spark, sf_dir), source="ticker").withColumn(
        "avg_records_per_ticker", rounded("avg_records_per_ticker"))


@query("future_dates", f"""{W} SELECT ticker AS source,
count(*) FILTER (WHERE "timestamp" > TIMESTAMP '{AS_OF}') AS future_dates,
max("timestamp") FILTER (WHERE "timestamp" > TIMESTAMP '{AS_OF}') AS max_future_date FROM bars GROUP BY ticker""")
def q_future_dates(spark, sf_dir):
    return pf.future_dates(_bars(spark, sf_dir), source="ticker", as_of=AS_OF)


@query("invalid_dates", f"""{WR} SELECT source, count(*) AS rows, count(*) FILTER (WHERE ts IS NULL) AS invalid_dates
FROM t GROUP BY source""")
def q_invalid_dates(spark, sf_dir):
    return pf.invalid_dates(events_stooq_text(spark, sf_dir), source="<TICKER>")


_ISSUES = f"""per AS (SELECT source, count(*) FILTER (WHERE ts IS NULL) AS bad, count(ts) AS good,
        count(*) FILTER (WHERE {FUT}) AS fut, max(ts) FILTER (WHERE {FUT}) AS fut_max FROM t GROUP BY source),
iss AS (SELECT source, 'invalid_dates' AS kind, 'Contains ' || bad || ' invalid dates' AS error FROM per WHERE bad > 0
  UNION ALL SELECT source, 'skipped', 'No valid dates after cleaning' FROM per WHERE good = 0
  UNION ALL SELECT source, 'future_dates', 'Contains ' || fut || ' future dates (up to ' || strftime(fut_max, '%Y-%m-%d') || ')'
  FROM per WHERE fut > 0)"""


@query("feed_issues", f"{WR}, {_ISSUES} SELECT * FROM iss")
def q_feed_issues(spark, sf_dir):
    return pf.feed_issues(events_stooq_text(spark, sf_dir), source="<TICKER>", as_of=AS_OF)


def _hint_sql() -> str:
    kinds = ("CASE WHEN contains(error, 'File not found') THEN 'not_found' "
             "WHEN contains(error, 'File is empty') THEN 'empty' "
             "WHEN contains(lower(error), 'format') THEN 'format' "
             "WHEN contains(lower(error), 'permission') THEN 'permission' ELSE 'other' END")
    texts = " ".join(f"WHEN '{k}' THEN '{' | '.join(v)}'".replace("'t ", "''t ") for k, v in cl.HINTS.items())
    return f"SELECT *, CASE hint_kind {texts} END AS hints_text FROM (SELECT *, {kinds} AS hint_kind FROM iss)"


@query("issue_hints", f"{WR}, {_ISSUES} {_hint_sql()}")
def q_issue_hints(spark, sf_dir):
    issues = pf.feed_issues(events_stooq_text(spark, sf_dir), source="<TICKER>", as_of=AS_OF)
    return cl.issue_hints(issues).withColumn("hints_text", F.array_join("hints", " | ")).drop("hints")


_ERRORS = ["File not found", "File is empty", "Invalid file format", "Permission denied", "Contains 3 invalid dates"]


@query("issue_hints_all", f"""WITH iss AS (SELECT event_id, CASE event_id % 5 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ERRORS))} END AS error FROM events)
{_hint_sql()}""")
def q_issue_hints_all(spark, sf_dir):
    """All five kinds of hints, a message for each event."""
    text = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("event_id") % 5 + 1).cast("int"))
    issues = table(spark, sf_dir, "events").select("event_id", text.alias("error"))
    return cl.issue_hints(issues).withColumn("hints_text", F.array_join("hints", " | ")).drop("hints")


@query("size_classes_all", """WITH b AS (SELECT CASE WHEN event_id < 30 THEN 'a' WHEN event_id < 130 THEN 'b' WHEN event_id < 140 THEN 'e' WHEN event_id % 8 = 0 THEN 'c' ELSE 'd' END AS source,
CASE WHEN event_id < 130 OR event_id >= 140 THEN ts END AS t FROM events),
per AS (SELECT source, count(t) AS records FROM b GROUP BY source)
SELECT CASE WHEN records = 0 THEN 'empty' WHEN records < 50 THEN 'very_small' WHEN records < 500 THEN 'small'
WHEN records < 2000 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS files FROM per GROUP BY ALL""")
def q_size_classes_all(spark, sf_dir):
    """Sources of every class at 10,000 events, one of them without a valid time."""
    e = F.col("event_id")
    source = F.when(e < 30, "a").when(e < 130, "b").when(e < 140, "e").when(e % 8 == 0, "c").otherwise("d")
    rows = table(spark, sf_dir, "events").select(source.alias("source"), F.when((e < 130) | (e >= 140), F.col("ts")).alias("timestamp"))
    return pf.size_classes(rows)


@query("timestamp_analysis", f"""{WR},
per AS (SELECT source, count(*) AS rows, count(*) FILTER (WHERE ts IS NULL) AS invalid_dates,
        count(*) FILTER (WHERE {FUT}) AS future_dates, max(ts) FILTER (WHERE {FUT}) AS max_future_date,
        min(ts) AS first_timestamp, max(ts) AS last_timestamp FROM t GROUP BY source),
rk AS (SELECT source, ts, row_number() OVER (PARTITION BY source ORDER BY seq) - 1 AS rn FROM t),
bad AS (SELECT source, rn, row_number() OVER (PARTITION BY source ORDER BY rn) - 1 AS k FROM rk WHERE ts IS NULL),
firsts AS (SELECT source, string_agg(CAST(rn AS VARCHAR), ',' ORDER BY rn) AS first_invalid_rows
           FROM bad WHERE k < 5 GROUP BY source)
SELECT per.*, firsts.first_invalid_rows FROM per LEFT JOIN firsts ON per.source = firsts.source""")
def q_timestamp_analysis(spark, sf_dir):
    return pf.timestamp_analysis(events_stooq_text(spark, sf_dir), source="<TICKER>", order=("seq",), as_of=AS_OF)


# Paths in the layout of a bulk daily download, one file per ticker.
_LAYOUTS = ["us/stocks", "us/nasdaq stocks", "us/etfs", "world/bonds", "world/cryptocurrencies",
            "world/money market", "world/indices", "pl/stocks"]


def _paths_spark(spark, sf_dir):
    b = _bars(spark, sf_dir).select("ticker").distinct()
    idx = (F.substring("ticker", 2, 20).cast("long") % len(_LAYOUTS) + 1).cast("int")
    layout = F.element_at(F.array(*[F.lit(x) for x in _LAYOUTS]), idx)
    return b.select(F.concat(F.lit("data/daily/"), layout, F.lit("/"), F.lower("ticker"), F.lit(".txt")).alias("path"))


_PATHS_SQL = f"""{W}, paths AS (SELECT DISTINCT 'data/daily/' ||
  ['{"', '".join(_LAYOUTS)}'][CAST(substr(ticker, 2) AS BIGINT) % {len(_LAYOUTS)} + 1] || '/' || lower(ticker) || '.txt'
  AS path FROM bars)"""

_CATEGORY_SQL = """CASE WHEN list_contains(string_split(path, '/'), 'us') THEN
    CASE WHEN list_contains(string_split(path, '/'), 'stocks') OR list_contains(string_split(path, '/'), 'etfs')
         THEN 'us_stocks' ELSE 'other' END
  WHEN list_contains(string_split(path, '/'), 'world') THEN
    CASE WHEN list_contains(string_split(path, '/'), 'bonds') THEN 'world_bonds'
         WHEN list_contains(string_split(path, '/'), 'cryptocurrencies') THEN 'cryptocurrencies'
         WHEN list_contains(string_split(path, '/'), 'money market') THEN 'money_market'
         WHEN list_contains(string_split(path, '/'), 'indices') THEN 'indices' ELSE 'other' END
  ELSE 'other' END"""


@query("file_categories", f"{_PATHS_SQL} SELECT path, {_CATEGORY_SQL} AS category FROM paths")
def q_file_categories(spark, sf_dir):
    return pf.file_categories(_paths_spark(spark, sf_dir))


@query("batch_assign", f"""{_PATHS_SQL} SELECT path, row_number() OVER (ORDER BY path) - 1 AS file_idx,
(row_number() OVER (ORDER BY path) - 1) // 10 AS batch FROM paths""")
def q_batch_assign(spark, sf_dir):
    return pf.batch_assign(_paths_spark(spark, sf_dir), batch_size=10)
