"""Filter, paging and ticker-statistics queries (F*, P*, A1–A5, A14) over ``events`` bars."""

from __future__ import annotations

from barspark.functions.columns import rounded
from barspark.operators import filters as flt
from barspark.operators import paging as pg
from barspark.operators import profile as pf
from barspark.plans.registry import query
from barspark.plans.sql_fragments import EVENTS_BARS, rnd
from barspark.sources.driver_tables import events_bars

BAR_SQL = 'ticker, "timestamp", open, high, low, close, vol, openint, format, seq'
W = f"WITH bars AS ({EVENTS_BARS})"


def _bars(spark, sf_dir):
    return events_bars(spark, sf_dir)


# --- F1–F8: single conditions and their conjunction ---------------------------------------

_CONDS = {
    "filter_equals": ([{"column": "ticker", "operator": "equals", "value": "U42"}], "ticker = 'U42'"),
    "filter_not_equals": ([{"column": "format", "operator": "not_equals", "value": "view"}], "format != 'view'"),
    "filter_contains": ([{"column": "ticker", "operator": "contains", "value": "4"}], "ticker LIKE '%4%'"),
    "filter_not_contains": ([{"column": "format", "operator": "not_contains", "value": "ic"}],
                            "format NOT LIKE '%ic%'"),
    "filter_gt": ([{"column": "close", "operator": "greater_than", "value": "100"}], "close > 100"),
    "filter_lt": ([{"column": "close", "operator": "less_than", "value": 20}], "close < 20"),
    "filter_ge": ([{"column": "vol", "operator": "greater_equal", "value": 500}], "vol >= 500"),
    "filter_le": ([{"column": "vol", "operator": "less_equal", "value": 10}], "vol <= 10"),
    "filter_between": ([{"column": "close", "operator": "between", "value": ["100", "200"]}],
                       "close BETWEEN 100 AND 200"),
    "filter_in": ([{"column": "ticker", "operator": "in", "value": ["U1", "U2", "U3"]}],
                  "ticker IN ('U1', 'U2', 'U3')"),
    "filter_not_in": ([{"column": "format", "operator": "not_in", "value": "view, click"}],
                      "format NOT IN ('view', 'click')"),
    "filter_is_null": ([{"column": "openint", "operator": "is_null"}], "openint IS NULL"),
    "filter_is_not_null": ([{"column": "openint", "operator": "is_not_null"}], "openint IS NOT NULL"),
    "filter_in_range": ([{"column": "timestamp", "operator": "in_range", "value": ["2024-01-05", "2024-01-10"]}],
                        "\"timestamp\" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"),
    "filter_conjunction": ([{"column": "ticker", "operator": "contains", "value": "1"},
                            {"column": "close", "operator": "greater_than", "value": 100},
                            {"column": "vol", "operator": "between", "value": [100, 900]},
                            {"column": "openint", "operator": "is_not_null"}],
                           "ticker LIKE '%1%' AND close > 100 AND vol BETWEEN 100 AND 900 AND openint IS NOT NULL"),
}

for _name, (_conds, _where) in _CONDS.items():
    def _mk(conds=_conds):
        return lambda spark, sf_dir: flt.apply_conditions(_bars(spark, sf_dir), conds)
    query(_name, f"{W} SELECT {BAR_SQL} FROM bars WHERE {_where}")(_mk())


@query("date_range", f"""{W} SELECT {BAR_SQL} FROM bars
WHERE "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" <= TIMESTAMP '2024-01-07'""")
def q_date_range(spark, sf_dir):
    return flt.date_range(_bars(spark, sf_dir), "2024-01-03", "2024-01-07")


@query("column_filter", f"""{W} SELECT {BAR_SQL} FROM bars
WHERE contains(lower(ticker), 'u1') AND contains(lower(format), 'cli')""")
def q_column_filter(spark, sf_dir):
    return flt.column_filter(_bars(spark, sf_dir), {"ticker": "U1", "format": "CLI"})


_ROW_TEXT = ("concat_ws(' ', " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '')" for c in BAR_SQL.split(", ")) + ")")


@query("search", f"{W} SELECT {BAR_SQL} FROM bars WHERE contains(lower({_ROW_TEXT}), 'purch')")
def q_search(spark, sf_dir):
    return flt.search(_bars(spark, sf_dir), "PURCH")


@query("search_count", f"""{W} SELECT count(*) FILTER (WHERE contains(lower({_ROW_TEXT}), 'purch')) AS matched,
count(*) AS total FROM bars""")
def q_search_count(spark, sf_dir):
    return flt.search_count(_bars(spark, sf_dir), "PURCH")


# --- P1–P9 ------------------------------------------------------------------------------

@query("sort_numeric", f"""{W} SELECT seq, close, row_number() OVER (ORDER BY close, seq) - 1 AS pos FROM bars""")
def q_sort_numeric(spark, sf_dir):
    return pg.sorted_positions(_bars(spark, sf_dir), "close", tiebreak=["seq"]).select("seq", "close", "pos")


@query("sort_text", f"""{W} SELECT seq, format,
row_number() OVER (ORDER BY lower(format) DESC, seq) - 1 AS pos FROM bars""")
def q_sort_text(spark, sf_dir):
    return pg.sorted_positions(_bars(spark, sf_dir), "format", descending=True,
                               tiebreak=["seq"]).select("seq", "format", "pos")


@query("page", f"""{W} SELECT {BAR_SQL} FROM bars ORDER BY "timestamp", seq LIMIT 100 OFFSET 200""")
def q_page(spark, sf_dir):
    return pg.page(_bars(spark, sf_dir), ["timestamp", "seq"], 3, 100)


@query("page_deep", f"""{W} SELECT {BAR_SQL} FROM bars ORDER BY "timestamp", seq LIMIT 50 OFFSET 5000""")
def q_page_deep(spark, sf_dir):
    # a page beyond the top-k limit goes through the distributed row index
    return pg.page(_bars(spark, sf_dir), ["timestamp", "seq"], 101, 50, shallow_rows=1000)


@query("page_count", f"""{W} SELECT count(*) AS total_rows, 100 AS page_size,
CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_pages FROM bars""")
def q_page_count(spark, sf_dir):
    return pg.page_count(_bars(spark, sf_dir), 100)


@query("ticker_page", f"""{W} SELECT {BAR_SQL} FROM bars WHERE ticker = 'U7'
ORDER BY "timestamp", seq LIMIT 10 OFFSET 10""")
def q_ticker_page(spark, sf_dir):
    return pg.ticker_page(_bars(spark, sf_dir), "U7", 2, 10, order=("timestamp", "seq"))


@query("row_range", f"""{W} SELECT * FROM (SELECT {BAR_SQL},
row_number() OVER (ORDER BY "timestamp", seq) - 1 AS row_idx FROM bars) WHERE row_idx >= 100 AND row_idx < 110""")
def q_row_range(spark, sf_dir):
    return pg.row_range(_bars(spark, sf_dir), ["timestamp", "seq"], 100, 110)


@query("row_count", f"{W} SELECT count(*) AS row_count FROM bars")
def q_row_count(spark, sf_dir):
    return pg.row_count(_bars(spark, sf_dir))


@query("ticker_list", f"{W} SELECT DISTINCT ticker FROM bars WHERE ticker IS NOT NULL AND ticker != ''")
def q_ticker_list(spark, sf_dir):
    return pg.ticker_list(_bars(spark, sf_dir))


@query("ticker_neighbors", f"""{W},
t AS (SELECT DISTINCT ticker FROM bars WHERE ticker IS NOT NULL AND ticker != ''),
r AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS idx, count(*) OVER () AS n FROM t)
SELECT a.ticker, a.idx, p.ticker AS prev_ticker, nx.ticker AS next_ticker
FROM r a JOIN r nx ON nx.idx = (a.idx + 1) % a.n JOIN r p ON p.idx = (a.idx + a.n - 1) % a.n""")
def q_ticker_neighbors(spark, sf_dir):
    return pg.ticker_neighbors(_bars(spark, sf_dir))


@query("top_tickers", f"""{W} SELECT ticker, count(*) AS records FROM bars WHERE ticker IS NOT NULL
GROUP BY ticker ORDER BY records DESC, ticker LIMIT 5""")
def q_top_tickers(spark, sf_dir):
    return pg.top_tickers(_bars(spark, sf_dir))


@query("bottom_tickers", f"""{W} SELECT ticker, count(*) AS records FROM bars WHERE ticker IS NOT NULL
GROUP BY ticker ORDER BY records ASC, ticker LIMIT 5""")
def q_bottom_tickers(spark, sf_dir):
    return pg.bottom_tickers(_bars(spark, sf_dir))


_INFO = [("ticker", "string"), ("timestamp", "timestamp_ntz"), ("open", "double"), ("high", "double"),
         ("low", "double"), ("close", "double"), ("vol", "double"), ("openint", "double"), ("format", "string"),
         ("seq", "bigint")]


@query("table_info", "SELECT column_name, data_type, CAST(ordinal AS INTEGER) AS ordinal, "
                     "(SELECT count(*) FROM events) AS row_count FROM (VALUES "
                     + ", ".join(f"('{c}', '{t}', {i})" for i, (c, t) in enumerate(_INFO))
                     + ") AS t(column_name, data_type, ordinal)")
def q_table_info(spark, sf_dir):
    return pg.table_info(_bars(spark, sf_dir))


# --- A1–A5, A14 ----------------------------------------------------------------------------

@query("ticker_distribution", f"""{W} SELECT ticker, count(*) AS records, min("timestamp") AS first_timestamp,
max("timestamp") AS last_timestamp FROM bars WHERE ticker IS NOT NULL GROUP BY ticker""")
def q_ticker_distribution(spark, sf_dir):
    return pf.ticker_distribution(_bars(spark, sf_dir))


@query("ticker_totals", f"""{W} SELECT count(*) AS total_records, count(DISTINCT ticker) AS total_tickers,
count(*) // count(DISTINCT ticker) AS avg_records_per_ticker FROM bars""")
def q_ticker_totals(spark, sf_dir):
    return pf.ticker_totals(_bars(spark, sf_dir))


@query("ticker_count_stats", f"""{W}, c AS (SELECT ticker, count(*) AS records, min("timestamp") AS f,
max("timestamp") AS l FROM bars WHERE ticker IS NOT NULL GROUP BY ticker)
SELECT min(records) AS min_records, max(records) AS max_records, {rnd('avg(records)')} AS mean_records,
min(f) AS first_timestamp, max(l) AS last_timestamp, {rnd('quantile_cont(records, 0.5)')} AS median_records
FROM c""")
def q_ticker_count_stats(spark, sf_dir):
    s = pf.ticker_count_stats(_bars(spark, sf_dir))
    return s.withColumn("mean_records", rounded("mean_records")).withColumn(
        "median_records", rounded("median_records"))


@query("suggested_targets", f"""{W} SELECT count(*) AS total_records, count(DISTINCT ticker) AS total_tickers,
count(*) // count(DISTINCT ticker) AS target_records, (count(*) // count(DISTINCT ticker)) // 2 AS min_records
FROM bars""")
def q_suggested_targets(spark, sf_dir):
    return pf.suggested_targets(_bars(spark, sf_dir))


_NUM = ["open", "high", "low", "close", "vol", "openint", "seq"]
_TXT = ["ticker", "format"]
_TMS = ["timestamp"]


def _describe_sql() -> str:
    parts = []
    for c in _TXT:
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS count, count(DISTINCT {c}) AS "unique",
 (SELECT {c} FROM bars WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
 (SELECT count(*) FROM bars WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq,
 NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50,
 NULL::DOUBLE AS p75, NULL::DOUBLE AS max, NULL::TIMESTAMP AS min_time, NULL::TIMESTAMP AS max_time FROM bars""")
    for c in _NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS count, NULL::BIGINT AS "unique",
 NULL::VARCHAR AS top, NULL::BIGINT AS freq, {rnd(f'avg({x})')} AS mean, {rnd(f'stddev_samp({x})')} AS std,
 {rnd(f'min({x})')} AS min, {rnd(f'quantile_cont({x}, 0.25)')} AS p25, {rnd(f'quantile_cont({x}, 0.5)')} AS p50,
 {rnd(f'quantile_cont({x}, 0.75)')} AS p75, {rnd(f'max({x})')} AS max, NULL::TIMESTAMP AS min_time,
 NULL::TIMESTAMP AS max_time FROM bars""")
    for c in _TMS:
        parts.append(f"""SELECT '{c}' AS column_name, count("{c}") AS count, NULL::BIGINT AS "unique",
 NULL::VARCHAR AS top, NULL::BIGINT AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
 NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max,
 min("{c}") AS min_time, max("{c}") AS max_time FROM bars""")
    return f"{W} " + " UNION ALL ".join(parts)


@query("describe", _describe_sql())
def q_describe(spark, sf_dir):
    d = pf.describe(_bars(spark, sf_dir), _TXT + _NUM + _TMS)
    for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]:
        d = d.withColumn(c, rounded(c))
    return d


@query("date_coverage", f"""{W} SELECT min("timestamp") AS start, max("timestamp") AS "end",
count(DISTINCT CAST("timestamp" AS DATE)) AS periods, count(*) AS records, count(DISTINCT ticker) AS tickers
FROM bars""")
def q_date_coverage(spark, sf_dir):
    return pf.date_coverage(_bars(spark, sf_dir))
