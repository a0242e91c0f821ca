"""Time-series preparation over ``events`` bars: as-of joins, resampling, corporate actions, outliers, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions.columns import rounded
from barspark.operators import asof, corporate, impute as imp, resample as rs, rolling
from barspark.plans.registry import query
from barspark.plans.sql_fragments import EVENTS_BARS, rnd
from barspark.sources.driver_tables import events_bars, table

ORDER = ("timestamp", "seq")
W = f"WITH bars AS ({EVENTS_BARS})"

# ---- currency: most tickers in one currency; quotes derived from events, several at one time, some empty, one currency late
CURRENCY_SQL = """CASE WHEN user_id % 10 < 6 THEN 'EUR' WHEN user_id % 10 < 8 THEN 'GBP' WHEN user_id % 10 < 9 THEN 'CHF' ELSE 'USD' END"""
RATES_SQL = """SELECT CASE event_id // 20 % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'CHF' END AS currency, date_trunc('hour', ts) AS quoted,
  CASE WHEN event_id % 100 = 23 THEN NULL ELSE 0.5 + value / 1000 END AS rate, event_id AS quote_id
FROM events WHERE event_id % 20 = 3 AND (event_id // 20 % 3 < 2 OR ts >= TIMESTAMP '2024-01-10')"""


def _currency():
    return F.expr(CURRENCY_SQL)


def currency_bars(spark, sf_dir):
    user = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), _currency().alias("currency"))
    return events_bars(spark, sf_dir).join(user, "seq")


def currency_rates(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    part = F.floor(F.col("event_id") / 20) % 3
    ev = ev.where((F.col("event_id") % 20 == 3) & ((part < 2) | (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))))
    return ev.select(F.when(part == 0, "EUR").when(part == 1, "GBP").otherwise("CHF").alias("currency"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("quoted"),
                     F.when(F.col("event_id") % 100 != 23, F.col("value") / 1000 + 0.5).alias("rate"), F.col("event_id").alias("quote_id"))


_QUOTES = f"q AS (SELECT currency, quoted, arg_max(rate, quote_id) AS rate FROM ({RATES_SQL}) WHERE rate IS NOT NULL GROUP BY ALL)"


@query("convert_currency", f"""WITH b AS (SELECT event_id AS seq, ts AS "timestamp", value AS close, {CURRENCY_SQL} AS currency FROM events),
{_QUOTES}, j AS (SELECT b.seq, b."timestamp", b.close, b.currency AS own, CASE WHEN b.currency = 'USD' THEN 1.0::DOUBLE ELSE q.rate END AS rate
FROM b ASOF LEFT JOIN q ON b.currency = q.currency AND b."timestamp" >= q.quoted)
SELECT seq, "timestamp", CASE WHEN rate IS NULL THEN own ELSE 'USD' END AS currency, {rnd('rate')} AS rate, {rnd('close * rate')} AS close,
{rnd('close * 1.05 * rate')} AS high FROM j""")
def q_convert_currency(spark, sf_dir):
    out = asof.convert_currency(currency_bars(spark, sf_dir), currency_rates(spark, sf_dir), "USD", rate_time="quoted", tie=("quote_id",))
    return out.select("seq", "timestamp", "currency", rounded("rate").alias("rate"), rounded("close").alias("close"), rounded("high").alias("high"))


@query("convert_currency_max_age", f"""WITH b AS (SELECT event_id AS seq, ts AS "timestamp", value AS close, {CURRENCY_SQL} AS currency FROM events WHERE user_id % 10 < 9),
{_QUOTES}, j AS (SELECT b.seq, b.close, CASE WHEN b."timestamp" - q.quoted <= INTERVAL 90 MINUTE THEN q.rate END AS rate
FROM b ASOF LEFT JOIN q ON b.currency = q.currency AND b."timestamp" >= q.quoted)
SELECT seq, {rnd('rate')} AS rate, {rnd('close * rate')} AS close FROM j""")
def q_convert_currency_max_age(spark, sf_dir):
    bars = currency_bars(spark, sf_dir).where("currency <> 'USD'")
    out = asof.convert_currency(bars, currency_rates(spark, sf_dir), "USD", rate_time="quoted", tie=("quote_id",), max_age=90 * 60)
    return out.select("seq", rounded("rate").alias("rate"), rounded("close").alias("close"))


#: Events to find partners for, and the partners: the same user's other events.
_LEFT, _RIGHT = "event_id % 3 = 0", "event_id % 3 <> 0"


def _partners(spark, sf_dir, **kw):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    right = ev.where(_RIGHT).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("partner"), F.col("value").alias("partner_value"))
    out = asof.asof_join(ev.where(_LEFT), right, "user_id", "ts", "at", ["partner", "partner_value"], **kw)
    return out.select("event_id", "partner", "partner_value")


_SIDES = f"l AS (SELECT * FROM events WHERE {_LEFT}), r AS (SELECT * FROM events WHERE {_RIGHT})"


@query("asof_forward", f"""WITH {_SIDES} SELECT l.event_id, r.event_id AS partner, r.value AS partner_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts""")
def q_asof_forward(spark, sf_dir):
    return _partners(spark, sf_dir, direction="forward")


@query("asof_nearest", f"""WITH {_SIDES}, near AS (SELECT l.event_id, r.event_id AS partner, r.value AS partner_value FROM l JOIN r ON l.user_id = r.user_id
AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 7200000000
QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) = 1)
SELECT l.event_id, partner, partner_value FROM l LEFT JOIN near USING (event_id)""")
def q_asof_nearest(spark, sf_dir):
    return _partners(spark, sf_dir, direction="nearest", tolerance=7200)


# ---- resampling

_FIRST = 'first(open ORDER BY "timestamp", seq) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY "timestamp", seq) AS close, sum(vol) AS vol, count(*) AS bars'
_BUCKET = ["ticker", "timestamp", "open", "high", "low", "close", "vol", "bars"]


def _resampled(spark, sf_dir, freq, zone="UTC", fill="none"):
    out = rs.resample(events_bars(spark, sf_dir), freq, zone, order=ORDER, fill=fill)
    return out.select("ticker", "timestamp", *[rounded(c).alias(c) for c in ("open", "high", "low", "close")], "vol", "bars")


def _round_bars(src: str) -> str:
    return f"SELECT ticker, \"timestamp\", {', '.join(f'{rnd(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, vol, bars FROM {src}"


@query("resample_1h", f"""{W}, r AS (SELECT ticker, date_trunc('hour', "timestamp") AS t, {_FIRST} FROM bars GROUP BY ticker, t),
o AS (SELECT ticker, t AS "timestamp", * EXCLUDE (ticker, t) FROM r) {_round_bars('o')}""")
def q_resample_1h(spark, sf_dir):
    return _resampled(spark, sf_dir, "1h")


@query("resample_1w", f"""{W}, r AS (SELECT ticker, CAST(date_trunc('week', "timestamp") AS TIMESTAMP) AS t, {_FIRST} FROM bars GROUP BY ticker, t),
o AS (SELECT ticker, t AS "timestamp", * EXCLUDE (ticker, t) FROM r) {_round_bars('o')}""")
def q_resample_1w(spark, sf_dir):
    return _resampled(spark, sf_dir, "1w")


def _gaps_sql(bucket: str, step: str, back: str) -> str:
    """Buckets of local time ``bucket`` and the empty ones between, carrying the close; ``back`` turns a bucket into UTC."""
    return f"""{W}, z AS (SELECT *, timezone('America/New_York', timezone('UTC', "timestamp")) AS local FROM bars),
r AS (SELECT ticker, {bucket} AS t, {_FIRST} FROM z GROUP BY ticker, t),
every AS (SELECT ticker, unnest(generate_series(min(t), max(t), INTERVAL {step})) AS t FROM r GROUP BY ticker),
f AS (SELECT ticker, t, open, high, low, vol, bars, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM every LEFT JOIN r USING (ticker, t)),
o AS (SELECT ticker, {back} AS "timestamp", coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(vol, 0.0) AS vol, coalesce(bars, 0) AS bars FROM f)
{_round_bars('o')}"""


_UTC = "timezone('UTC', timezone('America/New_York', t))"


@query("resample_1d_gaps", _gaps_sql("CAST(date_trunc('day', local) AS TIMESTAMP)", "1 DAY", _UTC))
def q_resample_1d_gaps(spark, sf_dir):
    return _resampled(spark, sf_dir, "1d", "America/New_York", "carry")


# no day of January has 23 or 25 hours, so local borders are plain multiples here; the tests have such days
@query("resample_4h_gaps", _gaps_sql("time_bucket(INTERVAL 4 HOUR, local)", "4 HOUR", _UTC))
def q_resample_4h_gaps(spark, sf_dir):
    return _resampled(spark, sf_dir, "4h", "America/New_York", "carry")


# ---- splits and dividends: derived from events, several a ticker, some of them without effect

ACTIONS_SQL = """SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, date_trunc('hour', ts) AS ex_time,
  CASE event_id % 41 WHEN 7 THEN 'split' WHEN 11 THEN 'dividend' ELSE 'merger' END AS kind,
  CASE event_id % 41 WHEN 7 THEN CAST(event_id % 4 AS DOUBLE) WHEN 11 THEN value / 20 ELSE 1.0 END AS value, event_id AS action_id
FROM events WHERE event_id % 41 IN (7, 11, 15)"""


def corporate_actions(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where("event_id % 41 in (7, 11, 15)")
    k = F.col("event_id") % 41
    return ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ex_time"),
                     F.when(k == 7, "split").when(k == 11, "dividend").otherwise("merger").alias("kind"),
                     F.when(k == 7, (F.col("event_id") % 4).cast("double")).when(k == 11, F.col("value") / 20).otherwise(1.0).alias("value"), F.col("event_id").alias("action_id"))


_QUOTED = """quoted AS (SELECT a.*, (SELECT arg_max(b.close, (b."timestamp", b.seq)) FROM bars b WHERE b.ticker = a.ticker AND b."timestamp" < a.ex_time) AS last_close FROM actions a)"""


@query("adjust_splits", f"""{W}, actions AS ({ACTIONS_SQL}), {_QUOTED},
act AS (SELECT ticker, ex_time, kind, CASE WHEN kind = 'split' AND value > 0 THEN 1 / value WHEN kind = 'dividend' AND value > 0 AND last_close > value THEN 1 - value / last_close END AS f FROM quoted),
j AS (SELECT b.seq, any_value(b.ticker) AS ticker, any_value(b.close) AS close, any_value(b.vol) AS vol, coalesce(product(a.f), 1.0) AS pf, coalesce(product(CASE WHEN a.kind = 'split' THEN 1 / a.f END), 1.0) AS vf
FROM bars b LEFT JOIN act a ON a.ticker = b.ticker AND a.ex_time > b."timestamp" GROUP BY b.seq)
SELECT ticker, seq, {rnd('close * pf')} AS close, {rnd('vol * vf', 4)} AS vol, {rnd('pf')} AS price_factor, {rnd('vf', 4)} AS volume_factor FROM j""")
def q_adjust_splits(spark, sf_dir):
    out = corporate.adjust_prices(events_bars(spark, sf_dir), corporate_actions(spark, sf_dir), order=ORDER)
    return out.select("ticker", "seq", rounded("close").alias("close"), rounded("vol", 4).alias("vol"), rounded("price_factor").alias("price_factor"),
                      rounded("volume_factor", 4).alias("volume_factor"))


@query("idle_actions", f"""{W}, actions AS ({ACTIONS_SQL}), {_QUOTED},
x AS (SELECT action_id, kind, CASE WHEN kind = 'merger' THEN 'unknown kind' WHEN NOT value > 0 THEN 'bad value' WHEN kind = 'dividend' AND last_close IS NULL THEN 'no earlier close'
WHEN kind = 'dividend' AND last_close <= value THEN 'dividend not below close' END AS reason FROM quoted) SELECT * FROM x WHERE reason IS NOT NULL""")
def q_idle_actions(spark, sf_dir):
    return corporate.idle_actions(events_bars(spark, sf_dir), corporate_actions(spark, sf_dir), tie=("seq",)).select("action_id", "kind", "reason")


# ---- outliers

@query("outliers_mad", f"""{W}, p AS (SELECT ticker, seq, "timestamp", CASE WHEN seq % 13 <> 5 THEN close END AS x FROM bars),
s AS (SELECT ticker, seq, x, count(x) OVER w AS n, median(x) OVER w AS m, mad(x) OVER w AS d FROM p WINDOW w AS (PARTITION BY ticker ORDER BY "timestamp", seq ROWS BETWEEN 100 PRECEDING AND CURRENT ROW))
SELECT ticker, seq, {rnd('CASE WHEN n >= 20 THEN m END')} AS rolling_median, {rnd('CASE WHEN n >= 20 THEN d END')} AS rolling_mad,
CASE WHEN n >= 20 THEN abs(x - m) > d * {3.0 * rolling.NORMAL!r} END AS is_outlier FROM s""")
def q_outliers_mad(spark, sf_dir):
    bars = events_bars(spark, sf_dir).withColumn("close", F.when(F.col("seq") % 13 != 5, F.col("close")))
    out = rolling.outliers(bars, 101, 3.0, order=ORDER, least=20)
    return out.select("ticker", "seq", rounded("rolling_median").alias("rolling_median"), rounded("rolling_mad").alias("rolling_mad"), "is_outlier")


# ---- imputation: runs of up to twenty gaps by event number, and every third price missing besides

_GAPPY = "CASE WHEN seq % 400 < 200 OR seq % 3 = 0 THEN NULL ELSE close END"
_SEEN = f"""{W}, p AS (SELECT ticker, seq, "timestamp" AS t, {_GAPPY} AS x, row_number() OVER (PARTITION BY ticker ORDER BY "timestamp", seq) AS g FROM bars),
s AS (SELECT ticker, seq, t, x, g, last_value(x IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN x IS NOT NULL THEN g END IGNORE NULLS) OVER b AS pg, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt,
first_value(x IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN x IS NOT NULL THEN g END IGNORE NULLS) OVER a AS ng, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt FROM p
WINDOW b AS (PARTITION BY ticker ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY ticker ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _imputed(spark, sf_dir, method, limit=None):
    bars = events_bars(spark, sf_dir).withColumn("close", F.expr(_GAPPY))
    out = imp.impute(bars, method, ["close", "openint"], order=ORDER, limit=limit, flag="filled")
    return out.select("ticker", "seq", rounded("close").alias("close"), F.array_contains("filled", "close").alias("filled"))


def _imputed_sql(new: str) -> str:
    return f"{_SEEN} SELECT ticker, seq, {rnd(f'coalesce(x, {new})')} AS close, x IS NULL AND ({new}) IS NOT NULL AS filled FROM s"


@query("impute_ffill_limit", _imputed_sql("CASE WHEN g - pg <= 3 THEN pv END"))
def q_impute_ffill(spark, sf_dir):
    return _imputed(spark, sf_dir, "ffill", 3)


@query("impute_bfill", _imputed_sql("nv"))
def q_impute_bfill(spark, sf_dir):
    return _imputed(spark, sf_dir, "bfill")


@query("impute_linear", _imputed_sql("CASE WHEN x IS NULL THEN pv + (nv - pv) * (g - pg) / (ng - pg) END"))
def q_impute_linear(spark, sf_dir):
    return _imputed(spark, sf_dir, "linear")


@query("impute_time", _imputed_sql("CASE WHEN x IS NULL THEN pv + (nv - pv) * (epoch_us(t) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt)) END"))
def q_impute_time(spark, sf_dir):
    return _imputed(spark, sf_dir, "time")
