"""Queries on files of several layouts, on NaN and on long gaps: what a folder of real downloads holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions.columns import rounded
from barspark.operators import features as ft
from barspark.operators import indicators as ind
from barspark.operators import paging as pg
from barspark.operators import profile as pf
from barspark.operators.standardize import conform_schema
from barspark.plans.q_files import BAR9_SQL, BARS9, STOOQ9
from barspark.plans.registry import query
from barspark.plans.sql_fragments import EVENTS_BARS, EVENTS_STOOQ, ema_sql, rnd, stooq_ts_sql
from barspark.schema import BAR_COLUMNS
from barspark.session import scratch_path
from barspark.sources import files as fl
from barspark.sources import readers as rd
from barspark.sources import sinks as sk
from barspark.sources.driver_tables import events_bars, events_stooq_text
from barspark.sources.headers import BOM
from barspark.sources.readers import TIMESTAMP_FORMAT
from barspark.sources.stooq_text import write_stooq_text

NUMERIC = ["open", "high", "low", "close", "vol", "openint"]
#: Rows whose close is NaN.
NAN_RULE = "seq % 7 = 3"
#: Rows whose close is missing: 900 of every 1000.
GAP_RULE = "seq % 1000 >= 100"


# --- S2, S3, S4: several layouts in one folder ----------------------------------------------------

@query("scan_csv_reordered", f"""WITH bars AS ({EVENTS_BARS}) SELECT ticker, "timestamp",
{', '.join(f'CASE WHEN seq % 2 = 0 THEN {c} END AS {c}' for c in ['open', 'high', 'low'])}, close,
{', '.join(f'CASE WHEN seq % 2 = 0 THEN {c} END AS {c}' for c in ['vol', 'openint', 'format'])} FROM bars""")
def q_scan_csv_reordered(spark, sf_dir):
    """Half of the rows in files with all columns reversed, half in tab files with three columns and a foreign one."""
    out = scratch_path(spark, "scan-csv-reordered")
    bars = events_bars(spark, sf_dir)
    w = lambda df: df.write.option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT)
    w(bars.where("seq % 2 = 0").select(*reversed(BAR_COLUMNS))).csv(f"{out}/reversed")
    w(bars.where("seq % 2 = 1").select("close", F.lit("x, y").alias("note"), "timestamp", "ticker")).option("sep", "\t").csv(f"{out}/few")
    return rd.read_csv(spark, out, recursive=True, glob="*.csv")


@query("scan_json_mixed", BARS9)
def q_scan_json_mixed(spark, sf_dir):
    out = scratch_path(spark, "scan-json-mixed")
    bars = events_bars(spark, sf_dir)
    sk.save(bars.where("seq % 2 = 0").select(*BAR_COLUMNS), f"{out}/lines", "json")
    sk.save_arrays(bars.where("seq % 2 = 1").select(*BAR_COLUMNS), f"{out}/array", lead="\n")
    return rd.read_json(spark, out, recursive=True)


def _mixed_stooq(spark, sf_dir) -> str:
    """One folder: tab; comma without ``<PER>`` and reordered; lower-case bare names; BOM and blanks in the header."""
    out = scratch_path(spark, "scan-stooq-mixed")
    raw = events_stooq_text(spark, sf_dir)
    part = lambda k: raw.where(F.col("seq") % 4 == k)
    names = [c for c in raw.columns if c != "seq"]
    write_stooq_text(part(0), f"{out}/tab")
    write_stooq_text(part(1), f"{out}/comma", columns=[c for c in reversed(names) if c != "<PER>"], sep=",")
    bare = part(2).select(*[F.col(f"`{c}`").alias(c.strip("<>").lower()) for c in names], "seq")
    write_stooq_text(bare, f"{out}/bare", by="ticker", columns=[c.strip("<>").lower() for c in names], sep=",")
    marked = part(3).select(*[F.col(f"`{c}`").alias((BOM if c == "<TICKER>" else " ") + c) for c in names], "seq")
    write_stooq_text(marked, f"{out}/bom", by=BOM + "<TICKER>", columns=[(BOM if c == "<TICKER>" else " ") + c for c in names])
    return out


@query("scan_stooq_mixed", STOOQ9)
def q_scan_stooq_mixed(spark, sf_dir):
    return rd.read_stooq(spark, _mixed_stooq(spark, sf_dir), recursive=True, glob="*.txt")


@query("validate_required", f"""WITH raw AS ({EVENTS_STOOQ}), t AS (SELECT DISTINCT "<TICKER>" AS ticker FROM raw)
SELECT 'noper' AS kind, ticker, true AS valid, NULL::VARCHAR AS error FROM t
UNION ALL SELECT 'novol', ticker, false, 'Missing required columns: <VOL>' FROM t""")
def q_validate_required(spark, sf_dir):
    root = scratch_path(spark, "validate-required")
    raw = events_stooq_text(spark, sf_dir)
    for kind, gone in (("noper", "<PER>"), ("novol", "<VOL>")):
        write_stooq_text(raw, f"{root}/{kind}", columns=[c for c in raw.columns if c not in (gone, "seq")])
    v = fl.validate_files(spark, fl.list_files(spark, root, "*.txt").select("path", F.lit("txt").alias("format")), root)
    return v.select(F.regexp_extract("path", r"/(noper|novol)/", 1).alias("kind"), F.regexp_extract("path", r"_part=([^/]+)/", 1).alias("ticker"), "valid", "error")


@query("files_by_records", """SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, count(*) AS records FROM events GROUP BY 1""")
def q_files_by_records(spark, sf_dir):
    root = scratch_path(spark, "files-by-records")
    write_stooq_text(events_stooq_text(spark, sf_dir), root)
    ranked = pg.files_by_records(rd.read_stooq_raw(spark, root, with_source=True, recursive=True, glob="*.txt"))
    return ranked.select(F.regexp_extract("source", r"_part=([^/]+)/", 1).alias("ticker"), "records")


@query("timestamp_report", f"""WITH raw AS ({EVENTS_STOOQ}), t AS (SELECT "<TICKER>" AS ticker, {stooq_ts_sql()} AS ts FROM raw)
SELECT 2 * count(DISTINCT ticker) AS total_files, count(DISTINCT ticker) AS processed_files, count(DISTINCT ticker) AS files_with_errors,
min(ts) AS earliest_date, max(ts) AS latest_date FROM t""")
def q_timestamp_report(spark, sf_dir):
    from barspark.plans.report import timestamp_report
    root = scratch_path(spark, "timestamp-report")
    raw = events_stooq_text(spark, sf_dir)
    write_stooq_text(raw, f"{root}/good")
    write_stooq_text(raw, f"{root}/nodate", columns=[c for c in raw.columns if c not in ("<DATE>", "seq")])
    return timestamp_report(spark, root, as_of="2025-01-01")["summary"]


# --- NaN is a missing value -----------------------------------------------------------------------

def _nan_bars(spark, sf_dir):
    bars = events_bars(spark, sf_dir)
    return bars.withColumn("close", F.when(F.expr(NAN_RULE), F.lit(float("nan"))).otherwise(F.col("close")))


NAN_BARS = f"WITH raw AS ({EVENTS_BARS}), bars AS (SELECT * REPLACE (CASE WHEN {NAN_RULE} THEN NULL ELSE close END AS close) FROM raw)"


@query("conform_nan", f"{NAN_BARS} SELECT {BAR9_SQL} FROM bars")
def q_conform_nan(spark, sf_dir):
    return conform_schema(_nan_bars(spark, sf_dir))


def _scaled(center: str, scale: str) -> str:
    return f"""{NAN_BARS}, st AS (SELECT {center} AS a, {scale} AS s FROM bars)
SELECT seq, {rnd('(close - a) / (CASE WHEN s IS NULL OR s = 0 THEN 1.0 ELSE s END)')} AS close FROM bars, st"""


for _method, _center, _scale in (("minmax", "min(close)", "max(close) - min(close)"), ("standard", "avg(close)", "stddev_pop(close)"),
                                 ("robust", "quantile_cont(close, 0.5)", "quantile_cont(close, 0.75) - quantile_cont(close, 0.25)")):
    def _mk(method=_method):
        def run(spark, sf_dir):
            return ft.normalize(_nan_bars(spark, sf_dir), method, ["close"]).select("seq", rounded("close").alias("close"))
        return run
    query(f"normalize_{_method}_nan", _scaled(_center, _scale))(_mk())


@query("describe_nan", f"""{NAN_BARS} SELECT 'close' AS column_name, count(close) AS count, {rnd('avg(close)')} AS mean, {rnd('stddev_samp(close)')} AS std,
{rnd('min(close)')} AS min, {rnd('quantile_cont(close, 0.5)')} AS p50, {rnd('max(close)')} AS max, NULL::BIGINT AS "unique", NULL::VARCHAR AS top FROM bars
UNION ALL SELECT 'even', count(*), NULL, NULL, NULL, NULL, NULL, count(DISTINCT seq % 2 = 0),
(SELECT CAST(seq % 2 = 0 AS VARCHAR) FROM bars GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM bars
UNION ALL SELECT 'day', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM bars""")
def q_describe_nan(spark, sf_dir):
    bars = _nan_bars(spark, sf_dir).select("close", (F.col("seq") % 2 == 0).alias("even"), F.to_date("timestamp").alias("day"))
    d = pf.describe(bars)
    return d.select("column_name", "count", *[rounded(c).alias(c) for c in ("mean", "std", "min", "p50", "max")], "unique", "top")


# --- W2, W3: averages over long gaps ---------------------------------------------------------------

GAP_BARS = f"""WITH raw AS ({EVENTS_BARS}),
r AS (SELECT 'ALL' AS ticker, seq, CASE WHEN {GAP_RULE} THEN NULL ELSE close END AS close, row_number() OVER (ORDER BY seq) - 1 AS rn FROM raw)"""


@query("ema_null_gaps", f"""{GAP_BARS},
f AS ({ema_sql('r', 'close', 12, 'ema_12', carry='seq')}), s AS ({ema_sql('r', 'close', 26, 'ema_26', carry='seq')})
SELECT f.seq, {rnd('ema_12', 4)} AS ema_12, {rnd('ema_26', 4)} AS ema_26 FROM f JOIN s ON f.seq = s.seq""")
def q_ema_null_gaps(spark, sf_dir):
    """All rows as one ticker, in the smallest blocks: gaps are longer than a block's halo."""
    bars = events_bars(spark, sf_dir).select(F.lit("ALL").alias("ticker"), "seq", F.when(~F.expr(GAP_RULE), F.col("close")).alias("close"))
    out = ind.ema(bars, order=("seq",), block_rows=1)
    return out.select("seq", rounded("ema_12", 4).alias("ema_12"), rounded("ema_26", 4).alias("ema_26"))
