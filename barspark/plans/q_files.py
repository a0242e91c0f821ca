"""Source, sink, file-listing and ingest queries (S*, K*, V1–V2, A16, A18).

Each query first writes its input files, derived from ``events``, into a fresh folder
under the session's checkpoint directory, then runs the operator on those files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barspark.operators import filters as flt, profile as pf
from barspark.plans.registry import query
from barspark.plans.sql_fragments import EVENTS_BARS, EVENTS_STOOQ, num_sql, rnd, stooq_bars_sql, stooq_ts_sql
from barspark.schema import BAR_COLUMNS
from barspark.session import scratch_path
from barspark.sources import files as fl
from barspark.sources import readers as rd
from barspark.sources import sinks as sk
from barspark.sources.driver_tables import events_bars, events_stooq_text
from barspark.sources.headers import plain_path, read_layouts
from barspark.sources.lines import NO_VALUE
from barspark.sources.readers import TIMESTAMP_FORMAT
from barspark.sources.stooq_text import write_stooq_text
from barspark.streaming.ingest import ingest_files, ingest_summary

BAR9_SQL = 'ticker, "timestamp", open, high, low, close, vol, openint, format'
BARS9 = f"WITH bars AS ({EVENTS_BARS}) SELECT {BAR9_SQL} FROM bars"
STOOQ9 = f"WITH raw AS ({EVENTS_STOOQ}) {stooq_bars_sql(keep='')}"


def _bars9(spark, sf_dir):
    return events_bars(spark, sf_dir, with_seq=False)


# --- S2–S7: each reader on files written by Spark's own writers -----------------------------

@query("scan_csv", BARS9)
def q_scan_csv(spark, sf_dir):
    out = scratch_path(spark, "scan-csv")
    _bars9(spark, sf_dir).write.option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(out)
    return rd.read_csv(spark, out)


@query("scan_json", BARS9)
def q_scan_json(spark, sf_dir):
    out = scratch_path(spark, "scan-json")
    _bars9(spark, sf_dir).write.option("timestampNTZFormat", TIMESTAMP_FORMAT).json(out)
    return rd.read_json(spark, out)


@query("scan_stooq", STOOQ9)
def q_scan_stooq(spark, sf_dir):
    out = scratch_path(spark, "scan-stooq")
    write_stooq_text(events_stooq_text(spark, sf_dir), out)
    return rd.read_stooq(spark, out, recursive=True, glob="*.txt")


@query("scan_parquet", BARS9)
def q_scan_parquet(spark, sf_dir):
    out = scratch_path(spark, "scan-parquet")
    _bars9(spark, sf_dir).write.parquet(out)
    return rd.read_parquet(spark, out)


@query("scan_feather", BARS9)
def q_scan_feather(spark, sf_dir):
    from barspark.sources.arrow_ipc import FORMAT_NAME, register
    register(spark)
    out = scratch_path(spark, "scan-feather")
    _bars9(spark, sf_dir).write.format(FORMAT_NAME).mode("overwrite").save(out)
    return rd.read_feather(spark, out)


@query("table_scan", BARS9)
def q_table_scan(spark, sf_dir):
    name = f"barspark_bars_{uuid.uuid4().hex[:12]}"
    sk.save_table(events_bars(spark, sf_dir), name, path=scratch_path(spark, "table"))
    return rd.read_table(spark, name)


@query("table_if_absent", BARS9)
def q_table_if_absent(spark, sf_dir):
    """K7: the second creation leaves the table of the first alone."""
    name = f"barspark_bars_{uuid.uuid4().hex[:12]}"
    sk.save_table(events_bars(spark, sf_dir), name, path=scratch_path(spark, "table"), if_absent=True)
    sk.save_table(events_bars(spark, sf_dir).where("seq % 2 = 0"), name, path=scratch_path(spark, "table"), if_absent=True)
    return rd.read_table(spark, name)


@query("load_by_extension", f"{BARS9} UNION ALL SELECT {BAR9_SQL} FROM bars UNION ALL SELECT {BAR9_SQL} FROM bars")
def q_load_by_extension(spark, sf_dir):
    """Folders whose names end in an extension, in any case, are read by it."""
    bars, out = _bars9(spark, sf_dir), None
    for fmt, ext in (("csv", "CSV"), ("json", "json"), ("parquet", "Parquet")):
        path = scratch_path(spark, "by-extension") + f".{ext}"
        sk.save(bars, path, fmt)
        part = rd.load(spark, path)
        out = part if out is None else out.unionByName(part)
    return out


@query("filter_saved", f"""WITH bars AS ({EVENTS_BARS}), b AS (SELECT * FROM bars WHERE close BETWEEN 20 AND 90 AND ticker IN ('U1', 'U2', 'U3', 'U42') AND "timestamp" >= TIMESTAMP '2024-01-05' AND openint IS NOT NULL AND vol < 800)
SELECT {BAR9_SQL} FROM b""")
def q_filter_saved(spark, sf_dir):
    """conditions as a user types them, saved as JSON text in a file and loaded from it; values follow the columns' types."""
    typed = [{"column": "close", "operator": "between", "value": " 20 , 90"}, {"column": "ticker", "operator": "in", "value": "U1, U2,U3 ,U42"},
             {"column": "timestamp", "operator": "greater_equal", "value": "2024-01-05"}, {"column": "openint", "operator": "is_not_null", "value": None}, {"column": "vol", "operator": "less_than", "value": "800"}]
    path = scratch_path(spark, "conditions")
    spark.createDataFrame([(flt.conditions_to_json(typed),)], "value string").coalesce(1).write.text(path, lineSep="\0")
    saved = spark.read.text(path, wholetext=True).first()["value"].rstrip("\0")
    return flt.apply_conditions(_bars9(spark, sf_dir), flt.conditions_from_json(saved))


# --- K1–K5, K10: our sinks read back by our readers ------------------------------------------

for _fmt in ("csv", "txt", "json", "parquet", "feather"):
    def _mk(fmt=_fmt):
        def run(spark, sf_dir):
            out = scratch_path(spark, f"roundtrip-{fmt}")
            sk.save(_bars9(spark, sf_dir), out, fmt)
            if fmt == "txt":
                return rd.read_csv(spark, out)
            return rd.load(spark, out, fmt)
        return run
    query(f"roundtrip_{_fmt}", BARS9)(_mk())


@query("roundtrip_json_array", BARS9)
def q_roundtrip_json_array(spark, sf_dir):
    out = scratch_path(spark, "roundtrip-json-array")
    sk.save(_bars9(spark, sf_dir), out, "json_array")
    return rd.read_json(spark, out)


@query("convert_csv_to_parquet", BARS9)
def q_convert(spark, sf_dir):
    src, dst = scratch_path(spark, "convert-src"), scratch_path(spark, "convert-dst")
    sk.save(_bars9(spark, sf_dir), src, "csv")
    sk.convert(spark, src, dst, "csv", "parquet")
    return rd.read_parquet(spark, dst)


#: Conditions on numbers, text and time at once.
SCAN_CONDITIONS = [{"column": "close", "operator": "greater_than", "value": "20"}, {"column": "vol", "operator": "between", "value": "100,900"},
                   {"column": "high", "operator": "less_equal", "value": 250.5}, {"column": "ticker", "operator": "not_equals", "value": "U7"}]


@query("scan_filtered", f"""WITH bars AS ({EVENTS_BARS}), b AS (SELECT * REPLACE (CASE WHEN vol % 7 = 3 THEN NULL ELSE close END AS close) FROM bars)
SELECT {BAR9_SQL} FROM b WHERE close > 20 AND vol BETWEEN 100 AND 900 AND high <= 250.5 AND ticker <> 'U7'""")
def q_scan_filtered(spark, sf_dir):
    """Stored prices are NaN in places, which a scan's own comparison may keep and the conformed one does not."""
    out = scratch_path(spark, "scan-filtered")
    _bars9(spark, sf_dir).withColumn("close", F.when(F.col("vol") % 7 == 3, float("nan")).otherwise(F.col("close"))).write.parquet(out)
    return rd.load(spark, out, "parquet", conditions=SCAN_CONDITIONS)


# --- S8, S9, V1, V2: a folder of good and broken Stooq files ---------------------------------

_FOLDERS: dict[tuple[str, str], str] = {}


def _stooq_folder(spark, sf_dir) -> str:
    """``good/`` holds one Stooq file per ticker; ``bad/`` the same rows without ``<CLOSE>``.

    Written once per session and input folder; the file queries below share it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        root = scratch_path(spark, "stooq-folder")
        raw = events_stooq_text(spark, sf_dir)
        write_stooq_text(raw, f"{root}/good")
        write_stooq_text(raw, f"{root}/bad", columns=[c for c in raw.columns if c not in ("<CLOSE>", "seq")])
        _FOLDERS[key] = root
    return _FOLDERS[key]


def _kind_ticker(path_col: str = "path"):
    return [F.regexp_extract(F.col(path_col), r"/(good|bad|missing)/", 1).alias("kind"),
            F.regexp_extract(F.col(path_col), r"_part=([^/]+)/", 1).alias("ticker")]


@query("load_with_skips", STOOQ9)
def q_load_with_skips(spark, sf_dir):
    bars, _ = rd.load_with_skips(spark, _stooq_folder(spark, sf_dir), "txt")
    return bars.drop("_source")


@query("load_skips", f"""WITH raw AS ({EVENTS_STOOQ}) SELECT DISTINCT 'bad' AS kind, "<TICKER>" AS ticker,
'Missing required columns: <CLOSE>' AS error FROM raw""")
def q_load_skips(spark, sf_dir):
    _, skipped = rd.load_with_skips(spark, _stooq_folder(spark, sf_dir), "txt")
    return skipped.select(*_kind_ticker(), "error")


@query("discover_files", f"""WITH raw AS ({EVENTS_STOOQ}), t AS (SELECT DISTINCT "<TICKER>" AS ticker FROM raw)
SELECT 'good' AS kind, ticker, true AS is_stooq, '' AS missing FROM t
UNION ALL SELECT 'bad', ticker, false, '<CLOSE>' FROM t""")
def q_discover_files(spark, sf_dir):
    found = fl.discover_stooq_files(spark, _stooq_folder(spark, sf_dir))
    return found.select(*_kind_ticker(), "is_stooq", F.array_join("missing", ",").alias("missing"))


@query("validate_files", f"""WITH raw AS ({EVENTS_STOOQ}), t AS (SELECT DISTINCT "<TICKER>" AS ticker FROM raw)
SELECT 'good' AS kind, ticker, 'txt' AS format, true AS valid, NULL::VARCHAR AS error FROM t
UNION ALL SELECT 'good', ticker, 'csv', false, 'Invalid file format: extension .txt does not match csv' FROM t
UNION ALL SELECT 'bad', ticker, 'txt', false, 'Missing required columns: <CLOSE>' FROM t
UNION ALL SELECT 'missing', ticker, 'txt', false, 'File not found' FROM t""")
def q_validate_files(spark, sf_dir):
    root = _stooq_folder(spark, sf_dir)
    listed = fl.list_files(spark, root, "*.txt").select("path")
    tickers = events_stooq_text(spark, sf_dir).select(F.col("`<TICKER>`").alias("t")).distinct()
    missing = tickers.select(F.concat(F.lit(f"{root}/missing/_part="), F.col("t"), F.lit("/gone.txt")).alias("path"))
    # one listing: files of good/ are candidates twice
    formats = F.when(F.col("path").contains("/good/"), F.array(F.lit("txt"), F.lit("csv"))).otherwise(F.array(F.lit("txt")))
    cands = listed.withColumn("format", F.explode(formats)).unionByName(missing.withColumn("format", F.lit("txt")))
    v = fl.validate_files(spark, cands, root)
    return v.select(*_kind_ticker(), "format", "valid", "error")


# --- S10, A16, A18: listings (byte sizes depend on the writer; unit tests have them) -------------

_FOLDER_FILES = f"""WITH raw AS ({EVENTS_STOOQ}), t AS (SELECT DISTINCT "<TICKER>" AS ticker FROM raw),
f AS (SELECT kind, ticker FROM t, (VALUES ('good'), ('bad')) k(kind))"""


@query("list_files", f"""{_FOLDER_FILES} SELECT kind, ticker, '.txt' AS extension, 'txt' AS format, true AS has_bytes FROM f""")
def q_list_files(spark, sf_dir):
    listed = fl.list_files(spark, _stooq_folder(spark, sf_dir), "*.txt")
    return listed.select(*_kind_ticker(), "extension", "format", (F.col("length") > 0).alias("has_bytes"))


@query("directory_rollup", f"""{_FOLDER_FILES} SELECT 'extension' AS group_kind, '.txt' AS "group", count(*) AS files FROM f
UNION ALL SELECT 'directory', kind || '/_part=' || ticker, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'total', '', count(*) FROM f""")
def q_directory_rollup(spark, sf_dir):
    root = _stooq_folder(spark, sf_dir)
    listed = fl.list_files(spark, root, "*.txt").withColumn("path", fl._plain(F.col("path")))
    return pf.directory_rollup(listed, root.removeprefix("file:").replace("///", "/")).select("group_kind", "group", "files")


@query("processing_estimate", f"""{_FOLDER_FILES} SELECT count(*) AS total_files, round(count(*) / 10.0, 2)::DOUBLE AS estimated_seconds,
round(count(*) / 600.0, 2)::DOUBLE AS estimated_minutes FROM f""")
def q_processing_estimate(spark, sf_dir):
    est = pf.processing_estimate(fl.list_files(spark, _stooq_folder(spark, sf_dir), "*.txt"))
    return est.select("total_files", "estimated_seconds", "estimated_minutes")


# --- S11, S12: incremental ingest ---------------------------------------------------------------

def _ingest(spark, sf_dir):
    src = scratch_path(spark, "ingest-src")
    table, ckpt, log = (scratch_path(spark, n) for n in ("ingest-table", "ingest-ckpt", "ingest-log"))
    # eight good files by number, and one without the close column, which is skipped and logged
    bars = events_bars(spark, sf_dir)
    for k in range(8):
        sk.save(bars.where(F.col("seq") % 8 == k).select(*BAR_COLUMNS).coalesce(1), f"{src}/{k}", "csv")
    sk.save(bars.select("ticker", "timestamp", "open").coalesce(1), f"{src}/bad", "csv")
    ingest_files(spark, src, table, ckpt, fmt="csv", batch_size=2, log_path=log)
    return table, log


@query("ingest_stream", BARS9)
def q_ingest_stream(spark, sf_dir):
    table, _ = _ingest(spark, sf_dir)
    return spark.read.parquet(table).select(*BAR_COLUMNS)


@query("ingest_log", """SELECT 5::BIGINT AS batches, 9::BIGINT AS files, 8::BIGINT AS loaded, 1::BIGINT AS failed, count(*) AS rows FROM events""")
def q_ingest_log(spark, sf_dir):
    _, log = _ingest(spark, sf_dir)
    return ingest_summary(spark, log).select("batches", "files", "loaded", "failed", "rows")


# --- K9, V6, §3 C, §3 D -------------------------------------------------------------------------

@query("export_filtered", f"""WITH bars AS ({EVENTS_BARS}) SELECT {BAR9_SQL} FROM bars
WHERE close > 100 AND format IN ('view', 'click')""")
def q_export_filtered(spark, sf_dir):
    from barspark.operators.standardize import conform_schema
    out = scratch_path(spark, "export")
    sk.export_view(conform_schema(_bars9(spark, sf_dir)), out, "parquet",
                   [{"column": "close", "operator": "greater_than", "value": 100},
                    {"column": "format", "operator": "in", "value": ["view", "click"]}])
    return rd.read_parquet(spark, out)


@query("clean_folder", f"""WITH raw AS ({EVENTS_STOOQ})
SELECT "<TICKER>", "<DATE>", "<TIME>", {', '.join(f'{num_sql(q)} AS {q}' for q in ['"<OPEN>"', '"<CLOSE>"'])},
"<TICKER>" AS source_file FROM raw
WHERE "<DATE>" IS NOT NULL AND "<DATE>" != '' AND "<DATE>" != 'nan'
AND (CASE WHEN regexp_full_match(substr(trim("<DATE>"), 1, 4), '\\s*[+-]?\\d+\\s*')
     THEN TRY_CAST(trim(substr(trim("<DATE>"), 1, 4)) AS INTEGER) END) BETWEEN 1900 AND 2025
AND try_strptime(trim("<DATE>"), '%Y%m%d') IS NOT NULL AND length(trim("<DATE>")) = 8
AND {' AND '.join(f'{num_sql(q)} IS NOT NULL' for q in ['"<OPEN>"', '"<HIGH>"', '"<LOW>"', '"<CLOSE>"'])}""")
def q_clean_folder(spark, sf_dir):
    from barspark.plans.report import clean_folder
    root, out = _stooq_folder(spark, sf_dir), scratch_path(spark, "cleaned")
    clean_folder(spark, f"{root}/good", out, "v2", as_of="2025-06-30",
                 partition_key=lambda c: F.regexp_extract(c, r"_part=([^/]+)/", 1))
    names = ["<TICKER>", "<DATE>", "<TIME>", "<OPEN>", "<CLOSE>"]
    folder = F.regexp_extract(plain_path(F.col("_source")), r"source_file=([^/]+)/", 1)

    def select(df, columns):
        df = rd._with_source(df, True)
        return df.select(*[F.col(columns[c]).alias(c) for c in names], plain_path(F.nullif(folder, F.lit(NO_VALUE))).alias("source_file"))

    back = read_layouts(spark, [out], select, recursive=True, glob="*.csv")
    return back.select("`<TICKER>`", "`<DATE>`", "`<TIME>`", F.col("`<OPEN>`").cast("double").alias("<OPEN>"),
                       F.col("`<CLOSE>`").cast("double").alias("<CLOSE>"), "source_file")


@query("quality_report_files", f"""WITH raw AS ({EVENTS_STOOQ}),
b AS (SELECT "<TICKER>" AS ticker, {stooq_ts_sql()} AS ts, {num_sql('"<CLOSE>"')} AS close FROM raw),
v AS (SELECT * FROM b WHERE ts IS NOT NULL)
SELECT ticker, count(*) AS records, count(DISTINCT CAST(ts AS DATE)) AS trading_days, min(ts) AS start_date,
max(ts) AS end_date, max(ts) > TIMESTAMP '2024-01-29 12:00:00' AS has_future_dates FROM v GROUP BY ticker""")
def q_quality_report_files(spark, sf_dir):
    from barspark.plans.report import quality_report
    root = _stooq_folder(spark, sf_dir)
    rep = quality_report(spark, root, as_of="2024-01-29 12:00:00")
    # files failing the header check (the bad/ folder) are reported as issues, not profiled
    return rep["files"].select(F.regexp_extract("source", r"_part=([^/]+)/", 1).alias("ticker"), "records",
                               "trading_days", "start_date", "end_date", "has_future_dates")


@query("preprocess_file", f"""WITH bars AS ({EVENTS_BARS}),
st AS (SELECT {', '.join(f'min({c}) AS a_{c}, max({c}) - min({c}) AS s_{c}' for c in ['open', 'high', 'low', 'close', 'vol', 'openint'])} FROM bars)
SELECT {', '.join(f"{rnd(f'({c} - a_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END)')} AS {c}" for c in ['open', 'high', 'low', 'close', 'vol', 'openint'])}
FROM bars, st""")
def q_preprocess_file(spark, sf_dir):
    from barspark.functions.columns import rounded
    from barspark.plans.prepare import preprocess_file
    src, out = scratch_path(spark, "pre-src"), scratch_path(spark, "pre-out")
    sk.save(_bars9(spark, sf_dir), src, "parquet")
    preprocess_file(spark, src, out, "parquet", "minmax")
    back = spark.read.parquet(out)
    return back.select(*[rounded(c).alias(c) for c in back.columns])
