"""Aggregation and profiling.

Per-source functions take a ``source`` column: a file path when bars were read from
files (``_metadata.file_path``), or any key such as the ticker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.columns import base_name, file_extension, parent_dir, stooq_timestamp
from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, global_position, with_key_rank
from barspark.operators.stats import exact_percentiles, exact_percentiles_many
from barspark.schema import SIZE_CLASS_BOUNDS


def _c(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def _as_of(as_of: str | None) -> Column:
    return F.to_timestamp(F.lit(as_of)).cast("timestamp_ntz") if as_of else F.localtimestamp()


# --- A1–A3, A14: ticker statistics -------------------------------------------------------

def ticker_distribution(df: DataFrame, ticker: str = "ticker", ts: str = "timestamp") -> DataFrame:
    """Rows, first and last timestamp per ticker (A1). NULL tickers are not a group."""
    return (df.filter(_c(ticker).isNotNull()).groupBy(_c(ticker).alias("ticker"))
            .agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("first_timestamp"),
                 F.max(ts).alias("last_timestamp")))


def ticker_totals(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Total rows, distinct tickers and their integer-division average (A2)."""
    t = _c(ticker)
    return (df.agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct(t).alias("total_tickers"))
            .withColumn("avg_records_per_ticker",
                        F.when(F.col("total_tickers") > 0,
                               (F.col("total_records") / F.col("total_tickers")).cast("long"))))


def ticker_count_stats(df: DataFrame, ticker: str = "ticker", ts: str = "timestamp") -> DataFrame:
    """Min, max, median and mean of per-ticker row counts; global first/last time (A3)."""
    counts = ticker_distribution(df, ticker, ts).cache()
    median = exact_percentiles(counts, "records", [0.5])[0]
    row = counts.agg(F.min("records").alias("min_records"), F.max("records").alias("max_records"),
                     F.avg("records").alias("mean_records"),
                     F.min("first_timestamp").alias("first_timestamp"),
                     F.max("last_timestamp").alias("last_timestamp"))
    # one row, taken while the counts are still kept
    out = row.withColumn("median_records", F.lit(median).cast("double"))
    out = df.sparkSession.createDataFrame(out.collect(), out.schema)
    counts.unpersist()
    return out


def suggested_targets(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Default balance bounds: target = total // tickers, minimum = target // 2."""
    tot = ticker_totals(df, ticker)
    return tot.select("total_records", "total_tickers",
                      F.col("avg_records_per_ticker").alias("target_records"),
                      (F.col("avg_records_per_ticker") / 2).cast("long").alias("min_records"))


# --- A4, A5: describe and coverage ------------------------------------------------------

DESCRIBE_SCHEMA = ("column_name string, count long, unique long, top string, freq long, mean double, "
                   "std double, min double, p25 double, p50 double, p75 double, max double, "
                   "min_time timestamp_ntz, max_time timestamp_ntz")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column statistics like pandas ``describe(include='all')`` (A4), one row per column.

    Text and boolean columns: count, unique, top (most frequent; ties → smallest value), freq,
    all from one count per value. NaN counts as NULL.
    Numeric columns: count, mean, sample std, min, exact 25/50/75 % (linear), max.
    Timestamp and date columns: count and the first and last time (``min_time``, ``max_time``).
    Means and counts come from one aggregate; the percentiles from distributed sorts.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    num = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    flags = [f.name for f in fields if isinstance(f.dataType, T.BooleanType)]
    txt = [f.name for f in fields if isinstance(f.dataType, T.StringType)] + flags
    tms = [f.name for f in fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    aggs = []
    for c in tms:
        x = F.col(f"`{c}`").cast("timestamp_ntz")
        aggs += [F.count(x).alias(f"n_{c}"), F.min(x).alias(f"t0_{c}"), F.max(x).alias(f"t1_{c}")]
    clean = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in num}
    for c in num:
        x = clean[c]
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"mean_{c}"), F.stddev_samp(x).alias(f"std_{c}"),
                 F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    base = df.agg(*aggs).first() if aggs else None
    tops = {}
    if txt:
        # every text column's most frequent value in one job: unpivot, count, keep the max
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), _c(c).cast("string").alias("v")) for i, c in enumerate(txt)]))
        freq = (df.select(pairs.alias("p")).select("p.k", "p.v").filter(F.col("v").isNotNull())
                .groupBy("k", "v").agg(F.count(F.lit(1)).alias("f")))
        best = freq.groupBy("k").agg(F.min(F.struct((-F.col("f")).alias("nf"), F.col("v").alias("v"))).alias("m"),
                                     F.sum("f").alias("n"), F.count(F.lit(1)).alias("u"))
        tops = {txt[r["k"]]: r for r in best.collect()}
    rows = []
    for c in txt:
        top = tops.get(c)
        rows.append((c, top["n"] if top else 0, top["u"] if top else 0, top["m"]["v"] if top else None,
                     -top["m"]["nf"] if top else None, None, None, None, None, None, None, None, None, None))
    quart = exact_percentiles_many(df.select(*[clean[c].alias(c) for c in num]), num, [0.25, 0.5, 0.75])
    for c in num:
        p25, p50, p75 = quart[c]
        rows.append((c, base[f"n_{c}"], None, None, None, base[f"mean_{c}"], base[f"std_{c}"],
                     base[f"min_{c}"], p25, p50, p75, base[f"max_{c}"], None, None))
    for c in tms:
        rows.append((c, base[f"n_{c}"], None, None, None, None, None, None, None, None, None, None,
                     base[f"t0_{c}"], base[f"t1_{c}"]))
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


def date_coverage(df: DataFrame, ts: str = "timestamp", ticker: str = "ticker") -> DataFrame:
    """Date range of the data (A5): start, end, distinct days, rows, tickers."""
    return df.agg(F.min(ts).alias("start"), F.max(ts).alias("end"),
                  F.count_distinct(F.to_date(_c(ts))).alias("periods"),
                  F.count(F.lit(1)).alias("records"), F.count_distinct(_c(ticker)).alias("tickers"))


# --- A6–A13: per-source quality ------------------------------------------------------------

def _per_day(df: DataFrame, source: str, ts: str, *more: Column) -> DataFrame:
    """One row per (source, date) of the rows with a time: the table that the quality figures derive from."""
    return (df.filter(_c(ts).isNotNull()).groupBy(_c(source).alias("source"), F.to_date(_c(ts)).alias("date"))
            .agg(F.count(F.lit(1)).alias("n"), *more))


def _business_days(first: Column, last: Column) -> Column:
    """Mondays to Fridays from ``first`` to ``last``, both included."""
    days = F.date_diff(last, first) + 1
    rest = days % 7
    odd = sum((F.when((F.lit(i) < rest) & ((F.weekday(first) + i) % 7 < 5), 1).otherwise(0) for i in range(6)), F.lit(0))
    return F.floor(days / 7) * 5 + odd


def _missing() -> list[Column]:
    d = F.col("date")
    return [F.min(d).alias("_d0"), F.max(d).alias("_d1"), F.count_if(F.weekday(d) < 5).alias("_there")]


def _gap_columns(df: DataFrame) -> DataFrame:
    """``gap_count, has_gaps`` from first and last date and the business days that have a row."""
    return (df.withColumn("gap_count", (_business_days(F.col("_d0"), F.col("_d1")) - F.col("_there")).cast("long"))
            .withColumn("has_gaps", F.col("gap_count") > 0).drop("_d0", "_d1", "_there"))


def gap_days(df: DataFrame, source: str = "source", ts: str = "timestamp") -> DataFrame:
    """Business days (Mon–Fri) between a source's first and last date that have no row.

    The days between a date and the one before it are generated with ``sequence``; a window partition
    holds one row per day of a source, however many rows the source has.
    """
    before = F.lag("date").over(Window.partitionBy("source").orderBy("date"))
    holes = _per_day(df, source, ts).select("source", "date", before.alias("_before")).where(F.date_diff("date", "_before") > 1)
    return (holes.select("source", F.explode(F.sequence(F.date_add("_before", 1), F.date_sub("date", 1))).alias("missing_date"))
            .where(F.weekday("missing_date") < 5))


def gap_count(df: DataFrame, source: str = "source", ts: str = "timestamp") -> DataFrame:
    """Missing business days per source, zero included, and the gap flag (A7): the business days of its
    span less those that have a row, so no calendar is built."""
    return _gap_columns(_per_day(df, source, ts).groupBy("source").agg(*_missing()))


def file_quality(df: DataFrame, source: str = "source", ts: str = "timestamp", close: str = "close",
                 as_of: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Per-source profile (A6): records, trading days, first/last time, close min/max/avg,
    future-date flag, gap count; ``sizes`` (``source, file_size``) adds the file size.

    One scan: rows are aggregated to (source, date), and these to sources.
    """
    days = _per_day(df, source, ts, F.min(ts).alias("t0"), F.max(ts).alias("t1"), F.min(close).alias("lo"),
                    F.max(close).alias("hi"), F.sum(close).alias("total"), F.count(close).alias("closes"))
    out = days.groupBy("source").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("trading_days"), F.min("t0").alias("start_date"),
        F.max("t1").alias("end_date"), F.min("lo").alias("close_min"), F.max("hi").alias("close_max"),
        (F.sum("total") / F.sum("closes")).alias("close_avg"), *_missing())
    out = _gap_columns(out).withColumn("has_future_dates", F.col("end_date") > _as_of(as_of))
    if sizes is not None:
        out = out.join(sizes.select("source", "file_size"), "source", "left")
    return out


def size_class(records: Column) -> Column:
    """Record count → size class (A10)."""
    expr = F.when(records == 0, F.lit("empty"))
    for name, bound in SIZE_CLASS_BOUNDS:
        expr = expr.when(records < bound, F.lit(name))
    return expr.otherwise(F.lit("large"))


def size_classes(df: DataFrame, source: str = "source", ts: str = "timestamp") -> DataFrame:
    """Sources per size class, counting valid-timestamp rows (A10)."""
    per = df.groupBy(_c(source).alias("source")).agg(F.count(_c(ts)).alias("records"))
    return per.groupBy(size_class(F.col("records")).alias("size_class")).agg(F.count(F.lit(1)).alias("files"))


def feed_summary(df: DataFrame, source: str = "source", ticker: str = "ticker", ts: str = "timestamp") -> DataFrame:
    """Files, tickers, records, earliest, latest and the float average per ticker."""
    valid = df.filter(_c(ts).isNotNull())
    return (valid.agg(F.count_distinct(_c(source)).alias("total_files"),
                      F.count_distinct(_c(ticker)).alias("total_tickers"),
                      F.count(F.lit(1)).alias("total_records"),
                      F.min(ts).alias("earliest_date"), F.max(ts).alias("latest_date"))
            .withColumn("avg_records_per_ticker",
                        F.when(F.col("total_tickers") > 0,
                               F.col("total_records") / F.col("total_tickers"))))


def raw_timestamps(raw: DataFrame, source: str = "source") -> DataFrame:
    """Raw Stooq rows → ``source, timestamp`` (NULL when ``<DATE>``+``<TIME>`` fail)."""
    time = F.col("`<TIME>`") if "<TIME>" in raw.columns else None
    return raw.select(_c(source).alias("source"), stooq_timestamp(F.col("`<DATE>`"), time).alias("timestamp"),
                      *[c for c in raw.columns if c not in (source,)])


def invalid_dates(raw: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source whose date and time do not parse."""
    t = raw_timestamps(raw, source)
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("rows"),
                                   F.count_if(F.col("timestamp").isNull()).alias("invalid_dates"))


def future_dates(df: DataFrame, source: str = "source", ts: str = "timestamp", as_of: str | None = None) -> DataFrame:
    """Rows after ``as_of`` per source and the latest such time."""
    fut = _c(ts) > _as_of(as_of)
    return df.groupBy(_c(source).alias("source")).agg(
        F.count_if(fut).alias("future_dates"), F.max(F.when(fut, _c(ts))).alias("max_future_date"))


def feed_issues(raw: DataFrame, source: str = "source", as_of: str | None = None) -> DataFrame:
    """Issue list (A12): ``source, kind, error`` rows with the fixed texts of the report.

    Kinds: ``invalid_dates`` ("Contains n invalid dates"), ``future_dates`` ("Contains n
    future dates (up to YYYY-MM-DD)") and ``skipped`` ("No valid dates after cleaning").
    """
    t = raw_timestamps(raw, source)
    fut = F.col("timestamp") > _as_of(as_of)
    per = t.groupBy("source").agg(
        F.count_if(F.col("timestamp").isNull()).alias("bad"),
        F.count(F.col("timestamp")).alias("good"),
        F.count_if(fut).alias("fut"),
        F.max(F.when(fut, F.col("timestamp"))).alias("fut_max"))
    bad = per.filter(F.col("bad") > 0).select(
        "source", F.lit("invalid_dates").alias("kind"),
        F.format_string("Contains %d invalid dates", F.col("bad")).alias("error"))
    skipped = per.filter(F.col("good") == 0).select(
        "source", F.lit("skipped").alias("kind"), F.lit("No valid dates after cleaning").alias("error"))
    future = per.filter(F.col("fut") > 0).select(
        "source", F.lit("future_dates").alias("kind"),
        F.format_string("Contains %d future dates (up to %s)", F.col("fut"),
                        F.date_format("fut_max", "yyyy-MM-dd")).alias("error"))
    return bad.unionByName(skipped).unionByName(future)


def timestamp_analysis(raw: DataFrame, source: str = "source", order: Sequence[str] = ("seq",),
                       as_of: str | None = None, first_n: int = 5,
                       block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Per source (A13): rows, invalid count with the first ``first_n`` invalid row numbers
    (0-based, file order), future count and latest future time, valid time range.

    Row numbers come from a skew-safe rank; the first invalid ones are picked per
    ``(source, block)`` and then per source, keeping at most ``first_n`` per block.
    """
    return timestamp_figures(raw_timestamps(raw, source), order, as_of, first_n, block_rows)


def timestamp_figures(t: DataFrame, order: Sequence[str], as_of: str | None = None, first_n: int = 5,
                      block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """:func:`timestamp_analysis` of rows that have ``source`` and a parsed ``timestamp`` (NULL: invalid)."""
    fut = F.col("timestamp") > _as_of(as_of)
    per = t.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("timestamp").isNull()).alias("invalid_dates"),
        F.count_if(fut).alias("future_dates"),
        F.max(F.when(fut, F.col("timestamp"))).alias("max_future_date"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    ranked = with_key_rank(t, ["source"], list(order), block_rows, rank="_row")
    bad = ranked.filter(F.col("timestamp").isNull())
    # the first_n smallest row numbers per (source, block), then per source: each step
    # keeps at most first_n numbers per block, so no group grows with the data
    in_block = Window.partitionBy("source", "_blk").orderBy("_row")
    block_firsts = bad.withColumn("_k", F.row_number().over(in_block)).filter(F.col("_k") <= first_n)
    firsts = block_firsts.groupBy("source").agg(
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("_row")), 1, first_n),
                                 lambda x: x.cast("string")), ",").alias("first_invalid_rows"))
    return per.join(firsts, "source", "left")


# --- A15–A18: file listings ------------------------------------------------------------------

def file_category(path: Column) -> Column:
    """Path parts → category."""
    parts = F.split(path, "/")
    has = lambda p: F.array_contains(parts, p)
    return (F.when(has("us"), F.when(has("stocks") | has("etfs"), F.lit("us_stocks")).otherwise(F.lit("other")))
            .when(has("world"),
                  F.when(has("bonds"), F.lit("world_bonds"))
                  .when(has("cryptocurrencies"), F.lit("cryptocurrencies"))
                  .when(has("money market"), F.lit("money_market"))
                  .when(has("indices"), F.lit("indices"))
                  .otherwise(F.lit("other")))
            .otherwise(F.lit("other")))


def file_categories(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("category", file_category(_c(path)))


def file_info(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """path, name, size, size_mb (2 places), extension, directory."""
    return files.select(_c(path).alias("path"), base_name(_c(path)).alias("name"),
                        _c(size).alias("size"), F.round(_c(size) / F.lit(1024 * 1024), 2).alias("size_mb"),
                        file_extension(_c(path)).alias("extension"), parent_dir(_c(path)).alias("directory"))


def directory_rollup(files: DataFrame, root: str, path: str = "path", size: str = "length") -> DataFrame:
    """Files and MB per extension and per relative directory, plus a total row.

    Output rows ``group_kind`` (``extension``, ``directory``, ``total``), ``group``,
    ``files``, ``total_size_mb``. One pass over ``files``, which may be a listing of a folder: each file counts in its three groups.
    """
    info = file_info(files, path, size)
    root = root.rstrip("/")
    rel = F.regexp_replace(F.col("directory"), "^" + _regex_quote(root) + "/?", "")
    info = info.withColumn("rel_dir", F.when(rel == "", F.lit(".")).otherwise(rel))
    kinds = {"extension": F.col("extension"), "directory": F.col("rel_dir"), "total": F.lit("")}
    groups = F.array(*[F.struct(F.lit(k).alias("group_kind"), g.alias("group")) for k, g in kinds.items()])
    return (info.select(F.inline(groups), "size_mb").groupBy("group_kind", "group")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("size_mb").alias("total_size_mb")))


def _regex_quote(s: str) -> str:
    import re
    return re.escape(s)


def batch_assign(files: DataFrame, batch_size: int = 100, order: Sequence[str] = ("path",)) -> DataFrame:
    """Batch number ``idx div batch_size`` in ``order``."""
    pos = global_position(files, list(order), "file_idx")
    return pos.withColumn("batch", (F.col("file_idx") / F.lit(batch_size)).cast("long"))


def processing_estimate(files: DataFrame, files_per_second: float = 10.0, size: str = "length") -> DataFrame:
    """Files, MB and the time estimate at a fixed file rate."""
    mb = F.round(_c(size) / F.lit(1024 * 1024), 2)
    base = files.agg(F.count(F.lit(1)).alias("total_files"), F.sum(mb).alias("_mb"))
    secs = F.col("total_files") / F.lit(files_per_second)
    return base.select(
        "total_files", F.round(F.coalesce("_mb", F.lit(0.0)), 2).alias("total_size_mb"),
        F.round(secs, 2).alias("estimated_seconds"), F.round(secs / 60, 2).alias("estimated_minutes"),
        F.round(secs / 3600, 2).alias("estimated_hours"), F.lit(files_per_second).alias("files_per_second"))
