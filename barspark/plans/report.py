"""Folder-level jobs: the quality report over Stooq files (§3 C) and cleaning every file (V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.columns import file_stem, numeric, stooq_timestamp
from barspark.operators import clean as cl
from barspark.operators import profile as pf
from barspark.schema import ANALYSIS_REQUIRED
from barspark.session import written
from barspark.sources import files as fl
from barspark.sources.headers import header_names, of_files, plain_path, separator
from barspark.sources.lines import write_lines
from barspark.sources.listing import inspected, known_store
from barspark.sources.readers import read_csv, read_stooq_raw


def quality_report(spark: SparkSession, root: str, as_of: str | None = None,
                   source_key=None) -> dict[str, DataFrame]:
    """Per-file report over the Stooq ``.txt`` files under ``root``.

    Returns ``files`` (per-file profile with size), ``issues`` (invalid / future dates,
    no valid rows, files failing the header check), ``skipped`` (zero-byte and
    header-only files), ``summary`` (one row) and ``size_classes`` (files per class). ``source_key`` maps the file path column to the report key
    (default: the path itself, without ``file:``). A file needs the columns ``<DATE>``, ``<TIME>`` and ``<CLOSE>``; files without them are
    not read. The tables are separate plans over the files.
    """
    key = source_key or (lambda c: c)
    # one look at the folder, kept as a small table: every figure below starts from it
    seen = fl.needs_columns(inspected(spark, root, "*.txt"), ANALYSIS_REQUIRED)
    seen = written(seen.select("path", "length", "valid", "error", separator(F.col("header")).alias("sep"), header_names(F.col("header")).alias("names")), "inspected")
    listing = seen.withColumn("source", key(fl._plain(F.col("path"))))
    verdict = listing
    found = of_files(seen.where("valid"))
    raw = read_stooq_raw(spark, root, with_source=True, layouts=found).withColumn("source", key(fl._plain(plain_path(F.col("_source")))))
    bars = raw.select("source", stooq_timestamp(F.col("`<DATE>`"), F.col("`<TIME>`")).alias("timestamp"),
                      numeric(F.col("`<CLOSE>`")).alias("close"))
    good = verdict.filter(F.col("valid")).select("source")
    sizes = listing.select("source", F.col("length").alias("file_size"))
    files = (pf.file_quality(bars, "source", as_of=as_of, sizes=sizes)
             .withColumn("ticker", file_stem(F.col("source"))))
    issues = (pf.feed_issues(raw, "source", as_of)
              .unionByName(verdict.filter(~F.col("valid") & (F.col("error") != "File is empty"))
                           .select("source", F.lit("invalid_file").alias("kind"), "error")))
    empty = verdict.filter(F.col("error") == "File is empty").select(
        "source", F.lit("Empty file (0 bytes)").alias("reason"), F.lit(0).cast("long").alias("size"))
    header_only = (good.join(raw.select("source").distinct(), "source", "left_anti")
                   .join(sizes, "source").select("source", F.lit("Empty CSV file (no data rows)").alias("reason"),
                                                 F.col("file_size").alias("size")))
    skipped = empty.unionByName(header_only)
    summary = pf.feed_summary(bars.withColumn("ticker", file_stem(F.col("source"))), "source", "ticker")
    classes = (pf.size_classes(bars, "source")
               .unionByName(skipped.groupBy(F.lit("empty").alias("size_class")).agg(F.count(F.lit(1)).alias("files")))
               .groupBy("size_class").agg(F.sum("files").alias("files")))
    return {"files": files, "issues": issues, "skipped": skipped, "summary": summary, "size_classes": classes}


def timestamp_report(spark: SparkSession, root: str, stooq: bool = True, as_of: str | None = None,
                     pattern: str | None = None) -> dict[str, DataFrame]:
    """Timestamps of the files under ``root`` before loading (A13): Stooq text, or text with a ``timestamp`` column.

    Returns ``files`` (per file: rows, invalid dates with the first five row numbers, future dates, time
    range), ``errors`` (``path, error``: empty files and missing columns) and ``summary`` (one row: files, processed
    files, files with errors, earliest and latest time).
    """
    pattern = pattern or ("*.txt" if stooq else "*.csv")
    need = ["<DATE>", "<TIME>"] if stooq else ["timestamp"]
    seen = fl.needs_columns(inspected(spark, root, pattern), need, "Empty file")
    seen = written(seen.select("path", "length", "valid", "error", separator(F.col("header")).alias("sep"), header_names(F.col("header")).alias("names")), "inspected")
    counts = {r["valid"]: r["count"] for r in seen.groupBy("valid").count().collect()}
    good, bad = counts.get(True, 0), counts.get(False, 0)
    found = of_files(seen.where("valid"))
    errors = seen.where(~F.col("valid")).select("path", "error").orderBy("path")
    if stooq:
        raw = read_stooq_raw(spark, root, with_source=True, layouts=found) if good else spark.createDataFrame([], "`<DATE>` string, `<TIME>` string, _source string")
        rows = raw.select(F.col("_source").alias("source"), stooq_timestamp(F.col("`<DATE>`"), F.col("`<TIME>`")).alias("timestamp"))
    else:
        rows = (read_csv(spark, root, with_source=True, layouts=found) if good else spark.createDataFrame([], "_source string, timestamp timestamp_ntz")).select(F.col("_source").alias("source"), "timestamp")
    # the id grows with a row's place in its file: the splits of a scan are numbered in file order. Kept as a table, as the figures
    # go over the rows several times
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "timestamps")
    figures = pf.timestamp_figures(rows, ["_at"], as_of)
    summary = figures.agg(F.count(F.lit(1)).alias("with_rows"), F.min("first_timestamp").alias("earliest_date"), F.max("last_timestamp").alias("latest_date"))
    summary = summary.select(F.lit(good + bad).cast("long").alias("total_files"), F.lit(good).cast("long").alias("processed_files"),
                             F.lit(bad).cast("long").alias("files_with_errors"), "earliest_date", "latest_date")
    return {"files": figures, "errors": errors, "summary": summary}


def clean_folder(spark: SparkSession, root: str, out: str, mode: str = "v2", as_of: str | None = None,
                 partition_key=None) -> DataFrame:
    """Clean every Stooq file under ``root`` in one job (V6) and write them partitioned by file.

    ``partition_key`` maps the source path to the output folder value (default: the path below ``root``, so equal names in
    two folders stay apart). Files with no row left produce no output, as with one file.
    """
    top = fl._plain(F.lit(root.rstrip("/") + "/"))
    key = partition_key or (lambda c: F.regexp_replace(fl._plain(plain_path(c)), F.concat(F.lit("^\\Q"), top, F.lit("\\E")), F.lit("")))
    raw = read_stooq_raw(spark, root, with_source=True, recursive=True, glob="*.txt")
    cleaned = cl.clean_stooq(raw, mode, as_of).withColumn("source_file", key(F.col("_source"))).drop("_source")
    if known_store(out):
        # one file a folder, as many as files were read: tasks write them
        names = [c for c in cleaned.columns if c != "source_file"]
        rows = cleaned.select("source_file", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])).alias("line"), F.monotonically_increasing_id().alias("_at"))
        write_lines(rows, out, "source_file", ",".join(names), ["_at"], ".csv")
    else:
        cleaned.write.mode("overwrite").partitionBy("source_file").option("header", True).csv(out)
    return cleaned
