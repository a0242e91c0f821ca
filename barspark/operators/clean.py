"""Validation and cleaning (V3–V9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.columns import numeric
from barspark.schema import STOOQ_CLEAN_REQUIRED

_NUMERIC_RAW = ["<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>", "<OPENINT>"]
_CRITICAL = ["<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>"]
_INT_PATTERN = r"^\s*[+-]?\d+\s*$"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _require(df: DataFrame) -> None:
    missing = [c for c in STOOQ_CLEAN_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"not a Stooq frame: missing required columns {missing}")


def _as_of_year(as_of: str | None) -> Column:
    return F.year(F.to_date(F.lit(as_of))) if as_of else F.year(F.current_date())


def _clean_flags(df: DataFrame, mode: str, as_of: str | None) -> dict[str, Column]:
    date = F.trim(_q("<DATE>").cast("string"))
    year_txt = F.substring(date, 1, 4)
    year = F.when(year_txt.rlike(_INT_PATTERN), F.trim(year_txt).try_cast("int"))
    top = _as_of_year(as_of) + (1 if mode == "v1" else 0)
    flags = {}
    if mode == "v2":
        flags["date_present"] = date.isNotNull() & (date != "") & (date != "nan")
    else:
        flags["date_present"] = F.lit(True)
    flags["year_ok"] = flags["date_present"] & year.between(F.lit(1900), top)
    flags["date_ok"] = flags["year_ok"] & F.try_to_date(date, "yyyyMMdd").isNotNull() & (F.length(date) == 8)
    flags["numeric_ok"] = flags["date_ok"]
    for c in _CRITICAL:
        flags["numeric_ok"] = flags["numeric_ok"] & numeric(_q(c)).isNotNull()
    return flags


def clean_stooq(df: DataFrame, mode: str = "v1", as_of: str | None = None) -> DataFrame:
    """Clean raw Stooq rows (V3 for ``mode='v1'``, V4 for ``mode='v2'``).

    v1: year in [1900, as_of year + 1], ``<DATE>`` parses as ``yyyyMMdd``, numerics
    coerced, rows with a NULL open/high/low/close dropped. v2 also drops NULL, ``nan``
    and empty dates, needs an integer year and caps it at the as_of year. ``as_of`` is a
    date text; default today.
    """
    if mode not in ("v1", "v2"):
        raise ValueError(f"unknown clean mode {mode!r}")
    _require(df)
    flags = _clean_flags(df, mode, as_of)
    out = []
    for c in df.columns:
        out.append(numeric(_q(c)).alias(c) if c in _NUMERIC_RAW else _q(c))
    return df.filter(flags["numeric_ok"]).select(*out)


def clean_counts(df: DataFrame, mode: str = "v1", as_of: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Row counts after each cleaning stage (V5), in one pass; optionally per group."""
    _require(df)
    flags = _clean_flags(df, mode, as_of)
    aggs = [F.count(F.lit(1)).alias("original_rows")]
    if mode == "v2":
        aggs.append(F.count_if(flags["date_present"]).alias("after_date_present"))
    aggs += [F.count_if(flags["year_ok"]).alias("after_year_filter"),
             F.count_if(flags["date_ok"]).alias("after_date_parse"),
             F.count_if(flags["numeric_ok"]).alias("after_numeric_check")]
    return df.groupBy(*(by or [])).agg(*aggs)


def drop_nulls(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL in any column (V7)."""
    return df.na.drop(how="any")


def drop_nulls_count(df: DataFrame) -> DataFrame:
    """One row: rows before, after and dropped by :func:`drop_nulls`, in one pass."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & _q(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(complete).alias("rows_after")) \
        .withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def dedupe(df: DataFrame) -> DataFrame:
    """Drop full-row duplicates (V8). Partial aggregation collapses copies map-side."""
    return df.dropDuplicates()


def dedupe_count(df: DataFrame) -> DataFrame:
    """One row: rows before, distinct rows and duplicates removed."""
    groups = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(F.sum("_copies").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")) \
        .withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after"))


# Hint texts per error kind.
HINTS = {
    "not_found": ["Check if the file path is correct",
                  "Verify the file exists in the specified location",
                  "Try using the file browser to select the file"],
    "empty": ["Check if the file contains data",
              "Verify the file wasn't corrupted during transfer",
              "Try opening the file in a text editor to verify content"],
    "format": ["Check if the file format is supported",
               "Verify the file extension matches the content",
               "Try converting the file to a supported format"],
    "permission": ["Check file permissions",
                   "Try running the application with elevated privileges",
                   "Verify you have read access to the file"],
    "other": ["Check the file format and content",
              "Verify all required dependencies are installed",
              "Try refreshing the file list"],
}


def hint_kind(error: Column) -> Column:
    """Error text → hint kind; rules tried in order (V9)."""
    low = F.lower(error)
    return (F.when(error.contains("File not found"), F.lit("not_found"))
            .when(error.contains("File is empty"), F.lit("empty"))
            .when(low.contains("format"), F.lit("format"))
            .when(low.contains("permission"), F.lit("permission"))
            .otherwise(F.lit("other")))


def issue_hints(issues: DataFrame, error_col: str = "error") -> DataFrame:
    """Add ``hint_kind`` and the ``hints`` list to an issue table."""
    kind = hint_kind(F.col(error_col))
    hints = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return issues.withColumn("hint_kind", kind).withColumn("hints", F.element_at(hints, F.col("hint_kind")))
