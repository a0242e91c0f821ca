"""Standardisation into the bar schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.columns import file_stem, numeric, numeric_from, stooq_timestamp
from barspark.schema import BAR_COLUMNS, BAR_SCHEMA, NUMERIC_COLUMNS, STOOQ_COLUMNS, STOOQ_STANDARDIZE_REQUIRED


def _require(df: DataFrame, required: list[str], what: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing required columns {missing}")


def _stooq_select(df: DataFrame, fmt: str):
    has = set(df.columns)
    ticker = F.col("`<TICKER>`").cast("string") if "<TICKER>" in has else F.lit(None).cast("string")
    time = F.col("`<TIME>`") if "<TIME>" in has else None
    ts = stooq_timestamp(F.col("`<DATE>`"), time) if "<DATE>" in has else F.lit(None).cast("timestamp_ntz")
    cols = [ticker.alias("ticker"), ts.alias("timestamp")]
    for name, raw in zip(NUMERIC_COLUMNS, ["<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>", "<OPENINT>"]):
        cols.append((numeric(F.col(f"`{raw}`")) if raw in has else F.lit(None).cast("double")).alias(name))
    cols.append(F.lit(fmt).alias("format"))
    return cols


def standardize_stooq(df: DataFrame, fmt: str = "txt", keep: list[str] | None = None,
                      require_rows: bool = False) -> DataFrame:
    """Strict Stooq standardisation.

    ``<DATE>``‖zero-filled ``<TIME>`` → ``timestamp`` (unparsable → NULL); numeric text →
    DOUBLE (unparsable → NULL); ``ticker`` NULL when ``<TICKER>`` is absent; ``openint``
    optional; ``format`` = ``fmt``. Rows without a timestamp or close are dropped.
    ``keep`` carries extra input columns through (e.g. a source file column).
    ``require_rows`` raises ``ValueError`` when no row survives (one small job).
    """
    _require(df, STOOQ_STANDARDIZE_REQUIRED, "Stooq standardisation")
    extra = [F.col(c) for c in (keep or [])]
    out = df.select(*_stooq_select(df, fmt), *extra).na.drop(subset=["timestamp", "close"])
    if require_rows and out.limit(1).count() == 0:
        raise ValueError("No valid data after standardisation")
    return out


def clean_header_name(name: str) -> str:
    """BOM and blanks stripped, angle brackets removed, upper-cased."""
    return name.replace("﻿", "").strip().strip("<>").strip().upper()


def standardize_lenient(df: DataFrame, fmt: str = "txt", keep: list[str] | None = None) -> DataFrame:
    """Lenient Stooq standardisation (T2): header names are matched loosely.

    Names are cleaned (:func:`clean_header_name`) and matched to the ten Stooq names;
    nothing is required, absent columns become NULL. The strict tail then applies.
    """
    known = {c.strip("<>"): c for c in STOOQ_COLUMNS}
    renamed = []
    for c in df.columns:
        key = clean_header_name(c)
        target = known.get(key)
        renamed.append(F.col(f"`{c}`").alias(target) if target else F.col(f"`{c}`"))
    std = df.select(*renamed)
    extra = [F.col(c) for c in (keep or [])]
    return std.select(*_stooq_select(std, fmt), *extra).na.drop(subset=["timestamp", "close"])


def conform_schema(df: DataFrame, fmt: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Conform any frame to the bar schema.

    Missing columns become NULL, extra columns are dropped, columns come in schema
    order; numerics are coerced to DOUBLE (bad, NaN or nested → NULL); timestamps are coerced
    (text parsed, bad → NULL). ``fmt`` stamps the ``format`` column; ``keep`` carries
    extra columns (such as ``_source``) through.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = []
    for name in BAR_COLUMNS:
        if name == "format" and fmt is not None:
            out.append(F.lit(fmt).alias(name))
            continue
        if name not in types:
            dt = "double" if name in NUMERIC_COLUMNS else ("timestamp_ntz" if name == "timestamp" else "string")
            out.append(F.lit(None).cast(dt).alias(name))
            continue
        dtype = types[name]
        c = F.col(f"`{name}`")
        if dtype == BAR_SCHEMA[name].dataType and name not in NUMERIC_COLUMNS:
            # already the bar type: pass through untouched so filters still reach the scan
            out.append(c)
        elif name in NUMERIC_COLUMNS:
            out.append(numeric_from(c, dtype).alias(name))
        elif name == "timestamp":
            if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                out.append(c.cast("timestamp_ntz").alias(name))
            elif isinstance(dtype, T.StringType):
                out.append(F.try_to_timestamp(F.trim(c)).cast("timestamp_ntz").alias(name))
            else:
                out.append(F.lit(None).cast("timestamp_ntz").alias(name))
        else:
            if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
                out.append(F.lit(None).cast("string").alias(name))
            else:
                out.append(c.cast("string").alias(name))
    return df.select(*out, *[F.col(f"`{k}`") for k in (keep or [])])


def ticker_from_path(path_col: str = "_source") -> F.Column:
    """Ticker as the file's base name up to the first dot."""
    return file_stem(F.col(path_col))


def column_profile(df: DataFrame) -> DataFrame:
    """Display profile per column (T5): ``column_name, kind, anchor, width``.

    Numeric → right/80; a name containing date or time → centre/120; text → left with
    width ``min(8 · longest value, 200)``; anything else → centre/100. The longest text
    values come from one aggregate over all string columns.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)
            and not any(w in f.name.lower() for w in ("date", "time"))]
    rows = []
    for f in fields:
        low = f.name.lower()
        if isinstance(f.dataType, T.NumericType):
            rows.append((f.name, "numeric", "e", F.lit(80)))
        elif "date" in low or "time" in low:
            rows.append((f.name, "datetime", "center", F.lit(120)))
        elif isinstance(f.dataType, T.StringType):
            rows.append((f.name, "text", "w", None))
        else:
            rows.append((f.name, "other", "center", F.lit(100)))
    if text:
        lens = df.agg(*[F.max(F.length(F.col(f"`{c}`"))).alias(f"_len_{i}") for i, c in enumerate(text)])
    else:
        lens = spark.range(1).select()
    idx = {c: i for i, c in enumerate(text)}
    structs = []
    for name, kind, anchor, width in rows:
        if width is None:
            w = F.coalesce(F.least(F.col(f"_len_{idx[name]}") * 8, F.lit(200)), F.lit(120))
        else:
            w = width
        structs.append(F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"),
                                F.lit(anchor).alias("anchor"), w.cast("int").alias("width")))
    return lens.select(F.inline(F.array(*structs)))
