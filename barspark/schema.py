"""The standard bar table and the names that map onto it."""

from __future__ import annotations

from pyspark.sql import types as T

# The standard bar columns, in order.
BAR_COLUMNS = ["ticker", "timestamp", "open", "high", "low", "close", "vol", "openint", "format"]
NUMERIC_COLUMNS = ["open", "high", "low", "close", "vol", "openint"]
PRICE_COLUMNS = ["open", "high", "low", "close"]

BAR_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("vol", T.DoubleType()),
    T.StructField("openint", T.DoubleType()),
    T.StructField("format", T.StringType()),
])

# Raw Stooq header names, in file order.
STOOQ_COLUMNS = ["<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>",
                 "<CLOSE>", "<VOL>", "<OPENINT>"]
# Columns a Stooq text file must carry to be accepted.
STOOQ_REQUIRED = ["<TICKER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>"]
# Columns the strict standardiser needs.
STOOQ_STANDARDIZE_REQUIRED = ["<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>"]
# Columns the cleaners need.
STOOQ_CLEAN_REQUIRED = ["<TICKER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>"]
# Columns a csv/json bar file must carry.
BAR_REQUIRED = ["ticker", "timestamp", "close"]
# Columns the per-file quality analysis needs.
ANALYSIS_REQUIRED = ["<DATE>", "<TIME>", "<CLOSE>"]

# File extension -> format name.
EXTENSION_FORMATS = {
    ".csv": "csv",
    ".txt": "txt",
    ".json": "json",
    ".parquet": "parquet",
    ".feather": "feather",
    ".arrow": "feather",
    ".duckdb": "duckdb",
}

# Paging sizes offered to users.
PAGE_SIZES = [50, 100, 200, 500, 1000]

# File size classes by record count (upper bounds are exclusive).
SIZE_CLASS_BOUNDS = [("very_small", 50), ("small", 500), ("medium", 2000)]
