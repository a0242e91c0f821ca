"""Scans (S1–S8): every format lands in the bar schema.

Text formats are read with explicit schemas (all strings for Stooq text), never with
``inferSchema``. Each reader keeps the source file as ``_source`` when asked
(``with_source=True``), from the ``_metadata`` column, so per-file reports need no
extra pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.columns import file_stem
from barspark.operators.filters import apply_conditions, scan_condition
from barspark.operators.standardize import clean_header_name, conform_schema, standardize_stooq
from barspark.schema import BAR_COLUMNS, BAR_REQUIRED, EXTENSION_FORMATS, STOOQ_COLUMNS, STOOQ_REQUIRED
from barspark.session import configure, written
from barspark.sources import lines
from barspark.sources.headers import Layout, by_folder, grouped, json_shapes, of_files, read_layouts, reader

# Timestamp text written and read by the text sinks and scans.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

#: Separates nothing: JSON allows no raw control character, so a file read by lines that end with it is a single line.
NO_LINE = "\x01barspark\x01"
#: Bytes of an array file that are read as one line; a line is in memory besides its rows, and Hadoop's longest has 2 GB.
WHOLE = 512 << 20

STRING_BARS = T.StructType([T.StructField(c, T.StringType()) for c in BAR_COLUMNS])


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def detect_format(path: str) -> str:
    """Lower-cased extension → format name (S1); unknown → ``ValueError``."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    ext = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    if ext not in EXTENSION_FORMATS:
        raise ValueError(f"Unsupported file type: {ext or name}")
    return EXTENSION_FORMATS[ext]


def _with_source(df: DataFrame, with_source: bool) -> DataFrame:
    return df.withColumn("_source", F.col("_metadata.file_path")) if with_source and "_source" not in df.columns else df


def _empty(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def known_files(fmt: str, rows) -> dict:
    """What ``load`` needs to know of files, from rows with ``path, sep, names, array``."""
    if fmt in ("csv", "txt"):
        return {"layouts": grouped((r["path"], r["sep"], r["names"]) for r in rows)}
    if fmt == "json":
        shapes: dict[bool, list[str]] = {}
        for r in rows:
            shapes.setdefault(r["array"], []).append(r["path"])
        return {"shapes": shapes}
    return {}


def read_csv(spark: SparkSession, paths, with_source: bool = False, recursive: bool = False,
             glob: str | None = None, layouts: list[Layout] | None = None) -> DataFrame:
    """Bar CSV (S2), comma or tab: columns are taken by each file's own header, then conformed.

    Columns that a file lacks are NULL, those that bars do not have are dropped.
    """
    configure(spark)
    keep = ["_source"] if with_source else []

    def select(df, columns):
        df = _with_source(df, with_source)
        return df.select(*[(F.col(columns[c]) if c in columns else F.lit(None).cast("string")).alias(c) for c in BAR_COLUMNS], *keep)

    raw = read_layouts(spark, _paths(paths), select, recursive, glob, found=layouts)
    raw = _empty(spark, BAR_COLUMNS + keep) if raw is None else raw
    return conform_schema(raw.withColumn("timestamp", F.try_to_timestamp("timestamp")), keep=keep)


def read_json(spark: SparkSession, paths, with_source: bool = False, recursive: bool = False,
              glob: str | None = None, shapes: dict[bool, list[str]] | None = None) -> DataFrame:
    """Bar JSON (S3): one record per line, or one array of records. Each file's first character decides."""
    configure(spark)
    ps, keep = _paths(paths), ["_source"] if with_source else []
    known = shapes is not None
    shapes = shapes if known else json_shapes(spark, ps, recursive, glob)
    raw = None
    for array, files in sorted(shapes.items()):
        whole = len(shapes) == 1 and not known
        r = (lambda: reader(spark, recursive, glob)) if whole else (lambda: spark.read)
        part = (_read_arrays if array else _read_records)(r, ps if whole else files, with_source)
        raw = part if raw is None else raw.unionByName(part)
    raw = _empty(spark, BAR_COLUMNS + keep) if raw is None else raw
    return conform_schema(raw.withColumn("timestamp", F.try_to_timestamp("timestamp")), keep=keep)


def _read_records(r: Callable[[], DataFrameReader], paths: list[str], with_source: bool) -> DataFrame:
    return _with_source(r().option("multiLine", False).schema(STRING_BARS).json(paths), with_source)


def _read_arrays(r: Callable[[], DataFrameReader], paths: list[str], with_source: bool) -> DataFrame:
    """Files of one array each. Spark's multi-line reader keeps a number's text as written, for which it reads that place of the file
    once more, each number by a request of its own. Of a line it has the bytes at hand, so files are read as a line each; compressed ones, where
    the reader gives up the text, and those over ``WHOLE`` stay with it."""
    apart = (F.col("_metadata.file_size") > WHOLE) | lines.packed(F.col("_metadata.file_path"))
    parts = [_with_source(r().option(*option).schema(STRING_BARS).json(paths).where(rows), with_source)
             for option, rows in ((("lineSep", NO_LINE), ~apart), (("multiLine", True), apart))]
    return parts[0].unionByName(parts[1])


def read_stooq_raw(spark: SparkSession, paths, with_source: bool = False, recursive: bool = False,
                   glob: str | None = None, layouts: list[Layout] | None = None) -> DataFrame:
    """Stooq text as the ten all-string Stooq columns, by each file's own header and separator.

    Header names match loosely (BOM, blanks, angle brackets and case do not count); columns that
    a file lacks are NULL.
    """
    keep = ["_source"] if with_source else []

    def select(df, columns):
        loose = {}
        for name, c in columns.items():
            loose.setdefault(clean_header_name(name), c)
        df = _with_source(df, with_source)
        return df.select(*[(F.col(loose[c.strip("<>")]) if c.strip("<>") in loose else F.lit(None).cast("string")).alias(c) for c in STOOQ_COLUMNS], *keep)

    raw = read_layouts(spark, _paths(paths), select, recursive, glob, trim=True, found=layouts)
    return _empty(spark, STOOQ_COLUMNS + keep) if raw is None else raw


def read_stooq(spark: SparkSession, paths, with_source: bool = False, recursive: bool = False,
               glob: str | None = None, ticker_from_file: bool = False, layouts: list[Layout] | None = None) -> DataFrame:
    """Stooq text → standard bars (S4 + T1).

    ``ticker_from_file`` fills a missing ``<TICKER>`` with the file's base name up to the
    first dot (T6), as files named ``aapl.us.txt`` carry their ticker in the name.
    """
    configure(spark)
    raw = read_stooq_raw(spark, paths, with_source or ticker_from_file, recursive, glob, layouts)
    bars = standardize_stooq(raw, keep=["_source"] if (with_source or ticker_from_file) else None)
    if ticker_from_file:
        bars = bars.withColumn("ticker", F.coalesce(F.col("ticker"), file_stem(F.col("_source"))))
        if not with_source:
            bars = bars.drop("_source")
    return bars


def read_parquet(spark: SparkSession, paths, with_source: bool = False, recursive: bool = False,
                 glob: str | None = None, conditions: Sequence[dict] = ()) -> DataFrame:
    """Parquet (S5); column pruning and filters reach the scan.

    Rows that do not meet ``conditions`` (F1-F8) are left out. Given here, comparisons of numbers reach the scan
    too: as stored there, and once more, exactly, on the conformed columns.
    """
    configure(spark)
    raw = _with_source(reader(spark, recursive, glob).parquet(*_paths(paths)), with_source)
    conditions = list(conditions)
    if conditions:
        raw = raw.where(scan_condition(raw, conditions))
    return apply_conditions(conform_schema(raw, keep=["_source"] if with_source else None), conditions)


def read_feather(spark: SparkSession, paths, with_source: bool = False) -> DataFrame:
    """Arrow IPC / Feather files (S6) through the ``arrow_ipc`` Python data source."""
    from barspark.sources.arrow_ipc import FORMAT_NAME, register
    configure(spark)
    register(spark)
    frames = [spark.read.format(FORMAT_NAME).load(p) for p in _paths(paths)]
    if with_source:  # the source of a folder is the folder
        frames = [f.withColumn("_source", F.lit(p)) for f, p in zip(frames, _paths(paths))]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    return conform_schema(df, keep=["_source"] if with_source else None)


def read_table(spark: SparkSession, name: str, preview: bool = False) -> DataFrame:
    """A catalog table (S7); ``preview`` keeps the first 100 rows."""
    df = conform_schema(spark.table(name))
    return df.limit(100) if preview else df


def load(spark: SparkSession, paths, fmt: str | None = None, with_source: bool = False,
         recursive: bool = False, glob: str | None = None, **known) -> DataFrame:
    """Read any supported format into bars (S1); ``fmt`` defaults to the first path's extension.

    ``known``: what ``known_files`` says of exactly these files, if they were looked at before; for Parquet, ``conditions``.
    """
    ps = _paths(paths)
    fmt = fmt or detect_format(ps[0])
    if fmt == "csv":
        return read_csv(spark, ps, with_source, recursive=recursive, glob=glob, **known)
    if fmt in ("json", "json_array"):
        return read_json(spark, ps, with_source, recursive=recursive, glob=glob, **known)
    if fmt == "txt":
        return read_stooq(spark, ps, with_source=with_source, recursive=recursive, glob=glob, **known)
    if fmt in ("parquet", "polars", "pyarrow"):
        return read_parquet(spark, ps, with_source, recursive, glob, **known)
    if fmt == "feather":
        return read_feather(spark, ps, with_source)
    if fmt == "duckdb":
        raise ValueError("database files are not read; register the table in the catalog and use read_table")
    raise ValueError(f"Unsupported format: {fmt}")


def required_columns(fmt: str) -> list[str]:
    """Header names a file of ``fmt`` must carry (V1)."""
    if fmt == "txt":
        return STOOQ_REQUIRED
    if fmt in ("csv", "json"):
        return BAR_REQUIRED
    return []


def load_with_skips(spark: SparkSession, root: str, fmt: str, strict: bool = False,
                    pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Load every ``fmt`` file under ``root``, skipping files that fail validation.

    Returns ``(bars, skipped)``; ``skipped`` lists ``path, error``. One pass lists the files and reads the start of each, which
    gives its verdict and its layout, kept as a table; then only the good files are read. Paths of text files pass through the driver
    only if they are few. ``strict`` raises on the first bad file; no good file raises.
    """
    from barspark.sources.files import checked
    ext = {"txt": "*.txt", "csv": "*.csv", "json": "*.json", "parquet": "*.parquet", "feather": "*.feather"}.get(fmt, "*")
    rows = written(checked(spark, root, fmt, pattern or ext), "checked")
    counts = {r["valid"]: r["count"] for r in rows.groupBy("valid").count().collect()}
    skipped = rows.where(~F.col("valid")).select("path", "error").orderBy("path")
    if strict and (first := skipped.first()):
        raise ValueError(f"{first[0]}: {first[1]}")
    if not counts.get(True):
        raise ValueError("No valid files could be loaded")
    if fmt not in ("csv", "txt"):
        good = rows.where("valid").orderBy("path").collect()
        return load(spark, [r["path"] for r in good], fmt, with_source=True, **known_files(fmt, good)), skipped
    exact, pattern = of_files(rows.where("valid")), pattern or ext
    if sum(counts.values()) <= lines.MANY:
        folders = by_folder(root, exact, [r["path"] for r in skipped.collect()])
        bars = load(spark, root, fmt, with_source=True, recursive=True, glob=pattern, layouts=folders)
        if folders == exact or len(bars.inputFiles()) == counts[True]:
            return bars, skipped
    # very many, or files came or went meanwhile: exactly those that were looked at
    return load(spark, root, fmt, with_source=True, layouts=exact), skipped
