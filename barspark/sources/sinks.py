"""Sinks (K1–K10): bars written in any supported format, and conversion between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from barspark.operators.filters import apply_conditions
from barspark.operators.standardize import conform_schema
from barspark.sources.readers import TIMESTAMP_FORMAT, detect_format, load

#: Records of one JSON array document.
ARRAY_RECORDS = 50_000


def save(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite",
         partition_by: Sequence[str] | None = None) -> None:
    """Write ``df`` as csv (K1), txt = tab-separated (K2), json lines (K3), json_array (K3's
    export form: one array document of up to ``ARRAY_RECORDS`` records per output file), parquet (K4) or feather (K5).
    ``partition_by`` (e.g. ``["ticker"]``) lays out one folder per value."""
    fmt = fmt or detect_format(path)
    if partition_by and fmt in ("feather", "json_array"):
        raise ValueError(f"{fmt} has no folder per value")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path)
    elif fmt == "txt":
        w.option("header", True).option("sep", "\t").option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path)
    elif fmt == "json":
        w.option("timestampNTZFormat", TIMESTAMP_FORMAT).option("ignoreNullFields", False).json(path)
    elif fmt == "json_array":
        save_arrays(df, path, mode)
    elif fmt in ("parquet", "polars", "pyarrow"):
        w.parquet(path)
    elif fmt == "feather":
        from barspark.sources.arrow_ipc import FORMAT_NAME, register
        register(df.sparkSession)
        df.write.format(FORMAT_NAME).mode(mode).save(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def save_arrays(df: DataFrame, path: str, mode: str = "overwrite", lead: str = "") -> None:
    """Files of one JSON array of up to ``ARRAY_RECORDS`` records each, after ``lead``. A reader takes an array whole, so their size must not
    grow with the data."""
    json_array_lines(df, ARRAY_RECORDS, lead).write.mode(mode).option("maxRecordsPerFile", ARRAY_RECORDS).text(path)


def json_array_lines(df: DataFrame, records: int, lead: str = "") -> DataFrame:
    """Each partition as JSON array documents of ``records`` lines, one a record: ``[`` first, commas between, ``]`` last.

    Records are rendered by ``to_json`` in the JVM; the framing streams Arrow batches, so no partition is held whole in memory.
    """
    from pyspark.sql import functions as F
    rendered = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                                   {"timestampNTZFormat": TIMESTAMP_FORMAT, "ignoreNullFields": "false"})
                         .alias("value"))

    def frame(batches):
        import pandas as pd
        n, last = 0, None  # the last record is held back until it is known whether its array ends
        for pdf in batches:
            out = []
            for v in pdf["value"].tolist():
                if last is not None:
                    out.append(last + "]" if n % records == 0 else last)
                last = (lead + "[" if n % records == 0 else ",") + v
                n += 1
            if out:
                yield pd.DataFrame({"value": out})
        if last is not None:
            yield pd.DataFrame({"value": [last + "]"]})

    return rendered.mapInPandas(frame, "value string")


def save_table(df: DataFrame, name: str, fmt: str | None = None, path: str | None = None,
               if_absent: bool = False) -> None:
    """Replace catalog table ``name`` with the conformed bars (K6); ``if_absent`` keeps an
    existing table untouched (K7). ``path`` makes it an external table there."""
    out = conform_schema(df, fmt)
    w = out.write.mode("ignore" if if_absent else "overwrite").format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def export_view(df: DataFrame, path: str, fmt: str, conditions: Sequence[dict] = ()) -> None:
    """Write the rows that pass the conditions (K9); csv, json (lines or array) and parquet."""
    if fmt not in ("csv", "json", "json_array", "parquet"):
        raise ValueError(f"Unsupported export format: {fmt}")
    save(apply_conditions(df, conditions), path, fmt)


def convert(spark: SparkSession, src: str | Sequence[str], dst: str, src_fmt: str | None = None,
            dst_fmt: str | None = None, tag: str | None = None) -> DataFrame:
    """Load → conform → save (K10); returns the conformed DataFrame that was written."""
    df = conform_schema(load(spark, src, src_fmt), tag)
    save(df, dst, dst_fmt)
    return df
