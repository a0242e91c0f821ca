"""Sort, paging, row access and ticker navigation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.columns import numeric
from barspark.operators.ordering import global_position

SHALLOW_ROWS = 10_000  # each task of a top-k keeps up to this many rows, and one merges them all


def _c(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_numeric_column(df: DataFrame, column: str) -> bool:
    """True when every non-null value of ``column`` parses as a number (one aggregate)."""
    c = _c(column)
    bad = df.agg(F.count_if(c.isNotNull() & numeric(c).isNull()).alias("bad")).first()["bad"]
    return bad == 0


def sort_key(df: DataFrame, column: str, numeric_sort: bool | None = None) -> Column:
    """Typed columns by their own order; text in numeric order when every value parses,
    else in lower-cased order."""
    if not isinstance(df.select(_c(column)).schema[0].dataType, T.StringType):
        return _c(column)
    if numeric_sort is None:
        numeric_sort = is_numeric_column(df, column)
    return numeric(_c(column)) if numeric_sort else F.lower(_c(column).cast("string"))


def sort_column(df: DataFrame, column: str, descending: bool = False,
                tiebreak: Sequence[str] = (), numeric_sort: bool | None = None) -> DataFrame:
    key = sort_key(df, column, numeric_sort)
    key = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return df.orderBy(key, *[_c(t) for t in tiebreak])


def sorted_positions(df: DataFrame, column: str, descending: bool = False,
                     tiebreak: Sequence[str] = (), numeric_sort: bool | None = None,
                     name: str = "pos") -> DataFrame:
    """Sorted order as an explicit 0-based ``pos`` column (distributed, no single task)."""
    key = sort_key(df, column, numeric_sort)
    key = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return global_position(df, [key, *[_c(t) for t in tiebreak]], name)


def page(df: DataFrame, order: Sequence[str | Column], page_number: int, page_size: int,
         shallow_rows: int | None = None) -> DataFrame:
    """Rows ``(page-1)·size`` … ``page·size - 1`` in ``order``.

    Pages ending within ``shallow_rows`` (default :data:`SHALLOW_ROWS`) use a top-k sort;
    deeper pages filter a distributed row index instead of keeping ``offset`` rows per task.
    """
    if page_size <= 0 or page_number <= 0:
        raise ValueError("page and page size must be positive")
    start = (page_number - 1) * page_size
    by = [_c(o) for o in order]
    if start + page_size <= (SHALLOW_ROWS if shallow_rows is None else shallow_rows):
        return df.orderBy(*by).offset(start).limit(page_size)
    pos = global_position(df, by, "_pos")
    return pos.filter((F.col("_pos") >= start) & (F.col("_pos") < start + page_size)).orderBy("_pos").drop("_pos")


def page_count(df: DataFrame, page_size: int) -> DataFrame:
    """One row: total rows, page size and ``ceil(total / size)`` pages."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(page_size).alias("page_size"),
        F.ceil(F.col("total_rows") / F.lit(page_size)).cast("long").alias("total_pages"))


def ticker_page(df: DataFrame, ticker: str, page_number: int, page_size: int,
                order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """One ticker's rows by time, one page of them."""
    return page(df.filter(F.col("ticker") == F.lit(ticker)), order, page_number, page_size)


def row_range(df: DataFrame, order: Sequence[str | Column], start: int, stop: int,
              name: str = "row_idx") -> DataFrame:
    """Rows with index in ``[start, stop)`` of the explicit ``order`` (P5); out of range → empty."""
    pos = global_position(df, [_c(o) for o in order], name)
    return pos.filter((F.col(name) >= start) & (F.col(name) < stop))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def ticker_list(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Distinct non-empty tickers (P7); ``orderBy`` for display."""
    c = _c(column)
    return df.select(c.alias("ticker")).filter(c.isNotNull() & (c != "")).distinct()


def ticker_neighbors(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Each ticker with the previous and next one in sorted order, cyclic.

    Positions come from a distributed sort; neighbours are equi-joins on position.
    """
    t = global_position(ticker_list(df, column), ["ticker"], "idx")
    n = t.count()
    if n == 0:
        return t.select("ticker", F.lit(None).cast("string").alias("prev_ticker"),
                        F.lit(None).cast("string").alias("next_ticker"))
    nxt = t.select(F.col("idx").alias("_ni"), F.col("ticker").alias("next_ticker"))
    prv = t.select(F.col("idx").alias("_pi"), F.col("ticker").alias("prev_ticker"))
    return (t.withColumn("_ni", (F.col("idx") + 1) % n).withColumn("_pi", (F.col("idx") + n - 1) % n)
            .join(nxt, "_ni").join(prv, "_pi")
            .select("ticker", "idx", "prev_ticker", "next_ticker"))


def next_ticker(df: DataFrame, current: str | None, column: str = "ticker", step: int = 1) -> str | None:
    """Next (``step=1``) or previous (``-1``) ticker; unknown → first / last."""
    t = ticker_list(df, column)
    c = F.col("ticker")
    row = t.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.max(c == F.lit(current)).alias("known"),
                F.min(F.when(c > F.lit(current), c)).alias("next"), F.max(F.when(c < F.lit(current), c)).alias("prev")).first()
    near = (row["next"] if step > 0 else row["prev"]) if row["known"] else None
    return near if near is not None else (row["lo"] if step > 0 else row["hi"])


def ticker_counts(df: DataFrame, column: str = "ticker") -> DataFrame:
    return df.filter(_c(column).isNotNull()).groupBy(_c(column).alias("ticker")).agg(
        F.count(F.lit(1)).alias("records"))


def top_tickers(df: DataFrame, n: int = 5, column: str = "ticker") -> DataFrame:
    """Tickers with the most rows (P9); ties by ticker name."""
    return ticker_counts(df, column).orderBy(F.desc("records"), F.asc("ticker")).limit(n)


def bottom_tickers(df: DataFrame, n: int = 5, column: str = "ticker") -> DataFrame:
    return ticker_counts(df, column).orderBy(F.asc("records"), F.asc("ticker")).limit(n)


def table_info(df: DataFrame) -> DataFrame:
    """Columns, their types and the row count."""
    spark = df.sparkSession
    n = df.count()
    return spark.createDataFrame(
        [(f.name, f.dataType.simpleString(), i, n) for i, f in enumerate(df.schema.fields)],
        "column_name string, data_type string, ordinal int, row_count long")


def files_by_records(df: DataFrame, source: str = "_source") -> DataFrame:
    """Files by their number of rows, most first (P10); ties by name."""
    return df.groupBy(_c(source).alias("source")).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), F.asc("source"))
