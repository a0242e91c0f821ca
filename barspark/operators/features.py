"""ML preparation: scaling, feature arrays, training sequences, RL state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, with_blocks
from barspark.operators.stats import exact_percentiles_many

METHODS = ("minmax", "standard", "robust")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def normalize(df: DataFrame, method: str = "minmax", columns: Sequence[str] | None = None) -> DataFrame:
    """Scale numeric columns, other columns unchanged (M1–M4).

    minmax: (x − min) / (max − min); standard: (x − mean) / population std;
    robust: (x − median) / (p75 − p25) with exact linear percentiles. A zero scale
    counts as 1. NULLs stay NULL and are ignored when fitting; NaN counts as NULL. The fitted
    statistics are one small row; the scaling is a projection.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown normalization method: {method}")
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return df
    x = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols}
    center, scale = {}, {}
    if method in ("minmax", "standard"):
        aggs = []
        for i, c in enumerate(cols):
            if method == "minmax":
                aggs += [F.min(x[c]).alias(f"a{i}"), F.max(x[c]).alias(f"b{i}")]
            else:
                aggs += [F.avg(x[c]).alias(f"a{i}"), F.stddev_pop(x[c]).alias(f"b{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(cols):
            a, b = row[f"a{i}"], row[f"b{i}"]
            center[c] = a
            s = (b - a) if (method == "minmax" and a is not None and b is not None) else b
            scale[c] = s if s else 1.0
    else:
        quart = exact_percentiles_many(df.select(*[x[c].alias(c) for c in cols]), cols, [0.25, 0.5, 0.75])
        for c in cols:
            q25, q50, q75 = quart[c]
            center[c] = q50
            s = (q75 - q25) if q25 is not None else None
            scale[c] = s if s else 1.0
    out = []
    for f in df.schema.fields:
        if f.name in center:
            c0 = center[f.name]
            expr = ((x[f.name] - F.lit(c0)) / F.lit(scale[f.name])) if c0 is not None else F.lit(None).cast("double")
            out.append(expr.alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def feature_matrix(df: DataFrame, columns: Sequence[str] | None = None, name: str = "features") -> DataFrame:
    """Numeric columns as one ``ARRAY<DOUBLE>`` per row (M5, K8)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    return df.withColumn(name, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))


def rl_state(df: DataFrame, price: str = "close", name: str = "state") -> DataFrame:
    """The close price as a one-element FLOAT array per row (M6)."""
    return df.withColumn(name, F.array(F.col(price).cast("float")))


def prepared_summary(df: DataFrame, by: str = "ticker", fmt: str = "numpy") -> DataFrame:
    """One row: format, number of per-group matrices, type, rows (M7)."""
    return df.agg(F.count_distinct(F.col(by)).alias("size"), F.count(F.lit(1)).alias("rows")).select(
        F.lit(fmt).alias("format"), "size", F.lit("numpy_arrays").alias("type"), "rows")


def sequences(df: DataFrame, features: Sequence[str], target: str, length: int = 60,
              key: str = "ticker", order: Sequence[str] = ("timestamp",),
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Training windows per key (W7): for row i ≥ ``length``, ``X`` = rows i−length … i−1
    (``features``), ``y`` = ``target`` at row i.

    Rows are cut into bounded blocks with a halo of ``length`` rows, so the sliding
    ``collect_list`` never holds more than one block of a key. ``X`` multiplies the data
    ``length``-fold; keep it last in a plan.
    """
    block_rows = max(block_rows, length)
    b = with_blocks(df, [key], list(order), block_rows, length).repartition(key, "_blk")
    w = Window.partitionBy(key, "_blk").orderBy("_g").rowsBetween(-length, -1)
    row = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    out = (b.withColumn("X", F.collect_list(row).over(w))
           .filter(~F.col("_halo") & (F.size("X") == length))
           .withColumn("y", F.col(f"`{target}`").cast("double")))
    return out.drop("_g", "_blk", "_halo")
