"""Target encoding that does not leak: a row's category is described by the targets of other folds only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the mean of all targets counts as, in a category's mean.
SMOOTHING = 20.0


def _target(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def target_totals(df: DataFrame, column: str, target: str, fold: Column | None = None) -> DataFrame:
    """``value, [fold,] n, s``: rows with a target and their sum, by category. Combines map-side, so a hot category is a row a task."""
    keys = [F.col(f"`{column}`").alias("value"), *([fold.alias("fold")] if fold is not None else [])]
    return df.groupBy(*keys).agg(F.count(_target(target)).alias("n"), F.coalesce(F.sum(_target(target)), F.lit(0.0)).alias("s"))


def _smoothed(n: Column, s: Column, mean: Column, smoothing: float) -> Column:
    return F.try_divide(s + F.lit(smoothing) * mean, n + F.lit(smoothing))


def encode_target(df: DataFrame, column: str, target: str, fold: Column, name: str | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """``df`` with ``<column>_target``: the smoothed mean target of the row's category in all folds but the row's own.

    ``(sum + smoothing * mean) / (rows + smoothing)``, where the mean too is that of the other folds; a category that
    occurs in its own fold only gets that mean, and everything is NULL where no other fold has targets. NULL is a category and
    a fold of its own. Rows without a target (NULL or NaN) are encoded but teach nothing. The table of totals has one row a
    category and fold; Spark chooses by its size how to bring it to the rows, and splits a hot category then.
    """
    name = name or f"{column}_target"
    if smoothing < 0:
        raise ValueError("smoothing must not be negative")
    per = target_totals(df, column, target, fold)
    folds = per.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    every = folds.agg(F.sum("fn").alias("n"), F.sum("fs").alias("s")).first()
    total_n, total_s = F.lit(every["n"] or 0), F.lit(every["s"] or 0.0)
    mean = F.try_divide(total_s - F.col("fs"), (total_n - F.col("fn")).cast("double"))
    value = per.groupBy("value").agg(F.sum("n").alias("vn"), F.sum("s").alias("vs"))
    # folds are few: one row each
    table = (per.join(value.withColumnRenamed("value", "v2"), F.col("value").eqNullSafe(F.col("v2"))).join(F.broadcast(folds.withColumnRenamed("fold", "f2")), F.col("fold").eqNullSafe(F.col("f2")))
             .select(F.col("value").alias("_value"), F.col("fold").alias("_fold"),
                     F.when(mean.isNotNull(), _smoothed((F.col("vn") - F.col("n")).cast("double"), F.col("vs") - F.col("s"), mean, smoothing)).alias(name)))
    rows = df.withColumn("_own", fold)
    return rows.join(table, F.col(f"`{column}`").eqNullSafe(F.col("_value")) & F.col("_own").eqNullSafe(F.col("_fold")), "left").drop("_value", "_fold", "_own")


def apply_target(df: DataFrame, totals: DataFrame, column: str, name: str | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """``df`` (rows that taught nothing, such as a test set) with the smoothed mean target of ``totals`` (without folds); unseen categories get the mean of all."""
    name = name or f"{column}_target"
    every = totals.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = F.lit(every["s"] / every["n"] if every["n"] else None).cast("double")
    table = totals.select(F.col("value").alias("_value"), _smoothed(F.col("n").cast("double"), F.col("s"), mean, smoothing).alias(name))
    out = df.join(table, F.col(f"`{column}`").eqNullSafe(F.col("_value")), "left").drop("_value")
    return out.withColumn(name, F.coalesce(name, mean))
