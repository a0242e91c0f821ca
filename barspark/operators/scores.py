"""Completeness and consistency scores from states that merge.

A file's state is one row of counts. New files add rows to a state table; a score is an aggregate over that table, so
files already counted are not read again. A file that is ingested anew replaces its earlier state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.schema import BAR_COLUMNS, PRICE_COLUMNS


def _num(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def bar_rules() -> dict[str, Column]:
    """What a consistent bar keeps to; a rule that missing values leave open counts neither way."""
    o, h, lo, c, v = (_num(x) for x in ("open", "high", "low", "close", "vol"))
    return {"high_low": h >= lo, "open_inside": (o >= lo) & (o <= h), "close_inside": (c >= lo) & (c <= h), "prices_positive": F.least(*[_num(x) for x in PRICE_COLUMNS]) > 0, "volume_not_negative": v >= 0}


def states(df: DataFrame, source: str = "source", columns: Sequence[str] = BAR_COLUMNS, rules: Mapping[str, Column] | None = None, time: str = "timestamp") -> DataFrame:
    """One row a source: ``source, rows, filled, kept, broken, first_time, last_time``.

    ``filled``: values present, by column; ``kept`` and ``broken``: rows that keep and break each rule, by name. NULL and NaN are
    missing, and so are columns that ``df`` lacks. Rows with a NULL source are one source.
    """
    rules = bar_rules() if rules is None else rules
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    present = {c: F.count(_num(c) if c in numeric else F.col(f"`{c}`")) if c in df.columns else F.lit(0).cast("long") for c in columns}
    pairs = lambda found: F.map_from_arrays(F.array(*[F.lit(k) for k in found]), F.array(*found.values())) if found else F.create_map().cast("map<string,bigint>")
    return df.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), pairs(present).alias("filled"), pairs({k: F.count_if(r) for k, r in rules.items()}).alias("kept"),
        pairs({k: F.count_if(~r) for k, r in rules.items()}).alias("broken"), F.min(F.col(f"`{time}`")).alias("first_time"), F.max(F.col(f"`{time}`")).alias("last_time"))


def add_states(found: DataFrame, path: str, run: int) -> None:
    """Write the states of run ``run`` under ``path``; a repeated run replaces its own states, so a retry counts once."""
    found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={int(run)}")


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """Each source's state of its latest run."""
    every = spark.read.option("basePath", path).parquet(path)
    fields = [c for c in every.columns if c != "run"]
    best = every.groupBy(F.col("source").alias("_s")).agg(F.max_by(F.struct(*fields), "run").alias("m"))
    return best.select("m.*")


def scores(found: DataFrame, by: str | None = "source", weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """``[source,] files, rows, completeness, consistency, score`` from states, for each source or (``by=None``) for all.

    ``completeness``: share of values present; ``consistency``: share of rule checks kept, of those that could be made (1 if
    none could); ``score``: their weighted mean. Without rows, completeness and score are NULL.
    """
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    flat = found.select("source", "rows", (F.col("rows") * F.size("filled")).alias("cells"), total("filled").alias("filled"), total("kept").alias("kept"), total("broken").alias("broken"))
    out = flat.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("rows", "cells", "filled", "kept", "broken")])
    complete = F.try_divide(F.col("filled"), F.col("cells"))
    consistent = F.coalesce(F.try_divide(F.col("kept"), F.col("kept") + F.col("broken")), F.lit(1.0))
    a, b = weights
    return out.select(*([by] if by else []), "files", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), complete.alias("completeness"), consistent.alias("consistency"),
                      ((complete * a + consistent * b) / (a + b)).alias("score"))


def rule_report(found: DataFrame) -> DataFrame:
    """``rule, kept, broken, share``: over all sources, which rules break how often."""
    rows = found.select(F.explode("kept").alias("rule", "kept"), "broken").withColumn("broken", F.coalesce(F.element_at("broken", F.col("rule")), F.lit(0)))
    out = rows.groupBy("rule").agg(F.sum("kept").alias("kept"), F.sum("broken").alias("broken"))
    return out.withColumn("share", F.try_divide(F.col("broken"), F.col("kept") + F.col("broken")))
