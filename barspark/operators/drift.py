"""Column sketches that merge, and drift between two tables.

A numeric column becomes a KLL quantile sketch (Spark's own aggregate): partial sketches merge map-side, stored ones
of files or days merge later without reading the rows again. Drift is measured from two sketches, or exactly from one
sort of the values; both give the same report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators.carry import sums_upto
from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, into_blocks, global_position
from barspark.operators.stats import exact_percentiles_many

#: Sketch size: items kept a level. Points of either sketch at which distributions are compared.
SKETCH_K, POINTS = 2048, 256
#: Least share that a bin counts with, so that an empty one gives no infinite index; index from which a column has drifted.
LEAST_SHARE, DRIFTED = 1e-4, 0.2

REPORT = "column string, kind string, rows_base long, rows_current long, missing_base double, missing_current double, psi double, ks double, ks_error double, drifted boolean"


def rank_error(k: int = SKETCH_K) -> float:
    """How far a sketch's rank of a value may be off, as a share of all values (with 99 % confidence); the published fit for KLL."""
    return 2.296 / k ** 0.9021


def _clean(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def column_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric columns, and text and boolean ones."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return ([f.name for f in fields if isinstance(f.dataType, T.NumericType)], [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))])


def sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """One row a column (and group): ``*by, column, rows, present, sketch`` of its numbers; NULL and NaN count as missing."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(_clean(c)).alias(f"_n{i}"), F.kll_sketch_agg_double(_clean(c), F.lit(k)).alias(f"_s{i}")]
    wide = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*aggs)
    each = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("present"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return wide.select(*[F.col(f"`{c}`") for c in by], F.explode(F.array(*each)).alias("_e")).select(*[F.col(f"`{c}`") for c in by], "_e.*")


def merged(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several groups, files or runs as those of all their rows."""
    return found.groupBy(*[F.col(f"`{c}`") for c in by], "column").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _numbers(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"CAST('{float(v)!r}' AS DOUBLE)" for v in values) + ")"


def _psi(base: Column, current: Column) -> Column:
    """Stability index of two arrays of shares."""
    floor = lambda x: F.greatest(x, F.lit(LEAST_SHARE))
    parts = F.zip_with(base, current, lambda b, c: (floor(c) - floor(b)) * F.log(floor(c) / floor(b)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _shares(ranks: Column) -> Column:
    """Shares of the bins whose upper borders have these ranks; the last bin is what is left."""
    upper, lower = F.concat(ranks, F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), ranks)
    return F.zip_with(upper, lower, lambda u, w: u - w)


def sketch_drift(base: DataFrame, current: DataFrame, bins: int = 10, k: int = SKETCH_K) -> DataFrame:
    """The report for numeric columns from merged sketches of both tables (as ``merged`` or ``sketches`` give them).

    Bins end at the base's quantiles. ``ks`` is the largest difference of the distribution functions at POINTS quantiles of
    either side; it is off by at most ``ks_error`` (both sketches' errors and the spacing of points).
    A column without values on one side has neither figure.
    """
    both = base.select("column", F.col("rows").alias("rows_base"), F.col("present").alias("_nb"), F.col("sketch").alias("_b")).join(
        current.select("column", F.col("rows").alias("rows_current"), F.col("present").alias("_nc"), F.col("sketch").alias("_c")), "column")
    # a sketch a column and side, some 20 KB each: held once, so that the tables behind them are read once
    both = base.sparkSession.createDataFrame(both.collect(), both.schema)
    some = both.where("_nb > 0 and _nc > 0")
    # ranks are asked for at literal points: each side's quantiles come to the driver, a few hundred numbers a column
    ask = {"edges": ("_b", [i / bins for i in range(1, bins)]), "pb": ("_b", [i / (POINTS - 1) for i in range(POINTS)]), "pc": ("_c", [i / (POINTS - 1) for i in range(POINTS)])}
    at = some.select("column", *[F.expr(f"kll_sketch_get_quantile_double({side}, {_numbers(q)}) AS {name}") for name, (side, q) in ask.items()]).collect()

    def ranks(side: str, where: dict[str, list[float]]) -> Column:
        out = F.lit(None).cast("array<double>")
        for column, values in where.items():
            out = F.when(F.col("column") == column, F.expr(f"kll_sketch_get_rank_double({side}, {_numbers(values)})")).otherwise(out)
        return out

    edges = {r["column"]: r["edges"] for r in at}
    points = {r["column"]: sorted({*r["pb"], *r["pc"]}) for r in at}
    away = F.array_max(F.zip_with(ranks("_b", points), ranks("_c", points), lambda a, b: F.abs(a - b)))
    some = some.select("column", _psi(_shares(ranks("_b", edges)), _shares(ranks("_c", edges))).alias("psi"), away.alias("ks"))
    out = both.join(some, "column", "left")
    return _report(out, "numeric", F.lit(2 * rank_error(k) + 1 / (POINTS - 1)))


def _report(rows: DataFrame, kind: str, error: Column) -> DataFrame:
    missing = lambda side, n: F.when(F.col(f"rows_{side}") > 0, 1 - F.col(n) / F.col(f"rows_{side}"))
    return rows.select("column", F.lit(kind).alias("kind"), "rows_base", "rows_current", missing("base", "_nb").alias("missing_base"), missing("current", "_nc").alias("missing_current"),
                       "psi", "ks", F.when(F.col("ks").isNotNull(), error).alias("ks_error"), (F.col("psi") > DRIFTED).alias("drifted"))


def exact_drift(base: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The report for numeric columns without sketches: borders from exact percentiles, ``ks`` from one sort of all values.

    Equal values of both tables are one row with two counts before the sort, which splits a hot column by value."""
    spark = base.sparkSession
    borders = exact_percentiles_many(base.select(*[_clean(c).alias(c) for c in columns]), columns, [i / bins for i in range(1, bins)])

    def counted(df: DataFrame, side: str) -> dict:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(columns):
            upto = [F.count_if(_clean(c) <= e) if e is not None else F.lit(0).cast("long") for e in borders[c]]
            aggs += [F.count(_clean(c)).alias(f"n{i}"), F.array(*upto).alias(f"u{i}")]
        return df.agg(*aggs).first().asDict()

    b, c = counted(base, "base"), counted(current, "current")
    rows = []
    for i, name in enumerate(columns):
        ranks = [[u / side[f"n{i}"] for u in side[f"u{i}"]] if side[f"n{i}"] else None for side in (b, c)]
        rows.append((name, b["rows"], c["rows"], b[f"n{i}"], c[f"n{i}"], *ranks))
    small = spark.createDataFrame(rows, "column string, rows_base long, rows_current long, _nb long, _nc long, _rb array<double>, _rc array<double>")
    small = small.withColumn("psi", F.when((F.col("_nb") > 0) & (F.col("_nc") > 0), _psi(_shares(F.col("_rb")), _shares(F.col("_rc")))))
    long = None
    for df, side in ((base, 0), (current, 1)):
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), _clean(n).alias("v")) for n in columns])).alias("p")
        part = df.select(pairs).select("p.*", F.lit(side).alias("side")).where("v is not null")
        long = part if long is None else long.unionByName(part)
    values = long.groupBy("column", "v").agg(F.count_if(F.col("side") == 0).alias("nb"), F.count_if(F.col("side") == 1).alias("nc"))
    blocked = into_blocks(global_position(values, ["column", "v"]), block_rows, 0)
    upto = sums_upto(blocked, "column", {"_ub": F.col("nb"), "_uc": F.col("nc")}).join(F.broadcast(small.select("column", "_nb", "_nc").where("_nb > 0 and _nc > 0")), "column")
    ks = upto.groupBy("column").agg(F.max(F.abs(F.col("_ub") / F.col("_nb") - F.col("_uc") / F.col("_nc"))).alias("ks"))
    return _report(small.join(ks, "column", "left"), "numeric", F.lit(0.0))


def text_drift(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The report for text and boolean columns: each value is a bin, ``ks`` is half the sum of all differences of shares."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("p")
        return df.select(pairs).select("p.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias(name))

    both = counts(base, "_xb").join(counts(current, "_xc").withColumnsRenamed({"column": "_c2", "v": "_v2"}), F.col("column").eqNullSafe(F.col("_c2")) & F.col("v").eqNullSafe(F.col("_v2")), "full")
    both = both.select(F.coalesce("column", "_c2").alias("column"), F.coalesce("v", "_v2").alias("v"), F.coalesce("_xb", F.lit(0)).alias("_xb"), F.coalesce("_xc", F.lit(0)).alias("_xc"))
    total = both.groupBy("column").agg(F.sum("_xb").alias("rows_base"), F.sum("_xc").alias("rows_current"), F.sum(F.when(F.col("v").isNotNull(), F.col("_xb")).otherwise(0)).alias("_nb"),
                                       F.sum(F.when(F.col("v").isNotNull(), F.col("_xc")).otherwise(0)).alias("_nc"))
    # one row a column, and columns are few
    share = both.where("v is not null").join(F.broadcast(total), "column").where("_nb > 0 and _nc > 0")
    pb, pc = F.col("_xb") / F.col("_nb"), F.col("_xc") / F.col("_nc")
    fb, fc = F.greatest(pb, F.lit(LEAST_SHARE)), F.greatest(pc, F.lit(LEAST_SHARE))
    figures = share.groupBy("column").agg(F.sum((fc - fb) * F.log(fc / fb)).alias("psi"), (F.sum(F.abs(pb - pc)) / 2).alias("ks"))
    return _report(total.join(figures, "column", "left"), "text", F.lit(0.0))


def drift_report(base: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, bins: int = 10, exact: bool = False, k: int = SKETCH_K) -> DataFrame:
    """How each column's distribution in ``current`` differs from ``base``: shares of missing values, stability index over the base's
    quantile bins, and the Kolmogorov-Smirnov distance with its error bound. ``drifted``: the index is above 0.2.

    Numeric columns go through sketches, or with ``exact`` through a sort; text and boolean ones are counted by value.
    NULL and NaN are missing. Only columns of both tables are compared. A table without rows leaves figures NULL.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    numeric, text = (list(filter(lambda c: c in current.columns, cs)) for cs in column_kinds(base, columns))
    parts = []
    if numeric:
        parts.append(exact_drift(base, current, numeric, bins) if exact else sketch_drift(sketches(base, numeric, k=k), sketches(current, numeric, k=k), bins, k))
    if text:
        parts.append(text_drift(base, current, text))
    if not parts:
        return base.sparkSession.createDataFrame([], REPORT)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
