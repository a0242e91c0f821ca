"""As-of join, and currency conversion by it.

The two sides become one set of rows in (key, time) order, cut into bounded blocks; the last right row is carried
along (:mod:`barspark.operators.carry`). Neither side is broadcast and no key is collected, so one currency
may hold most bars, and one (currency, time) too: rows that tie are ordered by a hash of the row, which
lets the range exchange split them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators.carry import carried
from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, with_blocks
from barspark.schema import PRICE_COLUMNS

DIRECTIONS = ("backward", "forward", "nearest")


def _ticks(c: Column, dtype: T.DataType) -> Column:
    """A time as a number: microseconds of timestamps and dates, numbers as they are."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    return c


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str = "timestamp", right_time: str = "timestamp",
              values: Sequence[str] | None = None, tie: Sequence[str] = (), direction: str = "backward",
              tolerance: float | None = None, allow_exact: bool = True, matched_time: str | None = None,
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Every row of ``left`` with ``values`` of the row of ``right`` with the same ``on`` that is nearest in time.

    ``direction``: the last right row at or before the left row's time, the first at or after it, or the nearer of the two
    (the earlier one if both are as far). Without ``allow_exact`` (not for nearest) a right row at the same time does not count.
    ``tolerance`` is the largest distance (seconds for timestamps and dates, else in the unit of the time); beyond it
    there is no match. Of right rows with equal key and time the one with the largest ``tie`` columns counts,
    by default that with the largest values. Left rows without a match, or with a NULL key or time, are kept
    with NULL values; right rows with a NULL key or time match nothing. ``matched_time`` names a column for the right
    row's time. ``values`` must not be columns of ``left``.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    if direction == "nearest" and not allow_exact:
        raise ValueError("nearest always counts a row at the same time")
    values = list(values or [c for c in right.columns if c not in (on, right_time)])
    added = [*values, *([matched_time] if matched_time else [])]
    clash = [c for c in added if c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    dtype = left.schema[left_time].dataType
    q = lambda c: F.col(f"`{c}`")
    at = q(right_time).cast(dtype)
    found = F.struct(*[q(c).alias(c) for c in values], at.alias("_time"))
    right = (right.where(q(on).isNotNull() & at.isNotNull()).select(q(on).cast(left.schema[on].dataType).alias("_k"), at.alias("_t"), found.alias("_right"),
                                                                   F.struct(*[q(c).alias(f"t{i}") for i, c in enumerate(tie or values)]).alias("_tie"))
             .groupBy("_k", "_t").agg(F.max_by("_right", "_tie").alias("_right")))
    # where a right row stands among left rows of its time decides whether it counts for them
    first = (direction == "forward") != allow_exact
    whole = F.struct(*[q(c).alias(c) for c in left.columns])
    usable = q(on).isNotNull() & q(left_time).isNotNull()
    rows = left.where(usable).select(q(on).alias("_k"), q(left_time).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(*[q(c) for c in left.columns if not _maps(left.schema[c].dataType)]).alias("_h"), whole.alias("_left"))
    both = rows.withColumn("_right", F.lit(None).cast(right.schema["_right"].dataType)).unionByName(
        right.select("_k", "_t", F.lit(0 if first else 2).alias("_side"), F.lit(0).cast("long").alias("_h"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), "_right"))
    blocked = with_blocks(both, ["_k"], ["_t", "_side", "_h"], block_rows)
    own = F.when(F.col("_side") != 1, F.col("_right"))
    if direction != "forward":
        blocked = carried(blocked, "_k", {"_before": own})
    if direction != "backward":
        blocked = carried(blocked, "_k", {"_after": own}, backwards=True)
    out = blocked.where("_side = 1")
    unit = 1_000_000 if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) else 1
    now = _ticks(F.col("_t"), dtype)
    gap = lambda name: F.abs(now - _ticks(F.col(f"{name}._time"), dtype))
    if direction == "nearest":
        later = F.col("_before").isNull() | (gap("_after") < gap("_before"))
        out = out.withColumn("_hit", F.when(later & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before")))
    else:
        out = out.withColumnRenamed("_before" if direction == "backward" else "_after", "_hit")
    if tolerance is not None:
        out = out.withColumn("_hit", F.when(gap("_hit") <= F.lit(tolerance * unit), F.col("_hit")))
    out = out.select("_left.*", *[F.col(f"_hit.`{c}`").alias(c) for c in values], *([F.col("_hit._time").alias(matched_time)] if matched_time else []))
    unmatched = left.where(~F.coalesce(usable, F.lit(False))).select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in added])
    return out.unionByName(unmatched)


def _maps(dtype: T.DataType) -> bool:
    """Whether a type holds a map, which has no hash."""
    if isinstance(dtype, T.ArrayType):
        return _maps(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_maps(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def convert_currency(bars: DataFrame, rates: DataFrame, target: str, currency: str = "currency", rate: str = "rate",
                     time: str = "timestamp", rate_time: str = "timestamp", tie: Sequence[str] = (), prices: Sequence[str] = PRICE_COLUMNS,
                     max_age: float | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``bars`` with prices in ``target``: each times the last ``rate`` (target units for one of the currency) at or before the bar's time.

    Adds the rate used; the currency column becomes ``target`` where there is one. Bars in the target currency keep their
    prices (rate 1). Without a rate, or with one older than ``max_age`` seconds, prices and rate are NULL and the currency stays.
    Rates that are NULL, NaN or not positive are passed over, as if they had not been quoted.
    """
    name = "_rate"
    r = F.col(f"`{rate}`").cast("double")
    quotes = rates.where(r.isNotNull() & ~F.isnan(r) & (r > 0) & (F.col(f"`{currency}`") != target))
    quotes = quotes.select(F.col(f"`{currency}`"), F.col(f"`{rate_time}`").alias("_quoted"), r.alias(name), *[F.col(f"`{c}`").alias(f"_tie{i}") for i, c in enumerate(tie)])
    own = F.col(f"`{currency}`") == target
    foreign = asof_join(bars.where(~F.coalesce(own, F.lit(False))), quotes, currency, time, "_quoted", [name], [f"_tie{i}" for i in range(len(tie))], tolerance=max_age, block_rows=block_rows)
    out = foreign.unionByName(bars.where(own).withColumn(name, F.lit(1.0)))
    changed = {p: F.col(f"`{p}`") * F.col(name) for p in prices}
    changed[currency] = F.when(F.col(name).isNotNull(), F.lit(target)).otherwise(F.col(f"`{currency}`"))
    return out.withColumns(changed).withColumnRenamed(name, "rate" if "rate" not in bars.columns else name)
