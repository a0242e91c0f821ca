"""Filling NULL prices along a ticker's rows: from before, from after, or on the line between both.

The nearest values on both sides come with their place and time from :mod:`barspark.operators.carry`, across any number of
blocks; everything else is an expression of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.carry import carried
from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, with_blocks

METHODS = ("ffill", "bfill", "linear", "time")


def impute(df: DataFrame, method: str, columns: Sequence[str], key: str = "ticker", order: Sequence[str] = ("timestamp",), time: str = "timestamp",
           limit: int | None = None, flag: str | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``df`` with NULL and NaN values of numeric ``columns`` filled along each ticker's rows.

    ``ffill``: the last value before; ``bfill``: the next one after; ``linear``: on the line between both by row number; ``time``: by
    ``time`` (equal times on both sides: the value before). A gap at a ticker's start or end has one side only, so ``linear``
    and ``time`` leave it. ``limit`` fills only rows at most so many places from the value they are filled from (for
    lines: from the value before). ``flag`` adds an array of the columns filled in the row. Rows with a NULL ticker stay as they are.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    q = lambda c: F.col(f"`{c}`")
    value = {c: F.nanvl(q(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    blocked = with_blocks(df.where(q(key).isNotNull()), [key], list(order), block_rows)
    point = {c: F.when(value[c].isNotNull(), F.struct(value[c].alias("v"), F.col("_g").alias("g"), *([q(time).alias("t")] if method == "time" else []))) for c in columns}
    if method != "bfill":
        blocked = carried(blocked, key, {f"_before{i}": point[c] for i, c in enumerate(columns)})
    if method != "ffill":
        blocked = carried(blocked, key, {f"_after{i}": point[c] for i, c in enumerate(columns)}, backwards=True)
    filled = {}
    for i, c in enumerate(columns):
        a, b = F.col(f"_before{i}"), F.col(f"_after{i}")
        if method == "ffill":
            new = a["v"]
        elif method == "bfill":
            new = b["v"]
        else:
            new = a["v"] + (b["v"] - a["v"]) * _share(a, b, q(time), method)
        if limit is not None:
            steps = b["g"] - F.col("_g") if method == "bfill" else F.col("_g") - a["g"]
            new = F.when(steps <= limit, new)
        filled[c] = F.when(value[c].isNull(), new)
    out = blocked.withColumns({f"_new{i}": filled[c] for i, c in enumerate(columns)})
    flags = F.filter(F.array(*[F.when(F.col(f"_new{i}").isNotNull(), F.lit(c)) for i, c in enumerate(columns)]), lambda x: x.isNotNull())
    names = {c: f"_new{i}" for i, c in enumerate(columns)}
    own = [F.coalesce(value[c], F.col(names[c])).alias(c) if c in names else q(c) for c in df.columns]
    out = out.select(*own, *([flags.alias(flag)] if flag else []))
    rest = df.where(q(key).isNull())
    rest = rest.select(*[value[c].alias(c) if c in names else q(c) for c in df.columns], *([F.array().cast("array<string>").alias(flag)] if flag else []))
    return out.unionByName(rest)


def _share(a: Column, b: Column, time: Column, method: str) -> Column:
    """How far a row lies on the way from a to b."""
    if method == "linear":
        return (F.col("_g") - a["g"]) / (b["g"] - a["g"])
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    span = micros(b["t"]) - micros(a["t"])
    return F.when(span > 0, (micros(time) - micros(a["t"])) / span).when(b.isNotNull() & a.isNotNull(), F.lit(0.0))
