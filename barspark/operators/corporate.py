"""Back-adjustment of bars for splits and dividends.

A bar's factor is the product of the factors of all its ticker's actions that take effect later. Bars and actions
are put in one (ticker, time) order and cut into blocks: the product after each row is taken inside its block and
multiplied by that of the later blocks (:func:`barspark.operators.carry.product_after`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.carry import carried, product_after
from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, with_blocks
from barspark.schema import PRICE_COLUMNS


def action_factor(kind: Column, value: Column, close: Column) -> Column:
    """What an action multiplies earlier prices by: 1/ratio for a split, 1 - amount/last close for a dividend.
    NULL if the action has no effect: another kind, a value that is not a positive number, no close, or a
    dividend not below the close."""
    v = F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value)
    return F.when(kind == "split", 1 / v).when((kind == "dividend") & (close > v), 1 - v / close)


def adjust_prices(bars: DataFrame, actions: DataFrame, key: str = "ticker", order: Sequence[str] = ("timestamp",), price: str = "close",
                  prices: Sequence[str] = PRICE_COLUMNS, volume: str | None = "vol", time: str = "timestamp",
                  action_time: str = "ex_time", kind: str = "kind", value: str = "value", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``bars`` with prices (and, for splits, volume) as if all later actions had been in effect; adds ``price_factor`` and ``volume_factor``.

    ``actions``: one row for each split (``value`` new shares for an old one) or dividend (``value`` per share). An
    action at time t changes bars before t. A dividend is set against the ticker's last non-NULL ``price`` before t, as it was
    quoted. Actions of one time multiply. Actions without effect (see :func:`action_factor`) change nothing.
    Bars with a NULL ticker or time are returned with factor 1. ``order`` starts with the time.
    """
    if order[0] != time:
        raise ValueError("order must start with the time column")
    q = lambda c: F.col(f"`{c}`")
    whole = F.struct(*[q(c).alias(c) for c in bars.columns])
    usable = q(key).isNotNull() & q(time).isNotNull()
    ties = [f"_o{i}" for i in range(len(order) - 1)]
    rows = bars.where(usable).select(q(key).alias("_k"), q(time).alias("_t"), F.lit(1).alias("_side"), *[q(c).alias(n) for c, n in zip(order[1:], ties)],
                                     whole.alias("_bar"), F.lit(None).cast("string").alias("_kind"), F.lit(None).cast("double").alias("_value"))
    events = actions.where(q(key).isNotNull() & q(action_time).isNotNull()).select(
        q(key).cast(rows.schema["_k"].dataType).alias("_k"), q(action_time).cast(rows.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_side"),
        *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in ties],
        F.lit(None).cast(rows.schema["_bar"].dataType).alias("_bar"), q(kind).alias("_kind"), q(value).cast("double").alias("_value"))
    # among tied rows the hash lets the range exchange cut; actions of one time commute
    tail = F.xxhash64(*[q(c) for c in ties], "_kind", "_value")
    blocked = with_blocks(rows.unionByName(events), ["_k"], ["_t", "_side", *ties, tail], block_rows)
    quoted = F.nanvl(F.col(f"_bar.`{price}`").cast("double"), F.lit(None).cast("double"))
    blocked = carried(blocked, "_k", {"_close": quoted})
    effect = action_factor(F.col("_kind"), F.col("_value"), F.col("_close"))
    blocked = product_after(blocked, "_k", effect, "price_factor")
    out = product_after(blocked, "_k", F.when(F.col("_kind") == "split", 1 / effect), "volume_factor").where("_side = 1").select("_bar.*", "price_factor", "volume_factor")
    out = out.unionByName(bars.where(~usable).select("*", F.lit(1.0).alias("price_factor"), F.lit(1.0).alias("volume_factor")))
    changed = {p: q(p) * F.col("price_factor") for p in prices}
    if volume:
        changed[volume] = q(volume) * F.col("volume_factor")
    return out.withColumns(changed)


def idle_actions(bars: DataFrame, actions: DataFrame, key: str = "ticker", price: str = "close", time: str = "timestamp",
                 action_time: str = "ex_time", kind: str = "kind", value: str = "value", tie: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The rows of ``actions`` that change nothing, with ``reason``: NULL key or time, unknown kind, bad value, no earlier close, or dividend not below it."""
    from barspark.operators.asof import asof_join
    q = lambda c: F.col(f"`{c}`")
    v, close = q(value).cast("double"), F.col("_close")
    quoted = F.nanvl(q(price).cast("double"), F.lit(None).cast("double"))
    quotes = bars.where(quoted.isNotNull()).select(q(key), q(time).alias("_at"), quoted.alias("_close"), *[q(c).alias(f"_tie{i}") for i, c in enumerate(tie)])
    out = asof_join(actions, quotes, key, action_time, "_at", ["_close"], [f"_tie{i}" for i in range(len(tie))], allow_exact=False, block_rows=block_rows)
    reason = (F.when(q(key).isNull() | q(action_time).isNull(), "no ticker or time")
              .when(~F.coalesce(q(kind).isin("split", "dividend"), F.lit(False)), "unknown kind")
              .when(~F.coalesce((v > 0) & ~F.isnan(v) & (v < float("inf")), F.lit(False)), "bad value")
              .when((q(kind) == "dividend") & close.isNull(), "no earlier close")
              .when((q(kind) == "dividend") & (close <= v), "dividend not below close"))
    return out.withColumn("reason", reason).drop("_close").where("reason is not null")
