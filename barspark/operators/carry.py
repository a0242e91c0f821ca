"""Values carried along a key's rows, forwards and backwards, and running products, over bounded blocks.

Input rows have positions and blocks (:func:`barspark.operators.ordering.with_blocks` without halo). Inside a
block a window per ``(key, _blk)`` does the work; between blocks travels a table of one row per (key, block). No
window ever covers a whole key, so a key with a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _per_block(blocked: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """``ends`` (``_ck``, ``_cb`` and more) brought to the rows of their block."""
    return blocked.join(ends, F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_blk") == F.col("_cb")), "left").drop("_ck", "_cb")


def carried(blocked: DataFrame, key: str, values: Mapping[str, Column], backwards: bool = False) -> DataFrame:
    """Add each of ``values`` under its name: the value of the key's nearest row at or before this one that has one
    (``backwards``: at or after). A row's own value counts; NULL where there is none."""
    names = list(values)
    own = blocked.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    pick = F.min_by if backwards else F.max_by
    ends = own.groupBy(key, "_blk").agg(*[pick(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col("_g"))).alias(f"_e{i}") for i in range(len(names))])
    by_block, by_row = (F.col("_blk").desc(), F.col("_g").desc()) if backwards else (F.col("_blk"), F.col("_g"))
    beyond = Window.partitionBy(key).orderBy(by_block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_ck"), F.col("_blk").alias("_cb"), *[F.last(f"_e{i}", True).over(beyond).alias(f"_c{i}") for i in range(len(names))])
    within = Window.partitionBy(key, "_blk").orderBy(by_row).rowsBetween(Window.unboundedPreceding, 0)
    out = _per_block(own, ends, key).withColumns({n: F.coalesce(F.last(f"_v{i}", True).over(within), F.col(f"_c{i}")) for i, n in enumerate(names)})
    return out.drop(*[f"_{x}{i}" for x in "vc" for i in range(len(names))])


def product_after(blocked: DataFrame, key: str, factor: Column, name: str) -> DataFrame:
    """Add ``name``: the product of ``factor`` over the key's rows after this one (1 where there is none).

    NULL factors count as 1. Blocks multiply up on their own; a block's rows then take the product of all later
    blocks of the key."""
    own = blocked.withColumn("_f", F.coalesce(factor.cast("double"), F.lit(1.0)))
    later = Window.partitionBy(key).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy(key, "_blk").agg(F.product("_f").alias("_p"))
    ends = ends.select(F.col(key).alias("_ck"), F.col("_blk").alias("_cb"), F.product("_p").over(later).alias("_later"))
    within = Window.partitionBy(key, "_blk").orderBy(F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = _per_block(own, ends, key)
    return out.withColumn(name, F.coalesce(F.product("_f").over(within), F.lit(1.0)) * F.coalesce("_later", F.lit(1.0))).drop("_f", "_later")


def sums_upto(blocked: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """Add each of ``values`` under its name: its sum over the key's rows up to and including this one (NULL counts as 0)."""
    names = list(values)
    own = blocked.withColumns({f"_v{i}": F.coalesce(values[n], F.lit(0)) for i, n in enumerate(names)})
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy(key, "_blk").agg(*[F.sum(f"_v{i}").alias(f"_e{i}") for i in range(len(names))])
    ends = ends.select(F.col(key).alias("_ck"), F.col("_blk").alias("_cb"), *[F.sum(f"_e{i}").over(earlier).alias(f"_c{i}") for i in range(len(names))])
    within = Window.partitionBy(key, "_blk").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    out = _per_block(own, ends, key).withColumns({n: F.sum(f"_v{i}").over(within) + F.coalesce(f"_c{i}", F.lit(0)) for i, n in enumerate(names)})
    return out.drop(*[f"_{x}{i}" for x in "vc" for i in range(len(names))])
