"""Exact order statistics without holding a group in one task.

Spark's exact ``percentile`` keeps a map of every distinct value of a group in memory.
Here the values of all requested columns are unpivoted to ``(column, value)``, sorted
once by a range-partitioned sort, numbered, and only the one or two rows around each
requested rank are fetched (linear interpolation as pandas and ``quantile_cont``).
A fixed number of jobs, whatever the number of columns: the sort's sample, the counts
(which materialise the sorted rows) and the fetch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.ordering import global_position, positions_kept, release_positions


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = int(math.floor(h))
    return lo, int(math.ceil(h)), h - lo


def exact_percentiles_many(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """``{column: [value at each prob]}``; NULL and NaN values are ignored."""
    cols = list(columns)
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"`{c}`").cast("double").alias("v"))
                                for i, c in enumerate(cols)]))
    long = df.select(pairs.alias("p")).select("p.k", "p.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    kept = positions_kept()
    # positions first: the sorted rows are materialised once and the counts read them
    pos = global_position(long, ["k", "v"], "_i")
    counts = {r["k"]: r["n"] for r in pos.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, offset = {}, 0
    for k in range(len(cols)):
        start[k] = offset
        offset += counts.get(k, 0)
    wanted = set()
    for k in range(len(cols)):
        n = counts.get(k, 0)
        for p in probs:
            if n:
                lo, hi, _ = _ranks(n, p)
                wanted.update({start[k] + lo, start[k] + hi})
    got = {}
    if wanted:
        got = {r["_i"]: r["v"] for r in pos.filter(F.col("_i").isin(sorted(wanted))).select("_i", "v").collect()}
    release_positions(kept)  # nothing lazy is left
    out = {}
    for k, c in enumerate(cols):
        n = counts.get(k, 0)
        vals = []
        for p in probs:
            if not n:
                vals.append(None)
                continue
            lo, hi, frac = _ranks(n, p)
            a, b = got[start[k] + lo], got[start[k] + hi]
            vals.append(a + frac * (b - a))
        out[c] = vals
    return out


def exact_percentiles(df: DataFrame, column: str | Column, probs: Sequence[float]) -> list[float | None]:
    if not isinstance(column, str):
        df = df.select(column.alias("_x"))
        column = "_x"
    return exact_percentiles_many(df, [column], probs)[column]


def exact_median(df: DataFrame, column: str | Column) -> float | None:
    return exact_percentiles(df, column, [0.5])[0]
