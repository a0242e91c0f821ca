"""Bars of a coarser frequency, with bucket borders of a time zone and empty buckets inside gaps.

Rows are aggregated by (key, bucket): first and last values are picked by the smallest and largest (time, tie-breaker), which
combines map-side like any sum, so a hot key costs one row per task and bucket. Empty buckets are then made from
the gap between neighbouring buckets of a key; a key's buckets are cut into blocks for that.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.carry import carried
from barspark.operators.ordering import DEFAULT_BLOCK_ROWS, global_position, into_blocks
from barspark.schema import PRICE_COLUMNS

# Frequency units.
FIXED_UNITS = {"s": 1, "min": 60, "h": 3600}
CALENDAR_UNITS = {"d": "day", "w": "week", "mo": "month", "q": "quarter", "y": "year"}
FILLS = ("none", "null", "carry")


class Frequency:
    """``15min``, ``1h``, ``4h`` (counted from the start of each local day) or ``1d``, ``1w``, ``1mo``, ``1q``, ``1y`` (local calendar).

    A day that daylight saving shortens or lengthens has fewer or more buckets of a fixed length; the last may be
    shorter. A bucket is named by the day it starts on and its number in that day.
    """

    def __init__(self, text: str, zone: str = "UTC"):
        found = re.fullmatch(r"(\d+)(s|min|h|d|w|mo|q|y)", text)
        if not found or int(found[1]) < 1:
            raise ValueError(f"no frequency: {text}")
        n, unit = int(found[1]), found[2]
        self.zone, self.calendar = zone, CALENDAR_UNITS.get(unit)
        if self.calendar and n != 1:
            raise ValueError("calendar frequencies are of one unit")
        self.seconds = None if self.calendar else n * FIXED_UNITS[unit]
        if self.seconds and self.seconds > 86400:
            raise ValueError("fixed frequencies are of a day at most")

    def local(self, ts: Column) -> Column:
        """Local wall-clock time of a zone-less UTC time."""
        return ts if self.zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(self.zone), ts)

    def utc(self, local: Column) -> Column:
        return local if self.zone == "UTC" else F.convert_timezone(F.lit(self.zone), F.lit("UTC"), local)

    def day(self, ts: Column) -> Column:
        """The local date on which the bucket's day (or week, month ...) starts."""
        return F.to_date(F.date_trunc(self.calendar or "day", self.local(ts)))

    def day_start(self, day: Column) -> Column:
        return self.utc(day.cast("timestamp_ntz"))

    def number(self, ts: Column, day: Column) -> Column:
        """The bucket's number in its day."""
        if self.calendar:
            return F.lit(0).cast("long")
        return self._whole(self._since(ts, self.day_start(day)))

    def start(self, day: Column, number: Column) -> Column:
        """When a bucket starts, as a zone-less UTC time."""
        if self.calendar:
            return self.day_start(day)
        return F.timestamp_micros(F.unix_micros(self.day_start(day).cast("timestamp")) + number * F.lit(self.seconds * 1_000_000)).cast("timestamp_ntz")

    def in_day(self, day: Column) -> Column:
        """How many buckets a day has."""
        if self.calendar:
            return F.lit(1).cast("long")
        return self._whole(self._since(self.day_start(F.date_add(day, 1)), self.day_start(day)) - 1) + 1

    def days(self, first: Column, last: Column) -> Column:
        """All days (or weeks, months ...) from first to last."""
        step = {"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}.get(self.calendar, "INTERVAL 1 DAY")
        return F.sequence(first, last, F.expr(step))

    def _whole(self, micros: Column) -> Column:
        """Whole buckets in a span."""
        return F.floor(micros / F.lit(self.seconds * 1_000_000)).cast("long")

    @staticmethod
    def _since(a: Column, b: Column) -> Column:
        return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))


def resample(bars: DataFrame, freq: str, zone: str = "UTC", key: str = "ticker", order: Sequence[str] = ("timestamp",), time: str = "timestamp",
             fill: str = "none", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """One bar a ticker and bucket: first open, highest high, lowest low, last close, sum of volume, last openint, count of rows.

    Columns: ``key, time`` (the bucket's start, zone-less UTC like the input), ``open, high, low, close, vol, openint, bars``.
    NULL and NaN values are passed over; a bucket in which a column has none gets NULL there. Rows that tie in ``order``
    are interchangeable. Rows with a NULL time are left out, those with a NULL ticker are a ticker of their own.
    ``fill``: ``none`` makes no empty buckets; ``null`` and ``carry`` make those between a ticker's first and last
    bucket, with 0 bars and volume 0, and NULL prices or the last close before them as all four prices.
    """
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {', '.join(FILLS)}")
    f = Frequency(freq, zone)
    q = lambda c: F.col(f"`{c}`")
    rows = bars.where(q(time).isNotNull()).withColumn("_day", f.day(q(time))).withColumn("_no", f.number(q(time), F.col("_day")))
    rank = F.struct(*[q(c).alias(f"o{i}") for i, c in enumerate(order)])
    value = lambda c: F.nanvl(q(c).cast("double"), F.lit(None).cast("double"))
    some = lambda c: F.when(value(c).isNotNull(), rank)
    out = rows.groupBy(q(key), "_day", "_no").agg(
        F.min_by(value("open"), some("open")).alias("open"), F.max(value("high")).alias("high"), F.min(value("low")).alias("low"),
        F.max_by(value("close"), some("close")).alias("close"), F.sum(value("vol")).alias("vol"),
        F.max_by(value("openint"), some("openint")).alias("openint"), F.count(F.lit(1)).alias("bars"))
    if fill != "none":
        out = _filled(out, f, key, fill, block_rows)
    return out.select(q(key), f.start(F.col("_day"), F.col("_no")).alias(time), "open", "high", "low", "close", "vol", "openint", "bars")


def _filled(buckets: DataFrame, f: Frequency, key: str, fill: str, block_rows: int) -> DataFrame:
    """``buckets`` and the empty ones before each that follows a gap. One range exchange over the buckets serves both steps."""
    nothing = F.lit(None).cast("double")
    g = global_position(buckets, [key, "_day", "_no"])
    if fill == "carry":
        g = carried(into_blocks(g, block_rows, 0), key, {"_carry": F.col("close")}).drop("_blk", "_halo")
    else:
        g = g.withColumn("_carry", nothing)
    near = Window.partitionBy(key, "_blk").orderBy("_g")
    before = F.lag(F.struct(F.col("_day").alias("day"), F.col("_no").alias("no"), F.col("_carry").alias("close"))).over(near)
    rows = into_blocks(g, block_rows, 1).withColumn("_last", before).where("not _halo")
    day = F.col("_missing")
    # every day of the gap, then the numbers of that day that lie strictly between both ends
    gaps = rows.where("_last is not null").withColumn("_missing", F.explode(f.days(F.col("_last.day"), F.col("_day"))))
    low = F.when(day == F.col("_last.day"), F.col("_last.no") + 1).otherwise(F.lit(0).cast("long"))
    high = F.when(day == F.col("_day"), F.col("_no") - 1).otherwise(f.in_day(day) - 1)
    gaps = gaps.withColumn("_empty", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    empty = gaps.select(F.col(f"`{key}`"), day.alias("_day"), F.col("_empty").alias("_no"), *[F.col("_last.close").alias(c) for c in PRICE_COLUMNS],
                        F.lit(0.0).alias("vol"), nothing.alias("openint"), F.lit(0).cast("long").alias("bars"))
    return rows.select(*buckets.columns).unionByName(empty)
