"""Row positions and bounded blocks that hold up when one key carries a third of the rows.

A window ``partitionBy(ticker)`` puts each ticker in one task. Instead the rows are
range-partitioned on ``keys + order`` (Spark samples the sort keys, so a hot ticker
spreads over many tasks), numbered inside each partition, and turned into one global
position ``_g`` with a per-partition offset table. That table has one row per shuffle
partition, so broadcasting it is safe at any data volume. The range-partitioned rows
are materialised once (see :func:`_tagged`) so that the count and the rows agree.

Windows then run per ``(key, _blk)`` with ``_blk = _g div block_rows``: every window
partition holds at most ``block_rows`` rows (plus a copied *halo* of the rows just
before the block, so bounded frames and EMA carries see their history).

A row's rank inside its key is ``_g`` minus the key's first position (``min(_g)`` per
key, a partial aggregate), joined back on ``(key, _blk)`` – a join key that never
holds more than ``block_rows`` rows, however hot the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 1 << 20
_LOCAL_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the in-partition count here


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(f"`{c}`") if isinstance(c, str) else c for c in cols]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(counts: DataFrame, total: str) -> DataFrame:
    """``_pid → _off``: sum of ``total`` over all earlier partitions (one row per partition)."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_pid", F.coalesce(F.sum(total).over(before), F.lit(0)).alias("_off"))


_PERSISTED: list[DataFrame] = []


def positions_kept() -> int:
    """How many positioned frames are materialised now; :func:`release_positions` takes it back."""
    return len(_PERSISTED)


def release_positions(since: int = 0) -> None:
    """Unpersist the positioned frames that were materialised after ``since`` others.

    Call it once no DataFrame built on those positions will run again: a positioned
    frame evaluated after its release would recompute the range shuffle per branch.
    """
    while len(_PERSISTED) > since:
        _PERSISTED.pop().unpersist()


def materialised(df: DataFrame) -> DataFrame:
    """``df``, kept once it is evaluated, for rows that several plans start from; :func:`release_positions` counts it in."""
    _PERSISTED.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _PERSISTED[-1]


def _tagged(df: DataFrame, by: list[Column], split_copies: bool = False) -> DataFrame:
    """Range-partitioned, sorted rows with ``_pid`` and ``_mid``, materialised once.

    Two consumers read these rows: the per-partition counts and the rows themselves.
    Re-running the range exchange for each would draw a new sample (the sampler is
    seeded by RDD id) and so new partition bounds; reading one materialised copy makes
    both agree. Lost blocks are recomputed from the same partitioner, so they come back
    identical. The explicit partition count keeps adaptive execution from coalescing.

    Rows equal on every sort key land in one range partition. ``split_copies`` adds the
    row's position in its input split as a last key, so a large group of exact copies
    is spread too; that position is stable on recompute when the input is read straight
    from files (no shuffle before this point).
    """
    if split_copies:
        df = df.withColumn("_copy", F.monotonically_increasing_id())
        by = [*by, F.col("_copy")]
    ranged = df.repartitionByRange(_partitions(df), *by).sortWithinPartitions(*by)
    tagged = (ranged.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .persist(StorageLevel.MEMORY_AND_DISK))
    _PERSISTED.append(tagged)
    return tagged.drop("_copy") if split_copies else tagged


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "_g",
                    split_copies: bool = False) -> DataFrame:
    """Add ``name``: the dense 0-based position of each row in the total order ``order``.

    ``order`` should make rows unique (add a tie-breaker column); rows that tie on
    every column are interchangeable, so ties only matter for exact duplicates.
    """
    tagged = _tagged(df, _cols(order), split_copies)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    return (tagged.join(F.broadcast(_offsets(counts, "_cnt")), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOCAL_BITS)))
            .drop("_pid", "_mid", "_off"))


def with_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                block_rows: int = DEFAULT_BLOCK_ROWS, halo: int = 0, split_copies: bool = False) -> DataFrame:
    """Add ``_g`` (global position over ``keys + order``), ``_blk`` and ``_halo``.

    Rows whose position is among the last ``halo`` rows of a block are also emitted
    into the next block with ``_halo = true``; windows over ``(keys, _blk)`` then see
    the ``halo`` rows that precede every row. Drop halo rows after the windows.
    """
    if halo > block_rows:
        raise ValueError("halo must not exceed block_rows")
    g = global_position(df, [*keys, *order], split_copies=split_copies)
    return into_blocks(g, block_rows, halo)


def into_blocks(g: DataFrame, block_rows: int, halo: int = 0) -> DataFrame:
    """Add ``_blk`` and ``_halo`` to rows that have their position ``_g``."""
    own = F.floor(F.col("_g") / F.lit(block_rows)).cast("long")
    if halo <= 0:
        return g.withColumn("_blk", own).withColumn("_halo", F.lit(False))
    in_tail = (F.col("_g") % F.lit(block_rows)) >= F.lit(block_rows - halo)
    blocks = F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))
    return (g.withColumn("_blk", F.explode(blocks))
            .withColumn("_halo", F.col("_blk") != own))


def key_spans(positioned: DataFrame, keys: Sequence[str], block_rows: int = DEFAULT_BLOCK_ROWS,
              count: str = "_kn", first: str = "_kfirst") -> DataFrame:
    """One row per ``(key, _blk)`` the key occupies, with the key's row count and first position.

    The order sorts by key first, so a key's rows hold consecutive positions and its
    first position is ``min(_g)``: a partial aggregate, one row per key and map task.
    """
    own = positioned.filter(~F.col("_halo")) if "_halo" in positioned.columns else positioned
    starts = own.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min("_g").alias(first),
                                                                F.count(F.lit(1)).alias(count))
    lo = F.floor(F.col(first) / F.lit(block_rows)).cast("long")
    hi = F.floor((F.col(first) + F.col(count) - 1) / F.lit(block_rows)).cast("long")
    return starts.select(*keys, count, first, F.explode(F.sequence(lo, hi)).alias("_blk"))


def with_key_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  block_rows: int = DEFAULT_BLOCK_ROWS, halo: int = 0,
                  rank: str = "_r", count: str = "_n", split_copies: bool = False) -> DataFrame:
    """Add the 0-based rank of each row within its key (``rank``) and the key's row count.

    Rows with a NULL key get no rank and drop out.
    """
    keyed = df
    for k in keys:
        keyed = keyed.filter(F.col(f"`{k}`").isNotNull())
    b = with_blocks(keyed, keys, order, block_rows, halo, split_copies)
    spans = key_spans(b, keys, block_rows, "_kn", "_kfirst")
    return (b.join(spans, [*keys, "_blk"])
            .withColumn(rank, F.col("_g") - F.col("_kfirst"))
            .withColumnRenamed("_kn", count)
            .drop("_kfirst"))


def row_number_in_order(df: DataFrame, order: Sequence[str | Column], name: str = "row_idx") -> DataFrame:
    """A 0-based row index over the whole DataFrame in ``order`` without a single-task window."""
    return global_position(df, order, name)
