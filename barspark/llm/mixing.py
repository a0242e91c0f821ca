"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of equal size. With weight w (the sources' weights sum to 1), the
j-th block of a source (j from 0) is released at slot floor(j / w) and is due at slot
ceil((j + 1) / w). In each slot the released block with the earliest deadline is taken. After any
number t of slots a source then has more than w t - 1 and less than w t + 1 blocks.

Weights are not rounded to slots of a period, so the bound holds for the requested weights however long the
table is. The driver goes through the slots once and keeps what each source has placed after every ``period``
slots; tasks make the slots in between from that. When a source has no blocks left, the others go
on with their weights scaled up; so there is one phase for each source, and all documents are kept.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barspark.llm.frames import partitions, stored

#: Most sources; their totals and what each has placed after each period are held on the driver.
MAX_SOURCES = 1000
PERIOD = 1000
BLOCK_WORDS = 4096
#: About how many rows are numbered together.
RUN_ROWS = 4096


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each source, at least one each, by largest remainder."""
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {s: Fraction(w).limit_denominator(10 ** 9) / Fraction(total).limit_denominator(10 ** 9) * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(out, key=lambda s: (-(exact[s] - out[s]), s)):
        if sum(out.values()) < period:
            out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def windows(j: int, slots: int, period: int) -> tuple[int, int]:
    """Release and deadline of block j of a source with slots / period of all slots."""
    return j * period // slots, -(-(j + 1) * period // slots)


def turns(parts: dict[str, int], first: dict[str, int] | None = None, start: int = 0) -> Iterator[tuple[str, int]]:
    """(source, its block) for slot ``start`` and those after it without end, when each source has placed ``first``
    blocks: earliest deadline first among released blocks; ties go to the smaller name. The
    weights are ``parts`` of their sum."""
    period = sum(parts.values())
    later: list[tuple[int, int, str, int]] = []
    ready: list[tuple[int, str, int]] = []

    def wait(s: str, j: int) -> None:
        r, d = windows(j, parts[s], period)
        heapq.heappush(later, (r, d, s, j))

    for s in parts:
        wait(s, first[s] if first else 0)
    for t in count(start):
        while later and later[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        d, s, j = heapq.heappop(ready)
        assert t < d, "a deadline was missed"
        # blocks of a source go in order, so its next one competes once this one is placed
        wait(s, j + 1)
        yield s, j


def schedule(slots: dict[str, int]) -> list[tuple[str, int]]:
    """(source, its block) for each slot of the period after which whole slots repeat."""
    return list(islice(turns(slots), sum(slots.values())))


def exact_parts(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole parts of about 10 ** 12, at least one each; they do not depend on any period."""
    total = math.fsum(weights.values())
    return {s: max(1, round(w / total * 10 ** 12)) for s, w in weights.items()}


def phases(weights: dict[str, float], blocks: dict[str, int], period: int = PERIOD) -> Iterator[dict]:
    """Runs of at most ``period`` slots until all blocks are placed. Each is scheduled by itself from what its phase
    has placed before: parts, slot in the phase, blocks placed in the phase and before it, slot overall, slots."""
    left = {s: n for s, n in blocks.items() if n}
    before, start = dict.fromkeys(left, 0), 0
    every = exact_parts({s: weights[s] for s in left}) if left else {}
    while left:
        parts = {s: every[s] for s in left}
        done, at = dict.fromkeys(left, 0), 0
        order = turns(parts)
        ended = False
        while not ended:
            run = {"parts": parts, "at": at, "first": dict(done), "before": before, "start": start + at}
            if len(left) == 1:
                (s, n), = left.items()
                size = min(period, n - at)
                done[s] += size
                ended = done[s] == n
            else:
                for size in range(1, period + 1):
                    s, _ = next(order)
                    done[s] += 1
                    # the phase ends with the slot in which the first source places its last block
                    if ended := done[s] == left[s]:
                        break
            at += size
            yield {**run, "size": size}
        start += at
        before = {s: before[s] + done[s] for s in left}
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a phase to the slot of each of their blocks."""
    for b in batches:
        for r in b.to_pylist():
            parts = dict(zip(r["sources"], r["parts"]))
            placed = list(islice(turns(parts, dict(zip(r["sources"], r["first"])), r["at"]), r["size"]))
            before = dict(zip(r["sources"], r["before"]))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in placed], pa.string()), pa.array([before[s] + j for s, j in placed], pa.int64()),
                                              pa.array(range(r["start"], r["start"] + r["size"]), pa.int64())], ["source", "j", "slot"])


def balanced(words: dict[str, int]) -> dict[str, float]:
    """Weights by the square root of the sources' words, which raises small sources."""
    return {s: max(1, n) ** 0.5 for s, n in words.items()}


def source_name(source):
    return F.coalesce(source.cast("string"), F.lit(""))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_words: int = BLOCK_WORDS, period: int = PERIOD, seed: int = 0,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", slot_col: str = "slot", block_col: str = "block",
        rank_col: str = "rank", by_words: bool = False) -> DataFrame:
    """``docs`` with three more columns, whose order (slot, rank) is the mixed order of all rows.

    ``block`` is the row's block of its source, ``slot`` the block's slot and ``rank`` the row's place in its source.
    Within a source, rows stand in the order of a hash of id and text; a block is ``block_words`` words,
    and a row belongs to the block in which it starts. With ``by_words`` a row that goes on through further blocks uses
    up their slots too, so the words drawn keep to the weights and slots in which no row starts are missing from
    ``slot``; without it only blocks in which a row starts are scheduled. A null source counts as the source "". Null and empty texts have
    no words and go with the row before them. Weights default to the square root of the words of each source; sources without a
    given weight are an error, and so are new columns that ``docs`` has already. Repeated rows stay next to each other. Rows without an id are kept.

    Places in a source come from two levels: rows are dealt into runs by the leading bits of their hash, each run is
    numbered by itself, and the runs' totals (one row for about 4096 documents) are summed up, so a
    source of any size is split.
    """
    spark = docs.sparkSession
    if clash := {slot_col, block_col, rank_col} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose other names")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    base = docs.withColumns({"__op_source": source_name(F.col(source_col)), "__op_key": key, "__op_words": F.size(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")})
    slim = stored(base.select("__op_source", "__op_key", "__op_words"), "places")
    total = {r["s"]: (r["words"], r["rows"]) for r in slim.groupBy(F.col("__op_source").alias("s")).agg(F.sum("__op_words").alias("words"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()}
    if len(total) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weights = balanced({s: w for s, (w, _) in total.items()}) if weights is None else weights
    missing = sorted(set(total) - set(weights))
    if missing:
        raise ValueError(f"no weight for sources {missing[:5]}")
    bits = max(0, (sum(r for _, r in total.values()) // RUN_ROWS).bit_length())
    run = F.shiftrightunsigned("__op_key", 64 - bits).cast("int") if bits else F.lit(0)
    # equal rows (one source and key) are one entry with their words
    entry = slim.groupBy("__op_source", "__op_key").agg(F.sum("__op_words").alias("words"), F.count(F.lit(1)).alias("rows")).withColumn("run", run)
    sums = entry.groupBy("__op_source", "run").agg(F.sum("words").alias("w"), F.sum("rows").alias("r"))
    before = Window.partitionBy("__op_source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    source_words = Window.partitionBy("__op_source")
    base_of = sums.select("__op_source", "run", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"), F.sum("w").over(source_words).alias("all_words"))
    inner = Window.partitionBy("__op_source", "run").orderBy("__op_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = entry.select("*", F.coalesce(F.sum("words").over(inner), F.lit(0)).alias("w1"), F.coalesce(F.sum("rows").over(inner), F.lit(0)).alias("r1")).join(base_of, ["__op_source", "run"])
    placed = placed.select("__op_source", "__op_key", F.expr(f"least((w0 + w1) div {block_words}, greatest(all_words - 1, 0) div {block_words})").alias(block_col), (F.col("r0") + F.col("r1")).alias(rank_col))
    if by_words:
        counts = {s: max(1, -(-w // block_words)) for s, (w, _) in total.items()}
    else:
        # number the blocks that a row starts in
        blocks = stored(placed.select("__op_source", block_col).distinct(), "blocks")
        counts = {r["s"]: r["n"] for r in blocks.groupBy(F.col("__op_source").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
        numbered = blocks.withColumn("__op_run", F.expr(f"{block_col} div {RUN_ROWS}"))
        per_run = numbered.groupBy("__op_source", "__op_run").agg(F.count(F.lit(1)).alias("n"))
        per_run = per_run.select("__op_source", "__op_run", F.coalesce(F.sum("n").over(Window.partitionBy("__op_source").orderBy("__op_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
        numbered = numbered.withColumn("n1", F.row_number().over(Window.partitionBy("__op_source", "__op_run").orderBy(block_col)) - 1).join(per_run, ["__op_source", "__op_run"])
        numbered = numbered.select("__op_source", block_col, (F.col("n0") + F.col("n1")).alias("__op_j"))
    rows = [([*p["parts"]], [*p["parts"].values()], p["at"], [*p["first"].values()], [p["before"][s] for s in p["parts"]], p["start"], p["size"]) for p in phases(weights, counts, period)]
    runs = spark.createDataFrame(rows, "sources array<string>, parts array<long>, at long, first array<long>, before array<long>, start long, size int")
    table = runs.repartition(partitions(spark)).mapInArrow(_slots, f"__op_source string, __op_j long, {slot_col} long")
    slotted = table.withColumnRenamed("__op_j", block_col) if by_words else numbered.join(table, ["__op_source", "__op_j"]).drop("__op_j")
    out = placed.join(slotted, ["__op_source", block_col])
    return base.drop("__op_words").join(out, ["__op_source", "__op_key"]).select(*docs.columns, slot_col, block_col, rank_col)


def mix_report(docs: DataFrame, by_words: bool = True, **kw) -> DataFrame:
    """``doc_id, source, block, slot, rank`` of every row."""
    return mix(docs.select("doc_id", "source", "text"), by_words=by_words, **kw).select("doc_id", "source", "block", "slot", "rank")


def mixed(docs: DataFrame, partitions: int, by_words: bool = True, **kw) -> DataFrame:
    """The rows of ``docs`` in mixed order: range partitions of the slots, each sorted."""
    out = mix(docs, slot_col="__op_slot", block_col="__op_block", rank_col="__op_rank", by_words=by_words, **kw)
    return out.repartitionByRange(partitions, "__op_slot", "__op_rank").sortWithinPartitions("__op_slot", "__op_rank").drop("__op_slot", "__op_block", "__op_rank")
