"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits and of other characters beyond ASCII, lower-cased;
punctuation never counts. A document and an item that share a seed (a Karp-Rabin hash of
``min_tile`` tokens in a row) are compared: the longest match of unmarked tokens is marked in both, again and
again, until none of ``min_tile`` tokens is left. Coverage is the marked share of the
item's tokens. As tiles may lie in any order and place, reordered and scattered passages
count like whole ones. An item of fewer than ``min_tile`` tokens is covered where all of it stands in a row.

The benchmark goes to the tasks in blocks of at most ``block_chars`` characters; each block is one more
pass over the documents' rows in the same stage. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from barspark.llm import arrays as A

U64 = np.uint64
#: Characters of the benchmark that go to the tasks together.
BLOCK_CHARS = 8_000_000


class Seeds(NamedTuple):
    """A block of the benchmark: items, their tokens, and where each seed stands."""

    items: np.ndarray
    names: np.ndarray
    offsets: np.ndarray
    seed: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    sieve: np.ndarray


SIEVE_BITS = 20


def lowered(column: pa.Array) -> A.Text:
    return A.text_of(pc.utf8_lower(column))


def tokens(text: A.Text) -> A.Words:
    return A.words(text, breaks=A.PUNCTUATION)


def index_items(items: list[int], texts: list[str | None], min_tile: int, whole: bool = False) -> Seeds:
    """Seeds of all items of at least ``min_tile`` tokens; with ``whole``, of those of just so many."""
    w = tokens(lowered(pa.array(texts, pa.large_string())))
    starts, per_item = A.window_starts(w.offsets, min_tile)
    if whole:
        starts = starts[np.repeat(per_item == 1, per_item)]
        per_item = np.where(per_item == 1, 1, 0)
    h = A.rolling(w.names, min_tile)[starts] if len(starts) else np.zeros(0, U64)
    item = np.repeat(np.arange(len(items)), per_item)
    order = np.argsort(h, kind="stable")
    seed, first = np.unique(h[order], return_index=True)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[(seed >> U64(64 - SIEVE_BITS)).astype(np.int64)] = True
    return Seeds(np.array(items, np.int64), w.names, w.offsets, seed, np.append(first, len(h)), item[order], (starts - w.offsets[item])[order], sieve)


def tile(i: np.ndarray, j: np.ndarray, min_tile: int, n_item: int, n_doc: int) -> int:
    """Tokens of the item that greedy tiling marks.

    (i, j): places at which a seed of the item stands in the document. Seeds in a row on a diagonal
    are one match. The longest match goes first (ties: the earlier in the item, then in the
    document); what it overlaps is cut to the parts that stay unmarked.
    """
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    cut = np.append(True, (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1))
    head = np.flatnonzero(cut)
    size = np.diff(np.append(head, len(i))) + min_tile - 1
    a, b = i[head], j[head]
    own, other = np.zeros(n_item, bool), np.zeros(n_doc, bool)
    while len(size):
        k = np.lexsort((b, a, -size))[0]
        x, y, n = int(a[k]), int(b[k]), int(size[k])
        own[x:x + n] = True
        other[y:y + n] = True
        # only matches that overlap the new tile change
        hit = ((a < x + n) & (a + size > x)) | ((b < y + n) & (b + size > y))
        keep = [(a[~hit], b[~hit], size[~hit])]
        for p, q, m in zip(a[hit].tolist(), b[hit].tolist(), size[hit].tolist()):
            free = ~(own[p:p + m] | other[q:q + m])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            s, e = edge[::2], edge[1::2]
            s, e = s[e - s >= min_tile], e[e - s >= min_tile]
            keep.append((p + s, q + s, e - s))
        a, b, size = (np.concatenate(c) for c in zip(*keep))
    return int(own.sum())


def covered(w: A.Words, seeds: Seeds, min_tile: int, least: float) -> Iterator[tuple[int, int, float]]:
    """(document, item, coverage) of every pair that reaches ``least``."""
    starts, per_doc = A.window_starts(w.offsets, min_tile)
    if not len(starts) or not len(seeds.seed):
        return
    h = A.rolling(w.names, min_tile)[starts]
    maybe = np.flatnonzero(seeds.sieve[(h >> U64(64 - SIEVE_BITS)).astype(np.int64)])
    at = np.minimum(np.searchsorted(seeds.seed, h[maybe]), len(seeds.seed) - 1)
    real = seeds.seed[at] == h[maybe]
    maybe, at = maybe[real], at[real]
    if not len(maybe):
        return
    doc = np.repeat(np.arange(len(per_doc)), per_doc)[maybe]
    pos = starts[maybe] - w.offsets[doc]
    count = np.diff(seeds.first)[at]
    where = A.ranges(seeds.first[at], count)
    doc, pos, item, i = np.repeat(doc, count), np.repeat(pos, count), seeds.item[where], seeds.pos[where]
    order = np.lexsort((pos, item, doc))
    doc, pos, item, i = doc[order], pos[order], item[order], i[order]
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(doc)]):
        d, t = int(doc[a]), int(item[a])
        n_item = int(seeds.offsets[t + 1] - seeds.offsets[t])
        # distinct places that seeds can mark bound the coverage from above
        if len(np.unique(i[a:b])) + min_tile * (1 + np.count_nonzero(np.diff(np.unique(i[a:b])) > 1)) < least * n_item:
            continue
        n = tile(i[a:b], pos[a:b], min_tile, n_item, int(w.offsets[d + 1] - w.offsets[d]))
        if n >= least * n_item:
            yield d, t, n / n_item


def index_all(items: list[int], texts: list[str | None], min_tile: int, least: float) -> list[tuple[Seeds, int, float]]:
    """Indexes with their seed's size and least coverage: one for items that have a seed, one for each shorter length."""
    found = [(index_items(items, texts, min_tile), min_tile, least), *[(index_items(items, texts, n, True), n, 1.0) for n in range(1, min_tile)]]
    return [x for x in found if len(x[0].seed)]


def _add(indexes: list[tuple[Seeds, int, float]], at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, best = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for i, _, t in A.slices(lowered(b.column(at))):
                w = tokens(t)
                for seeds, size, least in indexes:
                    for d, k, c in covered(w, seeds, size, least):
                        items[i + d].append(int(seeds.items[k]))
                        best[i + d] = max(best[i + d], c)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(best, pa.float64())], names)

    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, least: float = 0.5, block_chars: int = BLOCK_CHARS,
               items_col: str = "items", coverage_col: str = "coverage", text_col: str = "text") -> DataFrame:
    """``docs`` with the sorted ids of the benchmark items that a row covers to at least ``least``, and the
    greatest coverage (0 without any).

    Null and empty texts cover nothing. Items without an id, a text or a token are not looked for. An
    item of fewer than ``min_tile`` tokens counts only whole, with its tokens in a row. Repeated items are
    each reported. Items go round in blocks; the driver holds one block at a time.
    """
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = known.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = int(chars // block_chars) + 1
    out = docs.withColumns({items_col: F.array().cast("array<bigint>"), coverage_col: F.lit(0.0)})
    schema = StructType([*docs.schema.fields, StructField(items_col, ArrayType(LongType())), StructField(coverage_col, DoubleType())])
    at = docs.columns.index(text_col)
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else known
        rows = part.orderBy("item_id", "text").collect()
        indexes = index_all([r["item_id"] for r in rows], [r["text"] for r in rows], min_tile, least)
        out = out.mapInArrow(_add(indexes, at, out.columns), schema)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``doc_id, contaminated, items, coverage`` of every row."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, **kw)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "coverage")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that cover no benchmark item."""
    found = with_leaks(docs, benchmark, items_col="__op_items", coverage_col="__op_coverage", **kw)
    return found.where(F.size("__op_items") == 0).drop("__op_items", "__op_coverage")
