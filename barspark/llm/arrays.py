"""Numpy over the UTF-8 buffers of Arrow string columns: words, hashes, packed columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. Words are named by 64-bit
hashes, which are the same in every task, so tasks need no shared dictionary.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once (a longer document is taken whole).
SLICE_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1


def _space_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _punctuation_table() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[128:] = False
    t[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return t


SPACE = _space_table()
#: All ASCII bytes but letters and digits.
PUNCTUATION = _punctuation_table()
LOWER = _lower_table()
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. The process keeps them in a module of their own: tasks get this
    package's functions by value, and a table among their globals would travel with them."""
    kept = sys.modules.setdefault("_barspark_powers", types.ModuleType("_barspark_powers")).__dict__
    have = kept.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 64), base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        kept[str(base)] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


class Text(NamedTuple):
    """Documents of one slice: UTF-8 bytes and the byte range of each document."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of one slice: byte ranges, 64-bit names, and the word range of each document."""

    starts: np.ndarray
    ends: np.ndarray
    names: np.ndarray
    offsets: np.ndarray


def text_of(column: pa.Array | pa.ChunkedArray) -> Text:
    """The bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return Text(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Text(raw, off - off[0])


def slices(text: Text, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """Runs of documents of about ``limit`` bytes: first row, last row + 1, their text."""
    n, i = len(text.offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(text.offsets, text.offsets[i] + limit, "right")) - 1)
        a, b = text.offsets[i], text.offsets[j]
        yield i, j, Text(text.data[a:b], text.offsets[i:j + 1] - a)
        i = j


def words(text: Text, lower: bool = False, breaks: np.ndarray = SPACE) -> Words:
    """Every word of every document, with its name. ``breaks``: the bytes that no word holds."""
    data, off = text
    if lower:
        data = LOWER[data]
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a document's end also ends a word
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    names = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return Words(starts, ends, mix(names), np.searchsorted(starts, off).astype(np.int64))


def rolling(names: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` names that start at each position (only whole windows)."""
    n = len(names) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    acc = np.full(n, size, dtype=U64)
    for j in range(size):
        acc *= U64(0xD6E8FEB86659FD93)
        acc += names[j:j + n]
    return mix(acc)


def window_starts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of ``size`` words lies inside one document; windows per document."""
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    return ranges(offsets[:-1], n), n


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] numbers), starts[1], ... as one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow binary column whose values are consecutive runs of ``counts`` items of ``data``."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts * data.itemsize, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def packed(column: pa.Array, dtype) -> np.ndarray:
    """The values of a packed binary column, joined end to end."""
    _, offs, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=dtype)
    off = np.frombuffer(offs, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]].view(dtype)


def planes(x: np.ndarray) -> bytes:
    """Byte planes: first bytes of all items, second bytes, ...; equal high bytes compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(k, -1).T).reshape(-1).view(dtype)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of equal non-null integer ``key``, across batches, one table a group."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and k[i] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = k[i]
            held.append(b.slice(i, j - i))
    if held:
        yield at, pa.Table.from_batches(held)
