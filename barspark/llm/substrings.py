"""Substring deduplication by recompression.

Recompression shortens a token sequence in rounds. A round first names maximal runs of one symbol
and then, with the alphabet split into a left and a right half by a bit of the symbol's name, names
every pair of a left symbol and the right symbol after it. A name is a 64-bit hash of what it
stands for, so all tasks give equal things equal names and no round needs a dictionary. Each
symbol carries the range of words that its existence depends on. If that range lies in a
window, the symbol stands at the same place in every occurrence of that window.

A window's *anchor* is the eligible symbol of the highest round and smallest name. Equal windows
have equal anchors, so Spark sends each window to the bucket of its anchor's name: neighbouring
windows share an anchor and travel as one record (document, first position, 64-bit window hashes).
A bucket finds the smallest doc_id of every window and returns the positions whose window starts
in an earlier document. Windows that repeat within one batch of documents are settled before the
shuffle, so a passage of very many documents is sent once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barspark.llm import arrays as A
from barspark.llm.frames import partitions, route_values

U64 = np.uint64
NONE = U64(0xFFFFFFFFFFFFFFFF)
#: Words whose windows are settled and sent together.
CHUNK_WORDS = 1 << 19


class Symbols(NamedTuple):
    """A parse: names, document of each symbol, first word, and the words it depends on."""

    name: np.ndarray
    doc: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _around(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Dependence of each symbol's neighbours; beyond a document's edge nothing is known, so
    a symbol that depends on the edge depends on a word outside the document."""
    n = len(s.name)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[0], after[-1] = s.left[0] - 1, s.right[-1] + 1
    inner = s.doc[1:] == s.doc[:-1]
    before[1:] = np.where(inner, s.left[:-1], s.left[1:] - 1)
    after[:-1] = np.where(inner, s.right[1:], s.right[:-1] + 1)
    return before, after


def name_runs(s: Symbols) -> Symbols:
    """Maximal runs of one symbol become one symbol; all others stay, knowing that they are no run."""
    n = len(s.name)
    if not n:
        return s
    before, after = _around(s)
    joined = np.zeros(n, bool)
    joined[1:] = (s.name[1:] == s.name[:-1]) & (s.doc[1:] == s.doc[:-1])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    name = s.name[first]
    many = size > 1
    name = np.where(many, A.mix(name * U64(0xA24BAED4963EE407) + size.astype(U64)), name)
    return Symbols(name, s.doc[first], np.minimum(before[first], s.left[first]), np.maximum(after[last], s.right[last]))


def name_pairs(s: Symbols, salt: int) -> Symbols:
    """Every pair of a left symbol and the right symbol after it becomes one symbol."""
    n = len(s.name)
    if n < 2:
        return s
    before, after = _around(s)
    is_left = (A.mix(s.name + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U64(1)).astype(bool)
    opens = np.zeros(n, bool)
    opens[:-1] = is_left[:-1] & ~is_left[1:] & (s.doc[1:] == s.doc[:-1])
    closes = np.zeros(n, bool)
    closes[1:] = opens[:-1]
    kept = np.flatnonzero(~closes)
    pair = opens[kept]
    second = np.minimum(kept + 1, n - 1)
    name = np.where(pair, A.mix(s.name[kept] * U64(0x9FB21C651E98DF25) + s.name[second]), s.name[kept])
    # a single left symbol was seen not to open a pair by its right neighbour, a right one by its left
    left = np.where(pair | is_left[kept], s.left[kept], before[kept])
    right = np.where(pair, s.right[second], np.where(is_left[kept], after[kept], s.right[kept]))
    return Symbols(name, s.doc[kept], left, right)


def parse(names: np.ndarray, offsets: np.ndarray, rounds: int) -> list[Symbols]:
    """The symbols of every round, words first."""
    at = np.arange(len(names), dtype=np.int64)
    levels = [Symbols(names, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), at, at)]
    for k in range(rounds):
        levels.append(name_pairs(name_runs(levels[-1]), k + 1))
    return levels


def _by_place(s: Symbols, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the symbol whose dependence begins there and ends first: its name and end."""
    name, right = np.full(n, NONE, dtype=U64), np.full(n, 1 << 60, dtype=np.int64)
    ok = np.flatnonzero((s.left >= 0) & (s.left < n))[::-1]  # written backwards: the first stays
    name[s.left[ok]] = s.name[ok]
    right[s.left[ok]] = s.right[ok]
    return name, right


def anchors(names: np.ndarray, offsets: np.ndarray, starts: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """The name of the anchor of the window at each of ``starts``."""
    best = np.full(len(starts), NONE, dtype=U64)
    for s in reversed(parse(names, offsets, rounds)):
        todo = np.flatnonzero(best == NONE)
        if not len(todo):
            break
        name, right = _by_place(s, len(names))
        at = starts[todo]
        found = np.full(len(at), NONE, dtype=U64)
        for t in range(size):
            np.minimum(found, np.where(right[at + t] < at + size, name[at + t], NONE), out=found)
        best[todo] = found
    return best


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, text hashes, word names and word offsets of about CHUNK_WORDS words of documents."""
    ids, hashes, names, counts, total = [], [], [], [], 0
    for b in batches:
        id_, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for i, j, t in A.slices(A.text_of(b.column(2))):
            w = A.words(t)
            ids.append(id_[i:j]); hashes.append(th[i:j]); names.append(w.names); counts.append(np.diff(w.offsets))  # noqa: E702
            total += len(w.names)
            if total >= CHUNK_WORDS:
                yield _joined(ids, hashes, names, counts)
                ids, hashes, names, counts, total = [], [], [], [], 0
    if ids:
        yield _joined(ids, hashes, names, counts)


def _joined(ids, hashes, names, counts):
    c = np.concatenate(counts)
    return np.concatenate(ids), np.concatenate(hashes), np.concatenate(names), np.concatenate([[0], np.cumsum(c)])


def _later(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an equal key has a smaller id."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.empty(len(k), bool)
    late[order] = d > least
    return late


def _spans(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length (at most 255) of each stretch of consecutive positions of one document."""
    cut = np.ones(len(pos), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.arange(len(pos))
    cut |= (at - np.maximum.accumulate(np.where(cut, at, 0))) % 255 == 0
    first = np.flatnonzero(cut)
    return first, np.diff(np.append(first, len(pos)))


#: A record: spans of windows of some documents, in byte planes; kind 0 with their hashes, to be judged.
_SENT = "bucket int, kind int, ids binary, th binary, counts binary, pos binary, size binary, keys binary"
_NAMES = ["bucket", "kind", "ids", "th", "counts", "pos", "size", "keys"]


def _record(bucket: int, kind: int, ids, th, doc, pos, keys) -> list:
    """doc: index into ids and th of each window, ascending; pos: its start."""
    first, size = _spans(doc, pos)
    d, n = np.unique(doc[first], return_counts=True)
    return [bucket, kind, A.planes(ids[d].astype(np.int64)), A.planes(th[d].astype(np.uint32)), A.planes(n.astype(np.uint32)), A.planes(pos[first].astype(np.uint32)), size.astype(np.uint8).tobytes(), keys.tobytes()]


def _send(size: int, rounds: int, routes: np.ndarray):
    """Documents to records: for each chunk one for each bucket, and one of marks that need no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, th, names, offsets in _chunks(batches):
            starts, per_doc = A.window_starts(offsets, size)
            if not len(starts):
                continue
            doc = np.repeat(np.arange(len(ids)), per_doc)
            key = A.rolling(names, size)[starts]
            pos = starts - offsets[doc]
            late = _later(key, ids[doc])
            rows = []
            if late.any():
                rows.append(_record(int(routes[int(key[0]) % len(routes)]), 1, ids, th, doc[late], pos[late], np.zeros(0, U64)))
            keep = np.flatnonzero(~late)
            bucket = (anchors(names, offsets, starts, size, rounds)[keep] % U64(len(routes))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(len(routes) + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = keep[order[cuts[k]:cuts[k + 1]]]
                rows.append(_record(int(routes[k]), 0, ids, th, doc[at], pos[at], key[at]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(len(_NAMES))], _NAMES)

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A record's id, text hash and start of each window."""
    counts = A.unplanes(row["counts"], np.uint32).astype(np.int64)
    size = np.frombuffer(row["size"], np.uint8).astype(np.int64)
    span = np.repeat(np.arange(len(counts)), counts)
    row_of = np.repeat(span, size)
    return A.unplanes(row["ids"], np.int64)[row_of], A.unplanes(row["th"], np.uint32)[row_of], A.ranges(A.unplanes(row["pos"], np.uint32).astype(np.int64), size)


_MARKS = "doc_id long, th long, spans binary"


def _mark_rows(ids: np.ndarray, th: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """A row for each document: its marked starts as packed (first, length) pairs."""
    order = np.lexsort((pos, th, ids))
    ids, th, pos = ids[order], th[order].astype(np.int64), pos[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]))
    head, doc = np.flatnonzero(new), np.cumsum(new) - 1
    first, size = _spans(doc, pos)
    n = np.diff(np.append(np.searchsorted(first, head), len(first)))
    pairs = np.stack([pos[first], size], 1).astype(np.uint32).reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(th[head]), A.binaries(pairs, n * 2)], ["doc_id", "th", "spans"])


def _settle(routes: np.ndarray):
    """The records of a bucket to records of marks, one for each place that documents are gathered at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in A.groups(batches, "bucket"):
            marks, held, keys = [], [], []
            for row in table.to_pylist():
                if row["kind"]:
                    marks.append(_opened(row))
                else:
                    held.append(_opened(row))
                    keys.append(np.frombuffer(row["keys"], U64))
            if held:
                found = tuple(np.concatenate(x) for x in zip(*held))
                late = _later(np.concatenate(keys), found[0])
                marks.append(tuple(x[late] for x in found))
            ids, th, pos = (np.concatenate(x) for x in zip(*marks))
            place = (A.mix(ids.view(U64)) % U64(len(routes))).astype(np.int64)
            order = np.lexsort((pos, th, ids, place))
            ids, th, pos, place = ids[order], th[order], pos[order], place[order]
            doc = np.cumsum(np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]))[:len(ids)]) - 1
            head = np.searchsorted(doc, np.arange(doc[-1] + 1)) if len(doc) else doc
            cuts = np.searchsorted(place, np.arange(len(routes) + 1))
            rows = [_record(int(routes[k]), 1, ids[head], th[head], doc[a:b], pos[a:b], np.zeros(0, U64))
                    for k in np.flatnonzero(np.diff(cuts)).tolist() for a, b in [cuts[k:k + 2]]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(len(_NAMES))], _NAMES)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All marks of a place's documents, a row for each document."""
    for _, table in A.groups(batches, "bucket"):
        ids, th, pos = (np.concatenate(x) for x in zip(*map(_opened, table.to_pylist())))
        yield _mark_rows(ids, th, pos)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), th.alias("th"), F.col(text_col).alias("text"))


def default_rounds(size: int) -> int:
    """Rounds after which a symbol and what it depends on still lie well inside a window."""
    return max(1, int(np.log2(max(size, 1) / 13)) + 1) if size >= 13 else 0


def repeated_windows(docs: DataFrame, size: int = 13, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where windows of ``size`` words start that also start in a document with a smaller id.

    Returns ``doc_id, th, spans``, a row for each document that has any: ``th`` is 32 bits of the text's
    hash, ``spans`` packed (first window start, number of consecutive starts) pairs of unsigned 32-bit integers. Rows
    without an id are left out; null and empty texts have no windows; rows that share an id never
    mark each other.
    """
    spark = docs.sparkSession
    routes = route_values(spark, partitions(spark))
    rounds = default_rounds(size) if rounds is None else rounds
    sent = _source(docs, id_col, text_col).mapInArrow(_send(size, rounds, routes), _SENT)
    settled = sent.repartition(len(routes), "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(routes), _SENT)
    return settled.repartition(len(routes), "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, _MARKS)


def _covered(spans: bytes, n: int, size: int) -> np.ndarray:
    """Which of n words a marked window covers."""
    step = np.zeros(n + 1, np.int64)
    pairs = np.frombuffer(spans, np.uint32).reshape(-1, 2).astype(np.int64)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, np.minimum(pairs[:, 0] + pairs[:, 1] - 1 + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2).to_pylist()
            for i, j, t in A.slices(A.text_of(b.column(1))):
                w = A.words(t)
                raw = t.data.tobytes()
                out = {"n_words": [], "n_removed": [], "kept": []}
                for d in range(j - i):
                    a, z = int(w.offsets[d]), int(w.offsets[d + 1])
                    s, e = w.starts[a:z], w.ends[a:z]
                    gone = 0
                    if spans[i + d]:
                        cov = _covered(spans[i + d], z - a, size)
                        gone = int(cov.sum())
                        s, e = s[~cov], e[~cov]
                    out["n_words"].append(z - a)
                    out["n_removed"].append(gone)
                    out["kept"].append(b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist())]).decode())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, size: int = 13, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``size`` words that also starts in a document with
    a smaller id; windows are judged on the input.

    Returns ``doc_id, n_words, n_removed, kept`` (kept words joined by one space), a row for each row
    with an id. Null and empty texts have no words and keep an empty text. Of repeated rows with
    one id and text, each gives a row.
    """
    marks = repeated_windows(docs, size, rounds, id_col, text_col)
    joined = _source(docs, id_col, text_col).join(marks, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept string")
