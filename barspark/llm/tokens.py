"""Token ids in binary shards: frequency-ranked ids, byte-aligned variable-length codes with
separate control bytes, decoded by numpy table lookup.

Shard format. A shard set is a folder of Parquet files (so Spark's committer makes each file
appear whole or not at all, on any store), plus a ``vocabulary`` folder of (token, rank) rows.
A row of a shard is a block of consecutive documents:

    shard int, block int       place of the block; blocks are in order of the documents
    n_codes, before long       its codes, and the codes before it in its shard
    ids binary                 document ids, little-endian int64, one per document
    sizes binary               ids per document, little-endian uint32
    control binary             two bits per code: its number of bytes less one, first code in the lowest bits
    data binary                codes: little-endian ranks in 1-4 bytes, leading zero bytes left out

A rank is a token id's place by falling corpus frequency (ties: smaller id first), so common ids
take one byte. The decoder reads four codes at a time: a control byte selects the codes' lengths
from a table of 256 rows, and offsets are the running sums of those lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barspark.llm import arrays as A
from barspark.llm.frames import discard, partitions, stored
from barspark.session import scratch_path

#: Codes of a block (a longer document is a block of its own).
BLOCK_CODES = 1 << 19
#: Pieces in the memo that a worker keeps, at most.
MEMO = 2_000_000

#: Length of each of the four codes of a control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode_codes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2**32."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    raw = r.view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    two = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    two[:len(r)] = size - 1
    two = two.reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _shown() -> dict[int, int]:
    """Byte-level tokenizers write every byte as a visible character: bytes that Latin-1 shows as themselves,
    the others, in order, as the characters from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


SHOWN = _shown()
SPACE_SHOWN = chr(SHOWN[32])
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Pieces:
    """Encodes texts piece by piece with a memo.

    The byte-level tokenizer cuts a text at white space and between letters and marks before it applies
    merges. So a text falls apart, with equal ids for equal pieces,

    * at single spaces between two other characters; the space belongs to the piece after it,
    * at single line ends between two other characters, which stand alone,
    * between a letter and the ASCII marks that end a piece.

    The words of a slice of documents are named at once (``arrays.words``), each distinct one that the memo lacks is tokenized
    once, and ids are gathered by numpy. Texts with other, doubled, leading or closing white space or with an added token go
    whole to the tokenizer. The memo is three arrays, at most ``MEMO`` pieces (some 60 MB), and starts anew when full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        #: Bytes of an id.
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        #: Strings that the tokenizer takes out of a text before anything else.
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.line_end = self.ids("\n")
        self.tails: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        """An empty memo: names in order, where each piece's ids start in ``flat``, and how many they are (-1: none by itself)."""
        self.names, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def word(self, letters: str) -> list[int]:
        """Ids of letters, perhaps after a space, which the tokenizer never cuts before merging: its merges alone."""
        shown = letters.replace(" ", SPACE_SHOWN) if letters.isascii() else letters.encode().decode("latin-1").translate(SHOWN)
        return [t.id for t in self.tok.model.tokenize(shown)]

    def piece(self, body: str, lead: str) -> list[int] | None:
        """Ids of a word after ``lead`` (a space or nothing); None if white space beyond ASCII touches its ends."""
        if body.isalpha():
            return self.word(lead + body)
        if body[0].isspace() or body[-1].isspace():
            return None
        stem = body.rstrip(MARKS)
        if stem != body and stem and stem[-1].isalpha():
            marks = body[len(stem):]
            tail = self.tails.get(marks)
            if tail is None:
                tail = self.ids(marks)
                if len(self.tails) < 10_000:
                    self.tails[marks] = tail
            return (self.word(lead + stem) if stem.isalpha() else self.ids(lead + stem)) + tail
        return self.ids(lead + body)

    def learn(self, names: np.ndarray, bodies: list[bytes], after_space: list[bool]) -> None:
        """Add pieces that the memo lacks; ``names`` ascend."""
        found = [self.piece(b.decode(), " " if s else "") for b, s in zip(bodies, after_space)]
        counts = np.array([-1 if f is None else len(f) for f in found], np.int32)
        flat = np.array([i for f in found if f for i in f], self.kind)
        starts = len(self.flat) + np.cumsum(np.maximum(counts, 0), dtype=np.int64) - np.maximum(counts, 0)
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.names, names)
        self.names, self.starts, self.counts = np.insert(self.names, at, names), np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def where(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of names in the memo, and which it has."""
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        return at, (self.names[at] == names) if len(self.names) else np.zeros(len(names), bool)

    def whole(self, text: A.Text) -> np.ndarray:
        """Documents that cannot be cut into pieces."""
        data, off = text
        n = len(off) - 1
        size = np.diff(off)
        space = A.SPACE[data]
        bad = space & (data != 0x20) & (data != 0x0A)
        bad[1:] |= space[1:] & space[:-1]
        some = size > 0
        bad[off[:-1][some]] = space[off[:-1][some]]  # a document's first byte does not follow the one before it
        bad[off[1:][some] - 1] |= space[off[1:][some] - 1]
        out = np.diff(np.concatenate([[0], np.cumsum(bad)])[off]) > 0
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out[min(n - 1, np.searchsorted(off, at, "right") - 1)] = True
                at = raw.find(token, at + 1)
        return out

    def encode(self, text: A.Text, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, each followed by ``end_id``, end to end; and their numbers by document."""
        data, off = text
        n = len(off) - 1
        w = A.words(text)
        before = np.where(w.starts > 0, data[np.maximum(w.starts, 1) - 1], 0) if len(w.starts) else np.zeros(0, np.uint8)
        first = np.zeros(len(w.starts), bool)
        first[w.offsets[:-1][np.diff(w.offsets) > 0]] = True
        spaced = (before == 0x20) & ~first
        broken = (before == 0x0A) & ~first
        doc = np.repeat(np.arange(n), np.diff(w.offsets))
        whole = self.whole(text)
        use = ~whole[doc]
        # a word's name, its length and whether a space leads make a piece's name
        names = A.mix(w.names + (w.ends - w.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + spaced)
        kinds, pick, back = np.unique(names[use], return_index=True, return_inverse=True)
        pick = np.flatnonzero(use)[pick]
        _, have = self.where(kinds)
        if not have.all() and len(self.names) + int((~have).sum()) > MEMO:
            self.forget()
            have = np.zeros(len(kinds), bool)
        new = np.flatnonzero(~have)
        raw = data.tobytes()
        if len(new):
            self.learn(kinds[new], [raw[a:b] for a, b in zip(w.starts[pick[new]].tolist(), w.ends[pick[new]].tolist())], spaced[pick[new]].tolist())
        at, _ = self.where(kinds)
        start, count = (self.starts[at], self.counts[at].astype(np.int64)) if len(kinds) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if (count < 0).any():
            whole[doc[use][count[back] < 0]] = True
            back, use = back[~whole[doc[use]]], ~whole[doc]
        # after the memo's ids: the line end, the end of a document, and documents taken whole
        extra = [self.line_end, [end_id]] + [self.ids(raw[off[d]:off[d + 1]].decode()) for d in np.flatnonzero(whole).tolist()]
        extra_n = np.array([len(x) for x in extra], np.int64)
        flat = np.concatenate([self.flat, np.array([i for x in extra for i in x], self.kind)])
        extra_at = len(self.flat) + np.cumsum(extra_n) - extra_n
        k = len(start)
        start, count = np.concatenate([start, extra_at]), np.concatenate([count, extra_n])
        # every document's pieces in order: (document, place, piece), line ends before their word, ends last
        d = doc[use]
        place = np.flatnonzero(use) * 2 + 1
        lines = broken[use]
        lone = np.flatnonzero(whole)
        top = 2 * len(doc) + 2
        docs = np.concatenate([d, d[lines], lone, np.arange(n)])
        rank = np.concatenate([place, place[lines] - 1, np.zeros(len(lone), np.int64), np.full(n, top)])
        piece = np.concatenate([back, np.full(int(lines.sum()), k), k + 2 + np.arange(len(lone)), np.full(n, k + 1)])
        order = np.argsort(docs * (top + 1) + rank, kind="stable")
        piece, docs = piece[order], docs[order]
        return flat[A.ranges(start[piece], count[piece])], np.bincount(docs, count[piece], n).astype(np.int64)


def worker_pieces(path: str) -> Pieces:
    """The tokenizer and memo that this Python worker keeps from task to task."""
    import sys
    import types
    kept = sys.modules.setdefault("_barspark_kept", types.ModuleType("_barspark_kept"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.pieces = path, Pieces(path)
    return kept.pieces


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = worker_pieces(path)
        width = np.dtype(pieces.kind).itemsize
        for b in batches:
            for i, j, text in A.slices(A.text_of(b.column(2))):
                ids, n = pieces.encode(text, end_id)
                # the last byte of a value tells the width of an id
                size = n * width + 1
                out = np.full(int(size.sum()), ord(pieces.kind[-1]), np.uint8)
                inner = np.ones(len(out), bool)
                inner[np.cumsum(size) - 1] = False
                out[inner] = ids.view(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), A.binaries(out, size)], ["place", "doc_id", "ids"])

    return run


def _ids_of(raw: bytes) -> np.ndarray:
    wide = raw[-1:] == b"4"
    return np.frombuffer(raw, "<u4" if wide else "<u2", count=len(raw) // (4 if wide else 2)).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for v in b.column(0):
            c = np.bincount(_ids_of(v.as_py()))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[:len(c)] += c
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])


def _blocks(rank: np.ndarray):
    """Rows of one shard in order, to blocks."""

    def close(shard, block, ids, codes, before):
        ranks = np.concatenate(codes)
        control, data = encode_codes(ranks)
        sizes = np.array([len(c) for c in codes], "<u4")
        row = [shard, block, np.array(ids, "<i8").tobytes(), sizes.tobytes(), control, data, len(ranks), before]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES)], _BLOCK_COLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, block, ids, codes, total, before = TaskContext.get().partitionId(), 0, [], [], 0, 0
        for b in batches:
            for d, raw in zip(b.column(1).to_pylist(), b.column(2)):
                r = rank[_ids_of(raw.as_py())]
                if ids and total + len(r) > BLOCK_CODES:
                    yield close(shard, block, ids, codes, before)
                    block, before, ids, codes, total = block + 1, before + total, [], [], 0
                ids.append(d)
                codes.append(r)
                total += len(r)
        if ids:
            yield close(shard, block, ids, codes, before)

    return run


_BLOCK_COLS = ["shard", "block", "ids", "sizes", "control", "data", "n_codes", "before"]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_BLOCK = "shard int, block int, ids binary, sizes binary, control binary, data binary, n_codes long, before long"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, order: list | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every whole text, append ``end_id`` and write a shard set at ``path``.

    Documents are in ascending order of ``order`` (default: the id). ``tokenizer`` is the file of a
    byte-level BPE for the tokenizers library; it must be readable on the executors. A null or
    empty text is one end id. Rows without an id are left out; repeated rows are written as often
    as they come. An empty table gives a shard set without blocks.

    The texts are tokenized once; ids are kept in a written table, from which frequencies
    are counted over all documents. The rank table (at most one entry for each vocabulary id, a few
    hundred kB) goes to every task. Order comes from a range partitioning, which splits
    any number of rows with different keys.
    """
    spark = docs.sparkSession
    order = order or [F.col(id_col).cast("long")]
    src = docs.where(F.col(id_col).isNotNull()).select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("place"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["place"].dataType.simpleString()
    ids = stored(src.mapInArrow(_tokenize(tokenizer, end_id), f"place {kind}, doc_id long, ids binary"), "token-ids")
    counted = ids.select("ids").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sorted(((r["n"], r["token"]) for r in counted.collect()), key=lambda r: (-r[0], r[1]))
    rank = np.zeros(max([t for _, t in rows], default=0) + 1, np.uint32)
    rank[[t for _, t in rows]] = np.arange(len(rows))
    n = partitions(spark)
    placed = ids.repartitionByRange(n, "place", "doc_id").sortWithinPartitions("place", "doc_id")
    placed.mapInArrow(_blocks(rank), _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    discard(ids)
    spark.createDataFrame([(int(t), i) for i, (_, t) in enumerate(rows)], "token long, rank long").coalesce(1).write.parquet(f"{path}/vocabulary")


def _read(token: np.ndarray, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                ids = token[decode_codes(r["control"], r["data"], int(sizes.sum()))].astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(ids).cast("B")
                first = base[r["shard"]] + r["before"]
                out = [raw[4 * (e - s):4 * e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], "<i8")), pa.array(first + ends - sizes), pa.array(sizes), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document of a shard set: ``start`` counts the ids of
    all documents before it, ``ids`` holds little-endian unsigned 32-bit token ids.

    Each block holds the codes before it in its shard; one row for each shard comes to the
    driver to give the shards their starts.
    """
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    token = np.array([r["token"] for r in spark.read.schema("token long, rank long").parquet(f"{path}/vocabulary").orderBy("rank").collect()] or [0], np.uint32)
    base, total = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_codes").alias("n")).collect(), key=lambda r: r["shard"]):
        base[r["shard"]] = total
        total += r["n"]
    return blocks.mapInArrow(_read(token, base), "doc_id long, start long, n_tokens long, ids binary")


def stored_order(docs: DataFrame) -> list:
    """Columns that order the rows of a frame read from files as they stand in them (part number, file, row)."""
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-([0-9]+)", 1).cast("long"), name, F.col("_metadata.row_index")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def new_shards(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write a shard set under the shared checkpoint folder and read it back."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer, **kw)
    return read_shards(docs.sparkSession, path)
