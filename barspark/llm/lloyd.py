"""Vector codes by Lloyd's rounds over cover trees.

Vectors become integers and are cut into equal parts, each with a codebook of its own. A task packs the vectors
of its partition into blocks and builds a cover tree over each part of a block: a node's points lie within its
radius, its children's centres are further apart than half of the next power of two below it, and its points
stand side by side, so that the difference of two cumulative sums is the sum of a whole subtree. The trees are written
once and serve every round.

In a round a node keeps the entries that could be nearest to any of its points: those no further from its centre than
the nearest one plus twice its radius. If one is left, the whole subtree is assigned at once; else
its children go on with the entries left, and the points of a leaf are compared exactly (integer distances, ties to
the lower entry). Tasks return sums and counts a part and entry; Spark adds them, and the driver
holds only the codebooks (entries times vector length). Equal vectors are one node of radius 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barspark.llm import arrays as A
from barspark.llm.frames import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block at most (their distances within a part are held at once), and points in a leaf.
BLOCK, LEAF = 2048, 8
#: Largest size of an integer component: squared distances and their sums over a vector stay within 64 bits.
LARGEST = 1 << 24
#: Salts of the join that returns a label's total to its rows.
SALTS = 16

#: ``child``: the first of ``children`` nodes, which follow each other; points ``start`` to ``end`` of the tree's order.
NODE = np.dtype([("centre", "<i4"), ("start", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between integer rows, exact: in doubles while every step fits 53 bits, else in integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, x.shape[1]) < 1 << 53 else np.int64
    x, y = x.astype(kind), y.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (the root first) and the order of points in which each node's are side by side."""
    far = np.sqrt(squared(points, points).astype(np.float64))
    nodes, order, filled = [], np.zeros(len(points), np.int32), 0
    # (node, centre, points): children are numbered when their parent is cut; points are placed at the leaves, depth first
    todo = [(0, 0, np.arange(len(points)))]
    nodes.append([0, 0, 0, 0, 0, 0.0])
    while todo:
        me, centre, own = todo.pop()
        away = far[centre, own]
        radius = float(away.max())
        nodes[me][:3] = [centre, filled, filled + len(own)]
        nodes[me][5] = radius * (1 + 1e-9)
        if len(own) <= leaf or radius == 0:
            order[filled:filled + len(own)] = own
            filled += len(own)
            continue
        reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
        near = away <= reach
        kids, own = [(centre, own[near])], own[~near]
        while len(own):
            near = far[own[0], own] <= reach
            kids.append((own[0], own[near]))
            own = own[~near]
        first = len(nodes)
        nodes[me][3:5] = [first, len(kids)]
        nodes += [[0, 0, 0, 0, 0, 0.0] for _ in kids]
        todo += [(first + k, c, pts) for k, (c, pts) in reversed(list(enumerate(kids)))]
    return np.array([tuple(n) for n in nodes], NODE), order


def assign(points: np.ndarray, nodes: np.ndarray, order: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole subtrees (nodes and their entry) and the entry of each single point, -1 where its subtree has it.
    Points are in tree order."""
    single = np.full(len(order), -1, np.int64)
    subtree, entry = [], []
    at, open_ = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    while len(at):
        far = np.where(open_, np.sqrt(squared(points[nodes["centre"][at]], book).astype(np.float64)), np.inf)
        limit = far.min(1) + 2 * nodes["radius"][at]
        open_ = far <= (limit * (1 + 1e-9))[:, None]
        sure = open_.sum(1) == 1
        subtree.append(at[sure])
        entry.append(open_[sure].argmax(1))
        at, open_ = at[~sure], open_[~sure]
        ends = nodes["children"][at] == 0
        if ends.any():
            leaf = nodes[at[ends]]
            size = (leaf["end"] - leaf["start"]).astype(np.int64)
            place = A.ranges(leaf["start"].astype(np.int64), size)
            exact = squared(points[order[place]], book)
            top = np.iinfo(np.int64).max if exact.dtype == np.int64 else np.inf
            single[place] = np.where(np.repeat(open_[ends], size, 0), exact, top).argmin(1)
        at, open_ = at[~ends], open_[~ends]
        n = nodes["children"][at].astype(np.int64)
        at, open_ = A.ranges(nodes["child"][at].astype(np.int64), n), np.repeat(open_, n, 0)
    return np.concatenate(subtree), np.concatenate(entry), single


def entries(points: np.ndarray, nodes: np.ndarray, order: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entry of each point, in the points' own order."""
    subtree, entry, single = assign(points, nodes, order, book)
    n = (nodes["end"][subtree] - nodes["start"][subtree]).astype(np.int64)
    single[A.ranges(nodes["start"][subtree].astype(np.int64), n)] = np.repeat(entry, n)
    out = np.empty(len(order), np.int64)
    out[order] = single
    return out


def sums(points: np.ndarray, nodes: np.ndarray, order: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points of each entry: of whole subtrees from cumulative sums, then of single points."""
    subtree, entry, single = assign(points, nodes, order, book)
    total, count = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    upto = np.zeros((len(order) + 1, points.shape[1]), np.int64)
    np.cumsum(points[order], axis=0, out=upto[1:])
    start, end = nodes["start"][subtree], nodes["end"][subtree]
    np.add.at(total, entry, upto[end] - upto[start])
    np.add.at(count, entry, end - start)
    alone = np.flatnonzero(single >= 0)
    np.add.at(total, single[alone], points[order[alone]])
    np.add.at(count, single[alone], 1)
    return total, count


def _integers(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * component), shorter ones with zeros at their end."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"vector components times {scale} must not exceed {LARGEST} in size")
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), size), A.ranges(np.zeros(len(lists), np.int64), size)] = flat.astype(np.int64)
    return out


def _plant(width: int, parts: int, scale: int, block: int):
    """Rows (id, label, vector) to blocks: their ids, labels, integers, and for each part a tree and its order."""

    def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for r in range(0, rows.num_rows, block):
            piece = rows.slice(r, block).combine_chunks()
            x = _integers(piece.column(2), width, scale)
            trees = [cover_tree(p) for p in np.split(x, parts, axis=1)]
            one = [pa.array([piece.column(k).to_pylist()], pa.list_(piece.schema.field(k).type)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*one, pa.array([x.astype("<i4").tobytes()]),
                                              pa.array([[n.tobytes() for n, _ in trees]], pa.list_(pa.binary())),
                                              pa.array([[o.astype("<i4").tobytes() for _, o in trees]], pa.list_(pa.binary()))],
                                             ["id", "label", "x", "nodes", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= block:
                t = pa.Table.from_batches(held)
                full = t.num_rows // block * block
                yield from blocks(t.slice(0, full))
                held = t.slice(full).to_batches()
        if held:
            yield from blocks(pa.Table.from_batches(held))

    return run


def _trees(b: pa.RecordBatch, row: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points, nodes and order of each part of a block."""
    n = len(b.column(0)[row])
    x = np.frombuffer(b.column(2)[row].as_py(), "<i4").reshape(n, -1).astype(np.int64)
    for p, nodes, order in zip(np.split(x, parts, axis=1), b.column(3)[row].as_py(), b.column(4)[row].as_py()):
        yield p, np.frombuffer(nodes, NODE), np.frombuffer(order, "<i4").astype(np.int64)


def _add_up(books: np.ndarray):
    """Blocks to one row a part and entry of the whole partition: (part, entry, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for row in range(b.num_rows):
                for part, (p, nodes, order) in enumerate(_trees(b, row, len(books))):
                    s, n = sums(p, nodes, order, books[part])
                    total[part] += s
                    count[part] += n
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
                                              pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def _encode(books: np.ndarray):
    """Blocks to (id, label, code, error) a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                code, error = [], 0
                for part, (p, nodes, order) in enumerate(_trees(b, row, len(books))):
                    at = entries(p, nodes, order, books[part])
                    code.append(at)
                    error = error + ((p - books[part][at]) ** 2).sum(1)
                code = np.stack(code, 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1).flatten(), b.column(1).slice(row, 1).flatten(),
                                                  pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def usable(v: Column) -> Column:
    """Vectors without null or non-finite components."""
    return v.isNotNull() & F.coalesce(F.forall(v.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all integers of the codebooks, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of each usable vector, and the codebooks (part, entry, component).

    Components become floor(scale * x); the codebook of each part starts as that part of the ``size`` vectors of
    smallest id (ties by vector, null ids last; fewer vectors: fewer entries) and goes through ``rounds`` rounds. Entries that no part
    takes stay. ``code`` is two hex digits a part, so ``size`` is at most 256.

    Vectors that are null or hold null or non-finite components are left out. Repeated rows count each. Shorter vectors
    (and all, if their length is no multiple of ``parts``) count as ending in zeros, empty ones as zeros.
    Integer components beyond 2**24 are an error. An empty table gives no rows and empty codebooks. Other columns are not read.
    """
    if not 1 <= size <= 256:
        raise ValueError("size must be 1 to 256")
    v = F.col(f"`{vector_col}`")
    rows = vectors.where(usable(v)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.cast("array<double>").alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    label = rows.schema["label"].dataType.simpleString()
    key = rows.schema["id"].dataType.simpleString()
    trees = stored(rows.mapInArrow(_plant(width, parts, scale, block), f"id array<{key}>, label array<{label}>, x binary, nodes array<binary>, orders array<binary>"), "trees")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(size).select("v").toArrow()
    books = np.stack(np.split(_integers(first.column("v"), width, scale), parts, axis=1)) if first.num_rows else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first.num_rows else 0):
        books = _moved(trees, books)
    codes = trees.mapInArrow(_encode(books), f"id {key}, label {label}, code string, error long")
    return codes.select(F.col("id").alias("vec_id"), "label", "code", "error"), books


def _moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of the mean of its parts."""
    width = books.shape[2]
    found = trees.mapInArrow(_add_up(books), "part int, entry int, n long, total array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(width)])
    books = books.copy()
    for r in found.collect():  # at most one row an entry
        if width:
            books[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return books


def codes_report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; label_error is the error of all vectors of a label, null ones together.

    Totals return to their rows by a join on label and one of ``SALTS`` salts, so a label with a third of all rows is no hot key.
    """
    codes, books = vector_codes(vectors)
    codes = stored(codes, "codes").withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    total = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    total = total.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = codes.join(total, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
