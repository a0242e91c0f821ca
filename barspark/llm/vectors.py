"""Near-duplicate vectors by cross-polytope hashing.

A vector is padded to a power of two and goes through three rounds of random signs and a fast Hadamard
transform, which stands for a random rotation; its hash is the coordinate of largest size with
its sign. A table joins the hashes of two rotations. Besides its own bucket, a vector probes
the buckets that swap one hash for the next best coordinate. Vectors that share a bucket are
compared exactly.

Equal vectors of one label are one point with a weight. Bucket names are shuffled with ids alone; buckets of one
point, and all but the smallest of those that hold the same points, are left out before vectors are fetched. A
pair that shares several buckets is judged in the smallest of them, so links are counted once without
a pair ever leaving its bucket: only counts and the edges of a spanning forest do. A bucket of more
than ``max_bucket`` points is cut into blocks, each pair of which is worked on by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barspark.llm import arrays as A
from barspark.llm.frames import components, discard, partitions, stored

TABLES, PROBES, MAX_BUCKET = 6, 4, 4096
ROWS = 2048
#: Pairs that are looked at together.
PAIRS = 1 << 19
#: A bucket's name holds its table (at most 32) above this many bits of hash.
TABLE_SHIFT = 58


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of signs and transform; ``x`` is padded with zeros to a power of two."""
    size = 1 << max(0, int(np.ceil(np.log2(max(1, x.shape[1])))))
    out = np.zeros((len(x), size))
    out[:, :x.shape[1]] = x
    rng = np.random.Generator(np.random.PCG64([seed, size]))
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], size))
    return out


def vertices(x: np.ndarray, seed: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` nearest vertices of the cross-polytope (coordinate and sign) and their coordinates' sizes."""
    r = rotate(x, seed)
    top = min(top, r.shape[1])
    order = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :top]
    value = np.take_along_axis(r, order, 1)
    return order * 2 + (value < 0), np.abs(value)


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Each row's buckets: for each table its own, then the ``probes`` that lose least by a next best coordinate."""
    out = []
    for t in range(tables):
        (a, va), (b, vb) = vertices(x, 2 * t, probes + 1), vertices(x, 2 * t + 1, probes + 1)
        k = a.shape[1]
        choice = [(0, 0), *[(i, 0) for i in range(1, k)], *[(0, i) for i in range(1, k)]]
        loss = np.stack([va[:, 0] - va[:, i] + vb[:, 0] - vb[:, j] for i, j in choice], 1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes + 1]
        name = np.stack([a[:, i] * 65536 + b[:, j] for i, j in choice], 1) * 64 + t
        out.append(np.take_along_axis(name, best, 1))
    return np.concatenate(out, 1)


def _hash(tables: int, probes: int, dtype: str):
    """Usable points (k, weight, label, values) to (k, weight, label, buckets, vector). Names ascend by table,
    each of which has as many; labels and lengths are part of a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(0, b.num_rows, ROWS):
                part = b.slice(r, ROWS)
                label = part.column(2).to_numpy(zero_copy_only=False)
                lists = part.column(3)
                size = np.diff(lists.offsets.to_numpy())
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n)
                    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                    own = buckets(unit(values), tables, probes)
                    name = A.mix((label[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] ^ A.mix(own.astype(np.uint64) + np.uint64(n << 48)))
                    table = np.repeat(np.arange(tables, dtype=np.uint64), own.shape[1] // tables) << np.uint64(TABLE_SHIFT)
                    name = np.sort((name >> np.uint64(64 - TABLE_SHIFT) | table).view(np.int64), 1)
                    m = name.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        *[c.take(pa.array(at)) for c in part.columns[:3]], pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * m), pa.array(name.reshape(-1))),
                        A.binaries(values.astype(dtype).reshape(-1), np.full(len(at), n))], ["k", "weight", "label", "buckets", "vector"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_meetings(own: np.ndarray, i: np.ndarray, j: np.ndarray, here: np.ndarray, tables: int) -> np.ndarray:
    """Which of the pairs (i, j), which share bucket ``here``, share no smaller one. Names of different tables differ,
    so tables are compared one by one, and a pair leaves at the first that holds it."""
    fresh, width = np.arange(len(i)), own.shape[1] // tables
    for t in range(tables):
        open_ = here[i[fresh]] >> TABLE_SHIFT >= t
        if not open_.any():
            break
        a, b = own[i[fresh], t * width:(t + 1) * width], own[j[fresh], t * width:(t + 1) * width]
        seen = ((a[:, :, None] == b[:, None, :]).any(2) & (a < here[i[fresh]][:, None])).any(1)
        fresh = fresh[~seen]
    return fresh


def join_forest(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Components after joining the pairs, and the pairs that joined two of them. In a round each component hooks
    under a smaller one."""
    edges = []
    while True:
        apart = comp[i] != comp[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return comp, edges
        low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        high, one = np.unique(high, return_index=True)
        edges.append(np.stack([i[one], j[one]], 1))
        parent = np.arange(len(comp))
        parent[high] = low[one]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]


def _compare(least: float, tables: int, dtype: str):
    """A region's points to (k, other, n): n links of k, other a linked point (or k itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, region in A.groups(batches, "region"):
            region = region.combine_chunks()
            sizes = pc.binary_length(region["vector"])
            for n in pc.unique(sizes).to_pylist():
                t = region.filter(pc.equal(sizes, n)).combine_chunks()
                if t.num_rows > 1:
                    yield compared(t)

    def compared(t: pa.Table) -> pa.RecordBatch:
        raw = {c: t.column(c).chunk(0) for c in t.column_names}
        k, here, side, weight, label = (raw[c].to_numpy() for c in ("k", "bucket", "side", "weight", "label"))
        x = unit(A.packed(raw["vector"], dtype).reshape(len(k), -1))
        own = raw["buckets"].flatten().to_numpy().reshape(len(k), -1)
        links, comp, edges = np.zeros(len(k), np.int64), np.arange(len(k)), [np.zeros((0, 2), np.int64)]
        step = max(1, PAIRS // len(k))
        for r in range(0, len(k), step):
            i, j = np.nonzero(x[r:r + step] @ x[r:].T >= least)
            i, j = i + r, j + r
            # each pair once; pairs within a block belong to the region of that block alone
            ok = (i < j) & ((side[i] != side[j]) | (side[i] == 2)) & (here[i] == here[j]) & (label[i] == label[j])
            i, j = i[ok], j[ok]
            fresh = first_meetings(own, i, j, here, tables)
            i, j = i[fresh], j[fresh]
            if len(i):
                links += (np.bincount(i, weight[j], len(k)) + np.bincount(j, weight[i], len(k))).astype(np.int64)
                comp, more = join_forest(comp, i, j)
                edges += more
        hit, e = np.flatnonzero(links), np.concatenate(edges)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[hit], k[e[:, 0]]])), pa.array(np.concatenate([k[hit], k[e[:, 1]]])),
                                           pa.array(np.concatenate([links[hit], np.zeros(len(e), np.int64)]))], ["k", "other", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, max_bucket: int = MAX_BUCKET,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of cosine at least ``least`` (double precision) between vectors of one label, and their components.

    Returns ``vec_id, n_links, component_id, kept`` for each row with an id. Vectors that are null, empty, zero or
    hold null or non-finite components, and those whose label is null, link with nothing; so do vectors of
    different lengths. Repeated rows are different vectors that link. Every pair returned was
    compared; pairs that never share a bucket are missed (the tests measure recall).
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.exists(v, lambda c: c != 0)
    dtype = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    # -0.0 equals 0.0
    clean = F.transform(v, lambda c: c + F.lit(0.0))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(F.col(label_col)).alias("label"), F.when(usable, clean).alias("v"))
    rows = rows.withColumn("k", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v", F.hash("v", "label"))))
    weights = stored(rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")), "points")
    one = rows.where("k is not null").join(weights.select(F.col("k").alias("wk"), "first", "weight"), (F.col("k") == F.col("wk")) & (F.col("vec_id") == F.col("first"))).select("k", "weight", "label", "v").dropDuplicates(["k"])
    points = stored(one.mapInArrow(_hash(tables, probes, dtype), "k long, weight long, label long, buckets array<long>, vector binary"), "hashed")
    member = points.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "k")
    # buckets of the same points say the same: the smallest stands for all, so a pair's first bucket is among them
    held = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("points"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")).where("points > 1")
    full = held.groupBy("points", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("points") / max_bucket).alias("blocks"))
    own = F.pmod(F.xxhash64("k", F.lit(7)), F.col("blocks"))
    # side 2: all pairs of the region; 0 and 1: pairs between the sides
    region = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(
        F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)).alias("region"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side")))
    placed = member.join(full, "bucket").select("bucket", "k", F.explode(region).alias("r")).select("r.region", "r.side", "bucket", "k").join(points, "k")
    found = stored(placed.repartition(partitions(spark), "region").sortWithinPartitions("region").mapInArrow(_compare(least, tables, dtype), "k long, other long, n long"), "links")
    linked = found.groupBy("k").agg(F.sum("n").alias("n"))
    discard(points)
    root = components(found.select(F.col("k").alias("a"), F.col("other").alias("b")))
    point = weights.join(linked, "k", "left").join(root.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least_id = point.groupBy("root").agg(F.min("first").alias("component"))
    point = point.join(least_id, "root").select("k", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "component")
    out = rows.select("vec_id", "k").join(point, "k", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
