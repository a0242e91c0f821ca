"""N-gram Jaccard join in the metric space of shingle sets.

d(A, B) = 1 - |A n B| / |A u B| is a metric. Documents link when d <= r (r = 0.15 for 85 %). Equal
sets are one point. Points are split into regions by pivots, in levels:

1. *Shingle pivots.* Almost all documents are at distance 1 from each other, so no document can serve as
   a pivot for them; single shingles can. The distance to {s} is 1 - 1/|A| if s is in A, else 1,
   so a document's nearest pivots are its own shingles. Ties go by one order of all shingles
   (shingles of very many documents last, then by hash). Linked documents differ in few shingles, so
   the first p = |A| - ceil(t|A|) + 1 of each hold one that they share, and the first 2p - 1 of each hold at
   least the p of the smaller linked size. A document is copied to the regions of its first 2p - 1
   shingles and no more, and leaves the join if too few of these have another point. Sizes in a
   region that jump by more than 1/t cut it, since sizes are distances to the empty set.
2. *Document pivots.* Each shingle region elects its smallest point as pivot; regions of one pivot
   merge. A region whose points all meet in another region is dropped.
3. *Recursion.* A region is joined in one task: pivots are picked farthest first, points go to the
   nearest pivot, and a point within 2r of that boundary is copied to the other side. Regions that
   still shrink are split again. The rest is compared point by point, where |d(x,p) - d(y,p)| > r
   rules pairs out and pairs of one known component are left out. A region of more than
   ``max_region`` points is first cut into blocks, and each pair of blocks is a region, so memory
   stays bounded and no pair is lost.

Only edges of a spanning forest leave a region; ``frames.components`` joins them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barspark.llm import arrays as A
from barspark.llm.frames import components, discard, partitions, route_values, stored

U64 = np.uint64
CHUNK_WORDS = 1 << 19
#: A shingle is ranked last from this share of all documents on. At most mean set size / share
#: shingles reach it, which bounds the table of them that goes to every task.
COMMON_SHARE = 0.005
#: Fewest documents of a chunk in which a shingle is reported as possibly common.
COMMON_IN_CHUNK = 3
PIVOTS = 8
LEAF = 24


def shingle_sets(w: A.Words, n: int) -> list[np.ndarray]:
    """Each document's distinct n-word shingles as sorted hashes; fewer words are one shingle."""
    rolled = A.rolling(w.names, n)
    out = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(rolled[a:b - n + 1]))
        elif b > a:
            out.append(A.rolling(w.names[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer."""
    total = np.append(s + U64(0x632BE59BD9B4E019), U64(len(s)))
    return int(A.mix(A.mix(total).sum(dtype=U64, keepdims=True)).view(np.int64)[0])


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list]]:
    """Document ids and shingle sets of about CHUNK_WORDS words."""
    ids, sets, total = [], [], 0
    for b in batches:
        id_ = b.column(0).to_pylist()
        for i, j, t in A.slices(A.text_of(b.column(1))):
            w = A.words(t, lower=True)
            ids += id_[i:j]
            sets += shingle_sets(w, n)
            total += len(w.names)
            if total >= CHUNK_WORDS:
                yield ids, sets
                ids, sets, total = [], [], 0
    if ids:
        yield ids, sets


def _name_sets(n: int):
    """(doc_id, n, k) of each document; (s, df) of shingles that recur within a chunk."""

    def run(batches):
        for ids, sets in _chunks(batches, n):
            size = [len(s) for s in sets]
            key = [set_key(s) if len(s) else None for s in sets]
            different = {k: s for k, s in zip(key, sets) if k is not None}
            s, df = np.unique(np.concatenate([*different.values(), np.zeros(0, U64)]), return_counts=True)
            often = df >= COMMON_IN_CHUNK
            s, df = s[often].view(np.int64), df[often]
            a, b = len(ids), len(s)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids + [None] * b, pa.int64()), pa.array(size + [None] * b, pa.int64()), pa.array(key + [None] * b, pa.int64()),
                pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(s)]), pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(df.astype(np.int64))])], ["doc_id", "n", "k", "s", "df"])

    return run


def reach(n, percent: int):
    """Shingles that a set of n may hold beyond those of any linked set, and one more."""
    return n - (percent * n + 99) // 100 + 1


def _prefix(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first 2 reach - 1 shingles of a sorted set in the order of all shingles."""
    m = 2 * reach(len(s), percent) - 1
    if len(common):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~late], s[late]]) if late.any() else s
    return s[:m]


def _postings(n: int, percent: int, common: np.ndarray, routes: np.ndarray):
    """One record for each chunk and bucket: shingles, set names and set sizes of prefixes."""

    def run(batches):
        for _, sets in _chunks(batches, n):
            different = {set_key(s): s for s in sets if len(s)}
            if not different:
                continue
            first = [_prefix(s, common, percent) for s in different.values()]
            count = np.array([len(x) for x in first])
            s = np.concatenate(first)
            k = np.repeat(np.array(list(different), np.int64), count)
            size = np.repeat(np.array([len(x) for x in different.values()], np.uint32), count)
            bucket = (s % U64(len(routes))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(len(routes) + 1))
            rows = [[int(routes[i]), s[at].tobytes(), k[at].tobytes(), A.planes(size[at])]
                    for i in np.flatnonzero(np.diff(cuts)).tolist() for at in [order[cuts[i]:cuts[i + 1]]]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(4)], ["bucket", "s", "k", "size"])

    return run


def _regions(s: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Where regions begin in rows sorted by shingle and size: at a new shingle or a jump of the size."""
    return np.append(True, (s[1:] != s[:-1]) | (100 * n[:-1] < percent * n[1:]))


def _shared(percent: int):
    """A bucket's postings to those (s, k, n) whose shingle region has two points or more."""

    def run(batches):
        for _, t in A.groups(batches, "bucket"):
            rows = t.to_pylist()
            s = np.concatenate([np.frombuffer(r["s"], U64) for r in rows])
            k = np.concatenate([np.frombuffer(r["k"], np.int64) for r in rows])
            n = np.concatenate([A.unplanes(r["size"], np.uint32) for r in rows]).astype(np.int64)
            order = np.lexsort((k, n, s))
            s, k, n = s[order], k[order], n[order]
            keep = np.append(True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]))
            s, k, n = s[keep], k[keep], n[keep]
            head = np.flatnonzero(_regions(s, n, percent))
            count = np.diff(np.append(head, len(s)))
            many = np.repeat(count, count) > 1
            yield pa.RecordBatch.from_arrays([pa.array(s[many].view(np.int64)), pa.array(k[many]), pa.array(n[many])], ["s", "k", "n"])

    return run


def _elect(percent: int):
    """Postings sorted by shingle and size to (k, c): point k meets others in the region of pivot c."""

    def pairs(s, k, n):
        head = np.flatnonzero(_regions(s, n, percent))
        count = np.diff(np.append(head, len(s)))
        least = np.repeat(np.minimum.reduceat(k, head), count)
        many = np.repeat(count, count) > 1
        found = np.unique(np.stack([k[many], least[many]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["k", "c"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            # the last shingle may go on in the next batch
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield pairs(*[h[:whole] for h in held])
                held = [h[whole:] for h in held]
        if len(held[0]):
            yield pairs(*held)

    return run


class Region:
    """The points of one region: an exact join that returns a spanning forest of their links."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.percent, self.radius = percent, 1 - percent / 100 + 1e-9
        values, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = self.codes.reshape(-1).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.mark = np.zeros(len(values), np.uint8)
        self.parent = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p
        return p

    def shared(self, i: int, among: np.ndarray) -> np.ndarray:
        """Shingles that point i shares with each of ``among``."""
        own = self.codes[self.first[i]:self.first[i] + self.size[i]]
        self.mark[own] = 1
        n = self.size[among]
        hit = self.mark[self.codes[A.ranges(self.first[among], n)]]
        self.mark[own] = 0
        return np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)

    def compare(self, i: int, among: np.ndarray) -> np.ndarray:
        """Distances from point i; links are kept."""
        both = self.shared(i, among)
        either = self.size[i] + self.size[among] - both
        for j in among[100 * both >= self.percent * either].tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[b] = a
                self.edges.append((i, j))
        return 1 - both / either

    def split(self, points: np.ndarray) -> None:
        """Join ``points``: Voronoi regions of pivots with windows of 2r, again and again."""
        if len(points) < 2 or len(np.unique(self.roots()[points])) == 1:
            return
        if len(points) <= LEAF:
            return self.brute(points, np.zeros((0, len(points))))
        far, at, rows = np.full(len(points), np.inf), 0, []
        for _ in range(PIVOTS):
            rows.append(self.compare(int(points[at]), points))
            far = np.minimum(far, rows[-1])
            at = int(np.argmax(far))
        d = np.stack(rows)
        inside = d - d.min(0) <= 2 * self.radius
        if inside.sum() > 0.5 * PIVOTS * len(points):
            return self.brute(points, d)
        for k in range(PIVOTS):
            part = points[inside[k]]
            if len(part) >= len(points):
                self.brute(part, d[:, inside[k]])
            else:
                self.split(part)

    def brute(self, points: np.ndarray, d: np.ndarray) -> None:
        """Compare every pair of different components that the distances ``d`` to pivots leave possible."""
        comp = self.roots()[points]
        _, comp, n = np.unique(comp, return_inverse=True, return_counts=True)
        # all but the points of one largest component, of which there may be several
        rest = np.flatnonzero(comp != n.argmax())
        for x in rest[np.argsort(n[comp[rest]], kind="stable")].tolist():
            roots = self.roots()[points]
            ok = roots != roots[x]
            ok &= (100 * np.minimum(self.size[points], self.size[points[x]]) >= self.percent * np.maximum(self.size[points], self.size[points[x]]))
            if len(d):
                ok &= (np.abs(d - d[:, x:x + 1]) <= self.radius).all(0)
            if ok.any():
                self.compare(int(points[x]), points[ok])


def _join(percent: int):
    def run(batches):
        for _, t in A.groups(batches, "region"):
            k, at = np.unique(t.column("k").to_numpy(), return_index=True)
            if len(k) < 2:
                continue
            raw = t.column("points").combine_chunks()
            sets = [np.frombuffer(raw[i].as_buffer(), U64) for i in at.tolist()]
            r = Region(sets, percent)
            r.split(np.arange(len(k)))
            if r.edges:
                e = np.array(r.edges)
                yield pa.RecordBatch.from_arrays([pa.array(k[e[:, 0]]), pa.array(k[e[:, 1]])], ["a", "b"])

    return run


def _route(n: int):
    """(text, name of its set, regions) to the set in each region."""

    def run(batches):
        for b in batches:
            k, regions = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j, t in A.slices(A.text_of(b.column(0))):
                rows = [(r, k[i + m], s.tobytes()) for m, s in enumerate(shingle_sets(A.words(t, lower=True), n))
                        if len(s) and set_key(s) == k[i + m] for r in regions[i + m]]
                for c in range(0, len(rows), 1000):
                    part = list(zip(*rows[c:c + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())], ["region", "k", "points"])

    return run


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, max_region: int = 4096,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of distinct ``n``-word shingles (A-Z lower-cased) have 100 * shared >=
    ``percent`` * union, and find the components of the links.

    Returns ``doc_id, n_shingles, n_same, component_id`` for each row with an id: the size of its set,
    the number of rows with that very set, and the smallest id reachable by links. Fewer than
    ``n`` words are one shingle. A null, empty or blank text has the empty set (n_shingles and
    n_same 0), links with nothing and is its own component. Repeated rows link with each other.
    """
    spark = docs.sparkSession
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = stored(src.mapInArrow(_name_sets(n), "doc_id long, n long, k long, s long, df long"), "sets")
    members = named.where("doc_id is not null").select("doc_id", "n", "k")
    least = max(1, members.count()) * COMMON_SHARE
    common = named.where("s is not null").groupBy("s").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("s")
    common = np.sort(np.array([r["s"] for r in common.collect()], np.int64).view(U64))

    routes = route_values(spark, partitions(spark))
    posted = src.select("doc_id", "text").mapInArrow(_postings(n, percent, common, routes), "bucket int, s binary, k binary, size binary")
    shared = stored(posted.repartition(len(routes), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(percent), "s long, k long, n long"), "shared")
    smaller = F.expr(f"({percent} * n + 99) div 100")
    alive = shared.groupBy("k", "n").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= smaller - F.floor((smaller * percent + 99) / 100) + 1).select("k")
    met = (shared.join(alive, "k", "left_semi").select("s", "k", "n").repartition(len(routes), "s").sortWithinPartitions("s", "n", "k")
           .mapInArrow(_elect(percent), "k long, c long").distinct())
    met = stored(met, "regions")
    discard(shared)

    # a region all of whose points have their first region in common is part of that region
    home = met.groupBy("k").agg(F.min("c").alias("home"))
    kept = (met.join(home, "k").groupBy("c").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.count(F.lit(1)).alias("points"))
            .where("points > 1 and not (lo = hi and lo <> c)").select("c", F.ceil(F.col("points") / max_region).alias("blocks")))
    own = F.pmod(F.xxhash64("k", F.lit(1)), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("c", F.least(own, j), F.greatest(own, j)))
    regions = (met.join(kept, "c").select("k", F.explode(F.when(F.col("blocks") == 1, F.array("c")).otherwise(pair)).alias("region"))
               .groupBy("k").agg(F.collect_set("region").alias("regions")))
    first = members.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    routed = src.join(first.join(regions, "k"), "doc_id").select("text", "k", "regions")
    points = routed.mapInArrow(_route(n), "region long, k long, points binary")
    edges = points.repartition(partitions(spark), "region").sortWithinPartitions("region").mapInArrow(_join(percent), "a long, b long")

    joined = components(edges)
    discard(met)
    found = members.join(joined.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least_id = found.where("k is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    same = members.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("same"))
    return (found.join(least_id, "root", "left").join(same, "k", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("same", F.lit(0)).alias("n_same"), F.coalesce("component", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a smaller id in their component. Rows that share
    an id are one document, and rows without an id stay."""
    lost = ngram_jaccard(docs, n, percent, id_col=id_col, text_col=text_col).where("component_id < doc_id").select(F.col("doc_id").alias("__op_id")).distinct()
    return docs.join(lost, docs[id_col] == F.col("__op_id"), "left_anti")
