"""Small Spark helpers shared by the operators: partition counts, scratch tables, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from barspark.session import scratch_path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def route_values(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n shuffle partitions, an integer that ``repartition(n, col)`` sends there, so that
    packed records can be dealt out evenly. One small job; n rows come back."""
    found: dict[int, int] = {}
    span = 16 * n
    while len(found) < n:
        rows = (spark.range(span).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p"))
                .agg(F.min("v").alias("v")).collect())
        found = {r["p"]: r["v"] for r in rows}
        span *= 4
    return np.array([found[i] for i in range(n)], dtype=np.int64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back, so that its lineage
    ends there and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has integer columns ``a`` and ``b``. Returns ``node, root`` (root: the smallest
    reachable node) for each node of an edge between two different nodes. Each round is two
    aggregations and two joins on the node and ends in a written table. A hub's edges are
    pre-aggregated before the shuffle, and the join's other side has one row a node, so Spark may
    split a hub. Rounds grow with the logarithm of the longest path. If ``max_rounds`` do not
    reach the fixed point, that is an error.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .where("a <> b").distinct())
        large = stored(large, "large")
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        after = stored(small, "small")
        discard(large, e)
        # at the fixed point every node has one smaller neighbour, and no node is both a root and a leaf
        leaves = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        open_leaf = leaves.where("n > 1").limit(1).count()
        open_root = after.select(F.col("b").alias("a")).join(leaves, "a", "left_semi").limit(1).count() if not open_leaf else 1
        e = after
        if not open_leaf and not open_root:
            break
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
