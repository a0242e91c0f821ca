"""Merkle manifest of a dataset by slot pivots.

A leaf is the SHA-256 of a row's fields. Inside each key (a source), leaves are numbered in order, and every
``fanout`` consecutive ones become one row by conditional aggregates: column ``c<j>`` holds the hash of the child
in slot j. The concatenated columns hash to the parent; without the own slot's column they are a child's
siblings. Levels repeat until a key has one node, its subroot; the subroots, in the order of their keys, are the
leaves of the tree above, whose last node is the root.

A level's groups hold at most ``fanout`` rows whatever the key's size, and numbering deals rows out by range of (key,
order), so a key with a third of all rows costs no more than many small ones. Only hashes and ids are shuffled,
texts never. Proofs are built from the root down: a node's path is its own siblings before its parent's path, so
long paths cross a shuffle once for each ``fanout`` leaves. The driver sees the size of the largest key and the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from barspark.llm.frames import discard, partitions, stored

FANOUT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE = (1 << 33) - 1  # monotonically_increasing_id counts a partition's rows in these bits
#: A level of a proof: the siblings before and after the node.
_PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def ordered_key(c: Column) -> Column:
    """A key that is never null and keeps the order: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


class Tree(NamedTuple):
    """``levels``: the slot pivots from the leaves up, one row a parent: ``g, i`` (its key and place), ``n`` and ``m``
    (nodes of the key below and here), ``c0..`` (children's hashes), ``h``; the first also holds the leaves' payload ``d0..``.
    ``tops``: one row a key, ``g, h``."""

    levels: list[DataFrame]
    tops: DataFrame


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with key ``g``) and each row's place ``i`` in its key and the key's row count ``n``.

    Rows are dealt out by range of key and order and written once, so places and rows agree. A key's rows before a
    partition are summed over at most one row for each partition. Rows equal in key and order are interchangeable.
    """
    by = [F.col("g"), *[F.col(c) for c in order]]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(_PLACE)), "dealt")
    of_key = Window.partitionBy("g")
    runs = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    runs = runs.select("g", "part", (F.sum("here").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here") - F.col("first")).alias("shift"),
                       F.sum("here").over(of_key).alias("n"))
    return dealt.join(runs, ["g", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _columns(name: str, fanout: int, form: str = "{c}") -> str:
    return ", ".join(form.format(c=f"{name}{j}", j=j) for j in range(fanout))


def pivot(nodes: DataFrame, fanout: int, payload: Sequence[str] = ()) -> DataFrame:
    """One row for each ``fanout`` consecutive nodes (``g, i, n, h``) of a key: their hashes by slot and their parent's hash.
    A key's only node has no parent: it stays as it is."""
    spread = [F.expr(f"max(CASE WHEN i % {fanout} = {j} THEN h END) AS c{j}") for j in range(fanout)]
    if payload:
        spread += [F.expr(f"max(CASE WHEN i % {fanout} = {j} THEN struct({', '.join(payload)}) END) AS d{j}") for j in range(fanout)]
    wide = nodes.groupBy("g", F.expr(f"i div {fanout} AS p"), "n").agg(*spread).withColumnRenamed("p", "i")
    return wide.withColumns({"h": F.expr(f"CASE WHEN n > 1 THEN sha2(CAST(concat_ws('', {_columns('c', fanout)}) AS BINARY), 256) ELSE c0 END"),
                             "m": F.expr(f"(n + {fanout - 1}) div {fanout}")})


def grow(nodes: DataFrame, fanout: int = FANOUT, payload: Sequence[str] = ()) -> Tree:
    """All levels over numbered leaves; ``payload`` columns of the leaves are kept in their slots."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = None
    while True:
        levels.append(stored(pivot(nodes, fanout, () if levels else payload), "level"))
        done = levels[-1].where("m = 1").select("g", "h")
        tops = done if tops is None else tops.unionByName(done)
        most = -(-most // fanout)
        if most <= 1:
            return Tree(levels, tops)
        nodes = levels[-1].where("m > 1").select("g", "i", F.col("m").alias("n"), "h")


def paths(tree: Tree, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row a leaf: ``g``, its payload and hash ``h``, ``subroot``, and ``path``, the siblings at each level from the leaf up.
    ``above`` has for each key what lies over its last node: ``g, path, subroot``."""
    lower = None
    for k in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[k]
        over = level.where("m = 1").join(above, "g")
        if lower is not None:
            over = over.unionByName(level.where("m > 1").join(lower, ["g", "i"]))
        kids = over.withColumn("kids", F.expr(f"array({_columns('c' if k else 'd', fanout)})")).select("*", F.posexplode("kids").alias("slot", "kid")).where("kid is not null")
        # the own slot's column is left out
        left = f"concat_ws('', {_columns('c', fanout, 'CASE WHEN slot > {j} THEN {c} END')})"
        right = f"concat_ws('', {_columns('c', fanout, 'CASE WHEN slot < {j} THEN {c} END')})"
        kids = kids.selectExpr("g", f"i * {fanout} + slot AS i", "subroot", "kid", f"element_at(array({_columns('c', fanout)}), slot + 1) AS h",
                               f"CASE WHEN n > 1 THEN concat(array(struct({left} AS left, {right} AS right)), path) ELSE path END AS path")
        lower = kids.drop("kid", "h")
    return kids.select("g", "h", "subroot", "path", "kid.*")


def folded(h: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to over its path."""
    return F.aggregate(path, h, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def proofs(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT, payload: Sequence[str] = ()) -> DataFrame:
    """``payload`` columns, ``h``, ``subroot``, ``root`` and ``path`` for each leaf (key ``g``, hash ``h``); empty without leaves.

    The tree's levels are written tables, from which the returned frame reads.
    """
    flat = numbered(leaves, order)
    tree = grow(flat, fanout, payload)
    keys = numbered(tree.tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), ["of"])
    upper = grow(keys, fanout, ["of"])
    top = upper.tops.first()
    start = upper.levels[-1].where("m = 1").select("g", F.array().cast(_PATH).alias("path"), F.col("h").alias("subroot"))
    above = stored(paths(upper, start, fanout).select(F.col("of").alias("g"), "path", F.col("h").alias("subroot")), "above")
    discard(*upper.levels)
    return paths(tree, above, fanout).withColumn("root", F.lit(top.h if top else None).cast("string"))


def document_proofs(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = FANOUT) -> DataFrame:
    """Proof and audit of each row of ``docs``: ``doc_id, leaf, subroot, root, path, tampered, folded_root, verified``.

    The audit tampers with rows whose id's CRC-32 is a multiple of 5 by lower-casing A-Z of the text, and folds every
    row's (tampered) leaf over its original siblings; ``verified`` tells whether that gives the root.

    Every row is a leaf, also one whose id or source is null (such rows come first) or whose text is null (it stays
    so). Rows that repeat an id are ordered by their hash; equal rows are leaves of their own, interchangeable.
    Texts may be of any length: only their hashes travel. An empty table gives no rows. Other columns are not read.
    """
    column = lambda c: F.col(f"`{c}`")
    leaf = leaf_hash([column(c) for c in fields])
    changed = [F.translate(column(c), _UPPER, _LOWER) if c == text_col else column(c) for c in fields]
    audit = F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select(ordered_key(column(source_col)).alias("g"), column(id_col).alias("doc_id"), leaf.alias("h"),
                         F.when(audit, leaf_hash(changed)).alias("tampered"))
    leaves = stored(leaves, "leaves")
    out = proofs(leaves, ["doc_id", "h"], fanout, ["doc_id", "tampered"])
    found = folded(F.coalesce("tampered", "h"), F.col("path"))
    out = out.withColumn("folded_root", found)
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", "tampered", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row, as ``document_proofs`` finds them."""
    return document_proofs(docs).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
