"""Text files by header: each file's first line decides its separator and the names of its columns.

Files of one layout (separator and names) are read together in one scan with their own all-text
schema, then columns are taken by name. A folder of equal files is one scan; one with k
layouts is k scans over disjoint files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.session import written
from barspark.sources import lines
from barspark.sources.listing import BOM, inspected, known_store, with_headers


class Layout(NamedTuple):
    """Files that share separator and header; ``paths`` is what to read them by: a table with ``path, length`` if they are very many."""

    sep: str
    names: list[str]
    paths: list[str] | DataFrame


def reader(spark: SparkSession, recursive: bool = False, glob: str | None = None):
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r


def plain_path(file_path: Column) -> Column:
    """``_metadata.file_path`` is percent-encoded; readers take plain paths."""
    return F.url_decode(F.regexp_replace(file_path, r"\+", "%2B"))


def first_lines(spark: SparkSession, paths: Sequence[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """``path, header``: the first line of each file that is not blank, whatever its length; files without one have no row.

    Tasks read the start of each file only (``listing.with_headers``), in any store that pyarrow opens.
    """
    paths = list(paths)
    one_a_store = {p.split("://", 1)[0] if "://" in p else "": p for p in paths}
    if not all(known_store(p) for p in one_a_store.values()):
        return text_first_lines(spark, paths, recursive, glob)
    # the listing alone: without its content column this source opens no file
    r = reader(spark, recursive, glob).format("binaryFile")
    return with_headers(r.load(paths).select("path"), F.lit(True)).where(F.col("header").isNotNull())


def text_first_lines(spark: SparkSession, paths: Sequence[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """The same from Spark's text source, for stores that pyarrow does not know. It reads whole files; a file's first split, which
    lies in one task, meets its lines in order, so ``first`` is well defined."""
    lines = reader(spark, recursive, glob).text(list(paths)).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value"))
    return (lines.where((F.col("at") == 0) & (F.trim(F.regexp_replace("value", BOM, "")) != ""))
            .groupBy("path").agg(F.first("value").alias("header")))


def separator(header: Column) -> Column:
    return F.when(header.contains("\t"), F.lit("\t")).otherwise(F.lit(","))


def header_names(header: Column) -> Column:
    """Names of a header line: split at tabs if it has any, else at commas; BOM, quotes and blanks removed."""
    h = F.regexp_replace(header, "^" + BOM, "")
    return F.transform(F.split(h, separator(h)), lambda x: F.trim(F.regexp_replace(x, '"', "")))


def grouped(found: Iterable[tuple[str, str, Sequence[str]]]) -> list[Layout]:
    """Layouts of files given by path, separator and names."""
    by: dict[tuple, list[str]] = {}
    for path, sep, names in found:
        by.setdefault((sep, tuple(names)), []).append(path)
    return [Layout(sep, list(names), sorted(paths)) for (sep, names), paths in sorted(by.items())]


def of_files(seen: DataFrame) -> list[Layout]:
    """Layouts of files given by ``path, length, sep, names``, a stored table. The driver gets one row a layout and, of up to
    ``lines.MANY`` files, their paths. More stay rows of the table, if ``lines`` can read them."""
    kind = F.struct("sep", "names").alias("kind")
    store = F.regexp_extract("path", "^([^:/]+)://", 1)
    found = seen.groupBy(kind, store).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path"), F.max(lines.packed(F.col("path"))).alias("packed")).collect()
    if sum(r["files"] for r in found) <= lines.MANY or any(r["packed"] or not known_store(r["path"]) for r in found):
        return grouped((r["path"], r["sep"], r["names"]) for r in seen.select("path", "sep", "names").collect())
    kinds = sorted({(r["kind"]["sep"], tuple(r["kind"]["names"])) for r in found})
    same = lambda sep, names: (F.col("sep") == sep) & (F.col("names") == F.array(*map(F.lit, names)))
    return [Layout(sep, list(names), seen.where(same(sep, names)).select("path", "length")) for sep, names in kinds]


def by_folder(root: str, found: list[Layout], others: Iterable[str]) -> list[Layout]:
    """The same layouts by as few paths as will do: a folder below ``root`` stands for its files if all known ones have the
    layout. ``others``: known files that are not to be read. Spark's driver checks each path that it is given, so a
    million of them would cost it an hour."""
    bare = lambda path: re.sub("^file:(//)?", "", path).rstrip("/")
    top = bare(root)
    kinds: dict[str, int] = {}

    def folders(path: str) -> Iterator[str]:
        while len(bare(path)) > len(top) and "/" in path:
            path = path.rsplit("/", 1)[0]
            yield path

    for k, paths in [*((k, layout.paths) for k, layout in enumerate(found)), (-1, others)]:
        for path in paths:
            for folder in folders(path):
                if kinds.setdefault(folder, k) != k:
                    kinds[folder] = -1
    out = []
    for k, layout in enumerate(found):
        chosen = set()
        for path in layout.paths:
            best = path
            for folder in folders(path):
                if kinds[folder] != k:
                    break
                best = folder
            chosen.add(best)
        out.append(Layout(layout.sep, layout.names, sorted(chosen)))
    return out


def layouts(spark: SparkSession, paths: Sequence[str], recursive: bool = False, glob: str | None = None) -> list[Layout]:
    """The layouts found. The files of one folder are listed by tasks, and very many stay there; of others the driver holds the paths, as
    Spark's own file index does."""
    head = F.col("header")
    if recursive and glob in ("*.txt", "*.csv") and len(paths) == 1 and not re.search(r"[*?\[{]", paths[0]) and known_store(paths[0]):
        seen = inspected(spark, paths[0], glob).where(head.isNotNull())  # tasks list the folder
        return of_files(written(seen.select("path", "length", separator(head).alias("sep"), header_names(head).alias("names")), "layouts"))
    found = first_lines(spark, paths, recursive, glob).select("path", separator(head).alias("sep"), header_names(head).alias("names"))
    return grouped((r["path"], r["sep"], r["names"]) for r in found.collect())


def read_layouts(spark: SparkSession, paths: Sequence[str], select: Callable[[DataFrame, dict[str, str]], DataFrame],
                 recursive: bool = False, glob: str | None = None, trim: bool = False, found: list[Layout] | None = None) -> DataFrame | None:
    """Rows of all files, by name. ``select(frame, columns)`` gets the rows of one layout and the column that
    holds each header name (the first, if a name occurs twice), and returns the common columns. ``found``: the files' layouts, if
    known already; then their paths are read, folders among them as ``recursive`` and ``glob`` say."""
    known = found is not None
    found = found if known else layouts(spark, paths, recursive, glob)
    names = [p for k in found if not isinstance(k.paths, DataFrame) for p in k.paths]
    # very many files: Spark's scan would have its driver ask for each of them
    many = len(names) > lines.MANY and lines.readable(names) and all(known_store(p) for p in {p.split("://", 1)[0]: p for p in names}.values())
    out = None
    for k in found:
        columns = {n: f"_c{i}" for i, n in reversed(list(enumerate(k.names)))}
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(k.names))])
        if many or isinstance(k.paths, DataFrame):
            options = {"sep": k.sep, "mode": "PERMISSIVE", **({"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"} if trim else {})}
            rows = lines.data_lines(spark, k.paths)
            part = select(rows.select("_source", F.from_csv("line", schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r")).select("_source", "r.*"), columns)
            out = part if out is None else out.unionByName(part)
            continue
        # one layout: the folder itself; several: exactly their files
        whole = len(found) == 1 and not known
        r = reader(spark, recursive, glob) if whole or known else spark.read
        r = r.option("header", True).option("sep", k.sep).option("mode", "PERMISSIVE").option("enforceSchema", True)
        if trim:
            r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        part = select(r.schema(schema).csv(list(paths) if whole else k.paths), columns)
        out = part if out is None else out.unionByName(part)
    return out


def json_shapes(spark: SparkSession, paths: Sequence[str], recursive: bool = False, glob: str | None = None) -> dict[bool, list[str]]:
    """Paths by whether the file's first character that is not blank opens an array."""
    heads = first_lines(spark, paths, recursive, glob)
    out: dict[bool, list[str]] = {}
    for r in heads.select("path", opens_array(F.col("header")).alias("array")).orderBy("path").toLocalIterator():
        out.setdefault(r["array"], []).append(r["path"])
    return out


def opens_array(header: Column) -> Column:
    return F.ltrim(F.regexp_replace(header, "^" + BOM, "")).startswith("[")
