"""Listings and first lines of files, by tasks.

A folder is listed from its top: the driver descends only until there are enough sub-folders to deal out, and tasks list those
with sizes and times. A task that looks at a file's header opens its stream and reads blocks of ``HEAD_BLOCK`` bytes until a
line that is not blank ends, so a file's size does not matter. Both go through pyarrow; for a store that pyarrow
does not know, the driver lists through Hadoop's file system and headers come from Spark's text source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.columns import file_extension
from barspark.sources.arrow_ipc import _fs, _uri

HEAD_BLOCK = 64 << 10
#: Sub-folders that are enough to be listed by tasks.
FOLDERS = 32
FILES = "path string, length long, modification_time timestamp"
BOM = "﻿"
#: Extensions of files with lines to look at.
TEXT = (".txt", ".csv", ".json")
_LINE_END = re.compile(rb"\r\n|\r|\n")


def known_store(path: str) -> bool:
    """Whether pyarrow opens the store of ``path``."""
    import pyarrow as pa
    try:
        _fs(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def first_line(read: Callable[[int], bytes], block: int = HEAD_BLOCK) -> str | None:
    """The first line that holds more than blanks and a byte order mark; None if there is none."""
    held, start, at, ended = bytearray(), 0, 0, False
    while True:
        end = _LINE_END.search(held, at)
        # a carriage return at the end of what was read may be half of a line end; that changes no line's text
        if end is None and not ended:
            at = len(held)
            more = read(block)
            ended = not more
            held += more
            continue
        line = bytes(held[start:end.start()] if end else held[start:]).decode("utf-8", "replace")
        if line.replace(BOM, "").strip(" "):
            return line
        if end is None:
            return None
        start = at = end.end()


def _hidden(name: str) -> bool:
    """Spark's rule for names its file sources skip (markers, temporary files)."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def name_pattern(glob: str) -> str:
    """A file name glob (``*``, ``?``, ``[ab]``, ``{a,b}``) as a regular expression."""
    out, depth = "", 0
    for part in re.findall(r"\[[^\]]*\]|.", glob, re.S):
        if part in "{}":
            depth += 1 if part == "{" else -1
            out += "(?:" if part == "{" else ")"
        elif part == "," and depth:
            out += "|"
        else:
            out += {"*": ".*", "?": "."}.get(part) or (part.replace("[!", "[^") if len(part) > 1 else re.escape(part))
    return out


def _entries(folder: str, deep: bool) -> tuple[list[tuple], list[str]]:
    """Files (path, length, time) and sub-folders of a folder; with ``deep`` all files below it."""
    from pyarrow import fs as pafs

    filesystem, base = _fs(folder)

    def named(inner: str) -> str:
        path = _uri(folder, inner)
        return path if "://" in path else "file:" + path

    if filesystem.get_file_info(base).type == pafs.FileType.File:
        info = filesystem.get_file_info(base)
        return [(named(info.path), info.size, info.mtime)], []
    files, folders = [], []
    for info in filesystem.get_file_info(pafs.FileSelector(base, recursive=deep)):
        below = info.path[len(base):].strip("/")
        if any(_hidden(p) for p in below.split("/")):
            continue
        if info.type == pafs.FileType.File:
            files.append((named(info.path), info.size, info.mtime))
        elif not deep:
            folders.append(named(info.path))
    return files, folders


def _hadoop_files(spark: SparkSession, root: str) -> list[tuple]:
    import datetime as dt
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = store.getFileStatus(at).getPath().toString()
    out, found = [], store.listFiles(at, True)
    while found.hasNext():
        f = found.next()
        path = f.getPath().toString()
        if not any(_hidden(p) for p in path[len(top):].strip("/").split("/")):
            out.append((path, f.getLen(), dt.datetime.fromtimestamp(f.getModificationTime() / 1000)))
    return out


def _opened(deep: bool) -> Callable[[Iterator], Iterator]:
    """Rows of files as they are; folders, which have no length, opened: their files, and with ``deep`` those below, else their sub-folders."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            path, size, time = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(time, pa.timestamp("us", "UTC"))], ["path", "length", "modification_time"])

        held = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[1] is not None:
                    held.append(row)
                else:
                    files, below = _entries(row[0], deep)
                    held += files
                    held += [(f, None, None) for f in below]
                while len(held) >= 10_000:
                    yield batch(held[:10_000])
                    held = held[10_000:]
        if held:
            yield batch(held)

    return run


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modification_time`` of every file under ``root``, empty ones too, hidden ones not. One listing; a
    folder that cannot be listed is an error. The driver lists the top only; where that has few folders, tasks open
    two levels more before they deal out what is below."""
    if not known_store(root):
        return spark.createDataFrame(_hadoop_files(spark, root), FILES)
    files, todo = _entries(root, False)
    out = spark.createDataFrame(files, FILES)
    if todo:
        tasks = 4 * spark.sparkContext.defaultParallelism
        dealt = spark.createDataFrame([(f, None, None) for f in todo], FILES).repartition(min(len(todo), tasks))
        if len(todo) < FOLDERS:
            dealt = dealt.mapInArrow(_opened(False), FILES).repartition(tasks).mapInArrow(_opened(False), FILES).repartition(tasks)
        out = out.unionByName(dealt.mapInArrow(_opened(True), FILES))
    return out


def _read_headers(batches: Iterator) -> Iterator:
    """Rows whose first column is a path and whose last tells whether to look into the file, which becomes its header."""
    import pyarrow as pa

    for b in batches:
        heads = []
        for path, look in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            if not look:
                heads.append(None)
                continue
            filesystem, inner = _fs(path)
            with filesystem.open_input_stream(inner, buffer_size=None) as stream:
                heads.append(first_line(stream.read))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(heads, pa.string())], b.schema.names)


def with_headers(files: DataFrame, look) -> DataFrame:
    """``files`` (its first column ``path``) with ``header``, the first line that is not blank of files where ``look`` holds.
    Only for a store that pyarrow knows."""
    rows = files.withColumn("header", look)
    return rows.mapInArrow(_read_headers, T.StructType([*files.schema.fields, T.StructField("header", T.StringType())]))


def inspected(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``path, length, modification_time, extension, header`` of the files under ``root``: a single listing, and the first line of text files."""
    files = files_below(spark, root).withColumn("extension", file_extension(F.col("path")))
    if glob:
        files = files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(f"^(?s:{name_pattern(glob)})$"))
    look = F.col("extension").isin(*TEXT) & (F.col("length") > 0)
    if known_store(root):
        return with_headers(files.repartition(4 * spark.sparkContext.defaultParallelism), look)
    from barspark.sources.headers import text_first_lines
    heads = text_first_lines(spark, [root], True, glob or "*.{txt,csv,json}")
    return files.join(heads.withColumnRenamed("path", "_p"), F.regexp_replace("path", "^file:(//)?", "") == F.regexp_replace("_p", "^file:(//)?", ""), "left").drop("_p")
