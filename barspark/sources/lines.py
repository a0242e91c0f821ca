"""Very many text files, by tasks: written one per key, read as lines by ranges of bytes.

Spark's own write and scan ask Hadoop's file system for each folder and file, partly in the driver, which took about 6 ms a file written on a
local store. Here tasks open files through pyarrow, and parsing stays Spark's.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.session import file_tasks
from barspark.sources.arrow_ipc import _fs

#: Files of one read above which their lines are read here rather than by Spark's scan, and their paths stay out of the driver.
MANY = 1000
#: Bytes that one row of work covers, and text that a batch of rows holds.
RANGE, BATCH = 32 << 20, 2 << 20
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_PACKED = (".gz", ".gzip", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
_SPECIAL = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_NOT_IN_URI = re.compile("[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f]")
_BLANK = "".join(map(chr, range(33)))


def _escaped(name: str) -> str:
    return _SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", name)


def write_lines(rows: DataFrame, path: str, column: str, header: str, order: Sequence[str], ext: str) -> None:
    """One file for each value of the first column, in the folder that Spark's partitioned write would give it (``column`` names it):
    ``header``, then the lines of the second column by ``order``. A file appears under its name when it is whole."""
    key, line = rows.columns[:2]
    rows.limit(0).select(key, line).write.mode("overwrite").partitionBy(key).text(path)  # clears the folder as any write does
    dealt = rows.repartition(file_tasks(rows.sparkSession), key).sortWithinPartitions(key, *order).select(key, line)
    dealt.mapInArrow(_writer(path, column, header, ext), "files long").groupBy().sum("files").collect()


def _writer(path: str, column: str, header: str, ext: str) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        filesystem, base = _fs(path)
        task, files, out, key, names = TaskContext.get().partitionId(), 0, None, None, ("", "")
        for b in batches:
            keys, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if out is None or keys[start] != key:
                    if out is not None:
                        out.close()
                        filesystem.move(*names)
                    key = keys[start]
                    folder = f"{base}/{_escaped(column)}={_escaped(key) if key else NO_VALUE}"
                    filesystem.create_dir(folder, recursive=True)
                    names = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{task:05d}-{files:07d}{ext}"
                    out = filesystem.open_output_stream(names[0])
                    out.write(f"{header}\n".encode())
                    files += 1
                out.write(("\n".join(values[start:end]) + "\n").encode())
                start = end
        if out is not None:
            out.close()
            filesystem.move(*names)
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def readable(paths: Sequence[str]) -> bool:
    """Whether ranges of these files can be read: none is compressed."""
    return not any(p.lower().endswith(_PACKED) for p in paths)


def packed(path: Column) -> Column:
    """Whether a file's name says that it is compressed."""
    return F.lower(path).rlike(f"({'|'.join(map(re.escape, _PACKED))})$")


def data_lines(spark: SparkSession, files: Sequence[str] | DataFrame) -> DataFrame:
    """``_source, line``: the lines of known files that are not blank, but each file's first. Rows come in file order within a
    partition, and a file's parts in the order of partitions. ``files``: their paths, or a table with ``path, length``."""
    import pyarrow as pa
    tasks = file_tasks(spark)
    if not isinstance(files, DataFrame):
        paths = spark.createDataFrame(pa.table({"path": pa.array(files, pa.string())})).repartition(tasks)
        files = paths.mapInArrow(_sizes, "path string, length long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long")))
    parts = files.where("length > 0").select("path", "length", starts.alias("start"))
    parts = parts.select("path", "start", F.least(F.col("start") + RANGE, F.col("length")).alias("stop"))
    return parts.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start").mapInArrow(_lines, "_source string, line string")


def _sizes(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for b in batches:
        sizes = []
        for path in b.column(0).to_pylist():
            filesystem, inner = _fs(path)
            sizes.append(filesystem.get_file_info(inner).size)
            if sizes[-1] is None:
                raise FileNotFoundError(path)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["path", "length"])


def _read(path: str, start: int, stop: int) -> list[bytes]:
    """The lines that begin in a range of bytes."""
    filesystem, inner = _fs(path)
    if start == 0 and stop < RANGE:  # a whole file
        with filesystem.open_input_stream(inner, compression=None, buffer_size=None) as f:
            return f.read().splitlines()
    with filesystem.open_input_file(inner) as f:
        # the line that a byte belongs to is that of the range where it begins; one byte back tells whether a line ends there
        begin = max(start - 1, 0)
        f.seek(begin)
        held = bytearray(f.read(stop - begin))
        if held[-1:] not in (b"\n", b"\r"):  # the last line goes on
            end = None
            while end is None and (more := f.read(64 << 10)):
                end = re.search(rb"[\r\n]", more)
                held += more[:end.start()] if end else more
    lines = bytes(held).splitlines()
    return lines if start == 0 else lines[1:]


def _source(path: str) -> str:
    """A path as ``_metadata.file_path`` gives it."""
    bare = re.sub("^file:(//)?", "", path)
    return ("" if "://" in bare else "file:") + _NOT_IN_URI.sub(lambda m: f"%{ord(m[0]):02X}", bare)


def _lines(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(texts, pa.string())], ["_source", "line"])

    sources: list[str] = []
    texts: list[str] = []
    held = 0
    for b in batches:
        for path, start, stop in zip(*(c.to_pylist() for c in b.columns)):
            source, first = _source(path), start == 0
            for raw in _read(path, start, stop):
                line = raw.decode("utf-8", "replace")
                if first and line.startswith("﻿"):
                    line = line[1:]
                if not line.strip(_BLANK):
                    continue
                if first:  # the header
                    first = False
                    continue
                sources.append(source)
                texts.append(line)
                held += len(line)
                if held > BATCH:
                    yield batch()
                    sources, texts, held = [], [], 0
    if texts:
        yield batch()
