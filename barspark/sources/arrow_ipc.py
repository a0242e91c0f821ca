"""Arrow IPC (Feather v2) files as a Spark Python Data Source.

A write becomes visible by one small file: tasks write under ``_pending``, and the commit's journal names the new files and, for an overwrite,
the old ones that they replace. Readers that find a journal see the new files wherever they are and none of the old, so a
commit that is killed has either not happened or is complete; the next write clears up after it.

Reading plans one partition per file, or per range of record batches of a large one, and yields Arrow record batches, so Spark
receives columnar batches without per-row conversion. Writing has each task write its
partition as one ``part-<task>-<uuid>.feather`` file.
"""

from __future__ import annotations

import glob
import os
import uuid

from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

FORMAT_NAME = "arrow_ipc"
PENDING = "_pending"
JOURNAL = "_commit.json"
#: Larger files are read by several tasks.
SPLIT_BYTES = 128 << 20


def _fs(path: str):
    """Filesystem and in-filesystem path for any URI pyarrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:") and not path.startswith("file://"):
        return fs.LocalFileSystem(), path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def _uri(path: str, inner: str) -> str:
    if "://" in path:
        scheme = path.split("://", 1)[0]
        return f"{scheme}://{inner}" if not inner.startswith("/") else f"{scheme}://{inner}"
    return inner


def _journal(filesystem, folder: str) -> dict | None:
    """The commit that a folder's journal describes, if there is one: its job, new files and old files by their path below the folder."""
    import json

    from pyarrow import fs
    name = f"{folder}/{JOURNAL}"
    if filesystem.get_file_info(name).type != fs.FileType.File:
        return None
    with filesystem.open_input_stream(name) as stream:
        return json.loads(stream.read())


def _below(filesystem, folder: str) -> list[str]:
    """Arrow files of a folder by their path below it, as its journal has them."""
    from pyarrow import fs
    found = filesystem.get_file_info(fs.FileSelector(folder, recursive=True))
    names = [f.path[len(folder):].lstrip("/") for f in found if f.type == fs.FileType.File and f.path.endswith((".feather", ".arrow", ".ipc"))]
    live = {n for n in names if not n.startswith(f"{PENDING}/")}
    commit = _journal(filesystem, folder)
    if commit:
        live -= set(commit["old"])
        live |= {f"{PENDING}/{commit['job']}/{n}" for n in commit["new"] if n not in live and f"{PENDING}/{commit['job']}/{n}" in names}
    return sorted(live)


def _files(path: str) -> list[str]:
    from pyarrow import fs
    filesystem, p = _fs(path)
    info = filesystem.get_file_info(p)
    if info.type == fs.FileType.Directory:
        p = p.rstrip("/")
        return [_uri(path, f"{p}/{n}") for n in _below(filesystem, p)]
    if info.type == fs.FileType.File:
        return [path]
    return sorted(glob.glob(p))


def _step(action, *args) -> None:
    """One change to the store; the tests break off between them."""
    action(*args)


def _settle(filesystem, folder: str) -> None:
    """Bring about what the journal says: new files into place, old ones gone, then the journal itself."""
    from pyarrow import fs
    commit = _journal(filesystem, folder)
    if commit is None:
        return
    there = lambda name, kind: filesystem.get_file_info(name).type == kind
    own = f"{folder}/{PENDING}/{commit['job']}"
    for n in commit["new"]:
        if there(f"{own}/{n}", fs.FileType.File):
            _step(filesystem.move, f"{own}/{n}", f"{folder}/{n}")
    for n in commit["old"]:
        if there(f"{folder}/{n}", fs.FileType.File):
            _step(filesystem.delete_file, f"{folder}/{n}")
    _step(filesystem.delete_file, f"{folder}/{JOURNAL}")
    _drop(filesystem, folder, commit["job"])


def _drop(filesystem, folder: str, job: str) -> None:
    """Forget a job's pending files."""
    from pyarrow import fs
    for name in (f"{folder}/{PENDING}/{job}", f"{folder}/{PENDING}"):
        if filesystem.get_file_info(name).type == fs.FileType.Directory and (name.endswith(job) or not filesystem.get_file_info(fs.FileSelector(name))):
            _step(filesystem.delete_dir, name)


class _FilePartition(InputPartition):
    """Record batches ``first`` to ``last`` (exclusive; None: to the end) of a file."""

    def __init__(self, path: str, first: int = 0, last: int | None = None):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        """One per file; a file of more than SPLIT_BYTES is split at its record batches, which its footer counts."""
        import pyarrow.ipc as ipc
        out = []
        for f in _files(self.path):
            filesystem, p = _fs(f)
            parts = -(-filesystem.get_file_info(p).size // SPLIT_BYTES)
            batches = 0
            if parts > 1:
                with filesystem.open_input_file(p) as fh:
                    try:
                        batches = ipc.open_file(fh).num_record_batches
                    except Exception:  # noqa: BLE001 - a stream has no footer and is read whole
                        batches = 0
            if batches > 1:
                step = -(-batches // parts)
                out += [_FilePartition(f, i, min(i + step, batches)) for i in range(0, batches, step)]
            else:
                out.append(_FilePartition(f))
        return out

    def read(self, partition):
        import pyarrow.ipc as ipc
        filesystem, p = _fs(partition.path)
        with filesystem.open_input_file(p) as fh:
            try:
                reader = ipc.open_file(fh)
            except Exception:  # noqa: BLE001 - stream format instead of file format
                reader = None
            if reader is None:
                fh.seek(0)
                yield from ipc.open_stream(fh)
            else:
                last = reader.num_record_batches if partition.last is None else partition.last
                for i in range(partition.first, last):
                    yield reader.get_batch(i)


class _Commit(WriterCommitMessage):
    def __init__(self, file: str | None, rows: int):
        self.file = file
        self.rows = rows


class _Writer(DataSourceArrowWriter):
    """Each task streams its Arrow batches into one IPC file; an empty task writes nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        import pyarrow as pa
        from pyspark import TaskContext
        filesystem, out_dir = _fs(self.path)
        filesystem.create_dir(out_dir, recursive=True)
        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        # hidden until the job commits, so that a failed or repeated task leaves nothing to be read
        part = f"part-{pid:05d}-{uuid.uuid4().hex}.feather"
        pending = f"{out_dir.rstrip('/')}/{PENDING}/{self.job}"
        filesystem.create_dir(pending, recursive=True)
        name = f"{pending}/{part}"
        rows = 0
        writer = sink = None
        try:
            for batch in iterator:
                if writer is None:
                    sink = filesystem.open_output_stream(name)
                    writer = pa.ipc.new_file(sink, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        return _Commit(part if rows else None, rows)

    def commit(self, messages):
        """Publish the files of the tasks that count; with overwrite, in place of those of earlier writes."""
        import json

        from pyarrow import fs
        filesystem, folder = _fs(self.path)
        folder = folder.rstrip("/")
        filesystem.create_dir(folder, recursive=True)
        _settle(filesystem, folder)  # an earlier commit that was broken off
        old = _below(filesystem, folder) if self.overwrite else []
        text = json.dumps({"job": self.job, "new": [m.file for m in messages if m is not None and m.file], "old": old}).encode()
        # where a file grows in sight of readers it is written aside and renamed; elsewhere it appears whole when closed
        aside = isinstance(filesystem, (fs.LocalFileSystem, fs.HadoopFileSystem))
        name = f"{folder}/{JOURNAL}"
        with filesystem.open_output_stream(f"{name}.{self.job}" if aside else name) as out:
            out.write(text)
        if aside:
            _step(filesystem.move, f"{name}.{self.job}", name)
        _settle(filesystem, folder)

    def abort(self, messages):
        filesystem, folder = _fs(self.path)
        _drop(filesystem, folder.rstrip("/"), self.job)


class ArrowIpcDataSource(DataSource):
    """``spark.read.format("arrow_ipc").load(path)`` / ``df.write.format("arrow_ipc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT_NAME

    def schema(self):
        import pyarrow.ipc as ipc
        from pyspark.sql.pandas.types import from_arrow_schema
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        filesystem, p = _fs(files[0])
        with filesystem.open_input_file(p) as fh:
            try:
                sch = ipc.open_file(fh).schema
            except Exception:  # noqa: BLE001
                fh.seek(0)
                sch = ipc.open_stream(fh).schema
        return from_arrow_schema(sch)

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"], overwrite)


def register(spark) -> None:
    spark.dataSource.register(ArrowIpcDataSource)
