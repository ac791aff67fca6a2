"""S11 and SR1: tar archives as a data source, batch and stream.

One partition is one archive.  Its task streams it from Arrow's file systems
(local mounts, HDFS, object stores), member after member, and hands on Arrow
batches of about ``MEMBER_CHARS`` characters; neither the archive nor all its
members are ever held.  A stream's offset is the newest (time of change, path) that
was read, so a later run reads only archives that came or changed since.
"""

from __future__ import annotations

import fnmatch
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Characters of members that leave a task at a time.
MEMBER_CHARS = 8_000_000
SCHEMA = "archive string, member string, text string"


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def list_archives(path: str, glob: str) -> list[tuple[int, str]]:
    """(time of change in ns, path) of the archives below ``path``, oldest first; a missing folder has none."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(_uri(path))
    found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    if not found and store.get_file_info(folder).type == fs.FileType.File:
        found = [store.get_file_info(folder)]
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob))


def member_batches(root: str, archive: str):
    """Arrow batches of the regular members of one archive, decoded like S7."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(_uri(root))
    names, texts, size = [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(names)), pa.array(names, pa.string()), pa.array(texts, pa.string())], ["archive", "member", "text"])

    with store.open_input_stream(archive, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for m in tar:
            if not m.isfile():
                continue
            texts.append(tar.extractfile(m).read().decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))
            names.append(m.name)
            size += len(texts[-1])
            tar.members = []  # tarfile keeps the headers of all members otherwise
            if size > MEMBER_CHARS:
                yield batch()
                names, texts, size = [], [], 0
    if names:
        yield batch()


class _Archive(InputPartition):
    def __init__(self, root: str, archive: str):
        self.root, self.archive = root, archive


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.tar.gz")

    def partitions(self):
        return [_Archive(self.path, p) for _, p in list_archives(self.path, self.glob)] or [_Archive(self.path, "")]

    def read(self, partition):
        if partition.archive:
            yield from member_batches(partition.root, partition.archive)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.tar.gz")

    def initialOffset(self):
        return {"time": -1, "path": ""}

    def latestOffset(self):
        found = list_archives(self.path, self.glob)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start, end):
        first, last = ((o["time"], o["path"]) for o in (start, end))
        return [_Archive(self.path, p) for t, p in list_archives(self.path, self.glob) if first < (t, p) <= last]

    def read(self, partition):
        yield from member_batches(partition.root, partition.archive)


class TarMembers(DataSource):
    """Format ``tar_members``: options ``path`` and ``glob``."""

    @classmethod
    def name(cls):
        return "tar_members"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def read_tar_members(spark: SparkSession, path: str, glob: str = "*.tar.gz") -> DataFrame:
    """Every regular member of every tar archive -> (archive, member, text)."""
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("glob", glob).load(path)


def stream_tar_members(spark: SparkSession, path: str, glob: str = "*.tar.gz") -> DataFrame:
    """SR1 over archives: as ``read_tar_members``, a stream that begins where the last run of its checkpoint ended."""
    spark.dataSource.register(TarMembers)
    return spark.readStream.format("tar_members").option("glob", glob).load(path)
