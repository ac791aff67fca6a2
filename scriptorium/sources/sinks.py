"""Sinks K1-K5.  Every writer overwrites (a rerun never duplicates rows)."""

from __future__ import annotations

import io
import os
import tarfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import shard_ids
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def write_jsonl(df: DataFrame, path: str) -> str:
    """K1."""
    df.write.mode("overwrite").json(path)
    return path


def write_json_arrays(df: DataFrame, task: str, path: str) -> str:
    """One JSON array per file: the rows of a scan task (column ``task``) become one array.

    A scan task holds at most ``spark.sql.files.maxPartitionBytes`` of input, so an array is bounded.
    """
    rest = [c for c in df.columns if c != task]
    arrays = df.groupBy(task).agg(F.to_json(F.collect_list(F.struct(*rest))).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def write_json_array_file(df: DataFrame, path: str) -> str:
    """All rows as one JSON array in one file: the tasks write their rows as parts, each with a comma before it, and ``join_parts`` puts the parts together."""
    parts = f"{path}.parts"
    df.select(F.concat(F.lit(","), F.to_json(F.struct(*df.columns))).alias("value")).write.mode("overwrite").text(parts)
    return join_parts(df.sparkSession, parts, path, "part-00000.txt", b"[\n", b"]\n", skip=1)


def write_csv_file(df: DataFrame, path: str, sep: str = ",") -> str:
    """K2 into one file: a header, and the rows that all tasks write (``join_parts``)."""
    parts = f"{path}.parts"
    write_csv(df, parts, sep, header=False)
    names = ('"' + c.replace('"', '""') + '"' if set(c) & {sep, '"', "\n", "\r"} else c for c in df.columns)
    return join_parts(df.sparkSession, parts, path, "part-00000.csv", (sep.join(names) + "\n").encode(), b"")


#: Bytes that a task of ``join_parts`` holds at a time.
_COPY = 8 << 20


def join_parts(spark: SparkSession, parts: str, path: str, name: str, head: bytes, tail: bytes, skip: int = 0) -> str:
    """One file ``path/name`` of the part files of a folder, in their order, between ``head`` and ``tail``.

    The sizes of the parts (one row each, known to the store) tell where each one begins in the file, and every task
    copies its parts to their places: no task reads more than its parts, however large the file is.
    ``skip`` bytes are left out at the begin of the first part that has any.  The folder ``parts`` is removed after it.
    A store that cannot write at a place (all but mounted file systems) gets the bytes one part after the other.
    """
    source, target = spark._jvm.org.apache.hadoop.fs.Path(parts), spark._jvm.org.apache.hadoop.fs.Path(path, name)
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f.getLen()) for f in store.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen())
    if store.getUri().getScheme() != "file":
        out = store.create(target, True)
        out.write(bytearray(head))
        for i, (part, _) in enumerate(found):
            read = store.open(spark._jvm.org.apache.hadoop.fs.Path(source, part))
            read.seek(skip if i == 0 else 0)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, _COPY, False)
            read.close()
        out.write(bytearray(tail))
        out.close()
    else:
        folder, to = source.toUri().getPath(), target.toUri().getPath()
        os.makedirs(os.path.dirname(to), exist_ok=True)
        rows, at = [], len(head)
        for i, (part, size) in enumerate(found):
            first = skip if i == 0 else 0
            rows.append((f"{folder}/{part}", first, at))
            at += size - first
        with open(to, "wb") as out:
            out.write(head)
            out.seek(at)
            out.write(tail)

        def copy(batches):
            for batch in batches:
                for part, first, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with open(part, "rb") as read, open(to, "r+b") as out:
                        read.seek(first)
                        out.seek(at)
                        while data := read.read(_COPY):
                            out.write(data)
                yield batch

        if rows:
            todo = spark.createDataFrame(rows, "part string, first long, at long")
            todo.repartition(len(rows), "part").mapInArrow(copy, todo.schema).write.format("noop").mode("overwrite").save()
    store.delete(source, True)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    """K2: header (if wanted), no index, quotes doubled inside quoted fields.

    Edge blanks are kept, and an empty string is written as ``""``, so it does
    not come back as NULL.
    """
    w = df.write.mode("overwrite").option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(path)
    return path


def write_lines(df: DataFrame, col: str, path: str, compression: str | None = None) -> str:
    """K3: one line per row (rows holding newlines span several lines)."""
    w = df.select(F.col(col).alias("value")).write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)
    return path


def write_splits(df: DataFrame, path: str, split: str = "split") -> str:
    """K4: one parquet folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return path


def write_shards(df: DataFrame, order, shards: int, path: str, fmt: str = "json", max_records_per_file: int | None = None) -> str:
    """K5: contiguous shards; shard s goes to the folder ``shard=s/``.

    The indexed rows are already range-partitioned in order, so every task
    writes its contiguous slice straight into the shard folders it touches: a
    shard is a folder of part files in task order, and no shard is funnelled
    through a single task (at 100 TB and 20 shards that would be 5 TB each).
    """
    s = shard_ids(df, order, shards)
    w = s.write.mode("overwrite").partitionBy("shard").format(fmt)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.save(path)
    return path


def write_tar_archives(df: DataFrame, name: str, text: str, path: str, group: str) -> str:
    """Write one ``.tar.gz`` per value of ``group`` with one member per row.

    Used to produce archive inputs for S11; each archive is built by one task
    from its own group (groups must be bounded, e.g. ``id div 100``) and written
    through Arrow's file systems (local mounts, HDFS, object stores).
    """
    root = (path if "://" in path else "file://" + path.removeprefix("file:")).rstrip("/")

    def _write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        g = pdf[group].iloc[0]
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w:gz") as tf:
            for n, t in zip(pdf[name], pdf[text]):
                data = (t or "").encode("utf-8")
                info = tarfile.TarInfo(name=str(n))
                info.size = len(data)
                tf.addfile(info, io.BytesIO(data))
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        target = f"{folder}/part-{g}.tar.gz"
        with store.open_output_stream(target, compression=None) as out:
            out.write(buf.getvalue())
        return pd.DataFrame({"archive": [target], "members": [len(pdf)]})

    out = df.groupBy(group).applyInPandas(_write, "archive string, members long")
    out.write.format("noop").mode("overwrite").save()
    return path
