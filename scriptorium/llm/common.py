"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than blank, tab, \n, \v, \f and \r
#: (``[^\x20\x09-\x0D]+``).  ``bytes.split()`` and Java's ``\s`` use the same six.
BLANKS = " \t\n\x0b\f\r"


#: Input bytes that a Python worker turns into output rows at a time.
SLICE_BYTES = 2_000_000

class _Named(threading.local):
    """Folders that this thread named: runs of other threads are not its own."""

    def __init__(self):
        self.folders: list[str] = []


_named = _Named()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name inside the shared checkpoint folder."""
    _named.folders.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _named.folders[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage with files that survive the loss of an executor, and lets
    several consumers read one result.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def named_since():
    """The folders that ``shared_folder`` names inside of the block."""
    before, found = len(_named.folders), []
    try:
        yield found
    finally:
        found += _named.folders[before:]


def remove_folders(spark: SparkSession, paths: list[str]) -> int:
    """Delete folders that ``shared_folder`` named; DataFrames that read them are void after it."""
    n = 0
    for name in list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def sliced(batches):
    """Arrow batches in runs of rows of about ``SLICE_BYTES``, so that what is made of them stays small."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


@contextmanager
def one_blas_thread():
    """Inside of the block numpy multiplies matrices in the calling thread alone.

    OpenBLAS starts helpers that spin while they wait, on cores that other tasks use; small products
    then cost a multiple of their CPU time.  Other BLAS libraries are left as they are.
    """
    import ctypes
    import glob
    import os

    import numpy

    setters = []
    for lib in glob.glob(os.path.join(os.path.dirname(os.path.dirname(numpy.__file__)), "numpy.libs", "*openblas*")):
        handle = ctypes.CDLL(lib)
        for prefix, suffix in (("scipy_openblas", "64_"), ("scipy_openblas", ""), ("openblas", "64_"), ("openblas", "")):
            get, put = (getattr(handle, f"{prefix}_{verb}_num_threads{suffix}", None) for verb in ("get", "set"))
            if get is not None and put is not None:
                setters.append((put, get()))
                put(1)
                break
    try:
        yield
    finally:
        for put, was in setters:
            put(was)


def release_memory() -> None:
    """Give what a task's Python worker has freed back to the machine; the process waits for the next task with it otherwise."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def append_columns(df: DataFrame, fields: list[T.StructField], fn, done=None) -> DataFrame:
    """Append columns made by ``fn(batch) -> list of arrays``, some ``SLICE_BYTES`` of an Arrow batch at a time.

    An input column that has the name of an appended one is replaced by it.  ``done()`` is called at the
    end of a task: its worker process goes on, and should not hold what only the task needed.
    """
    names = {f.name.lower() for f in fields}
    rest = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType(rest + fields)
    keep = [f.name for f in rest]
    arrow = to_arrow_schema(schema)

    def run(batches):
        try:
            for batch in sliced(batches):
                made = fn(batch)
                arrays = [batch.column(k) for k in keep] + list(made)
                yield pa.RecordBatch.from_arrays([a.cast(t.type) if a.type != t.type else a for a, t in zip(arrays, arrow, strict=True)], schema=arrow)
        finally:
            if done is not None:
                done()
            release_memory()

    return df.mapInArrow(run, schema)


def binary_texts(column) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return [x or b"" for x in column.to_pylist()]
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
