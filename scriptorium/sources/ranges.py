"""S2 and S3 for large single files: one multi-line CSV or JSON-array file, read by many tasks.

Spark's line scan deals the byte ranges of a file to tasks, but a line (CSV) or
the text up to a ``}`` (JSON) need not end a record: whether it does depends on
all that stands before it.  So the file is read as *units* with that separator, and:

1. every range says what it does to the reader's state, whatever that was at
   its begin: CSV, to "inside of quotes" or not; JSON, to "inside of a string" and the depth of brackets.
   One small row a range leaves the tasks;
2. the rows of a file are composed in order, which gives the state at the begin
   of every range;
3. each range cuts its units into records from its true state; what it holds of
   records that begin or end in other ranges is put together by a small group-by;
4. Spark's own CSV and JSON functions parse the records.

Quotes are handled as the CSV reader does it: a run of quotes opens a
field only at its begin, and inside of a quoted field an odd run ends it.  A record is
one value and so has to fit in memory; a file has any size.  Files that are
compressed as a whole are one range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE, _BACKSLASH, _NEWLINE = 34, 92, 10


class CsvUnits:
    """Lines; the state is 1 inside of a quoted field."""

    separator, start = "\n", 0

    def __init__(self, sep: str = ","):
        self.sep = ord(sep)

    def _runs(self, data: np.ndarray):
        """Begin and state (from 0, from 1) after every odd run of quotes; an even run changes nothing."""
        edge = np.flatnonzero(np.diff(data == _QUOTE, prepend=False, append=False))
        begin, size = edge[0::2], edge[1::2] - edge[0::2]
        begin = begin[size % 2 == 1]
        before = np.where(begin > 0, data[begin - 1], _NEWLINE)
        swaps = (before == self.sep) | (before == _NEWLINE)  # at the begin of a field it opens or closes, elsewhere it can only close
        closed = np.maximum.accumulate(np.where(swaps, -1, np.arange(len(begin)))) if len(begin) else begin
        n = np.cumsum(swaps)
        known = (n - n[closed]) % 2
        return begin, [np.where(closed >= 0, known, (s + n) % 2) for s in (0, 1)]

    def summary(self, data, ends, known):
        """What ``data`` does to each state, after what ``known`` does."""
        _, after = self._runs(data)
        known = known or (0, 1)
        return tuple(int(after[s][-1]) if len(after[s]) else s for s in known)

    def apply(self, summary, state):
        return summary[state]

    def boundary(self, state) -> bool:
        return state == 0

    def cut(self, data, ends, state):
        """Does a record end with each unit?  And the state at the end of ``data``."""
        begin, after = self._runs(data)
        states = np.concatenate([[state], after[state]])
        at = states[np.searchsorted(begin, ends)]
        return at == 0, int(at[-1])


class JsonUnits:
    """Text up to and with a ``}``; the state is (inside of a string, depth of brackets)."""

    separator, start = "}", (0, 0)

    def _steps(self, data: np.ndarray):
        """Inside of a string after each byte (from outside), and the change of depth outside and inside."""
        plain = np.where(data != _BACKSLASH, np.arange(len(data)), -1)
        last = np.concatenate([[-1], np.maximum.accumulate(plain)[:-1]])
        quote = (data == _QUOTE) & ((np.arange(len(data)) - 1 - last) % 2 == 0)
        inside = np.cumsum(quote) % 2
        change = ((data == 123) | (data == 91)).astype(np.int64) - ((data == 125) | (data == 93))
        return inside, change

    def summary(self, data, ends, known):
        inside, change = self._steps(data)
        total = [int(change[inside == s].sum()) for s in (0, 1)]  # from outside of a string, from inside
        flips = int(inside[-1])
        known = known or ((0, 0), (1, 0))
        return tuple((s ^ flips, depth + total[s]) for s, depth in known)

    def apply(self, summary, state):
        inside, depth = summary[state[0]]
        return inside, state[1] + depth

    def boundary(self, state) -> bool:
        return state == (0, 1)

    def cut(self, data, ends, state):
        inside, change = self._steps(data)
        inside = inside ^ state[0]
        depth = state[1] + np.cumsum(np.where(inside == 0, change, 0))
        at_inside, at_depth = inside[ends], depth[ends]
        return (at_inside == 0) & (at_depth == 1), (int(at_inside[-1]), int(at_depth[-1]))


def _units(spark: SparkSession, path: str, kind) -> DataFrame:
    lines = spark.read.option("lineSep", kind.separator).text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))


def _parts(batches, separator: str):
    """(file, range, bytes, offsets of the units): runs of units of one range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file").to_numpy(), batch.column("range").to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)], strict=True):
            value = batch.column("value").slice(a, b - a).cast(pa.large_string())
            joined = pc.binary_join_element_wise(value, pa.scalar("", pa.large_string()), pa.scalar(separator, pa.large_string()))
            offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
            data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            yield (int(file[a]), int(start[a])), data, offsets - offsets[0]


def _range_states(units: DataFrame, kind) -> dict:
    """(file, range) -> state at its begin, for the ranges that do not begin with a record."""

    def run(batches):
        at, known = None, None
        out = []
        for key, data, offsets in _parts(batches, kind.separator):
            if key != at and at is not None:
                out.append((*at, repr(known)))
                known = None
            at = key
            known = kind.summary(data, offsets[1:] - 1, known)
        if at is not None:
            out.append((*at, repr(known)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "range", "summary"])

    import ast

    states, file, state = {}, None, None
    # one row for each range: the input's bytes / spark.sql.files.maxPartitionBytes
    for r in units.mapInArrow(run, "file long, range long, summary string").orderBy("file", "range").toLocalIterator():
        if r.file != file:
            file, state = r.file, kind.start
        if r.range and not kind.boundary(state):
            states[r.file, r.range] = state
        state = kind.apply(ast.literal_eval(r.summary), state)
    return states


_RECORD = "file long, range long, begins boolean, ends boolean, head boolean, text string"
_NAMES = ["file", "range", "begins", "ends", "head", "text"]


def _records(units: DataFrame, kind, states: dict, boundary) -> DataFrame:
    """Records and, where ``begins`` or ``ends`` is false, parts of records; ``head``: the first one of a file."""

    def run(batches):
        at, state, begins, head, held = None, None, True, False, []

        def one(ends):
            text = pa.array([b"".join(held)]).cast(pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in (at[0], at[1], begins, ends, head)), text], _NAMES)

        for key, data, offsets in _parts(batches, kind.separator):
            if key != at:
                if held:
                    yield one(False)
                at, state = key, states.get(key, kind.start if key[1] == 0 else boundary)
                begins, head = key not in states, key[1] == 0
            done, state = kind.cut(data, offsets[1:] - 1, state)
            last = offsets[1:][done]  # ends of records
            if not len(last):
                held.append(data.tobytes())
                continue
            first = 0
            if held or not begins:
                held.append(data[: last[0]].tobytes())
                yield one(True)
                begins, head, first = True, False, 1
            ends = last if first else np.concatenate([[0], last])
            n = len(ends) - 1
            for k in range(0, n, 10_000):
                edge = ends[k : k + 10_001]
                text = pa.Array.from_buffers(pa.large_string(), len(edge) - 1, [None, pa.py_buffer((edge - edge[0]).astype(np.int64)), pa.py_buffer(data[edge[0] : edge[-1]].tobytes())]).cast(pa.string())
                m, yes = len(text), pa.array(np.ones(len(text), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, at[0])), pa.array(np.full(m, at[1])), yes, yes, pa.array((np.arange(m) == 0) & head), text], _NAMES)
                head = False
            if last[-1] < len(data):
                held.append(data[last[-1] :].tobytes())
        if held:
            yield one(False)

    return units.mapInArrow(run, _RECORD)


def _whole_records(spark: SparkSession, path: str, kind, boundary) -> DataFrame:
    """(text, head): the text of every record, and whether it is the first one of a file."""
    units = _units(spark, path, kind)
    states = _range_states(units, kind)
    parts = _records(units, kind, states, boundary)
    whole = parts.where("begins AND ends").select("text", "head")
    order = Window.partitionBy("file").orderBy("range", "begins")
    cut = parts.where("NOT (begins AND ends)").withColumn("no", F.sum(F.col("begins").cast("int")).over(order))
    joined = cut.groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("range", "begins", "text"))).alias("p"), F.bool_or("ends").alias("ends"), F.bool_or("head").alias("head"))
    return whole.unionAll(joined.where("ends").select(F.array_join(F.col("p.text"), "").alias("text"), "head"))


def read_csv_ranges(spark: SparkSession, path: str, schema=None, sep: str = ",") -> DataFrame:
    """S3 by byte ranges: as ``read_csv_notes``, and a file of any size is read by as many tasks as it has ranges.

    Every file begins with a header record.  Without a schema all columns are strings named by it.
    Line breaks inside of quotes stay as they are (the one-task reader turns CRLF into LF there if the file's lines end in CRLF).
    """
    options = {
        "sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
        "emptyValue": "", "nullValue": "\u0000",
    }
    head = spark.read.options(**(options | {"multiLine": "false"})).option("header", True)
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in head.csv(path).columns])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text = F.rtrim(F.col("text"), F.lit("\r\n"))
    rows = _whole_records(spark, path, CsvUnits(sep), 0).where(~F.col("head")).select(text.alias("text")).where(F.col("text") != "")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("text", ddl, options).alias("r")).select("r.*")


def read_json_array_ranges(spark: SparkSession, path: str, schema) -> DataFrame:
    """S2 by byte ranges: files that hold one array of objects each, of any size."""
    records = _whole_records(spark, path, JsonUnits(), (0, 1))
    text = F.ltrim(F.col("text"), F.lit("﻿[, \t\r\n"))
    return records.select(F.from_json(text, schema).alias("r")).select("r.*")
