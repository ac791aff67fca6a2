"""Operator 7: exact substring dedup by a depth-limited radix sort of suffixes.

Removes every byte covered by a string of ``threshold`` bytes that also starts
anywhere else (same text included; texts are judged as given).  Two such strings
are equal suffixes to the depth of the threshold, so it is enough to sort the
suffixes that deep, digit by digit, and to drop a suffix as soon as it is alone
in its group: the groups left after the last digit are the repeated strings.

Which digits are taken first does not change the groups.  The first digit here is the most
selective one that all suffixes can be dealt by: the smallest-hash gram of
``gram`` bytes in the string (its anchor).  Neighbouring suffixes share their
anchor, so that about one row in 85 bytes stands for all suffixes around it:

1. all anchors are grouped by their gram; grams that occur once leave (a bit table of
   fixed size says which grams repeat; only anchors it reports are shuffled on);
2. the next digit is everything a suffix with this anchor can hold (the context).
   Equal contexts settle all their suffixes as repeated; they meet as partial counts;
3. where one gram has several contexts, one row per context goes on, with its bytes, and is
   sorted by one byte a pass, outwards from the anchor to both sides, singles
   dropping out; the suffix with o bytes before the anchor is repeated where its class to
   the left (o bytes) and to the right (threshold - o) are shared with another row.
   A gram with more than ``group_rows`` contexts is not collected: its rows are dealt
   again by a longer digit, for each half of the offsets, until the groups fit or the digit
   is the whole string.

Defined results: a null text counts as empty; a text shorter than the threshold
loses nothing; rows that repeat an id and a text are repeats of each other; null ids
are ids; all input columns are returned and clashing names replaced; an empty
table gives an empty one.  Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bittable
from .common import append_columns, binary_texts, written
from .tokenhash import mix

#: log2 of the bits in the table of repeated grams: 8 MB.
TABLE_BITS = 26
#: Contexts sorted at once in a task.
GROUP_ROWS = 20_000
GRAM = 32
_SLICE = 1 << 21
_B = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place on; ``gram`` is a power of two."""
    h, size, power = b.astype(np.uint64) + np.uint64(1), 1, _B
    while size < gram:
        h = h[:-size] * power + h[size:]
        with np.errstate(over="ignore"):
            power = power * power
        size *= 2
    return mix(h)


def anchor_places(raw: bytes, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: for every string of the threshold, its first smallest gram."""
    n = len(raw)
    places, hashes = [], []
    for start in range(0, max(0, n - threshold + 1), _SLICE):
        b = np.frombuffer(raw, np.uint8, min(n - start, _SLICE + threshold - 1), start)
        h = gram_hashes(b, gram)
        m = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, size = threshold - gram + 1, 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
        at = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        hashes.append(h[at])
        places.append(at + start)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _grams(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [anchor_places(x, threshold, gram)[1] for x in binary_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["gram"])

    return docs.select("__key", "__text").mapInArrow(run, "gram long")


def _contexts(docs: DataFrame, table, threshold: int, gram: int) -> DataFrame:
    """(gram, context, key, at) of the anchors whose gram may be repeated."""
    reach = threshold - gram

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys = batch.column(0).to_numpy()
            out = [[], [], [], []]
            for key, raw in zip(keys.tolist(), binary_texts(batch.column(1)), strict=True):
                at, h = anchor_places(raw, threshold, gram)
                there = bittable.present(table.value, h, TABLE_BITS)
                at = at[there].tolist()
                n = len(raw)
                out[0].append(h[there])
                # The seed holds how far the text reaches to both sides.
                out[1] += [digest(raw[a - reach : a + threshold], 0) if reach <= a <= n - threshold else digest(raw[max(0, a - reach) : a + threshold], 1 + min(a, reach) * (threshold + 1) + min(n - a, threshold)) for a in at]
                out[2] += [key] * len(at)
                out[3] += at
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.uint64), *out[0]]).view(np.int64)), pa.array(np.array(out[1], np.uint64).view(np.int64)), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                ["gram", "context", "key", "at"],
            )

    return docs.select("__key", "__text").mapInArrow(run, "gram long, context long, key long, at long")


def _dense(key: np.ndarray):
    """(class of each value, is it shared)."""
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    ids = np.cumsum(new) - 1
    shared = np.bincount(ids)[ids] > 1
    cls = np.empty(len(key), np.int64)
    cls[order] = ids
    both = np.empty(len(key), bool)
    both[order] = shared
    return cls, both


def _refine(cls: np.ndarray, digit: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """One pass: classes by one more digit; -1 for rows that are alone or have no such digit."""
    rows = np.flatnonzero((cls >= 0) & valid)
    out = np.full(len(cls), -1, np.int32)
    if len(rows):
        ids, shared = _dense(cls[rows].astype(np.int64) << 8 | digit[rows])
        out[rows[shared]] = ids[shared]
    return out


def _matrix(parts: list[bytes], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    flat = b"".join([p[::-1].ljust(width, b"\0") if backwards else p.ljust(width, b"\0") for p in parts])
    return np.frombuffer(flat, np.uint8).reshape(len(parts), width).T.copy(), sizes


def repeated_offsets(left: list[bytes], right: list[bytes], lo: int, hi: int, threshold: int) -> np.ndarray:
    """(row, offset - lo): is the string with that many bytes before the anchor shared with another row?

    ``left``: up to ``hi`` bytes before the anchor; ``right``: up to ``threshold - lo`` bytes from it on.
    """
    n = len(left)
    lefts, ln = _matrix(left, max(hi, 1), True)
    rights, rn = _matrix(right, threshold - lo, False)
    # What all offsets have in common comes first, as one long digit.
    core = threshold - hi
    common = [p[:core] + b"|" + q[len(q) - lo :] if lo else p[:core] for p, q in zip(right, left, strict=True)]
    _, ids = np.unique(np.array(common, dtype=object), return_inverse=True)
    cls, shared = _dense(ids.astype(np.int64))
    cls = np.where(shared & (rn >= core) & (ln >= lo), cls, -1).astype(np.int32)
    to_right = {core: cls}
    for r in range(core + 1, threshold - lo + 1):
        to_right[r] = _refine(to_right[r - 1], rights[r - 1], rn >= r)
    found = np.zeros((n, hi - lo + 1), bool)
    to_left = cls
    for o in range(lo, hi + 1):
        if o > lo:
            to_left = _refine(to_left, lefts[o - 1], ln >= o)
        rows = np.flatnonzero((to_left >= 0) & (to_right[threshold - o] >= 0))
        if len(rows):
            _, shared = _dense(to_left[rows].astype(np.int64) << 32 | to_right[threshold - o][rows])
            found[rows[shared], o - lo] = True
    return found


_SORTED = "key long, start long, stop long, group long, lo int, hi int, at long, left binary, right binary"
_DEALT = "group long, lo int, hi int, key long, at long, left binary, right binary"


def _sort_pass(rows: DataFrame, threshold: int, group_rows: int) -> DataFrame:
    """Covered spans (group null) of the groups that fit, and the rows of the others for the next pass."""

    def spans(lo, hi, keys, ats, lefts, rights):
        found = repeated_offsets(lefts, rights, lo, hi, threshold)
        edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
        r0, first = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        at, key = np.array(ats, np.int64), np.array(keys, np.int64)
        m = len(r0)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())]
        # Offsets first..stop-1: the strings start at at - offset.
        return pa.RecordBatch.from_arrays([pa.array(key[r0]), pa.array(at[r0] - (lo + stop - 1)), pa.array(at[r0] - (lo + first) + threshold), *none], _SORTED_NAMES)

    def further(lo, hi, rows):
        """Rows of a group that is too large: by a longer digit, or settled if the digit was all."""
        import xxhash

        m = len(rows)
        if lo == hi:
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] - lo for r in rows], pa.int64()), pa.array([r[1] - lo + threshold for r in rows], pa.int64()), *none], _SORTED_NAMES)
        mid = (lo + hi) // 2
        out = [[] for _ in range(7)]
        for a, b in ((lo, mid), (mid + 1, hi)):
            for key, at, left, right in rows:
                if len(left) < a or len(right) < threshold - b:
                    continue  # no string with these offsets fits into the text
                digit = xxhash.xxh3_64_intdigest(left[len(left) - a :] + right[: threshold - b], a * 1000 + b)
                for o, v in zip(out, (key, np.uint64(digit).view(np.int64).item(), a, b, at, left[max(0, len(left) - b) :], right[: threshold - a]), strict=True):
                    o.append(v)
        m = len(out[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary()), pa.array(out[6], pa.binary())],
            _SORTED_NAMES,
        )

    def run(batches):
        waiting, waiting_range = [], None  # whole groups, sorted together

        def flush():
            nonlocal waiting
            if waiting:
                lo, hi = waiting_range
                keys, ats, lefts, rights = zip(*waiting, strict=True)
                waiting = []
                yield spans(lo, hi, keys, ats, list(lefts), list(rights))

        group, mine, large = None, [], False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for g, lo, hi, key, at, left, right in zip(*columns, strict=True):
                if (lo, hi, g) != group:
                    if mine:
                        if large:
                            yield further(group[0], group[1], mine)
                        elif len(mine) > 1:
                            if waiting_range != group[:2] or len(waiting) + len(mine) > group_rows:
                                yield from flush()
                            waiting_range = group[:2]
                            waiting += mine
                    group, mine, large = (lo, hi, g), [], False
                mine.append((key, at, left, right))
                if len(mine) > group_rows:
                    large = True
                if large and len(mine) >= group_rows:
                    yield further(lo, hi, mine)
                    mine = []
        if mine:
            if large:
                yield further(group[0], group[1], mine)
            elif len(mine) > 1:
                if waiting_range != group[:2] or len(waiting) + len(mine) > group_rows:
                    yield from flush()
                waiting_range = group[:2]
                waiting += mine
        yield from flush()

    dealt = rows.repartition("group").sortWithinPartitions("lo", "hi", "group")
    return dealt.mapInArrow(run, _SORTED)


_SORTED_NAMES = ["key", "start", "stop", "group", "lo", "hi", "at", "left", "right"]


def repeated_spans(docs: DataFrame, threshold: int = 200, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` (__key long, __text) -> (key, start, stop): spans that together cover all repeated strings."""
    spark = docs.sparkSession
    reach = threshold - gram
    repeated = _grams(docs, threshold, gram).groupBy("gram").count().where("count > 1").select("gram")
    table = spark.sparkContext.broadcast(bittable.build(repeated, TABLE_BITS))
    anchors = written(_contexts(docs, table, threshold, gram), "suffix-anchors")

    classes = anchors.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    grams = classes.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
    useful = classes.join(grams.withColumnRenamed("gram", "g"), F.col("gram") == F.col("g")).where("n > 1 or contexts > 1")
    # A gram whose contexts are all repeated has nothing left to settle.
    useful = useful.select("gram", "context", (F.col("n") > 1).alias("settled"), "one", ((F.col("contexts") > 1) & (F.col("least") == 1)).alias("sort"))
    useful = written(useful, "suffix-classes")

    whole = anchors.join(useful.where("settled").select("gram", "context"), ["gram", "context"])
    spans = whole.select("key", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), (F.col("at") + threshold).alias("stop"))

    # The contexts' bytes: places per text (no more than the text has anchors), then the text.
    places = useful.where("sort").groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("one.at", "gram")).alias("places"))
    rows = docs.join(places, docs["__key"] == places["key"]).select("key", "__text", "places")

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for key, raw, found in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in found:
                    a = p["at"]
                    for o, v in zip(out, (p["gram"], key, a, raw[max(0, a - reach) : a], raw[a : a + threshold]), strict=True):
                        o.append(v)
                if len(out[0]) > 20_000:
                    yield rows_of(out)
                    out = [[] for _ in range(5)]
            yield rows_of(out)

    def rows_of(out):
        n = len(out[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, reach, np.int32)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())],
            ["group", "lo", "hi", "key", "at", "left", "right"],
        )

    left = rows.mapInArrow(cut, _DEALT)
    while True:
        done = written(_sort_pass(left, threshold, group_rows), "suffix-pass")
        spans = spans.unionAll(done.where("group is null").select("key", "start", "stop"))
        left = done.where("group is not null").select("group", "lo", "hi", "key", "at", "left", "right")
        if left.isEmpty():
            return spans


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 200, gram: int = GRAM, group_rows: int = GROUP_ROWS, spans_col: str = "removed_spans", kept_col: str = "kept") -> DataFrame:
    """Append the maximal removed byte spans and the bytes that are left (which may cut a character)."""
    added = {spans_col.lower(), kept_col.lower()}
    rest = [c for c in df.columns if c.lower() not in added]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(*rest, F.xxhash64(F.col(id_col), text).alias("__key"), text.alias("__text"))
    spans = repeated_spans(docs.select("__key", "__text"), threshold, gram, group_rows)
    lists = spans.groupBy(F.col("key").alias("__of")).agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    joined = docs.join(lists, docs["__key"] == lists["__of"], "left").drop("__of", "__key")

    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))

    def run(batch):
        texts, found = binary_texts(batch.column("__text")), batch.column("__spans").to_pylist()
        merged, kept = [], []
        for raw, spans in zip(texts, found, strict=True):
            runs = []
            for a, b in sorted((s["start"], min(s["stop"], len(raw))) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            merged.append([{"start": a, "stop": b} for a, b in runs])
            ends = [0, *[x for r in runs for x in r], len(raw)]
            kept.append(b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
        return [pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())]

    return append_columns(joined, [T.StructField(spans_col, kind), T.StructField(kept_col, T.BinaryType())], run).drop("__text", "__spans")
