"""Operator 6: SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code.  64 bits are taken as two parts
of 31 bits (the two bits left over are not needed); two fingerprints that
differ in at most t bits differ in at most t // 2 bits in one of the parts.  In
each part the anchors are the words of the perfect Hamming code of length 31,
whose covering radius is 1: every value has one anchor at distance 0 or 1, its
home.  A fingerprint is replicated to every anchor within covering radius plus
threshold of the part, 1 + t // 2: so at the home of the one fingerprint of a
linked pair the other is there too.  Per anchor, the fingerprints at home are
compared with all that are there, by all 64 bits.

Equal fingerprints are one before they are replicated.  Copies for anchors that
are nobody's home are not sent: a bit table of fixed size (``HOME_BITS``, the
same for any input) says which may be; a false hit costs a row, none is missed.
Inside an anchor, links become one star per local component, so the rows that
leave it are fewer than those that came.  An anchor with more than
``BLOCK`` fingerprints is cut into blocks, and the pairs of blocks are dealt to
tasks of their own.

Defined results: a null or empty text has fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; rows that repeat an
id and a text get equal results; a null id never becomes a component id unless
all of its component's are null; an empty table gives an empty one; extra
columns pass through ``with_fingerprint`` (its own column replaces a clashing one).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bittable
from .common import append_columns, binary_texts, written
from .components import connected_components

PART_BITS = 31
PART_SHIFTS = (0, 32)
#: log2 of the bits in the table of homes: 2^26 bits are 8 MB, whatever the input.
HOME_BITS = 26
#: Fingerprints of an anchor compared in one task.
BLOCK = 32_768
#: Anchor copies made at a time.
_STEP = 8_192


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash over the XXH64 of word shingles; only A-Z change case (``bytes.lower``)."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 1:
        return digest(joined, seed)
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    ends = starts + [len(w) for w in words]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):  # a very long text needs no more memory than this
        j = min(n, i + 65_536)
        pairs = zip(starts[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > n].sum(dtype=np.uint64))


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """Append the fingerprint of every whole text as a long with the same 64 bits."""

    def run(batch):
        found = np.array([fingerprint(x, shingle) for x in binary_texts(batch.column(text_col))], np.uint64)
        return [pa.array(found.view(np.int64))]

    return append_columns(df, [T.StructField(out_col, T.LongType())], run)


def syndrome(values: np.ndarray) -> np.ndarray:
    """Xor of the 1-based positions of the set bits: 0 for a word of the Hamming code."""
    out = np.zeros(len(values), np.uint64)
    for bit in range(5):
        mask = np.uint64(sum(1 << p for p in range(PART_BITS) if (p + 1) >> bit & 1))
        out |= (np.bitwise_count(values & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(bit)
    return out


@lru_cache(maxsize=8)
def _steps(radius: int) -> list[np.ndarray]:
    """For each syndrome, what to flip to reach every code word within ``radius``."""
    found: list[list[int]] = [[] for _ in range(32)]
    for k in range(radius + 1):
        for at in combinations(range(PART_BITS), k):
            s = 0
            for p in at:
                s ^= p + 1
            found[s].append(sum(1 << p for p in at))
    return [np.array(x, np.uint64) for x in found]


def homes(fps: np.ndarray, part: int) -> np.ndarray:
    """The nearest anchor of each fingerprint in a part, as a key that holds the part."""
    x = (fps >> np.uint64(PART_SHIFTS[part])) & np.uint64((1 << PART_BITS) - 1)
    s = syndrome(x)
    flip = np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - np.uint64(1)).astype(np.uint64), np.uint64(0))
    return (x ^ flip) | np.uint64(part << PART_BITS)


def anchors(fps: np.ndarray, part: int, threshold: int):
    """(row, anchor key) of every anchor within covering radius 1 plus the part's threshold."""
    x = (fps >> np.uint64(PART_SHIFTS[part])) & np.uint64((1 << PART_BITS) - 1)
    s = syndrome(x)
    rows, keys = [], []
    for value in range(32):
        at = np.flatnonzero(s == value)
        if len(at):
            flips = _steps(1 + threshold)[value]
            rows.append(np.repeat(at, len(flips)))
            keys.append((x[at][:, None] ^ flips[None, :]).ravel() | np.uint64(part << PART_BITS))
    return np.concatenate(rows), np.concatenate(keys)


def _all_homes(fps: np.ndarray) -> np.ndarray:
    return np.concatenate([homes(fps, part) for part in range(len(PART_SHIFTS))])


def _replicate(fps: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at all its anchors that somebody may have as home."""
    spread = fps.sparkSession.sparkContext.broadcast(bittable.build(fps.select("fp"), HOME_BITS, _all_homes))

    def run(batches):
        table = spread.value
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), _STEP):
                x = every[i : i + _STEP]
                for part in range(len(PART_SHIFTS)):
                    rows, keys = anchors(x, part, threshold)
                    there = bittable.present(table, keys, HOME_BITS)
                    rows, keys = rows[there], keys[there]
                    at_home = homes(x, part)[rows] == keys
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(x[rows].view(np.int64)), pa.array(at_home)], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _stars(fps: np.ndarray, links) -> tuple[list[int], list[int]]:
    """Links between row numbers -> one star per component: (member, smallest member)."""
    above = list(range(len(fps)))

    def top(i):
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for i, js in links:
        for r in {top(j) for j in js}:
            a = top(i)
            if r != a:
                above[max(a, r)] = min(a, r)
    members = [(i, top(i)) for i in range(len(fps))]
    return [int(fps[i]) for i, r in members if i != r], [int(fps[r]) for i, r in members if i != r]


def compare(fps: np.ndarray, at_home: np.ndarray, distance: int, others: np.ndarray | None = None, others_home: np.ndarray | None = None):
    """Stars of the links at one anchor, or of the links between two blocks of it."""
    every = fps if others is None else np.concatenate([fps, others])
    u = every.view(np.uint64)
    first = len(fps)

    def links():
        for i in np.flatnonzero(at_home):
            span = slice(0, len(every)) if others is None else slice(first, len(every))
            js = np.flatnonzero(np.bitwise_count(u[span] ^ u[i]) <= distance) + span.start
            yield int(i), js.tolist()
        if others is not None:
            for k in np.flatnonzero(others_home):
                js = np.flatnonzero(np.bitwise_count(u[:first] ^ u[first + k]) <= distance)
                yield int(first + k), js.tolist()

    return _stars(every, links())


_FOUND = "a long, b long, anchor long, block int, fps binary, homes binary"


def _found(a, b) -> pa.RecordBatch:
    n = len(a)
    nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *nothing], ["a", "b", "anchor", "block", "fps", "homes"])


def _per_anchor(copies: DataFrame, distance: int, block: int) -> DataFrame:
    """Stars of every anchor of at most ``block`` fingerprints; the blocks of larger ones."""

    def run(batches):
        def one(key, fps, at_home, number, more):
            if number == 0 and not more:
                if len(fps) > 1 and at_home.any():
                    return ("stars", *compare(fps, at_home, distance))
                return None
            return ("block", key, number, fps, at_home)

        def groups():
            key, fps, flags, size, number = None, [], [], 0, 0
            for batch in batches:
                k = batch.column(0).to_numpy()
                f = batch.column(1).to_numpy()
                h = batch.column(2).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                    if i == j:
                        continue
                    if key is None or k[i] != key:
                        if size:
                            yield one(key, np.concatenate(fps), np.concatenate(flags), number, False)
                        key, fps, flags, size, number = int(k[i]), [], [], 0, 0
                    while i < j:
                        if size == block:
                            yield one(key, np.concatenate(fps), np.concatenate(flags), number, True)
                            fps, flags, size, number = [], [], 0, number + 1
                        e = min(j, i + block - size)
                        fps.append(f[i:e])
                        flags.append(h[i:e])
                        size += e - i
                        i = e
            if size:
                yield one(key, np.concatenate(fps), np.concatenate(flags), number, False)

        a, b = [], []
        for x in groups():
            if x is None:
                continue
            if x[0] == "stars":
                a += x[1]
                b += x[2]
            else:
                _, key, number, fps, at_home = x
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([number], pa.int32()), pa.array([fps.tobytes()], pa.binary()), pa.array([at_home.tobytes()], pa.binary())],
                    ["a", "b", "anchor", "block", "fps", "homes"],
                )
            if len(a) > 50_000:
                yield _found(a, b)
                a, b = [], []
        if a:
            yield _found(a, b)

    dealt = copies.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _FOUND)


def _per_block_pair(blocks: DataFrame, distance: int) -> DataFrame:
    """Stars inside and between the blocks of the anchors that were cut."""
    mine = blocks.select("anchor", F.col("block").alias("i"), F.col("fps").alias("fi"), F.col("homes").alias("hi"))
    other = blocks.select("anchor", F.col("block").alias("j"), F.col("fps").alias("fj"), F.col("homes").alias("hj"))
    pairs = mine.join(other, "anchor").where("i <= j").repartition("anchor", "i", "j")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                f, h = np.frombuffer(r["fi"], np.int64), np.frombuffer(r["hi"], bool)
                if r["i"] == r["j"]:
                    a, b = compare(f, h, distance)
                else:
                    a, b = compare(f, h, distance, np.frombuffer(r["fj"], np.int64), np.frombuffer(r["hj"], bool))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp long) -> stars (a, b) whose components are those of all links."""
    found = written(_per_anchor(_replicate(fps, distance // 2), distance, block), "simhash-anchors")
    stars = found.where(F.col("block").isNull()).select("a", "b")
    blocks = found.where(F.col("block").isNotNull())
    return stars if blocks.isEmpty() else stars.unionAll(_per_block_pair(blocks, distance))


def simhash_components(fps: DataFrame, distance: int = 4, id_col: str = "doc_id", fp_col: str = "fingerprint", block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints of a table with ids -> (fp, component_id, component_fp).

    ``component_id`` is the smallest id of the component, ``component_fp`` the
    smallest fingerprint that this id has there.
    """
    distinct = written(fps.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("id")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, distance, block), "simhash")
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    member = written(member, "simhash-members")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first")
    named = member.groupBy("root").agg(first)
    return member.join(named, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.fp").alias("component_fp"))


def fingerprint_hex(col: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of the document that names its component; all input columns, one row per component."""
    marked = written(with_fingerprint(df, text_col, "__fp", shingle), "simhash-documents")
    found = simhash_components(marked.select(id_col, "__fp"), distance, id_col, "__fp")

    def key(i, fp):  # a null id leaves the fingerprint alone
        return F.concat_ws("/", i, F.hex(fp)).alias("__key")

    stay = found.where("fp = component_fp").select(key("component_id", "fp"))
    rows = marked.withColumn("__key", key(id_col, "__fp")).join(stay, "__key", "left_semi")
    return rows.dropDuplicates(["__key"]).drop("__fp", "__key")
