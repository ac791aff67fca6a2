"""Positional operators: W1 global index and everything built on it
(L1-L7, P10, K5 shard id, W5 batches).

Spark has no row order, so every positional operator takes an explicit,
*total* order key (add a unique id as the last key).  W1 never uses an
unpartitioned ``Window.orderBy`` (that funnels every row through one task):

1. the key columns alone go through ``repartitionByRange(key)`` +
   ``sortWithinPartitions(key)`` - partition ``p`` holds a contiguous key range, sorted;
2. ``spark_partition_id`` and ``monotonically_increasing_id`` give
   (partition, rank within partition);
3. the result is checkpointed to the shared checkpoint folder, because the
   range bounds come from sampling and a re-evaluation could move rows;
4. per-partition counts (one row per partition: a size bound known up front)
   become prefix offsets, broadcast back;
5. the other columns are joined back by the key, once.

Cost: one range shuffle and one checkpoint of keys, one tiny aggregate, one join.  No payload is
sampled, checkpointed or computed twice.  Splits (L3-L6) need no index: they compare a digest
with a bound.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded_digest
from ..session import checkpoint

_SHIFT = 1 << 33  # monotonically_increasing_id = partition << 33 | row


def indexed(df: DataFrame, order, out: str = "idx", keep=None) -> tuple[DataFrame, int]:
    """Adds a dense 0-based ``out`` column following ``order`` (column names, together unique);
    returns (df, row count).  ``keep(column) -> condition`` filters positions before the join back."""
    spark = df.sparkSession
    keys = [order] if isinstance(order, str) else list(order)
    ranged = df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    tagged = checkpoint(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    # one row per partition: a size bound known before the job runs
    counts = sorted((r["_pid"], r["_n"]) for r in tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, total = [], 0
    for pid, cnt in counts:
        offsets.append((pid, total))
        total += cnt
    # an Arrow table needs no Python worker on the executors
    off_df = spark.createDataFrame(pa.table({"_pid": pa.array([p for p, _ in offsets], pa.int32()), "_off": pa.array([o for _, o in offsets], pa.int64())}))
    idx = tagged.join(F.broadcast(off_df), "_pid").withColumn(out, F.col("_off") + F.col("_mid") - F.col("_pid").cast("bigint") * F.lit(_SHIFT))
    if keep is not None:
        idx = idx.where(keep(F.col(out)))
    if set(df.columns) == set(keys):
        return idx.select(*df.columns, out), total
    idx = idx.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], out)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(idx[f"_k{i}"]) for i, k in enumerate(keys)])
    return df.join(idx, same).drop(*[f"_k{i}" for i in range(len(keys))]), total


def row_index(df: DataFrame, order, out: str = "idx") -> DataFrame:
    return indexed(df, order, out)[0]


def seeded_key(seed, key: str) -> Column:
    """L2 order key: md5(seed|key); ties broken by the key itself."""
    return seeded_digest(seed, key)


def seeded_order(df: DataFrame, seed, key: str, out: str = "idx") -> DataFrame:
    """L2: reproducible shuffle = W1 over (md5(seed|key), key)."""
    return row_index(df.withColumn("_sk", seeded_key(seed, key)), ["_sk", key], out).drop("_sk")


#: Rows of the last digest bucket that are sorted to find a bound.
_SORTED_ROWS = 10_000


def first_n_bound(df: DataFrame, n, seed, key: str):
    """The n-th smallest (md5(seed|key), key) pair, or None when n >= row count.

    ``n`` may be a function of the row count.  A histogram over the next four
    hex digits of the digest (at most 65,536 rows reach the driver) names the
    bucket that holds the n-th pair; it is refined until the bucket is small,
    and only that bucket is sorted.  Nothing else is moved, whatever n is.
    """
    keyed = df.select(seeded_key(seed, key).alias("_sk"), F.col(key))
    prefix, left = "", None
    while True:
        inside = keyed.where(F.col("_sk").startswith(prefix)) if prefix else keyed
        hist = sorted((r["p"], r["count"]) for r in inside.groupBy(F.substring("_sk", len(prefix) + 1, 4).alias("p")).count().collect())
        if left is None:
            total = sum(c for _, c in hist)
            left = n(total) if callable(n) else n
            if left <= 0:
                return ("", None)
            if left >= total:
                return None
        for digits, size in hist:
            if left <= size:
                break
            left -= size
        prefix += digits
        if size <= _SORTED_ROWS or len(prefix) == 32:
            break
    rows = keyed.where(F.col("_sk").startswith(prefix)).orderBy("_sk", key).limit(left)
    last = rows.orderBy(F.col("_sk").desc(), F.col(key).desc()).limit(1).collect()
    return (last[0][0], last[0][1])


def _within(bound) -> Column:
    tk, tid = bound
    return (F.col("_sk") < F.lit(tk)) | ((F.col("_sk") == F.lit(tk)) & (F.col("_key_") <= F.lit(tid)))


def _inside(bound) -> Column:
    """Is a row (columns ``_sk``, ``_key_``) among the first n?"""
    if bound is None:
        return F.lit(True)
    return F.lit(False) if bound[1] is None else _within(bound)


def take_skip(df: DataFrame, n, seed, key: str, out: str = "split", take_name: str = "validation", rest_name: str = "train") -> DataFrame:
    """The ``n`` first rows of the seeded order vs the rest.

    The bound is found once (``first_n_bound``) and every row is labelled by
    comparing with it - no join, and membership cannot drift between calls.
    """
    bound = first_n_bound(df, n, seed, key)
    keyed = df.withColumn("_sk", seeded_key(seed, key)).withColumn("_key_", F.col(key))
    return keyed.withColumn(out, F.when(_inside(bound), F.lit(take_name)).otherwise(F.lit(rest_name))).drop("_sk", "_key_")


def sample_n(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """The first ``n`` rows of the seeded order (exact)."""
    bound = first_n_bound(df, n, seed, key)
    keyed = df.withColumn("_sk", seeded_key(seed, key)).withColumn("_key_", F.col(key))
    return keyed.where(_inside(bound)).drop("_sk", "_key_")


def fraction_split(df: DataFrame, test_size: float, seed, key: str, out: str = "split", test_name: str = "test", train_name: str = "train") -> DataFrame:
    """L5 (one level): ``ceil(n * test_size)`` first rows of the seeded order are test."""
    return take_skip(df, lambda n: math.ceil(n * test_size), seed, key, out, test_name, train_name)


def split_90_5_5(df: DataFrame, key: str, seeds=(42, 43), out: str = "split") -> DataFrame:
    """L5 nested: 90 % train; the 10 % holdout is split again in half with the
    second seed: ``ceil(m / 2)`` rows -> test, the rest -> validation.

    The corpus scripts use seed 42 both times (``recipes.SplitFractions`` does
    too); with equal seeds the halves are the two halves of one seeded order.
    """
    first = take_skip(df, lambda n: math.ceil(n * 0.1), seeds[0], key, out, "holdout", "train")
    held = first.where(F.col(out) == "holdout").select(key)
    bound = first_n_bound(held, lambda n: math.ceil(n * 0.5), seeds[1], key)
    keyed = first.withColumn("_sk", seeded_key(seeds[1], key)).withColumn("_key_", F.col(key))
    half = F.when(_inside(bound), F.lit("test")).otherwise(F.lit("validation"))
    return keyed.withColumn(out, F.when(F.col(out) == "train", F.col(out)).otherwise(half)).drop("_sk", "_key_")


def select_ranges(df: DataFrame, order, ranges, out: str = "idx") -> DataFrame:
    """P10: keep rows whose position is in any half-open range ``[a, b)``.

    Only the keys are indexed; positions are filtered before the rows are joined.
    """

    def wanted(i):
        return reduce(lambda x, y: x | y, [(i >= a) & (i < b) for a, b in ranges])

    return indexed(df, order, out, keep=wanted)[0]


def shard_ids(df: DataFrame, order, shards: int, out: str = "shard") -> DataFrame:
    """K5: contiguous sharding: ``per = N // S``; row i -> ``min(i // per, S - 1)``;
    with N < S every row gets its own shard."""
    ordered, n = indexed(df, order, "_i")
    per = n // shards
    sid = F.col("_i") if per == 0 else F.least(F.floor(F.col("_i") / per).cast("bigint"), F.lit(shards - 1).cast("bigint"))
    return ordered.withColumn(out, sid).drop("_i")


def batches(df: DataFrame, order, batch_size: int, out: str = "batch", pos: str = "pos") -> DataFrame:
    """Fixed-size batches in order; the incomplete last batch is dropped."""
    ordered, n = indexed(df, order, "_i")
    full = (n // batch_size) * batch_size
    return (
        ordered.where(F.col("_i") < full)
        .withColumn(out, F.floor(F.col("_i") / batch_size).cast("bigint"))
        .withColumn(pos, (F.col("_i") % batch_size).cast("bigint"))
        .drop("_i")
    )


# ---------------------------------------------------------------- a new order for every epoch (L2), without a sort

#: FIXED VALUES of the mixing step: odd multipliers below 2^31, and shifts.
_MIX = ((0x45D9F3B, 15), (0x2C1B3C6D, 13))
_M31 = (1 << 31) - 1
_FEISTEL_ROUNDS = 6


class EpochOrder:
    """A keyed permutation of the positions 0 .. n - 1, another one for every (seed, epoch).

    A Feistel network permutes the numbers of as many bits as n - 1 has, and a result of n or
    more is permuted again until it is below n (cycle walking), which makes a permutation of
    0 .. n - 1.  Every row computes its own place: nothing is sorted or shuffled, however many
    epochs there are, and the inverse names the rows of a batch.
    """

    def __init__(self, n: int, seed, epoch):
        import hashlib

        if not 0 <= n <= 1 << 60:
            raise ValueError("0 to 2^60 rows")
        self.n = n
        bits = max(2, (n - 1).bit_length() if n else 2)
        self.right = bits // 2
        self.masks = ((1 << (bits - self.right)) - 1, (1 << self.right) - 1)
        self.keys = [int(hashlib.md5(f"{seed}|{epoch}|{r}".encode()).hexdigest()[:7], 16) for r in range(_FEISTEL_ROUNDS)]

    def _mixed(self, x, key: int):
        x = (x ^ key) & _M31
        for factor, shift in _MIX:
            x = (x * factor) & _M31
            x = x ^ (x >> shift)
        return x

    def _rounds(self, x, keys):
        """Numbers or arrays of them."""
        left, right = x >> self.right, x & self.masks[1]
        for r, key in keys:
            if r % 2 == 0:
                left = left ^ (self._mixed(right, key) & self.masks[0])
            else:
                right = right ^ (self._mixed(left, key) & self.masks[1])
        return left << self.right | right

    def place(self, position: int) -> int:
        """Where the row at ``position`` comes in this epoch."""
        x = self._rounds(position, list(enumerate(self.keys)))
        while x >= self.n:
            x = self._rounds(x, list(enumerate(self.keys)))
        return x

    def row(self, place: int) -> int:
        """The position of the row that comes at ``place``: the inverse of ``place``."""
        back = list(reversed(list(enumerate(self.keys))))
        x = self._rounds(place, back)
        while x >= self.n:
            x = self._rounds(x, back)
        return x

    def places(self, position: Column) -> Column:
        """``place`` as a column: one Arrow batch at a time in numpy (nested expressions of six rounds do not pass the analyser)."""
        n, keys, rounds = self.n, list(enumerate(self.keys)), self._rounds

        @F.arrow_udf("long")
        def place(at: pa.Array) -> pa.Array:
            x = rounds(at.to_numpy(zero_copy_only=False).astype(np.int64), keys)
            while len(out := np.flatnonzero(x >= n)):
                x[out] = rounds(x[out], keys)
            return pa.array(x)

        return place(position.cast("long"))


def epoch_order(df: DataFrame, position: str, n: int, seed, epoch, out: str = "place") -> DataFrame:
    """L2 for training: every row's place in an epoch, from its position (W1, dense from 0)."""
    return df.withColumn(out, EpochOrder(n, seed, epoch).places(F.col(position)))


def epoch_batch(df: DataFrame, position: str, n: int, seed, epoch, batch: int, size: int, out: str = "place") -> DataFrame:
    """The rows of one batch of an epoch, by their positions: a pushed-down filter on ``size`` values, no shuffle."""
    order = EpochOrder(n, seed, epoch)
    places = {order.row(p): p for p in range(batch * size, min(n, (batch + 1) * size))}
    if not places:
        return df.where("false").withColumn(out, F.lit(0).cast("long"))
    named = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    return df.where(F.col(position).isin(*places)).withColumn(out, named[F.col(position)].cast("long"))
