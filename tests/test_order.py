"""W1 and everything built on it: index, splits, shards, batches, interleave."""

import math

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import mix, order


def _ids(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).alias("v"))


@pytest.mark.parametrize("parts", ["1", "8"])
def test_row_index_matches_sorted_positions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = _ids(spark, 500)
        out = order.row_index(df, ["v", "k"]).collect()
        expect = sorted(((r.v, r.k) for r in df.collect()))
        got = sorted(out, key=lambda r: r.idx)
        assert [r.idx for r in got] == list(range(500))
        assert [(r.v, r.k) for r in got] == expect
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_row_index_plan_has_no_single_partition(spark):
    df = order.row_index(_ids(spark, 100), ["k"])
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_splits_disjoint_and_complete(spark):
    df = _ids(spark, 1000)
    s = order.split_90_5_5(df, "k").collect()
    assert len(s) == 1000 and len({r.k for r in s}) == 1000
    counts = {}
    for r in s:
        counts[r.split] = counts.get(r.split, 0) + 1
    hold = math.ceil(1000 * 0.1)
    assert counts["train"] == 1000 - hold
    assert counts["test"] == math.ceil(hold * 0.5)
    assert counts["validation"] == hold - counts["test"]


def test_take_skip_is_stable(spark):
    df = _ids(spark, 300)
    a = {r.k for r in order.take_skip(df, 40, 9, "k").where("split = 'validation'").collect()}
    b = {r.k for r in order.take_skip(df, 40, 9, "k").where("split = 'validation'").collect()}
    assert a == b and len(a) == 40


def test_shards_formula_and_small_n(spark):
    df = _ids(spark, 23)
    got = {r.k: r.shard for r in order.shard_ids(df, ["k"], 5).collect()}
    per = 23 // 5
    assert got == {k: min(k // per, 4) for k in range(23)}
    small = {r.k: r.shard for r in order.shard_ids(_ids(spark, 3), ["k"], 5).collect()}
    assert small == {0: 0, 1: 1, 2: 2}


def test_batches_drop_incomplete_tail(spark):
    b = order.batches(_ids(spark, 70), ["k"], 32).collect()
    assert len(b) == 64
    assert {r.batch for r in b} == {0, 1}


def test_interleave_all_exhausted_and_partial(spark):
    a = spark.range(5).select(F.col("id").alias("x"))
    b = spark.range(2).select((F.col("id") + 100).alias("x"))
    full = sorted((r.pos, r.x) for r in mix.interleave([a, b], ["x", "x"]).collect())
    assert [x for _, x in full] == [0, 100, 1, 101, 2, 100, 3, 101, 4, 100]
    part = sorted((r.pos, r.x) for r in mix.interleave([a, b], ["x", "x"], partial_last_round=True).collect())
    assert [x for _, x in part] == [0, 100, 1, 101, 2, 100, 3, 101, 4]


def test_sample_n_matches_brute_force(spark):
    import hashlib

    df = _ids(spark, 257)
    keyed = sorted((hashlib.md5(f"5|{k}".encode()).hexdigest(), k) for k in range(257))
    for n in (0, 1, 17, 200, 256, 257, 400):
        got = sorted(r.k for r in order.sample_n(df, n, 5, "k").collect())
        assert got == sorted(k for _, k in keyed[:n]), n


def test_zero_row_inputs(spark):
    from scriptorium.operators.dedupe import dedupe_exact

    empty = spark.createDataFrame([], "k long, v long")
    assert order.row_index(empty, ["k"]).count() == 0
    assert order.split_90_5_5(empty, "k").count() == 0
    assert order.take_skip(empty, 5, 1, "k").count() == 0
    assert order.sample_n(empty, 5, 1, "k").count() == 0
    assert order.shard_ids(empty, ["k"], 4).count() == 0
    assert order.batches(empty, ["k"], 8).count() == 0
    assert dedupe_exact(empty.withColumn("t", F.lit("x")), "t", "k").count() == 0
    a = spark.range(3).select(F.col("id").alias("x"))
    got = sorted((r.pos, r.x) for r in mix.interleave([a, empty.select(F.col("k").alias("x"))], ["x", "x"]).collect())
    assert [x for _, x in got] == [0, 1, 2]


def test_epoch_orders_are_permutations(spark):
    for n in (1, 2, 3, 7, 100, 257, 1000):
        for epoch in (0, 1):
            o = order.EpochOrder(n, 42, epoch)
            places = [o.place(i) for i in range(n)]
            assert sorted(places) == list(range(n)) and all(o.row(p) == i for i, p in enumerate(places))
    df = spark.range(1000).withColumnRenamed("id", "i")
    for epoch in (0, 5):
        o = order.EpochOrder(1000, 42, epoch)
        got = {r.i: r.place for r in order.epoch_order(df, "i", 1000, 42, epoch).collect()}
        assert got == {i: o.place(i) for i in range(1000)}
    a, b = ([order.EpochOrder(1000, 42, e).place(i) for i in range(1000)] for e in (0, 1))
    assert sum(x == y for x, y in zip(a, b)) < 20 and sum(abs(x - y) < 3 for x, y in zip(a, a[1:])) < 30
    plan = order.epoch_order(df, "i", 1000, 42, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_epoch_batches_cover_an_epoch(spark):
    df = spark.range(70).withColumnRenamed("id", "i")
    found = [order.epoch_batch(df, "i", 70, 1, 3, b, 32) for b in range(4)]
    places = [sorted(r.place for r in f.collect()) for f in found]
    assert places == [list(range(32)), list(range(32, 64)), list(range(64, 70)), []]
    o = order.EpochOrder(70, 1, 3)
    assert all(o.place(r.i) == r.place for r in found[1].collect())
    assert "Exchange" not in found[0]._jdf.queryExecution().executedPlan().toString()


def test_epoch_orders_of_large_tables():
    n = 10**12 + 7
    o = order.EpochOrder(n, "s", 9)
    for i in (0, 1, 12345, n // 3, n - 1):
        assert 0 <= o.place(i) < n and o.row(o.place(i)) == i
