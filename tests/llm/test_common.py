"""Helpers of the subpackage."""

import numpy as np
from pyspark.sql import functions as F
from scriptorium.llm import bittable, common


def test_bit_table_reports_all_that_is_there(spark):
    rng = np.random.default_rng(1)
    there = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    table = bittable.build(spark.createDataFrame([(int(x),) for x in there], "h long"), 16)
    assert table.nbytes == 1 << 13
    assert bittable.present(table, there.view(np.uint64), 16).all()
    other = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    assert bittable.present(table, other, 16).mean() < 0.1
    assert not bittable.build(spark.createDataFrame([], "h long"), 16).any()


def test_intermediate_tables_can_be_removed(spark):
    with common.named_since() as named:
        df = common.written(spark.range(10).withColumn("x", F.lit("a")), "t")
    common.written(spark.range(1), "other")
    assert df.count() == 10 and len(named) == 1
    assert common.remove_folders(spark, named) == 1 and common.remove_folders(spark, named) == 0


def test_clashing_names_are_replaced(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "x"), (None, None)], "a long, B string")
    out = common.append_columns(df, [T.StructField("b", T.LongType())], lambda batch: [pa.array([7] * batch.num_rows)])
    assert out.columns == ["a", "b"] and sorted((r.a or 0, r.b) for r in out.collect()) == [(0, 7), (1, 7)]


def test_tables_of_other_threads_are_not_ones_own(spark):
    import threading

    found = {}

    def work(name, wait, go):
        with common.named_since() as named:
            common.shared_folder(spark, name)
            go.set()
            wait.wait(10)
        found[name] = [n.rsplit("/", 1)[1].split("-")[0] for n in named]

    a, b = threading.Event(), threading.Event()
    threads = [threading.Thread(target=work, args=x) for x in (("one", a, b), ("two", b, a))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {"one": ["one"], "two": ["two"]}


def test_one_blas_thread_is_restored():
    import ctypes
    import glob
    import os

    def threads():
        found = []
        for lib in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
            get = getattr(ctypes.CDLL(lib), "scipy_openblas_get_num_threads64_", None)
            found += [get()] if get else []
        return found

    before = threads()
    with common.one_blas_thread():
        assert all(n == 1 for n in threads())
        assert (np.ones((50, 50)) @ np.ones((50, 50)) == 50).all()
    assert threads() == before
