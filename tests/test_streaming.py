"""Increments: archives read once, and the keep-highest-id rule over batches, restarts and replays."""

import io
import os
import random
import tarfile

from pyspark.sql import functions as F

from scriptorium.operators.dedupe import dedupe_exact
from scriptorium.plans.catalog import streaming
from scriptorium.sources import archives
from scriptorium.streaming import ingest as S


def _tar(path, members):
    with tarfile.open(path, "w:gz") as tf:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tf.addfile(info, io.BytesIO(text))


def test_archives_are_partitions_and_members_leave_in_batches(spark, tmp_dir, monkeypatch):
    for i in range(5):
        _tar(f"{tmp_dir}/a{i}.tar.gz", [(f"m{i}_{j}.txt", f"text {i} {j}\r\n".encode() + b"\xff" * (j == 0)) for j in range(40)])
    _tar(f"{tmp_dir}/other.tgz", [("x", b"no")])
    df = archives.read_tar_members(spark, tmp_dir)
    assert df.rdd.getNumPartitions() == 5
    got = {(r.archive.rsplit("/", 1)[-1], r.member): r.text for r in df.collect()}
    assert len(got) == 200 and got["a3.tar.gz", "m3_7.txt"] == "text 3 7\n" and got["a0.tar.gz", "m0_0.txt"] == "text 0 0\n"
    monkeypatch.setattr(archives, "MEMBER_CHARS", 30)
    sizes = [b.num_rows for b in archives.member_batches(tmp_dir, f"{tmp_dir}/a1.tar.gz")]
    assert sum(sizes) == 40 and max(sizes) <= 4
    assert archives.read_tar_members(spark, f"{tmp_dir}/none").count() == 0


def test_second_run_reads_only_new_archives(spark, tmp_dir):
    src, ck = f"{tmp_dir}/src", f"{tmp_dir}/ck"
    os.makedirs(src)
    _tar(f"{src}/b.tar.gz", [("1.txt", b"one")])
    S.ingest_batches(archives.stream_tar_members(spark, src), f"{tmp_dir}/sink", ck)
    _tar(f"{src}/a.tar.gz", [("2.txt", b"two")])  # later, but earlier by name
    _tar(f"{src}/c.tar.gz", [("3.txt", b"three")])
    for _ in range(2):
        S.ingest_batches(archives.stream_tar_members(spark, src), f"{tmp_dir}/sink", ck)
    rows = sorted((r.batch, r.text) for r in spark.read.schema(archives.SCHEMA + ", batch int").parquet(f"{tmp_dir}/sink").collect())
    assert rows == [(0, "one"), (1, "three"), (1, "two")]


def _increment(spark, folder, no, rows):
    spark.createDataFrame(rows, "doc_id long, text string, extra int").coalesce(1).write.parquet(f"{folder}/part={no:02d}")


def test_latest_rows_equal_w2_over_all_increments(spark, tmp_dir):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 300)
    rows = [(i, rng.choice(["a", "b", "c", "", None, f"own {i}"]), i % 7) for i in ids]
    folder, root, ck = (f"{tmp_dir}/{n}" for n in ("inc", "root", "ck"))
    schema = "doc_id long, text string, extra int"
    for part in range(6):
        _increment(spark, folder, part, rows[part * 50 : part * 50 + 50])
        if part in (1, 3, 5):  # a restart after every second increment
            S.dedupe_latest(S.increments(spark, folder, schema, max_files=1), "text", "doc_id", root, ck, compact_every=2)
            so_far = spark.createDataFrame(rows[: part * 50 + 50], schema)
            want = sorted(map(tuple, dedupe_exact(so_far, "text", "doc_id").collect()), key=str)
            got = sorted((tuple(r[c] for c in ("doc_id", "text", "extra")) for r in S.latest_rows(spark, root, "doc_id").collect()), key=str)
            assert got == want
    assert S._batches(spark, f"{root}/seen") == [2, 4]
    last = max(S._batches(spark, f"{root}/state"))
    batch = spark.createDataFrame(rows[250:], schema)
    S.store_latest(batch, last, "text", "doc_id", root, 2)  # a replay of the last batch
    got = sorted((tuple(r[c] for c in ("doc_id", "text", "extra")) for r in S.latest_rows(spark, root, "doc_id").collect()), key=str)
    assert got == want


def test_a_later_batch_may_hold_lower_ids(spark, tmp_dir):
    for no, rows in enumerate([[(5, "x")], [(3, "x"), (9, "y")], [(7, "x"), (8, "y")]]):
        S.store_latest(spark.createDataFrame(rows, "doc_id long, text string"), no, "text", "doc_id", tmp_dir)
    assert sorted(r.doc_id for r in S.latest_rows(spark, tmp_dir, "doc_id").collect()) == [7, 9]
    replaced = spark.read.schema(S._STATE).parquet(f"{tmp_dir}/state/batch=2").where(F.col("replaced").isNotNull()).collect()
    assert [(r.id, r.replaced) for r in replaced] == [(7, 5)]


def test_one_increment_for_each_task_of_the_scan(spark, tmp_dir):
    rows = [(i if i % 50 else None, f"text {i % 150}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_dir}/documents")
    paths = [f"{tmp_dir}/documents/{n}" for n in sorted(os.listdir(f"{tmp_dir}/documents")) if n.endswith(".parquet")]
    df = spark.read.parquet(paths[0])
    for p in paths[1:]:
        df = df.unionAll(spark.read.parquet(p))  # a scan of six tasks
    assert df.rdd.getNumPartitions() == 6
    folder, schema = streaming._single_increments(spark, df, "inc")
    parts = [os.path.join(d, n) for d, _, names in os.walk(folder.removeprefix("file:")) for n in names if n.endswith(".parquet")]
    found = [spark.read.schema(schema).parquet(p).collect() for p in parts]
    # seven or eight: six tasks are dealt as two for each of four parts; rows without an id have a folder of their own
    assert len(parts) <= 9 and sorted(((r.doc_id, r.text) for f in found for r in f), key=str) == sorted(rows, key=str)
    assert all(len({r.doc_id % 4 if r.doc_id is not None else None for r in f}) == 1 for f in found)


def test_the_digests_seen_are_one_scan(spark, tmp_dir):
    for no in range(7):
        S.store_latest(spark.createDataFrame([(no, f"t{no % 4}")], "doc_id long, text string"), no, "text", "doc_id", tmp_dir, 3)
    seen = S._seen(spark, tmp_dir, 6)
    assert seen._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(r.id for r in seen.collect()) == [2, 3, 4, 5]
