"""Relations, annotation, dedupe and label encoding on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import tasks as T
from scriptorium.operators.dedupe import dedupe_exact


def test_dedupe_keeps_highest_id_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "c")], "id int, t string")
    once = dedupe_exact(df, "t", "id")
    assert sorted(r.id for r in once.collect()) == [2, 4, 5]
    assert sorted(r.id for r in dedupe_exact(once, "t", "id").collect()) == [2, 4, 5]


def test_relation_join_last_wins_and_orphans(spark):
    abstracts = spark.createDataFrame([("d1", "text one"), ("d2", "text two")], "doc_id string, text string")
    ents = spark.createDataFrame(
        [("d1", "T1", "old", 1), ("d1", "T2", "beta", 2), ("d1", "T1", "alpha", 3), ("d2", "T1", "gamma", 4)],
        "doc_id string, entity_id string, text string, line_no long",
    )
    rels = spark.createDataFrame([("d1", "CPR:3", "Arg1:T1", "Arg2:T2"), ("d2", "CPR:4", "Arg1:T1", "Arg2:T9")], "doc_id string, grp string, arg1 string, arg2 string")
    out = T.relation_join(abstracts, ents, rels).collect()
    assert [(r.sample, r.target) for r in out] == [("find relation between entities - alpha and beta in text one", "CPR:3")]
    orphans = T.relation_orphans(abstracts, ents, rels).collect()
    assert [(r.doc_id, r.missing) for r in orphans] == [("d2", "arg2")]
    with pytest.raises(KeyError):
        T.relation_orphans(abstracts, ents, rels, strict=True)


def test_token_annotate_last_entry_wins(spark):
    ents = [("cats", "Participant"), ("dogs", "Outcome"), ("cats dogs", "Outcome"), ("cats", "Intervention")]
    df = spark.createDataFrame([("cats and  dogs cats", ents)], "text string, entities array<struct<text:string,annotation_type:string>>")
    r = T.token_annotate(df).first()
    assert list(r.tokens) == ["cats", "and", "dogs", "cats"]
    assert list(r.labels) == ["Intervention", "<ignore>", "Outcome", "Intervention"]


def test_label_dimension_and_encode(spark):
    df = spark.createDataFrame([(1, ["B-x", "O", "I-x"]), (2, ["B-y", "<ignore>"]), (3, [])], "doc_id long, labels array<string>")
    dim = T.label_dimension(df, "labels")
    assert [(r.label, r.id) for r in dim.orderBy("id").collect()] == [("B-x", 0), ("B-y", 1), ("I-x", 2), ("O", 3)]
    b2i = {r.label: r.i_id for r in T.b_to_i(dim).collect()}
    assert b2i == {"B-x": 2, "B-y": 1, "I-x": 2, "O": 3}
    enc = T.encode_label_array(df, "labels", dim, "ids")
    assert [list(r.ids) for r in enc.orderBy("doc_id").collect()] == [[0, 3, 2], [1, -100], []]
    dec = T.decode_label_array(enc, "ids", dim, "back").orderBy("doc_id").collect()
    assert [list(r.back) for r in dec] == [["B-x", "O", "I-x"], ["B-y", None], []]


def test_label_encode_strict_and_lenient(spark):
    dim = spark.createDataFrame([("a", 0), ("b", 1)], "label string, id int")
    df = spark.createDataFrame([("a",), ("c",)], "lab string")
    with pytest.raises(KeyError):
        T.label_encode(df, "lab", dim, strict=True)
    got = sorted((r.lab, r.label_id) for r in T.label_encode(df, "lab", dim, strict=False).collect())
    assert got == [("a", 0), ("c", -100)]


def test_bounded_tsv_split_keeps_tabs_in_last_field(spark, tmp_dir):
    from scriptorium.sources.readers import read_bounded_tsv

    path = f"{tmp_dir}/ents.tsv"
    with open(path, "w") as fh:
        fh.write("d1\tT1\tChemical\t0\t5\tname\twith\ttabs\nshort\tline\n\nd2\tT2\tGene\t1\t2\tplain\n")
    rows = read_bounded_tsv(spark, path, ["doc_id", "entity_id", "kind", "a", "b", "text"]).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("d1", "name\twith\ttabs"), ("d2", "plain")]


def test_dedupe_hot_duplicate_pre_aggregates(spark):
    # a third of all rows carry the same text
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("t"))
    out = dedupe_exact(df, "t", "id")
    rows = {r.t: r.id for r in out.collect()}
    assert rows["hot"] == 2997 and len(rows) == 2001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "SortAggregate" not in plan


def test_streaming_dedupe_over_increments(spark, tmp_dir):
    from scriptorium.streaming import ingest as S

    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    df.withColumn("part", F.col("doc_id") % 4).write.mode("overwrite").partitionBy("part").parquet(f"{tmp_dir}/inc")
    sink = S.dedupe(S.increments(spark, f"{tmp_dir}/inc", df.schema, max_files=1), "text", f"{tmp_dir}/sink", f"{tmp_dir}/ck")
    hashes = [r.h for r in spark.read.parquet(sink).collect()]
    assert len(hashes) == 7 and len(set(hashes)) == 7


def test_label_arrays_with_repeated_and_null_row_ids(spark):
    rows = [(1, ["a", "b"]), (1, ["c", "a", None, "zz"]), (1, ["a", "b"]), (None, ["b"]), (None, ["c"]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "doc_id long, labels array<string>")
    dim = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, id int")
    table = {"a": 0, "b": 1, "c": 2}
    enc = T.encode_label_array(df, "labels", dim, "ids")
    want = sorted(((r, None if x is None else [table.get(l, -100) for l in x]) for r, x in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in enc.collect()), key=str) == want
    back = T.decode_label_array(enc, "ids", dim, "back").collect()
    names = {i: l for l, i in table.items()}
    assert all(r.back is None if r.ids is None else r.back == [names.get(i) for i in r.ids] for r in back)


def test_row_lookup_last_entry_wins_and_long_rows(spark):
    import time

    from scriptorium.operators.lookup import row_lookup

    rows = [(["x", None, "y", "q"], [("x", "1"), ("y", None), ("x", "2"), (None, "3")]), (None, [("x", "1")]), ([], []), (["x"], []), (["y"], [("x", "5"), ("y", "6")])]
    df = spark.createDataFrame(rows, "k array<string>, e array<struct<k: string, v: string>>")
    got = [r.o for r in df.select(row_lookup(F.col("k"), F.col("e"), "string", "-").alias("o")).collect()]
    assert got == [["2", "-", None, "-"], None, [], ["-"], ["6"]]
    words = [f"w{i % 9000}" for i in range(60_000)]
    big = spark.createDataFrame([(" ".join(words), [(w, f"t{i}") for i, w in enumerate(words[:20_000])])], "text string, entities array<struct<text: string, annotation_type: string>>")
    t0 = time.time()
    r = T.token_annotate(big).first()
    assert time.time() - t0 < 20  # 60,000 tokens x 20,000 entries would be 1.2 billion comparisons
    last = {w: f"t{i}" for i, w in enumerate(words[:20_000])}
    assert r.labels == [last[w] for w in words]
