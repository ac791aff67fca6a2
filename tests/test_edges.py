"""Inputs that once gave wrong answers: one test per case."""

import hashlib

import pytest
from pyspark.sql import functions as F
from scriptorium.operators import encode as E
from scriptorium.operators import metrics as M
from scriptorium.operators import mix, order
from scriptorium.operators import tasks as T
from scriptorium.sources import readers as R
from scriptorium.sources import sinks as K


def test_spans_of_tags_without_prefix(spark):
    tags = ["Participant", "Participant", "O", "Baseline", "Outcome", "Outcome", "B-x", "I-x", "I-y", "B-y"]
    df = spark.createDataFrame([(tags,)], "t array<string>")
    got = [(s.type, s.start, s.end) for s in df.select(M.spans(F.col("t")).alias("s")).first().s]
    assert got == [("Participant", 0, 1), ("Baseline", 3, 3), ("Outcome", 4, 5), ("x", 6, 7), ("y", 8, 8), ("y", 9, 9)]


def test_token_accuracy_of_unequal_lengths(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a", "a"], ["a", "a", "x"])], "g array<string>, p array<string>")
    assert M.token_accuracy(df, "g", "p").first().accuracy == 0.75


def test_running_mean_keeps_the_null_group(spark):
    log = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), (0, 1, 1.0), (0, 2, 3.0), (1, 5, 9.0)], "epoch int, step int, loss double")
    got = {(r.epoch, r.step): r.running_mean for r in M.loss_running_mean(log).collect()}
    assert got == {(None, 1): 2.0, (None, 2): 3.0, (0, 1): 1.0, (0, 2): 2.0, (1, 5): 9.0}
    buckets = {(r.epoch, r.bucket): r.mean_loss for r in M.loss_bucket_mean(log, 2).collect()}
    assert buckets == {(None, 0): 3.0, (0, 0): 2.0}


def test_csv_keeps_blanks_empty_strings_and_nulls(spark, tmp_dir):
    rows = [("1", "  lead and trail  "), ("2", ""), ("3", None), ("4", 'quo"te,\nline'), ("5", " ")]
    for sep in (",", "\t"):
        path = K.write_csv(spark.createDataFrame(rows, "k string, v string"), f"{tmp_dir}/csv{ord(sep)}", sep)
        r = R.read_csv_notes(spark, path) if sep == "," else None
        if r is not None:
            assert sorted(map(tuple, r.collect())) == rows


def test_xml_abstract_edges(spark, tmp_dir):
    els = [
        ('<AbstractText Label="A"/><AbstractText>foo</AbstractText>', ["", "foo"]),
        ("<AbstractText>&#945; &#x3b2;&#x1F642; &amp;lt; &bogus;</AbstractText>", ["α β🙂 &lt; &bogus;"]),
        ("<AbstractText><![CDATA[a < b & <i>c</i>]]> d</AbstractText>", ["a < b & <i>c</i> d"]),
        ('<AbstractText a="x/y">one<!-- no --> <b>two</b></AbstractText ><AbstractTexts>no</AbstractTexts>', ["one two"]),
        ("<AbstractText></AbstractText><AbstractText\n/>", ["", ""]),
    ]
    recs = [(f"<PubmedArticle><PMID>{i}</PMID>{x}</PubmedArticle>",) for i, (x, _) in enumerate(els)]
    path = K.write_lines(spark.createDataFrame(recs, "value string"), "value", f"{tmp_dir}/xml", compression="gzip")
    got = {}
    for r in sorted(R.read_xml_abstracts(spark, path).collect(), key=lambda r: (r.pmid, r.idx)):
        got.setdefault(int(r.pmid), []).append(r.text)
    assert got == {i: want for i, (_, want) in enumerate(els)}


def test_last_line_wins_over_files_of_different_size(spark, tmp_dir):
    import os

    os.makedirs(f"{tmp_dir}/ents")
    with open(f"{tmp_dir}/ents/a.tsv", "w") as f:
        f.write("d\tT1\tfirst\n")
    with open(f"{tmp_dir}/ents/b.tsv", "w") as f:
        f.write("short line\n" + "".join(f"x{i}\tT1\tfiller\n" for i in range(5000)) + "d\tT1\tlast\n")
    rows = R.read_bounded_tsv(spark, f"{tmp_dir}/ents", ["doc_id", "entity_id", "text"])
    assert {r.doc_id: r.text for r in T.latest_entities(rows).collect()}["d"] == "last"
    assert [r.value for r in R.rejected_tsv_lines(spark, f"{tmp_dir}/ents", 3).collect()] == ["short line"]


def test_strict_relations(spark):
    abstracts = spark.createDataFrame([("d", "text")], "doc_id string, text string")
    ents = spark.createDataFrame([("d", "T1", "a", 1)], "doc_id string, entity_id string, text string, line_no long")
    rels = spark.createDataFrame([("d", "g", "Arg1:T1", "Arg2:T2")], "doc_id string, grp string, arg1 string, arg2 string")
    assert T.relation_join(abstracts, ents, rels).count() == 0
    with pytest.raises(KeyError):
        T.relation_join(abstracts, ents, rels, strict=True)
    schema = "_text string, entity array<struct<_id:string,_text:string>>, pair array<struct<_e1:string,_e2:string,_ddi:string,_type:string>>"
    two = [("s", [("e1", "a"), ("e1", "b"), ("e2", "c")], [("e1", "e2", "true", "t"), ("e2", "e2", "true", "t")])]
    got = T.ddi_relations(spark.createDataFrame(two, schema)).collect()
    assert [r.sample for r in got] == ["find relation between entities - c and c in s"]
    with pytest.raises(Exception, match="not exactly one entity"):
        T.ddi_relations(spark.createDataFrame(two, schema), strict=True).collect()


def test_interleave_spreads_a_one_row_source(spark):
    one = spark.createDataFrame([("only",)], "x string")
    many = spark.range(20_000).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("x"))
    out = mix.interleave([one, many], ["x", "x"])
    rows = out.select("pos", "x", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 40_000 and all((r.x == "only") == (r.pos % 2 == 0) for r in rows)
    assert len(mix.interleave([one, many], ["x", "x"])._jdf.queryExecution().toString()) > 0
    salts = {(r.pos // 2) % mix.SALTS for r in rows if r.x == "only"}
    assert len(salts) == mix.SALTS


def test_bound_is_found_in_several_steps(spark, monkeypatch):
    monkeypatch.setattr(order, "_SORTED_ROWS", 1)
    df = spark.range(3000).withColumnRenamed("id", "k")
    keyed = sorted((hashlib.md5(f"5|{k}".encode()).hexdigest(), k) for k in range(3000))
    for n in (1, 2, 1500, 2999):
        assert order.first_n_bound(df, n, 5, "k") == keyed[n - 1]
    assert order.first_n_bound(df, 3000, 5, "k") is None


def test_index_reads_the_payload_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def heavy(x):
        calls.add(1)
        return f"v{x}"

    df = spark.range(1000).select(F.col("id").alias("k"), heavy("id").alias("v"))
    order.row_index(df, ["k"]).write.format("noop").mode("overwrite").save()
    assert calls.value == 1000


def test_mask_hashes_each_position_once(spark):
    df = spark.createDataFrame([(1, list(range(2, 60)) + [0] * 40)], "k long, ids array<int>")
    m = E.mask_columns(df, "ids", "k", 42, 100)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 1
    r = m.first()
    assert all(a == b and c == -100 for a, b, c in zip(r.ids[58:], r.masked_ids[58:], r.labels[58:]))
