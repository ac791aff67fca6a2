"""Losses counted in the pass that makes the rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scriptorium.operators import observed as OB
from scriptorium.operators import tasks as T


def _relations(spark):
    abstracts = spark.createDataFrame([("d1", "text one"), ("d2", "text two")], "doc_id string, text string")
    ents = spark.createDataFrame([("d1", "T1", "old", 1), ("d1", "T2", "beta", 2), ("d1", "T1", "alpha", 3), ("d2", "T1", "gamma", 4), ("d3", "T1", "x", 5)], "doc_id string, entity_id string, text string, line_no long")
    rels = spark.createDataFrame([("d1", "g", "Arg1:T1", "Arg2:T2"), ("d2", "g", "Arg1:T1", "Arg2:T9"), ("d3", "g", "Arg1:T1", "Arg2:T1"), (None, "g", "Arg1:T1", "Arg2:T1"), ("d1", "g", "T1", None)], "doc_id string, grp string, arg1 string, arg2 string")
    return abstracts, ents, rels


def test_relation_counts_equal_the_orphans(spark):
    inputs = _relations(spark)
    rows, seen = OB.relation_join_counted(*inputs)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, T.relation_join(*inputs).collect()))
    want = {r["missing"]: r["count"] for r in T.relation_orphans(*inputs).groupBy("missing").count().collect()}
    assert seen.get == {"rows": 5, **want}
    with pytest.raises(PySparkException, match="missing entities"):
        OB.relation_join_counted(*inputs, strict=True)[0].collect()
    good = inputs[2].where("grp = 'g' AND doc_id = 'd1' AND arg2 IS NOT NULL")
    assert OB.relation_join_counted(inputs[0], inputs[1], good, strict=True)[0].count() == 1


def test_each_input_is_read_once(spark, tmp_dir):
    paths = []
    for i, df in enumerate(_relations(spark)):
        paths.append(f"{tmp_dir}/input{i}")
        df.write.parquet(paths[-1])
    rows, seen = OB.relation_join_counted(*(spark.read.parquet(p) for p in paths))
    rows.collect()
    plan = rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    scans = rows._jdf.queryExecution().sparkPlan().toString()
    assert all(scans.count(f"input{i}]") == 1 for i in range(3)) and "CollectMetrics" in plan
    assert seen.get["rows"] == 5


def test_labels_lines_pages_and_pairs(spark):
    dim = spark.createDataFrame([("a", 0), ("b", 1)], "label string, id int")
    df = spark.createDataFrame([("a",), ("c",), (None,)], "lab string")
    rows, seen = OB.label_encode_counted(df, "lab", dim)
    assert [(r.lab, r.label_id) for r in rows.collect()] == [("a", 0)] and seen.get == {"rows": 3, "unseen": 2}
    with pytest.raises(PySparkException, match="unseen label"):
        OB.label_encode_counted(df, "lab", dim, strict=True)[0].collect()
    lines = spark.createDataFrame([("a\tb\tc\td",), ("a\tb",), ("",), (None,)], "value string")
    rows, seen = OB.well_formed_lines(lines, 3)
    assert [r.parts for r in rows.collect()] == [["a", "b", "c\td"]] and seen.get == {"rows": 4, "rejected": 3}
    books = spark.createDataFrame([(["x", "", "y"],), (None,), (["z"],), ([],)], "pages array<string>")
    rows, seen = OB.pages_counted(books)
    assert [r.pages for r in rows.collect()] == [["x", "y"], ["z"], []] and seen.get == {"rows": 4, "without": 1, "with_blank": 1}
    ent = "array<struct<_id: string, _text: string>>"
    pair = "array<struct<_e1: string, _e2: string, _ddi: string, _type: string>>"
    pairs = [("e0", "e1", "true", "t"), ("e0", "e2", "true", "t"), ("e0", "e9", "true", "t"), ("e0", "e1", "false", "t"), (None, "e1", "true", "t")]
    s = spark.createDataFrame([(1, "text", [("e0", "A"), ("e1", "B"), ("e2", "C"), ("e2", "D")], pairs), (2, "none", None, None)], f"doc_id int, _text string, entity {ent}, pair {pair}")
    rows, seen = OB.ddi_relations_counted(s, keep=("doc_id",))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, T.ddi_relations(s, keep=("doc_id",)).collect()))
    assert seen.get == {"rows": 4, "ambiguous": 3}
