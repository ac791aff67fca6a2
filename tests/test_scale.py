"""Steps that must not grow with one task, one batch or one lookup."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.functions.text import WHITESPACE, tokenise_ws
from scriptorium.ml.baselines import viterbi, viterbi_all
from scriptorium.operators import encode as E
from scriptorium.operators import tasks as T
from scriptorium.operators.lookup import row_lookup
from scriptorium.sources import ranges, sinks


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_file_is_written_by_all_tasks(spark):
    rows = [(i, f'a "{i}",\nb') for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    path = sinks.write_csv_file(df, sinks.scratch_path(spark, "one"))
    assert sorted((int(r.id), r.text) for r in ranges.read_csv_ranges(spark, path).collect()) == rows
    path = sinks.write_json_array_file(df, sinks.scratch_path(spark, "one"))
    assert sorted(map(tuple, ranges.read_json_array_ranges(spark, path, "id long, text string").collect())) == rows
    assert spark.read.text(path).inputFiles()[0].endswith("part-00000.txt") and len(spark.read.text(path).inputFiles()) == 1
    none = sinks.write_json_array_file(df.where("id < 0"), sinks.scratch_path(spark, "one"))
    assert "".join(r.value for r in spark.read.text(none).collect()) == "[]"


def test_words_as_python_splits_them(spark):
    texts = [f"{a}x{b}{c}­y{a}" for a, b, c in zip(WHITESPACE, reversed(WHITESPACE), WHITESPACE[3:] + WHITESPACE[:3], strict=True)] + ["", "   ", None, "a"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenise_ws("t").alias("w")).collect()
    assert all(r.w == (None if r.t is None else r.t.split()) for r in found)


def test_few_labels_need_no_join(spark):
    df = spark.createDataFrame([(1, ["a", "b", None, "z"]), (None, ["b"]), (3, None), (1, [])], "doc_id long, labels array<string>")
    dim = spark.createDataFrame([("a", 0), ("b", 1)], "label string, id int")
    out = T.encode_label_array(df, "labels", dim, "ids")
    assert "Join" not in _plan(out) and "ArrowEvalPython" not in _plan(out)
    assert [r.ids for r in out.collect()] == [[0, 1, -100, -100], [1], None, []]
    back = T.decode_label_array(out, "ids", dim, "names")
    assert [r.names for r in back.collect()] == [["a", "b", None, None], ["b"], None, []]


def test_many_labels_are_joined(spark):
    df = spark.createDataFrame([(1, ["l5", "l99", "x"])], "doc_id long, labels array<string>")
    dim = spark.range(100).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"), F.col("id").cast("int").alias("id"))
    assert T.encode_label_array(df, "labels", dim, "ids").first().ids == [5, 99, -100]


def test_batches_to_python_are_bounded(spark):
    row_lookup(F.array(F.lit("a")), F.array(F.struct(F.lit("a").alias("k"), F.lit("b").alias("v"))), "string")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(session.BATCH_BYTES)


def test_uniform_below_a_bound(spark):
    h = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("h"))
    for part, p in itertools.product(range(4), (0.0, 0.15, 0.5, 0.8, 1.0)):
        assert h.where(E._u_below(F.col("h"), part, p) != (E._u(F.col("h"), part) < p)).isEmpty()


def test_all_sequences_decoded_at_once():
    rng = np.random.default_rng(1)
    sizes, moves = [3, 0, 1, 4], rng.normal(size=(4, 3))
    scores = rng.normal(size=(sum(sizes), 3))
    found, at = viterbi_all(scores, sizes, moves).tolist(), 0
    for n in sizes:
        own = scores[at : at + n]
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(own[i, t] + moves[p[i - 1] if i else -1, t] for i, t in enumerate(p)))
        assert tuple(found[at : at + n]) == best and viterbi(own, moves) == list(best)
        at += n
