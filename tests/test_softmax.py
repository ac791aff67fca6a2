"""The tagger's regression on numbered tokens: the model of Spark ML, without a row for each token."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import functions as F

from scriptorium.functions.text import explode_rows
from scriptorium.ml import baselines as B
from scriptorium.ml import softmax
from scriptorium.ml import tokens as T


def _token_rows(df):
    """(k, pos, _f, _y): features and tag of every token, a row each."""
    rows = df.select("k", F.arrays_zip(F.col("w").alias("w"), F.col("t").alias("t")).alias("_z"), F.col("w").alias("_ws"))
    rows = explode_rows(rows, "_z", "z", pos="pos", keep=["k", "_ws"])
    ctx = F.array(
        F.concat(F.lit("w="), F.lower(F.col("z.w"))),
        F.concat(F.lit("p="), F.coalesce(F.lower(F.get(F.col("_ws"), F.col("pos") - 1)), F.lit("<s>"))),
        F.concat(F.lit("n="), F.coalesce(F.lower(F.get(F.col("_ws"), F.col("pos") + 1)), F.lit("</s>"))),
    )
    return rows.select("k", "pos", ctx.alias("_f"), F.col("z.t").alias("_y"))


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(8)
    words = ["Drug", "dose", "the", "of", "heart", "é", "日本語", "x" * 300, "ÀB", None]
    rows = []
    for i in range(120):
        n = rng.randint(0, 14)
        w = [rng.choice(words) for _ in range(n)]
        t = [rng.choice(["O", "B-x", None]) if x is None or rng.random() < 0.3 else {"Drug": "B-x", "dose": "I-x"}.get(x, "O") for x in w]
        rows.append((i, w, t))
    rows += [(500, None, ["O"]), (501, ["a"], None), (502, ["a", "b"], ["O"]), (503, ["a"], ["O", "B-x"]), (504, [], [])]
    return spark.createDataFrame(rows, "k long, w array<string>, t array<string>").coalesce(1)


def test_words_are_hashed_as_hashing_tf_does(spark):
    words = ["a", "ab", "abc", "abcd", "abcde", "é", "日本語", "<s>", "", "y" * 253, "y" * 254, "y" * 255, "z" * 1001, "\U0001f600x"]
    for features in (1 << 18, 1000):
        tf = HashingTF(numFeatures=features)
        assert T.hashed(pa.array(["cut", *words])[1:], features).tolist() == [[tf.indexOf(f"{r}={w}") for r in T.ROLES] for w in words]
    assert T.hashed(pa.array([], pa.string()), 16).shape == (0, 3)


def test_model_equals_spark_ml(spark, sequences):
    features = 24  # features of a token meet in one place now and then
    rows = _token_rows(sequences)
    rows = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows).transform(rows)
    rows = HashingTF(inputCol="_f", outputCol="features", numFeatures=features).transform(rows)
    # one block: a further one would begin with what is left of the one before in Spark's buffer of margins, where an intercept is 0
    expected = LogisticRegression(family="multinomial", maxIter=30, regParam=0.01, maxBlockSizeInMB=512).fit(rows)
    groups = T.token_groups(sequences.repartition(3), "w", "t", features)
    labels, _ = B._labels(groups)
    assert labels == ["B-x", "I-x", "O"]
    found = softmax.fit(groups, labels, features)
    assert np.allclose(found.history, list(expected.summary.objectiveHistory), rtol=1e-9)
    assert np.allclose(found.weights.T, expected.coefficientMatrix.toArray(), atol=1e-6)
    assert np.allclose(found.intercepts, expected.interceptVector.toArray(), atol=1e-6)


def test_groups_and_pieces_of_any_size_give_the_same_sums(monkeypatch, spark, sequences):
    batch = sequences.select(F.transform("w", F.lower).alias("w"), "t").toArrow().combine_chunks().to_batches()[0]
    labels, found = {"B-x": 0, "I-x": 1, "O": 2}, []
    sent = type("Sent", (), {"value": (np.random.default_rng(2).normal(size=(64, 4)), np.arange(4.0))})
    for piece, cuts in ((1 << 14, [0, len(batch)]), (5, [0, 30, 31, len(batch)])):
        for module in (T, softmax):
            monkeypatch.setattr(module, "PIECE", piece)
        groups = [T._group([batch.slice(a, b - a)], 64) for a, b in zip(cuts, cuts[1:])]
        for run in (softmax._counter(labels, 4, 64), softmax._expected(sent, 64)):
            found.append({b: np.frombuffer(s) for out in run(iter(groups)) for b, s in zip(out["block"].to_pylist(), out["sums"].to_pylist())})
    for one, other in zip(found[:2], found[2:]):
        assert one.keys() == other.keys() and all(np.allclose(one[b], other[b]) for b in one)


def test_tagged_sequences_as_before(spark, sequences):
    """Rows without a key, without words or tags are left out; rows of one key are one sequence, place by place."""
    twice = sequences.unionByName(sequences).unionByName(spark.createDataFrame([(None, ["a"], ["O"])], sequences.schema))
    _, test = B._split(twice.where("k is not null"), "k")
    gold = _token_rows(test).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "_y")))["_y"].alias("gold"))
    tagged = B.tagged(twice, "w", "t", "k", features=1 << 10)
    assert "Generate" not in tagged._jdf.queryExecution().executedPlan().toString()  # no row for each token
    out = tagged.collect()
    assert {r.k: r.gold for r in out} == {r.k: r.gold for r in gold.collect()} and len(out) == len({r.k for r in out}) > 10
    assert all(len(r.pred) == len(r.gold) and set(r.pred) <= {"B-x", "I-x", "O"} for r in out)


def test_one_tag_is_certain(spark):
    df = spark.createDataFrame([(i, ["a", "b"], ["O", "O"]) for i in range(20)], "k long, w array<string>, t array<string>")
    assert {tuple(r.pred) for r in B.tagged(df, "w", "t", "k", features=1 << 6).collect()} == {("O", "O")}
