"""B1-B4 on made data whose answer is known, so the metrics have bounds."""

import random

import numpy as np
from pyspark.sql import functions as F

from scriptorium.ml import baselines as B


def test_multiclass_learns_a_marker_word(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([f"mark{i % 3}"] + [rng.choice("abcdefgh") for _ in range(6)]), f"c{i % 3}") for i in range(240)]
    r = B.multiclass(spark.createDataFrame(rows, "k long, t string, y string"), "t", "y", "k", features=1 << 10).first()
    assert r.accuracy == r.precision == r.recall == r.f1 > 0.95


def test_multilabel_learns_two_words(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(["good"] * a + ["bad"] * b + [rng.choice("abcdef") for _ in range(5)]), int(a), int(b)))
    r = B.multilabel(spark.createDataFrame(rows, "k long, t string, qa int, qb int"), "t", ["qa", "qb"], "k", features=1 << 10).first()
    assert r.f1 > 0.95


def test_pair_regression_finds_the_line(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        n1, n2, common = rng.randint(1, 9), rng.randint(1, 9), rng.randint(0, 5)
        s1 = [f"x{k}" for k in range(common)] + [f"l{k}" for k in range(n1)]
        s2 = [f"x{k}" for k in range(common)] + [f"r{k}" for k in range(n2)]
        rows.append((i, " ".join(s1), " ".join(s2), 2.0 * len(s1) - len(s2) + 0.5 * common))
    r = B.pair_regression(spark.createDataFrame(rows, "k long, a string, b string, s double"), "a", "b", "s", "k").first()
    assert r.pearson > 0.999


def test_tagger_learns_words_and_neighbours(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = [rng.choice(["drug", "dose", "the", "of", "heart"]) for _ in range(12)]
        tags = ["B-x" if w == "drug" else "I-x" if w == "dose" and k and words[k - 1] == "drug" else "O" for k, w in enumerate(words)]
        rows.append((i, words, tags))
    r = B.tagger(spark.createDataFrame(rows, "k long, w array<string>, t array<string>"), "w", "t", "k", features=1 << 12).first()
    assert r.f1 > 0.95


def test_all_labels_at_once_equal_single_fits(spark):

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from scriptorium.ml import linear

    rng = random.Random(3)
    rows = []
    for i in range(240):
        x = {j: rng.gauss(0, 1) for j in rng.sample(range(12), 5)}
        s = sum(v * (1 if j < 6 else -0.5) for j, v in x.items())
        rows.append((Vectors.sparse(12, sorted(x.items())) if i % 3 else Vectors.dense(Vectors.sparse(12, sorted(x.items())).toArray()), int(s + rng.gauss(0, 1) > 0), int(x.get(2, 0) > 0.1), int(rng.random() < 0.2)))
    df = spark.createDataFrame(rows, ["features", "a", "b", "c"]).repartition(5)
    weights, passes = linear.fit_labels(df, "features", ["a", "b", "c"], 12, reg=0.1, iterations=60, tolerance=1e-7)
    for k, lab in enumerate("abc"):
        m = LogisticRegression(labelCol=lab, regParam=0.1, standardization=False, maxIter=200, tol=1e-10).fit(df)
        assert np.allclose(weights[:-1, k], m.coefficients.toArray(), atol=2e-4) and abs(weights[-1, k] - m.intercept) < 2e-4
    more = df.select("features", *[F.col("abc"[i % 3]).alias(f"l{i}") for i in range(12)])
    _, passes_of_many = linear.fit_labels(more, "features", [f"l{i}" for i in range(12)], 12, reg=0.1, iterations=60, tolerance=1e-7)
    assert passes_of_many <= passes + 10  # four times the labels, about as many passes
    scores = linear.label_scores(df, "features", weights).select("features", "scores").collect()
    for r in scores[:20]:
        z = np.asarray(r.features.toArray()) @ weights[:-1] + weights[-1]
        assert np.allclose(r.scores, 1 / (1 + np.exp(-z)))


def test_viterbi_equals_enumeration():
    import itertools


    rng = np.random.default_rng(7)
    for n in (1, 2, 5):
        scores, moves = rng.normal(0, 1, (n, 4)), rng.normal(0, 1, (5, 4))
        moves[2, 1] = -np.inf

        def value(path):
            return moves[-1, path[0]] + sum(moves[a, b] for a, b in itertools.pairwise(path)) + sum(scores[i, t] for i, t in enumerate(path))

        assert B.viterbi(scores, moves) == list(max(itertools.product(range(4), repeat=n), key=value))


def test_tagger_gives_valid_tags_and_beats_single_tokens(spark):

    rng = random.Random(5)
    rows = []
    for i in range(160):  # a span begins with a word of its type and goes on over words that say nothing
        words, tags = [], []
        while len(words) < 14:
            kind = rng.choice(["x", "y", None])
            if kind is None:
                words.append(rng.choice(["the", "of", "and"]))
                tags.append("O")
            else:
                words.append({"x": "gene", "y": "drug"}[kind])
                tags.append("B-" + kind)
                for _ in range(2):
                    words.append(rng.choice(["w1", "w2"]))
                    tags.append("I-" + kind)
        rows.append((i, words, tags))
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>, gold array<string>")
    out = B.tagged(df, "tokens", "gold", "doc_id", features=1 << 12).collect()
    assert len(out) == 32
    for r in out:
        assert len(r.pred) == len(r.gold)
        for before, t in zip(["O", *r.pred], r.pred):
            assert not t.startswith("I-") or before in (t, "B-" + t[2:])
    with_moves = B.tagger(df, "tokens", "gold", "doc_id", features=1 << 12).collect()[0]
    alone = B.tagger(df, "tokens", "gold", "doc_id", features=1 << 12, transitions=False).collect()[0]
    assert with_moves["f1"] > alone["f1"] and with_moves["f1"] > 0.95
