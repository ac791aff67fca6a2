"""Task baselines trained with Spark ML (re-aim of the fine-tuning
scripts: the task tables and metrics are the same, the model is a linear one
that trains distributed on the same DataFrames).

Each function returns the metric DataFrame of the held-out split, computed
with the metric operators of this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import tokenise_ws
from ..operators import metrics as M
from ..operators.order import fraction_split
from ..session import bound_batches, checkpoint
from . import softmax
from .linear import fit_labels, label_scores
from .tokens import PIECE, ROLES, lengths, line_up, places, token_groups, vocabulary


def _split(df: DataFrame, key: str, seed=1337):
    s = fraction_split(df, 0.2, seed, key, test_name="test", train_name="train")
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def multiclass(df: DataFrame, text: str, target: str, key: str, features: int = 1 << 16) -> DataFrame:
    """B1: hashed term frequencies + IDF + multinomial logistic regression;
    returns accuracy and micro-F1 on the held-out 20 %."""
    data = df.select(key, tokenise_ws(F.lower(F.col(text))).alias("_tok"), F.col(target).alias("_y"))
    # every stage makes passes of its own: what they read is joined, cut up and hashed once
    data = checkpoint(HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features).transform(data).drop("_tok"))
    train, test = _split(data, key)
    pipe = Pipeline(
        stages=[
            StringIndexer(inputCol="_y", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"),
            IDF(inputCol="_tf", outputCol="features"),
            LogisticRegression(family="multinomial", maxIter=30, regParam=0.01),
        ]
    )
    pred = pipe.fit(train).transform(test)
    # with one label per row micro precision, recall and F1 are the accuracy: one pass over the predictions
    return M.accuracy(pred, "prediction", "label").select("accuracy", *[F.col("accuracy").alias(m) for m in ("precision", "recall", "f1")])


def multilabel(df: DataFrame, text: str, labels: list[str], key: str, features: int = 1 << 16) -> DataFrame:
    """B2: one binary logistic regression per label, all fitted in the same passes; scores
    thresholded at 0.5 (E12) and scored on positive references (A10)."""
    data = df.select(key, tokenise_ws(F.lower(F.col(text))).alias("_tok"), *labels)
    tf = HashingTF(inputCol="_tok", outputCol="features", numFeatures=features)
    data = tf.transform(data)
    train, test = _split(data, key)
    weights, _ = fit_labels(train, "features", labels, features)
    preds = label_scores(test, "features", weights)
    pv = F.transform("scores", lambda s: (s >= 0.5).cast("int"))
    rv = F.array(*[F.col(lab).cast("int") for lab in labels])
    return M.multilabel_positive(preds.select(pv.alias("pv"), rv.alias("rv")), "pv", "rv")


def pair_features(df: DataFrame, s1: str, s2: str) -> DataFrame:
    """Words of both sentences and distinct words in common (n1, n2, common)."""
    t1, t2 = tokenise_ws(F.lower(F.col(s1))), tokenise_ws(F.lower(F.col(s2)))
    return df.withColumn("n1", F.size(t1).cast("double")).withColumn("n2", F.size(t2).cast("double")).withColumn("common", F.size(F.array_intersect(t1, t2)).cast("double"))


def pair_model(df: DataFrame, s1: str, s2: str, score: str):
    """B3's model on all rows of ``df``, by the normal equations (three features and the intercept)."""
    feats = pair_features(df, s1, s2).select("n1", "n2", "common", F.col(score).cast("double").alias("label"))
    feats = VectorAssembler(inputCols=["n1", "n2", "common"], outputCol="features").transform(feats)
    return LinearRegression(solver="normal").fit(feats)


def pair_regression(df: DataFrame, s1: str, s2: str, score: str, key: str) -> DataFrame:
    """Word-overlap features + linear regression; Pearson on held-out pairs."""
    feats = pair_features(df, s1, s2).select(key, "n1", "n2", "common", F.col(score).cast("double").alias("label"))
    feats = VectorAssembler(inputCols=["n1", "n2", "common"], outputCol="features").transform(feats)
    train, test = _split(feats, key)
    pred = LinearRegression(maxIter=50).fit(train).transform(test)
    return M.pearson(pred, "prediction", "label")


def transition_weights(pairs: np.ndarray, labels: list[str]) -> np.ndarray:
    """log P(tag | tag before) - log P(tag), smoothed, of the counts of all (tag before, tag); row ``len(labels)`` is the sequence start.

    Transitions that IOB2 forbids (``I-x`` after anything but ``B-x`` and ``I-x``) are impossible.
    """
    n = pairs + 0.1
    weights = np.log(n / n.sum(axis=1, keepdims=True)) - np.log(n.sum(axis=0) / n.sum())
    for b, t in enumerate(labels):
        if t.startswith("I-"):
            for a, before in enumerate([*labels, ""]):
                if before not in (t, "B-" + t[2:]):
                    weights[a, b] = -np.inf
    return weights


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags for (positions, labels) scores; the last row of ``moves`` is the start."""
    return viterbi_all(scores, [len(scores)], moves).tolist()


def viterbi_all(scores: np.ndarray, sizes, moves: np.ndarray) -> np.ndarray:
    """``viterbi`` of many sequences, whose scores follow each other: one step for the same place of all of them."""
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # long ones first: those that reach a place are the first ones
    starts, sizes = starts[order], sizes[order]
    reach = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), "right")  # sequences of more than k places
    path = np.zeros(len(scores), np.int64)
    if not len(reach):
        return path
    back = np.zeros(scores.shape, np.int16)
    best = scores[starts[: reach[0]]] + moves[-1]
    for k in range(1, len(reach)):
        at = starts[: reach[k]] + k
        through = best[: reach[k], :, None] + moves[:-1]
        back[at] = through.argmax(axis=1)
        best[: reach[k]] = through.max(axis=1) + scores[at]
    tag = best.argmax(axis=1)
    for k in range(len(reach) - 1, -1, -1):
        at, now = starts[: reach[k]] + k, tag[: reach[k]]
        path[at] = now
        if k:
            tag[: reach[k]] = back[at, now]
    return path


def tagger(df: DataFrame, tokens: str, tags: str, key: str, features: int = 1 << 18, transitions: bool = True) -> DataFrame:
    """Multinomial logistic regression over each token's word and neighbours, joined by
    transition weights and decoded by Viterbi, so that only valid IOB2 comes out; entity-level F1 (A12) on
    held-out sequences.  Without ``transitions`` every token takes its own best tag."""
    return M.span_metrics(tagged(df, tokens, tags, key, features, transitions), "gold", "pred")


def tagged(df: DataFrame, tokens: str, tags: str, key: str, features: int = 1 << 18, transitions: bool = True) -> DataFrame:
    """(key, gold, pred) of the held-out sequences."""
    # the digest of its key says where a sequence belongs, so whole sequences are told apart before they become tokens; one without a key belongs nowhere
    train, test = _split(df.select(key, tokens, tags).where(F.col(key).isNotNull()), key)
    groups = token_groups(train, tokens, tags, features)
    labels, pairs = _labels(groups)
    model = softmax.fit(groups, labels, features)
    moves = transition_weights(pairs, labels) if transitions else np.zeros((len(labels) + 1, len(labels)))
    # a group is one document, which was one row before; several rows of a key are one sequence
    rows = test.groupBy(key).agg(F.collect_list(F.struct(F.transform(tokens, F.lower).alias("w"), F.col(tags).alias("t"))).alias("_d"))
    bound_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.intercepts))
    shape = StructType([df.schema[key], *[StructField(c, ArrayType(StringType())) for c in ("gold", "pred")]])
    return rows.mapInArrow(_decoder(sent, moves, labels, features), shape)


def _labels(groups: DataFrame) -> tuple[list[str], np.ndarray]:
    """Tags of all tokens, in ``StringIndexer``'s alphabetical order, and how often each follows each (last row: comes first)."""
    found = [(r["names"], np.frombuffer(bytes(r["seen"]), np.int64), np.frombuffer(bytes(r["moves"]), np.int64)) for r in groups.select("names", "seen", "moves").collect()]  # a row of some megabytes of tokens each
    labels = sorted({t for names, seen, _ in found for t, n in zip(names, seen, strict=True) if n}, key=lambda t: t.encode("utf-16-be", "surrogatepass"))
    place = {t: k for k, t in enumerate(labels)}
    pairs = np.zeros((len(labels) + 1, len(labels)))
    for names, _, moves in found:
        known = [k for k, t in enumerate(names) if t in place]
        at = [place[names[k]] for k in known]
        pairs[np.ix_([*at, len(labels)], at)] += moves.reshape(-1, len(names))[np.ix_([*known, len(names)], known)]
    return labels, pairs


def _decoder(sent, moves: np.ndarray, labels: list[str], features: int):
    """(key, gold, pred) of rows of (key, list of (words, tags))."""

    def scores(line: np.ndarray, found: pa.Array) -> np.ndarray:
        weights, intercepts = sent.value
        classes = len(intercepts)
        words = vocabulary(found, features)
        p = np.empty((len(line), classes))
        into, more = np.empty((PIECE, classes)), np.empty((PIECE, classes))
        for s in range(1, len(line) - 1, PIECE):
            own, at = np.unique(line[s - 1 : min(s + PIECE, len(line) - 1) + 1], return_inverse=True)
            n = len(at) - 2
            softmax.margins(np.take(weights, words[own].ravel(), axis=0), at * len(ROLES), into[:n], more[:n])
            p[s : s + n] = softmax.probabilities(into[:n] + intercepts)
        return p

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = batch.column(1)
        words, tags = (docs.flatten().field(c) for c in ("w", "t"))
        owner = np.repeat(np.arange(len(docs)), lengths(docs))
        both = np.asarray(pc.and_(words.is_valid(), tags.is_valid()).to_numpy(zero_copy_only=False), bool)
        words, tags, owner = words.filter(pa.array(both)), tags.filter(pa.array(both)), owner[both]
        tagged_ = lengths(tags)
        sizes = np.maximum(lengths(words), tagged_)
        line, starts, found = line_up(words, sizes)
        at = places(sizes, starts)
        p = scores(line, found)[at]
        gold = np.full(len(line), -1)
        gold[places(tagged_, starts)] = np.arange(int(tagged_.sum()))
        gold, of, pos = gold[at], np.repeat(owner, sizes), places(sizes, np.zeros(len(sizes), np.int64))
        tag = tags.flatten().take(pa.array(gold, pa.int64(), mask=gold < 0))
        if (np.diff(owner) == 0).any():  # rows of one key: their tokens by place, tag and probabilities
            rank = {t: k for k, t in enumerate(sorted((t for t in tag.unique().to_pylist() if t is not None), key=str.encode))}
            by_tag = np.array([rank.get(t, -1) for t in tag.to_pylist()])
            order = np.lexsort((*p.T[::-1], by_tag, pos, of))
            p, tag = p[order], tag.take(pa.array(order))
        sizes = np.bincount(of, minlength=len(docs))
        path = viterbi_all(np.log(np.maximum(p[:, : len(labels)], 1e-12)), sizes, moves)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        best = pa.array(labels, pa.string()).take(pa.array(path))
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, tag), pa.ListArray.from_arrays(ends, best)], [batch.schema.field(0).name, "gold", "pred"])
        return out.filter(pa.array(sizes > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield part(batch)

    return run
