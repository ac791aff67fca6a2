"""Metrics against direct Python computations."""

import math
import random

from pyspark.sql import functions as F

from scriptorium.operators import encode as E
from scriptorium.operators import metrics as M


def py_spans(tags):
    out, cur = [], None
    for i, t in enumerate(tags + ["O"]):
        typ = None if t == "O" else t[2:]
        prev = tags[i - 1] if i > 0 else None
        prev_typ = None if prev in (None, "O") else prev[2:]
        start = t != "O" and (t.startswith("B-") or prev is None or prev == "O" or prev_typ != typ)
        if cur is not None and (t == "O" or start):
            out.append((cur[0], cur[1], i - 1))
            cur = None
        if start:
            cur = (typ, i)
    return set(out)


def test_spans_match_python(spark):
    rnd = random.Random(7)
    choices = ["O", "B-x", "I-x", "B-y", "I-y"]
    seqs = [[rnd.choice(choices) for _ in range(rnd.randint(0, 25))] for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, tags array<string>")
    got = {r.i: {(x.type, x.start, x.end) for x in r.s} for r in df.select("i", M.spans(F.col("tags")).alias("s")).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == py_spans(s), s


def test_span_metrics_perfect_and_empty(spark):
    df = spark.createDataFrame([(["B-x", "I-x", "O"], ["B-x", "I-x", "O"]), (["O"], ["B-y"])], "g array<string>, p array<string>")
    r = M.span_metrics(df, "g", "p").first()
    assert (round(r.precision, 6), r.recall) == (0.5, 1.0)


def test_masked_cross_entropy(spark):
    rows = [([1.0, 2.0, 0.5], 1), ([0.0, 0.0, 3.0], 0), ([5.0, 1.0, 1.0], -100)]
    df = spark.createDataFrame(rows, "logits array<double>, label int")
    got = M.masked_cross_entropy(df, "logits", "label").first().loss

    def nll(l, y):
        m = max(l)
        return m + math.log(sum(math.exp(x - m) for x in l)) - l[y]

    assert abs(got - (nll(*rows[0]) + nll(*rows[1])) / 2) < 1e-12


def test_argmax_threshold(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9, 0.2],)], "v array<double>")
    r = df.select(M.argmax(F.col("v")).alias("a"), M.threshold(F.col("v")).alias("t")).first()
    assert r.a == 1 and list(r.t) == [0, 1, 1, 0]


def test_mask_shares_within_bounds(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.array_repeat(F.lit(9), 128).alias("ids"))
    m = E.mask_columns(df, "ids", "k", 42, 1005)
    z = m.select(F.explode(F.arrays_zip("masked_ids", "labels")).alias("z")).select("z.*")
    c = z.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("labels") != -100).alias("chosen"), F.count_if(F.col("masked_ids") == 4).alias("masked")).first()
    p = c.chosen / c.n
    assert abs(p - 0.2) < 4 * math.sqrt(0.2 * 0.8 / c.n)
    assert abs(c.masked / c.chosen - 0.8) < 4 * math.sqrt(0.8 * 0.2 / c.chosen)


def test_running_stats_hot_group(spark):
    # one group holds most rows: the running totals must still be exact
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("g"), F.col("id").alias("s"), F.lit(1.0).alias("v"))
    r = M.running_stats(df, "g", ["s"], "v").collect()
    by_g = {}
    for row in sorted(r, key=lambda x: x.s):
        by_g[row.g] = by_g.get(row.g, 0) + 1
        assert row.run_n == by_g[row.g] and row.run_sum == float(by_g[row.g])
