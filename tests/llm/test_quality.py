"""Operator 4: counts against plain Python, and the learner against a plain one over rows."""

import math
import random
import re

from pyspark.sql import functions as F
from scriptorium.llm import quality as R
from scriptorium.llm import queries as Q
from tests.llm.conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {j for starts in at.values() if len(starts) > 1 for i in starts for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


def test_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "a b c", "a b c d", "a b c a b c", "x x x x x x", "a b a b a", "é#* <é>\n\n é#* <é>\n\x0b\x85 y", "q\r\nq\r\n q\n", "\n".join(["l w"] * 5), "a b c " * 20_000, "🙂 🙂 🙂 🙂 | % $ &", "\x1c a\x1d b c d"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(100)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(1, "again", 1), (1, "again", 1)], "doc_id long, text string, quality int")
    out = R.with_statistics(df)
    assert out.columns == ["doc_id", "text", "quality"]
    for r in out.collect():
        want = plain_counts(r.text)
        assert {k: r.quality[k] for k in want} == want, r.text
        assert all(r.quality[f] is not None for f in R.FEATURES)
    assert R.with_statistics(df.limit(0)).count() == 0


def test_no_python_in_plan(spark):
    plan = R.with_statistics(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _made(spark, n=900):
    """Stats with one planted rule: many symbols and short lines are bad; 2 % of labels are wrong."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        s = {f: rng.random() for f in R.FEATURES}
        bad = s["symbols_per_word"] > 0.7 and s["words_per_line"] <= 0.5 or s["digit_share"] > 0.9
        rows.append((i, *[s[f] for f in R.FEATURES]))
        labels.append((i, int(not bad) if rng.random() > 0.02 else int(bad)))
    flat = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} double" for f in R.FEATURES))
    return flat.select("doc_id", F.struct(*R.FEATURES).alias("quality")), spark.createDataFrame(labels, "doc_id long, quality int"), rows, labels


def plain_rules(rows, labels, pruning, cuts, n_rules=8, n_conditions=4, least=5, precise=0.8):
    """The same list learned over Python rows."""
    data = [(dict(zip(R.FEATURES, r[1:], strict=True)), y == 0, r[0] in pruning) for r, (_, y) in zip(rows, labels, strict=True)]

    def met(conds, s):
        return all(s[f] > t if above else s[f] <= t for f, above, t in conds)

    def count(conds, fold=None):
        hit = [y for s, y, p in data if met(conds, s) and fold in (None, p)]
        return sum(hit), len(hit) - sum(hit)

    rules = []
    for _ in range(n_rules):
        grown = []
        for _ in range(n_conditions):
            p0, n0 = count(grown, False)
            best = None
            for f in R.FEATURES:
                for t in cuts[f]:
                    for above in (False, True):
                        p1, n1 = count([*grown, (f, above, t)], False)
                        if p0 and n0 and p1 >= least:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, (f, above, t)
            if best is None:
                break
            grown.append(best[1])
        if not grown:
            break

        def worth(k, grown=grown):
            p, n = count(grown[:k], True)
            return (p - n) / (p + n) if p + n else -2.0

        k = max(range(1, len(grown) + 1), key=lambda k: (worth(k), -k))
        (p, n), (pp, pn) = count(grown[:k]), count(grown[:k], True)
        if p / (p + n) < precise or pp + pn and pp / (pp + pn) < precise:
            break
        rules.append((grown[:k], p, n))
        data = [x for x in data if not met(grown[:k], x[0])]
    return rules


def test_learner_equals_plain(spark):
    stats, labels, rows, marks = _made(spark)
    got = R.learn_rules(stats, labels, n_bins=8)
    pruning = {r.doc_id for r in stats.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).collect()}
    at = [k / 8 for k in range(1, 8)]
    cuts = {}
    joined = stats.join(labels.withColumnRenamed("quality", "y"), "doc_id")
    for f in R.FEATURES:
        v = F.col("quality")[f]
        r = joined.agg(F.percentile_approx(v, at, 10_000).alias("a"), F.percentile_approx(F.when(F.col("y") == 0, v), at, 10_000).alias("b")).first()
        cuts[f] = sorted({*r.a, *r.b})
    want = plain_rules(rows, marks, pruning, cuts)
    assert [([(c.feature, c.above, c.threshold) for c in r.conditions], r.rejected, r.kept) for r in got] == want
    assert {c.feature for r in got for c in r.conditions} >= {"symbols_per_word", "digit_share"}
    hit = {r.doc_id for r in stats.where(R.verdict(got) > 0).collect()}
    right = sum((i in hit) == (y == 0) for i, y in marks)
    assert right / len(marks) > 0.9


def test_learner_edges(spark):
    stats, labels, _, _ = _made(spark, 60)
    assert R.learn_rules(stats, labels.limit(0)) == []
    assert R.learn_rules(stats, labels.withColumn("quality", F.lit(None).cast("int"))) == []
    assert R.learn_rules(stats, labels.withColumn("quality", F.lit(1))) == []
    assert R.learn_rules(stats.limit(0), labels) == []
    assert stats.where(R.verdict([]) == 0).count() == 60
    R.learn_rules(stats, labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 0), (10**9, 0)], "doc_id long, quality int")))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.QUERIES["op4_quality_rules"](spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = out.collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.9 * len(good)
