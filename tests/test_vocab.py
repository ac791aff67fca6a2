"""Vocabulary learning and encoding against plain Python."""

from collections import Counter

from pyspark.sql import functions as F

from scriptorium.operators import encode as E

TEXTS = ["low lower lowest low", "newer wider new new", "löw löwer ll lll"]


def py_merges(texts, rounds):
    words = Counter(w for t in texts for w in t.lower().split())
    table = {tuple(w): n for w, n in words.items()}
    out = []
    for _ in range(rounds):
        pairs = Counter()
        for sym, n in table.items():
            for a, b in zip(sym, sym[1:]):
                pairs[(a, b)] += n
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        out.append((a, b, n))
        new = {}
        for sym, cnt in table.items():
            res = []
            for s in sym:
                if res and res[-1] == a and s == b:
                    res[-1] = a + b
                else:
                    res.append(s)
            new[tuple(res)] = new.get(tuple(res), 0) + cnt
        table = new
    return out


def test_learn_merges_matches_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [(r.a, r.b, r.n) for r in E.learn_merges(df, "text", 6).orderBy("rank").collect()]
    assert got == py_merges(TEXTS, 6)


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(0, "b a b c"), (1, "a b zz")], "id int, text string")
    v = E.vocab_words(df, "text", 2)
    assert [(r.word, r.id, r.n) for r in v.orderBy("id").collect()] == [("b", 5, 3), ("a", 6, 2)]
    enc = E.encode_ids(df.select("id", E.lower_tokens("text").alias("t")), "t", v, "ids")
    assert {r.id: list(r.ids) for r in enc.collect()} == {0: [2, 5, 6, 5, 1, 3], 1: [2, 6, 5, 1, 3]}


def test_truncate_pad(spark):
    df = spark.createDataFrame([([7, 8, 9, 10],), ([7],)], "c array<int>")
    ids, mask = E.truncate_pad(F.col("c"), 5)
    rows = df.select(ids.alias("i"), mask.alias("m")).collect()
    assert [list(r.i) for r in rows] == [[2, 7, 8, 9, 3], [2, 7, 3, 0, 0]]
    assert [list(r.m) for r in rows] == [[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]]


def test_many_merges_in_few_rounds(spark):
    import random

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(80)) for _ in range(6)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r.a, r.b, r.n) for r in E.learn_merges(df, "text", 25).orderBy("rank").collect()]
    assert got == py_merges(texts, 25)


def test_independent_pairs():
    ranked = [("a", "b", 9), ("c", "d", 8), ("b", "e", 7), ("f", "g", 6)]
    assert E.independent_pairs(ranked, 4) == [("a", "b", 9), ("c", "d", 8)]
    assert E.independent_pairs([("a", "b", 9), ("c", "d", 7), ("b", "e", 7)], 4) == [("a", "b", 9)]
    assert E.independent_pairs([], 4) == []


def test_top_k_takes_ties_by_word(spark):
    df = spark.createDataFrame([(f"w{i:03d}", 5 if i < 3 else 1) for i in range(200)], "word string, n long")
    got = sorted(r.word for r in E.top_k_by_count(df, 10, "word", "n").collect())
    assert got == [f"w{i:03d}" for i in range(10)]
    plan = E.top_k_by_count(df, 10, "word", "n")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan


def test_large_vocabularies_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(0, ["b", "a", "zz", "b"]), (1, []), (2, None), (0, ["a"]), (3, ["zz", None])], "id int, t array<string>")
    v = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "word string, id int")
    want = sorted(((r.id, r.ids) for r in E.encode_ids(df, "t", v, "ids").collect()), key=str)
    monkeypatch.setattr(E, "SHIPPED", 2)
    assert sorted(((r.id, r.ids) for r in E.encode_ids(df, "t", v, "ids").collect()), key=str) == want
