"""Operator 8: counts and base scores against plain Python, the model against its own definitions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from scriptorium.llm import attention as A
from scriptorium.llm import lmscore as M
from scriptorium.llm import queries as Q


def tokens(text):
    return (text or "").encode().lower().split()


def plain(rows):
    """(id, text) rows -> held_out, n_tokens, n_known, train_tokens, base_score."""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter()
    for i, t in rows:
        if not out(i):
            c.update(tokens(t) + [None])
    n, v = sum(c.values()), len(c)
    res = []
    for i, t in rows:
        w = tokens(t) + [None]
        res.append((out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return res


def _rows():
    rng = random.Random(4)
    vocabulary = ["the", "of", "é", "longerword"] + [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 300])]) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "The THE the"), (904, "z" * 30_000), (905, "a b " * 60_000), (None, "no id"), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("listed", [M.LISTED, 20])
def test_counts_and_base(spark, monkeypatch, listed):
    monkeypatch.setattr(M, "LISTED", listed)
    rows = _rows()
    df = spark.createDataFrame([(i, t, 1.0, "k") for i, t in rows], "doc_id long, text string, score double, tokens string").repartition(5)
    out = M.lm_scores(df, share=2)
    assert out.columns == ["doc_id", "text", "tokens", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    want = dict(zip([(i, t) for i, t in rows], plain(rows), strict=True))
    for r in got:
        w = want[r.doc_id, r.text]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score < 0
    assert M.lm_scores(df.limit(0)).count() == 0


def test_pieces():
    c = M.cut(b"The cat  thecathe x\xc3\xa9\n")
    assert len(set(c.hashes.tolist())) == 4 and c.lengths.tolist() == [3, 3, 8, 3]
    name = lambda x: (int(x & 0xFFFFFFFF).to_bytes(4, "little")[: int(x >> 32) & 15], bool(int(x) >> 36 & 1))
    assert [name(int(x)) for x in M.pieces(c.lengths, c.letters)] == [(b"the", True), (b"cat", True), (b"thec", False), (b"athe", True), ("xé".encode(), True)]
    assert [int(x).to_bytes(6, "big").rstrip(b"\0") for x in c.starts()] == [b"the", b"cat", b"thecat", "xé".encode()]
    keys, word = M.byte_sequences(np.array([2, 1]), np.frombuffer(b"abc", np.uint8).astype(np.uint64))
    a, b, z, end = ord("a") + 1, ord("b") + 1, ord("c") + 1, 257
    number = lambda *x: sum(y << 9 * k for k, y in enumerate(reversed(x)))
    assert keys.tolist() == [number(0, 0, 0, a), number(0, 0, a, b), number(0, a, b, end), number(0, 0, 0, z), number(0, 0, z, end)]
    assert word.tolist() == [0, 0, 0, 1, 1]
    long = b"ab cde " * 400_000
    parts = list(M.slices([b"x", long, b"", b"y z"]))
    assert [(i, j) for i, j, *_ in parts] == [(0, 1), (1, 2), (2, 4)]
    assert len(parts[1][2].hashes) == 800_000 and parts[2][3].tolist() == [0, 2]


def test_kept_company():
    """Counts, and the group that most occurrences of a word are in."""
    texts = [b"the cat the dog", b"le chat le cat cat cat", b"", b"the end the cat the"]
    [(_, _, c, ends)] = M.slices(texts)
    kinds, n, place = M.kept_company(c, ends)
    name = {int(h): w for h, w in zip(c.hashes, b" ".join(texts).split(), strict=True)}
    assert {name[int(k)]: int(x) for k, x in zip(kinds, n, strict=True)} == Counter(b" ".join(texts).split())
    group = {name[int(k)]: int(p) >> 48 for k, p in zip(kinds, place, strict=True)}
    of = {w: int(h) >> 49 for h, w in name.items()}
    assert group == {b"the": of[b"the"], b"dog": of[b"the"], b"end": of[b"the"], b"cat": of[b"cat"], b"le": of[b"cat"], b"chat": of[b"cat"]}


def _vocabulary(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    v = M.read_words(M.count_words(df))
    return texts, M.read_units(v, _unit_counts(df, v))


def _unit_counts(df, v):
    return M.read_into_units(df.withColumn("part", F.lit(0).cast("long")), v)[0]


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(M, "LISTED", 200)
    texts, v = _vocabulary(spark)
    assert 50 < len(v.listed) <= 200 and v.others > 0 and 0 < v.spell < 1
    share = Counter()
    for k, x in zip(v.klass.tolist(), v.inside.tolist(), strict=True):
        share[k] += 10**x
    assert all(s == pytest.approx(1) for s in share.values()) and max(share) < M.END_CLASS
    for context in ([0, 0, 0], [0, 0, ord("a") + 1], [ord("a") + 1, ord("b") + 1, ord("c") + 1], [9, 9, 9]):
        base = context[0] << 27 | context[1] << 18 | context[2] << 9
        assert (10.0 ** v.spelled(np.arange(1, 258) + base)).sum() == pytest.approx(1)
    assert np.allclose(np.exp(v.prior).sum(axis=1), 1, atol=1e-4)
    p = A.start(M.N_INPUTS, M.CLASSES, M.WIDTH)
    window, masked = A.blocks(np.arange(2 * A.BLOCK).reshape(2, A.BLOCK), np.array([True, False]))
    total = sum(np.exp(A.log_probabilities(p, A.tables(p), v.prior, window, masked, np.full((2, A.BLOCK), c))) for c in range(M.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {n: x.astype(np.float64) for n, x in A.start(9, 5, 4).items()}
    p["place"] += rng.standard_normal(p["place"].shape) * 0.1
    prior = rng.standard_normal((9, 5))
    window, masked = A.blocks(rng.integers(0, 9, (3, A.BLOCK)), np.array([True, False, True]))
    targets, weights = rng.integers(0, 5, (3, A.BLOCK)), rng.random((3, A.BLOCK)) > 0.2
    _, g = A.gradients(p, prior, window, masked, targets, weights)
    rows, own = g["embed"]
    g["embed"] = np.zeros(p["embed"].shape)
    g["embed"][rows] = own
    for name in A.NAMES:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            was, losses = p[name][at], []
            for d in (1e-5, -1e-5):
                p[name][at] = was + d
                losses.append(A.gradients(p, prior, window, masked, targets, weights)[0])
            p[name][at] = was
            assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=2e-5), name


def test_each_token_once_and_causal(spark, monkeypatch):
    monkeypatch.setattr(M, "LISTED", 150)
    texts, v = _vocabulary(spark)
    p = A.start(M.N_INPUTS, M.CLASSES, M.WIDTH)
    p["classes"] += np.random.default_rng(2).standard_normal(p["classes"].shape).astype(np.float32)
    made = A.tables(p)

    def score(ts):
        return np.concatenate([M._score(v, p, made, c, ends)[0] for _, _, c, ends in M.slices([t.encode() for t in ts])])

    together = score(texts + [""])
    alone = np.concatenate([score([t]) for t in texts + [""]])
    assert np.allclose(together, alone, atol=1e-3)
    # The plain reading: token by token, with the blocks it may see.
    ids, klass, inside, per_word, _, _ = v.units(M.cut(texts[0].encode()))
    assert per_word.min() == 1 and per_word.max() == 2 and (klass == -1).any()
    inputs, targets = [0, *ids.tolist()], [*klass.tolist(), M.END_CLASS]
    total = float(inside.sum())
    for t in range(len(targets)):
        if targets[t] < 0:
            continue  # a piece that must follow
        lo = max(0, t // A.BLOCK * A.BLOCK - A.BLOCK)
        keys = p["embed"][inputs[lo : t + 1]]
        e = p["embed"][inputs[t]]
        s = (e @ p["query"]) @ (keys @ p["key"]).T / math.sqrt(M.WIDTH) + p["place"][np.arange(t - lo, -1, -1)]
        a = np.exp(s - s.max())
        h = e + (a / a.sum()) @ (keys @ p["value"]) @ p["out"]
        assert np.abs(s).max() < A._LARGEST
        z = h @ p["classes"].T + p["bias"] + v.prior[inputs[t]]
        total += (z[targets[t]] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
    assert together[0] == pytest.approx(total, rel=1e-4)


def test_query(spark):
    out = Q.QUERIES["op8_lm_scores"](spark, "/root/testdata/sf0.01")
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    rows = out.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = dict(zip(docs, plain(list(docs.items())), strict=True))
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    assert all(r.score < 0 for r in rows)


def test_score_by_hand(spark, monkeypatch):
    """Without output weights, the score is the priors and the shares of the listed words."""
    monkeypatch.setattr(M, "LISTED", 6)
    texts = ["a b c d e f g h a b c a b", "a zz zz yy", "b a new", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.collect()
    train = df.where(~M.held_out("doc_id")).select("text")
    counts = M.count_words(train)
    v = M.read_words(counts)
    v = M.read_units(v, _unit_counts(train, v))
    p = A.start(M.N_INPUTS, M.CLASSES, M.WIDTH)
    p["classes"][:] = 0
    n = Counter(w for r in train.collect() for w in r.text.split())
    got = {r["__key"]: r for r in M.score_rows(df.selectExpr("doc_id as __key", "text as __text"), v, A.pack(p)).where("word is null").collect()}
    for r in rows:
        c = M.cut(r.text.encode())
        inputs, klass, inside, _, _, _ = v.units(c)
        before = [0, *inputs.tolist()]
        want = sum(v.prior[before[t], k] / math.log(10) + inside[t] for t, k in enumerate(klass.tolist()) if k >= 0) + v.prior[before[-1], M.END_CLASS] / math.log(10)
        assert got[r.doc_id].score == pytest.approx(want, rel=1e-5)
    assert v.others == sum(n.values()) - int(v.counts.sum())


def test_model_learns(spark):
    """Held-out texts of two word lists: context tells the list, so the model beats the base scores."""
    rng = random.Random(3)
    lists = [[f"{a}{i}" for i in range(40)] for a in "pq"]
    rows = [(i, " ".join(rng.choice(lists[i % 2]) for _ in range(200))) for i in range(400)]
    out = M.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), share=2).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_every_training_text_once(spark, monkeypatch):
    """The rounds together hand every training text to the gradient, none twice."""
    rows = [(i, f"text number n{i}") for i in range(300)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    given, parts = [], []

    def take(units, prior, flat, rate):
        parts.append(0)
        for r in units.collect():
            inputs, targets, real, first = M.unpack_units(r["units"])
            assert inputs.shape == targets.shape == real.shape and len(first) == len(inputs)
            given.append((int(first.sum()), int(real.sum())))
        return flat

    monkeypatch.setattr(M, "train_round", take)
    M.lm_scores(df)
    n = df.where(~M.held_out("doc_id")).count()
    assert len(parts) == M.ROUNDS and sum(f for f, _ in given) == n
    assert sum(r for _, r in given) == sum(len(r.text.split()) + 1 for r in df.where(~M.held_out("doc_id")).collect())


def test_units_pack_and_unpack():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5):
        shape = (n, A.BLOCK)
        given = rng.integers(0, M.N_INPUTS, shape), rng.integers(0, M.CLASSES, shape), rng.random(shape) > 0.5, rng.random(n) > 0.5
        for x, y in zip(given, M.unpack_units(M.pack_units(*given)), strict=True):
            assert x.shape == y.shape and (x == y).all()
    assert M.N_INPUTS < 1 << 16 and M.CLASSES <= 256


def test_rows_not_met_do_not_move():
    rng = np.random.default_rng(4)
    p = {"embed": rng.random((6, 3)).astype(np.float32), "bias": rng.random(3).astype(np.float32)}
    before = p["embed"].copy()
    adam = A.Adam(p, 0.1)
    for rows in ([1, 4], [4], [1, 2]):
        adam.step(p, {"embed": (np.array(rows), np.ones((len(rows), 3), np.float32)), "bias": np.ones(3, np.float32)})
    assert (p["embed"][[0, 3, 5]] == before[[0, 3, 5]]).all() and adam.t["embed"].tolist() == [0, 2, 1, 0, 2, 0]
    # the first step of a row has Adam's full rate, whenever it comes
    assert np.allclose(before[2] - p["embed"][2], 0.1, atol=1e-4)


def test_left_out_byte_sequences_stay_in_the_shorter_orders(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    letters = np.frombuffer("".join(words).encode(), np.uint8).astype(np.uint64)
    keys, _ = M.byte_sequences(np.array([len(w) for w in words]), letters)
    rows = [(M.BYTES, int(k), n) for k, n in Counter(keys.tolist()).items()]
    df = spark.createDataFrame(rows, "kind int, id long, n long")
    monkeypatch.setattr(M, "LISTED", 60)
    got = M.byte_counts(df)
    assert len(got[M.ORDER][0]) <= 60 < len(rows)
    for order in (0, 1):  # few enough to be kept whole: they count every symbol of every word
        want = Counter((keys & ((1 << 9 * (order + 1)) - 1)).tolist())
        assert len(want) <= 60 and dict(zip(*(x.tolist() for x in got[order]))) == want
        assert got[order][1].sum() == len(keys)


def test_places_of_the_slice_with_most_occurrences():
    place = np.array([3 << 48 | 0xAABBCCDDEEFF, 5 << 48 | 1 << 40, 0x7FFF << 48], np.int64)
    n = np.array([7, 9, 2], np.int64)
    w = M.weighed(n, place)
    assert (w > 0).all() and int(w.argmax()) == 1 and (w % (1 << 47) == place >> 16).all()
    assert M.weighed(np.array([10**9]), place[:1])[0] == 0x7FFF << 47 | place[0] >> 16


def test_texts_are_cut_in_one_pass():
    """The words are those of split(), whose lists are not built."""

    class Whole(bytes):
        def split(self, *_):
            raise AssertionError("split again")

    rng = random.Random(6)
    some = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x00", b"\x1c", b"a", b"Bc", "é".encode(), b"x" * 50]
    texts = [b"".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [b"", b" ", b"x" * 5000, b"end", b""]
    [(_, _, c, ends)] = M.slices([Whole(t) for t in texts])
    words = [t.lower().split() for t in texts]
    assert ends.tolist() == np.cumsum([len(w) for w in words]).tolist()
    flat = [w for ws in words for w in ws]
    assert c.lengths.tolist() == [len(w) for w in flat] and bytes(c.letters.astype(np.uint8)) == b"".join(flat)
    at = np.arange(len(flat))[::3]
    assert c.starts(at).tolist() == c.starts()[at].tolist()
    # the hash of a word does not depend on where it stands
    for w in set(flat):
        assert {int(h) for h, x in zip(c.hashes, flat, strict=True) if x == w} == {int(M.cut(w).hashes[0])}


def test_whole_tables_move_together(monkeypatch):
    """One update for the rows met and one for all other parameters; each moves as it does alone."""
    rng = np.random.default_rng(5)
    p = {n: rng.random(s).astype(np.float32) for n, s in (("embed", (6, 3)), ("query", (3, 3)), ("bias", (4,)))}
    alone = {n: {n: x.copy()} for n, x in p.items()}
    adam, single, moves = A.Adam(p, 0.1), {n: A.Adam(x, 0.1) for n, x in alone.items()}, []
    move = A.Adam._move
    monkeypatch.setattr(A.Adam, "_move", lambda self, *a: (moves.append(self), move(self, *a))[1])
    for rows in ([1, 4], [0, 4], [2, 3]):
        g = {n: rng.standard_normal(x.shape).astype(np.float32) for n, x in p.items()}
        g["embed"] = np.array(rows), g["embed"][rows]
        adam.step(p, g)
        for n, x in alone.items():
            single[n].step(x, {n: g[n]})
    assert sum(a is adam for a in moves) == 2 * 3
    assert all((p[n] == alone[n][n]).all() for n in p)
