"""Sub-word vocabularies against one-by-one merging, and longest match against the tokenizers library."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import constants as K
from scriptorium.operators import subword as S
from scriptorium.operators.encode import lower_tokens


def one_by_one(texts, size, least=2):
    """The plain algorithm: recount all pairs, merge the most frequent one, again."""
    words = Counter(w for t in texts for w in t.lower().split() if len(w) <= S.MAX_WORD)
    table = {tuple([w[0], *("##" + c for c in w[1:])]): n for w, n in words.items()}
    letters = Counter()
    for sym, n in table.items():
        for s in sym:
            letters[s] += n
    tokens = list(K.SPECIAL_TOKENS) + [s for s, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
    merges = []
    while len(tokens) < size:
        pairs = Counter()
        for sym, n in table.items():
            for p in zip(sym, sym[1:]):
                pairs[p] += n
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        merges.append((a, b, n))
        new = a + b.removeprefix("##")
        if new not in tokens:
            tokens.append(new)
        table = {tuple(S._merge(list(sym), a, b)): n for sym, n in table.items()}
    return tokens[:size], merges


def _texts(seed, alphabet="abcdefgh", n=6):
    rng = random.Random(seed)
    syllables = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(25)]
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(90)) for _ in range(n)]


@pytest.mark.parametrize("seed,per_round", [(1, 1), (2, 4), (3, 25), (4, 1000)])
def test_rounds_equal_one_by_one(spark, seed, per_round):
    texts = _texts(seed) + ["aaaa aaaaa aaaaaa aaa", "löw löwer 漢字漢字 ## a##b", "x" * 150]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens, merges = one_by_one(texts, 160)
    vocab, got, rounds = S.merges_of(df, "text", 160, pairs_per_round=per_round)
    assert got == merges and len(got) > 100
    assert [r["token"] for r in vocab.orderBy("id").collect()] == tokens
    assert rounds < len(merges) / 4 or per_round == 1


def test_stops_when_pairs_are_rare(spark):
    texts = ["abab cdcd", "abab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens, merges = one_by_one(texts, 999)
    vocab, got, _ = S.merges_of(df, "text", 999)
    assert got == merges and [r["token"] for r in vocab.orderBy("id").collect()] == tokens and len(tokens) < 60
    assert S.learn_subwords(df.limit(0), "text", 50).count() == len(K.SPECIAL_TOKENS)
    assert S.learn_subwords(df, "text", 7).count() == 7


def test_run_limit_takes_fewer_pairs(spark, monkeypatch):
    texts = _texts(9)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    monkeypatch.setattr(S, "MAX_RUNS", 20)
    assert S.merges_of(df, "text", 120)[1] == one_by_one(texts, 120)[1]


def test_longest_match_equals_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    texts = _texts(5) + ["unseen zzz ab~c", "", "a" * 101 + " ab", "漢 löwe ## a##b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    vocab = S.learn_subwords(df, "text", 90)
    table = {r["token"]: r["id"] for r in vocab.collect()}
    lib = Tokenizer(models.WordPiece(table, unk_token=K.SPECIAL_TOKENS[K.UNK_ID], max_input_chars_per_word=S.MAX_WORD))
    lib.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    out = S.encode_subwords(df.withColumn("toks", lower_tokens("text")), "toks", vocab).collect()
    for r in out:
        if r.text is not None:
            assert list(r.input_ids) == [K.CLS_ID, *lib.encode(r.text.lower()).ids, K.SEP_ID], r.text
        else:
            assert r.input_ids is None


def test_pieces_know_their_words(spark):
    vocab = spark.createDataFrame([("ab", 5), ("##c", 6), ("d", 7), ("##cc", 8)], "token string, id int")
    df = spark.createDataFrame([(["abccc", "d", "q", "abc"],)], "toks array<string>")
    rows = S.subword_ids(df, "toks", vocab).select("pieces", S.subword_table(F.col("pieces"), 7).alias("t")).collect()[0]
    assert rows.pieces == [[5, 8, 6], [7], [K.UNK_ID], [5, 6]]
    assert [tuple(x) for x in rows.t] == [(5, 0, 0), (8, 0, 1), (6, 0, 2), (7, 1, 0), (K.UNK_ID, 2, 0)]


def test_substring_vocabulary(spark):
    texts = ["abc ab abc", "bc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter()
    for w, n in Counter(" ".join(texts).split()).items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 2) + 1):
                want[("##" if i else "") + w[i:j]] += n
    got = [(r["token"], r["n"]) for r in S.vocab_substrings(df, "text", 5, longest=2).orderBy("id").collect()]
    assert got == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_rounds_take_more_pairs_while_runs_are_few(spark):
    texts = _texts(3)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens, merges = one_by_one(texts, 160)
    vocab, got, rounds = S.merges_of(df, "text", 160, pairs_per_round=2)
    assert got == merges and [r["token"] for r in vocab.orderBy("id").collect()] == tokens
    assert rounds <= 10 < len(merges) / 10


def test_hot_runs_stay_inside_of_words():
    hot = S.HotPairs([("a", "##b"), ("##b", "##c"), ("##c", "a")])
    words = [["a", "##b", "##x", "##b", "##c"], ["x", "##y"], ["a", "##b", "##c"], ["a", "##b"]]
    at, begins, ends, of = hot.spans(pa.array(words, pa.list_(pa.string())))
    flat = [s for w in words for s in w]
    assert [(flat[i:j], w) for i, j, w in zip(begins, ends, of, strict=True)] == [(["a", "##b"], 0), (["##b", "##c"], 0), (["a", "##b", "##c"], 2), (["a", "##b"], 3)]
    assert [hot.names[i].as_py() if i >= 0 else None for i in at.tolist()] == [s if s in ("a", "##b", "##c") else None for s in flat]
