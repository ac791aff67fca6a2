"""Operator 3 against every alignment of every document and item compared."""

import random
from itertools import combinations

import pytest
from scriptorium.llm import decontaminate as D
from scriptorium.llm import queries as Q
from scriptorium.llm.tokenhash import LETTERS, batches_of_words, word_hashes
from tests.llm.conftest import SF001


def words(text):
    b = bytes(int(LETTERS[x]) or 32 for x in (text or "").encode())
    return b.split()


def plain(docs, items, window=D.WINDOW, substitutions=D.SUBSTITUTIONS, least=D.MIN_ITEM_WORDS):
    found = {}
    for i, t in docs:
        d = words(t)
        for j, u in items:
            w = words(u)
            if len(w) < least:
                continue
            n = min(window, len(w))
            for shift in range(-len(w) + n, len(d) - n + 1):
                lo, hi = max(0, -shift), min(len(w), len(d) - shift)
                same = [d[k + shift] == w[k] for k in range(lo, hi)]
                for a in range(len(same) - n + 1):
                    e = sum(same[a : a + n])
                    if e >= n - (substitutions if n == window else 0):  # a short item: as it is, whole
                        first, last, best = found.get((i, j), (10**9, -1, 0))
                        found[i, j] = min(first, a + lo + shift), max(last, a + lo + shift + n - 1), max(best, e)
    return found


def test_masks_are_lossless():
    for bad in combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        assert any(not any(at + p in bad for p in m) for m in D.MASKS for at in range(D.WINDOW - m[-1])), bad


def test_word_hashes():
    texts = ["", "One  two,three", "é-À x1", "a" * 9000, "b c " * 700_000, "!", "One two three"]
    got = {}
    for i, w, ends in batches_of_words([t.encode() for t in texts]):
        lo = 0
        for k, hi in enumerate(ends.tolist()):
            got[i + k] = w[lo:hi].tolist()
            lo = hi
    for i, t in enumerate(texts):
        assert len(got[i]) == len(words(t))
        assert got[i][:50] == word_hashes(t.encode()).tolist()[:50]
    assert got[1] == got[6]


def _case():
    rng = random.Random(9)
    vocabulary = ["the", "of", "and"] + [f"w{i}" for i in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(j, prose(rng.randint(12, 40))) for j in range(20)] + [(20, prose(11)), (21, prose(3)), (22, [])]
    docs = []
    for i in range(120):
        d = prose(rng.randint(0, 60))
        if i % 2:
            w = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = "changed"
            at = rng.randint(0, len(d))
            d = d[:at] + w + d[at:]
        docs.append((i, " ".join(x.title() + rng.choice(["", ",", "."]) for x in d)))
    docs += [(500, None), (501, ""), (3, docs[3][1]), (None, docs[5][1])]
    return docs, [(j, " ".join(w)) for j, w in items] + [(23, None), (0, " ".join(items[0][1]))]


def test_equals_plain(spark):
    docs, items = _case()
    want = plain(docs, items)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, seed string").repartition(5)
    it = spark.createDataFrame([(j, t, 2) for j, t in items], "item_id long, text string, doc_id int")
    out = D.find_leaks(df, it)
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.equal_words) for r in out.collect()}
    assert got.keys() == want.keys() and len(want) > 40
    assert got == want
    clean = D.without_leaks(df, it)
    assert clean.columns == df.columns
    bad = {i for i, _ in want}
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _ in docs if i not in bad)
    assert D.find_leaks(df.limit(0), it).count() == 0
    assert D.find_leaks(df, it.limit(0)).count() == 0
    assert D.without_leaks(df, it.limit(0)).count() == len(docs)


@pytest.mark.parametrize("sf", [SF001])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = {w: k for k, w in enumerate(sorted({w for _, t in docs + items for w in words(t)}))}
    # Items share few words with a text: only texts with half of an item's rarer words are aligned in full.
    out = Q.QUERIES["op3_decontaminate"](spark, sf)
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.equal_words) for r in out.collect()}
    assert names
    some = [d for d in docs if any(k[0] == d[0] for k in got)][:10] + docs[:10]
    ids = {i for i, _ in some}
    assert {k: v for k, v in got.items() if k[0] in ids} == plain(some, items)


def test_short_items_and_text_ids(spark):
    """Items of 1 to 11 words: every exact copy is found, a changed one is not; ids keep their type."""
    rng = random.Random(4)
    items = [(f"q{n}", " ".join(f"word{n}x{k}" for k in range(n))) for n in range(0, 14)] + [("q14", None)]
    docs = []
    for j, t in items:
        filler = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))
        docs += [(f"copy-{j}", f"{filler} {t or ''}! {filler}"), (f"alone-{j}", (t or "").upper())]
        w = (t or "").split()
        for k in range(len(w)):
            docs.append((f"changed-{j}-{k}", " ".join([*w[:k], "other", *w[k + 1 :]])))
    docs += [(None, items[5][1]), ("none", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.equal_words) for r in D.find_leaks(df, benchmark).collect()}
    want = plain(docs, items)
    assert got == want
    assert {(f"copy-q{n}", f"q{n}") for n in range(1, 14)} <= set(got) and not any(i and i.startswith("changed-q7") for i, _ in got)
    kept = {r.doc_id for r in D.without_leaks(df, benchmark).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
