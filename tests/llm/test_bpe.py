"""Operator 9 against the tokenizers library and the plain merge loop."""

import hashlib
import random

import numpy as np
import pytest
from scriptorium.llm import queries as Q
from scriptorium.llm.bpe import bpe_encode_decode, load

PATH = Q.tokenizer_file("word_bpe_49k.json")
CASES = [
    "", " ", "\n\t\x0b\x0c\r ", "Hello, world's", "it's they'll I'd WE'VE", "x" * 300, "aaaa bbbb 123 4567",
    "Ünïcödé ÉCOLE ñandú Straße ǅ İstanbul ΣΑΣ", "é å ́x", "a b c\u0085d e", "\x1c\x1d\x1e\x1f",
    "<|startoftext|>hi<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|><|endoftext|> a<|endoftext|>b", "日本語テキスト 한국어 العربية", "🙂🙃 👩‍👩‍👧", "a\x00b",
    "don't 's 'S ’s ’t", "!!!??? --- *** <br/> </w> </w></w>", "½ ² ٣ Ⅷ", "​zero‌width﻿", "ﬁ ﬂ", "_under_score_",
]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(5)
    alphabet = "abcdefghiéèñüßstrionTHEA'.,!0123 \n\t<|>-" + "ЖЯλ漢字"
    return CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]


def test_ids_equal_the_library(lib):
    b = load(PATH)
    for t in _texts():
        want = lib.encode(t, add_special_tokens=False).ids
        got = [i for p in t.encode().split() for i in b.encode_piece(p)]
        assert got == want, t
        assert b.decode(got) == lib.decode(want, skip_special_tokens=False), t


def test_latin_letters_equal_the_library(lib):
    b = load(PATH)
    rng = random.Random(11)
    letters = [chr(c) for c in range(0x21, 0x1A0)]
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        assert [i for p in t.encode().split() for i in b.encode_piece(p)] == lib.encode(t, add_special_tokens=False).ids, t


def test_every_prefix_has_one_last_token():
    b = load(PATH)
    rng = random.Random(3)
    for _ in range(100):
        s = b.words("".join(rng.choice("thereinouastion") for _ in range(rng.randint(1, 14))))[0]
        ends = {}
        for end, (tok, n) in b.automaton.iter(s):
            start = end + 1 - n
            if start == 0 or any(b.compatible(p, tok) for p in ends.get(start, [])):
                ends.setdefault(end + 1, []).append(tok)
        assert all(len(x) == 1 for x in ends.values())


def test_operator_rows(spark, lib):
    rows = [(i, t, 7, "x") for i, t in enumerate(_texts()[:60])] + [(900, None, 1, None), (901, "a b " * 120_000, 2, "y"), (901, "a b " * 120_000, 2, "y"), (None, "null id", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int, token_ids string").repartition(5)
    out = bpe_encode_decode(df, PATH).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "token_ids", "decoded"}
    for r in out:
        ids = np.frombuffer(bytes(r.token_ids), "<u4").tolist()
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    plain = bpe_encode_decode(df.where("doc_id < 20"), PATH, packed=False).collect()
    assert all(r.token_ids == lib.encode(r.text, add_special_tokens=False).ids for r in plain)
    assert bpe_encode_decode(df.limit(0), PATH).count() == 0


def test_query(spark, lib):
    from tests.llm.conftest import SF001

    out = Q.QUERIES["op9_bpe_encode_decode"](spark, SF001)
    assert out.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = out.collect()
    assert len(got) == len(texts)
    for r in got:
        e = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(e, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()
