"""P1, P13, word counts and digit runs against Python's own string semantics."""

import re

from pyspark.sql import functions as F

from scriptorium.functions.text import WHITESPACE, collapse_ws, digit_runs, tokenise_ws, word_count

EDGE = [
    "",
    "   ",
    "a  b\tc",
    "x y z",
    "p\x1cq\x1dr\x1es\x1ft",
    "line1\r\nline2\rline3",
    "　lead and trail ",
    "tab\x0bvt\x0cff\x85nel",
    "١٢٣ arabic 45 and 6x7",
    "no-space",
]


def test_whitespace_set_matches_python():
    assert len(WHITESPACE) == 29
    assert all(c.isspace() for c in WHITESPACE)


def test_collapse_tokens_words(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "i int, s string")
    rows = df.select("i", collapse_ws("s").alias("c"), tokenise_ws("s").alias("t"), word_count("s").alias("w"), digit_runs("s").alias("d")).collect()
    for r in rows:
        s = EDGE[r["i"]]
        assert r["c"] == " ".join(s.split()), repr(s)
        assert list(r["t"]) == s.split(), repr(s)
        assert r["w"] == len(s.split()), repr(s)
        assert r["d"] == len(re.findall(r"\d+", s)), repr(s)


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(collapse_ws("s").alias("c")).first()
    assert r["c"] is None
