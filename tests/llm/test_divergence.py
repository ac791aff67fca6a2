"""Operator 12 against its SQL and a plain recount."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from scriptorium.llm import divergence as D
from scriptorium.llm import queries as Q

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _brute(texts, groups):
    n, docs = Counter(), Counter()
    for t, g in zip(texts, groups):
        found = Counter(x.lower() for x in TERM.findall(t))
        for x, k in found.items():
            n[g, x.decode()] += k
            docs[g, x.decode()] += 1
    return n, docs


def _counted(parts):
    n, docs = Counter(), Counter()
    for terms, g, k, d in parts:
        for t, gg, kk, dd in zip(terms.to_pylist(), g.tolist(), k.tolist(), d.tolist()):
            assert (gg, t) not in n
            n[gg, t], docs[gg, t] = kk, dd
    return n, docs


def _texts(n):
    rng = random.Random(4)
    words = ["a", "Be", "cat", "Éé", "日本", "longer", "exactly8", "ninebytes", "sixteenbytesword", "seventeenbytesabc", "x" * 40, "Ünïcödé" * 5, "zz"]
    return [" ".join(rng.choice(words) + rng.choice(["", "1", "\n", ".", "\x00"]) for _ in range(rng.randint(0, 60))).encode() for _ in range(n)] + [b"", b" ", b"q", b"1"]


@pytest.mark.parametrize("n_groups", [1, 7, 70_000])
def test_packed_counts(n_groups):
    texts = _texts(300)
    groups = np.array([(i * 7919) % n_groups for i in range(len(texts))])
    assert _counted(D.count_terms(texts, groups)) == _brute(texts, groups.tolist())


def test_long_text(monkeypatch):
    monkeypatch.setattr(D, "SLICE", 50)
    text = b" ".join(_texts(40))
    n, docs = _counted(D._count_long(text))
    want, _ = _brute([text], [0])
    assert n == want and set(docs.values()) == {1}


def test_radix_order():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 5000, dtype=np.uint64) >> np.uint64(60) << np.uint64(s) for s in (60, 10))
    order = D.radix_order([a, b], [1, 4])
    assert (order == np.lexsort((np.arange(5000), b, a))).all()


def _oracle(spark, df):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return sorted(con.sql(Q.DIVERGENCE_SQL).fetchall())


def _run(df, **kw):
    a = D.Audit(df, **kw)
    pair = [(r.lang, r.source, "pair", r["item"], r.value, r["rank"]) for r in D.source_divergence(a).collect()]
    return sorted(pair + [(r.lang, r.source, "term", r["item"], r.value, r["rank"]) for r in D.term_divergence(a).collect()])


SCHEMA = "doc_id long, lang string, source string, text string, term string, n long"


def test_edge_rows_equal_the_sql(spark):
    rng = random.Random(8)
    texts = [t.decode().replace("\x00", " ") for t in _texts(200)]
    rows = [(i % 150, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "s9"]), t, "clash", 1) for i, t in enumerate(texts)]
    rows += [(900, "xx", f"only{i}", "unique" + "abc"[i], None, None) for i in range(3)]  # no kept term
    rows += [(901, "yy", "alone", "same words", None, None)] * 4  # one source, repeated rows
    rows += [(None, "en", "s1", None, None, None), (902, "en", "empty", "", None, None), (903, "en", "s2", "Longword " * 3000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = _oracle(spark, df)
    assert {r[0] for r in want} >= {"", "en", "de", "xx"}
    assert _run(df) == want


def test_many_blocks_and_buckets(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "en", f"s{rng.randint(0, 9)}", t.decode().replace("\x00", ""), None, None) for i, t in enumerate(_texts(150))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _run(df)
    monkeypatch.setattr(D, "BUCKET_ROWS", 7)
    assert _run(df) == want == _oracle(spark, df)


def test_block_sums_split_alike(monkeypatch):
    import pyarrow as pa

    class Key(str):
        def as_py(self):
            return "en" if self == "en" else int(self)

    rng = np.random.default_rng(2)
    heads = [(i, f"s{i}", None, 0, 40 + i) for i in range(7)]
    rows = [(int(p), f"s{p}", f"t{t}", int(rng.integers(1, 9)), 40 + int(p)) for t in range(50) for p in rng.choice(7, 3, replace=False)]
    cols = list(zip(*(heads + rows)))
    table = pa.table({"place": pa.array(cols[0], pa.int64()), "source": cols[1], "term": pa.array(cols[2], pa.string()), "n": pa.array(cols[3], pa.int64()), "d": pa.array(cols[4], pa.int64())})
    whole = D._block_sums((Key("en"), Key("0"), Key("0")), table).to_pylist()
    monkeypatch.setattr(D, "BLOCK", 2)
    monkeypatch.setattr(D, "CELLS", 10)
    parts = [r for b in range(4) for r in D._block_sums((Key("en"), Key("0"), Key(str(b))), table).to_pylist()]
    assert sorted(map(str, parts)) == sorted(map(str, whole)) and len(whole) == 42


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(2000):
        d = rng.randint(1, 9 * 10**15)
        n = rng.randint(0, d - 1)
        assert D._shares(np.array([n]), np.array([d]))[0] == 1 + 10**9 * (n + 1) // d


def test_empty_table(spark):
    assert _run(spark.createDataFrame([], SCHEMA)) == []


def test_query(spark):
    from tests.llm.conftest import SF001

    out = Q.QUERIES["op12_source_divergence"](spark, SF001)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.lang, r.source, r.part].append(r)
    for (_, _, part), rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and (part == "pair" or len(rows) <= 200)
        assert all(a.value > b.value or a.value == b.value and a["item"].encode() < b["item"].encode() for a, b in zip(rows, rows[1:]))
