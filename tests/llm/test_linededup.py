"""Operator 1 against a plain version over Python lists, and against its SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from scriptorium.llm import linededup as L
from scriptorium.llm import queries as Q
from tests.llm.conftest import SF001


def plain(rows, window=2, modulus=3, least=2):
    """(id, text) rows -> list of (id, text left, lines, removed)."""

    def chunks(text):
        lines = [] if text is None else text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        out, now = [], []
        for i, line in enumerate(lines):
            now.append(line)
            if i >= window - 1 and sum(h[i - b] * 31**b for b in range(window)) % modulus == 0:
                out.append(now)
                now = []
        return out + [now] if now else out

    def key(i, t):
        return hashlib.md5("/".join([hashlib.md5((t or "").encode()).hexdigest(), *([] if i is None else [str(i)]), str(t is None).lower()]).encode()).digest()

    seen = {}
    for i, t in rows:
        for no, c in enumerate(chunks(t)):
            if len(c) >= least:
                at = (i is None, i or 0, key(i, t), no)
                text = "\n".join(c)
                seen[text] = min(seen.get(text, at), at)
    out = []
    for i, t in rows:
        stay, gone = [], 0
        for no, c in enumerate(chunks(t)):
            if len(c) >= least and seen["\n".join(c)] != (i is None, i or 0, key(i, t), no):
                gone += len(c)
            else:
                stay += c
        out.append((i, None if t is None else t if not gone else "\n".join(stay), 0 if t is None else len(t.split("\n")), gone))
    return out


def _rows():
    rng = random.Random(3)
    passage = [f"shared line {k}" for k in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "one"), (4, "é\r\nü"), (None, "\n".join(passage)), (None, "other\n" + "\n".join(passage))]
    for i in range(10, 50):
        own = [f"{i} {rng.random()}" for _ in range(rng.randint(0, 9))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + passage[rng.randint(0, 3) :] + own[at:])))
    return rows + [(60, "\n".join(["a", "b"] * 30)), (61, "x\n" * 20_000), (12, rows[9][1]), (10, rows[7][1]), (10, rows[7][1])]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n_lines int, lang string").repartition(6)


def _got(out):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in out.collect()), key=repr)


def test_equals_plain(spark):
    rows = _rows()
    out = L.line_dedup(_frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_removed_lines"]
    want = sorted(plain(rows), key=repr)
    assert _got(out) == want
    assert sum(w[3] for w in want) > 100
    assert L.line_dedup(_frame(spark, rows).limit(0)).count() == 0


def test_other_parameters(spark):
    rows = _rows()
    assert _got(L.line_dedup(_frame(spark, rows), window=3, modulus=5, min_lines=3)) == sorted(plain(rows, 3, 5, 3), key=repr)


def test_equal_digests_of_unequal_texts(spark, monkeypatch):
    """With a digest of a few bits only, the byte comparison alone decides."""
    monkeypatch.setattr(L, "chunk_digest", lambda c: F.unhex(F.rpad(F.substring(F.md5(c), 1, 1), 32, "0")))
    rows = _rows()
    assert _got(L.line_dedup(_frame(spark, rows))) == sorted(plain(rows), key=repr)


def test_no_python_in_plan(spark):
    plan = L.line_dedup(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sf", [SF001, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(Q.ORACLES["op1_line_dedup"]).fetchall())
    out = Q.QUERIES["op1_line_dedup"](spark, sf)
    assert out.columns == ["doc_id", "n_lines", "n_removed_lines", "text_md5"]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert sum(w[2] for w in want) > 0
