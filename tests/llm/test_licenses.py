"""Operator 2 against a full alignment of every template with every text."""

import random
import re

import pytest
from scriptorium.llm import licenses as L
from scriptorium.llm import queries as Q
from scriptorium.llm.licensetexts import TEMPLATES
from scriptorium.llm.tokenhash import LETTERS
from tests.llm.conftest import SF001


def words(text):
    return bytes(int(LETTERS[x]) or 32 for x in (text or "").encode()).split()


def plain_best(template, text):
    """Equal words of the best local alignment, over the whole text."""
    m, n = len(template), len(text)
    s = [[0] * (n + 1) for _ in range(m + 1)]
    e = [[0] * (n + 1) for _ in range(m + 1)]
    best = (0, 0)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            same = template[i - 1] == text[j - 1]
            s[i][j], e[i][j] = max((0, 0), (s[i - 1][j - 1] + (1 if same else -1), e[i - 1][j - 1] + same), (s[i - 1][j] - 1, e[i - 1][j]), (s[i][j - 1] - 1, e[i][j - 1]))
            best = max(best, (s[i][j], e[i][j]))
    return best[1]


def _rows():
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["the", "of", "license", "under", "thing", "word", "is"]) for _ in range(n))
    rows = [(0, None, "e"), (1, "", "e"), (2, prose(300), "e"), (3, "é " * 10_000 + TEMPLATES["mit/line"].upper(), "e")]
    for i, (_, t) in enumerate(sorted(TEMPLATES.items())):
        rows.append((10 + i, f"{prose(20)}\n{t}\n{prose(9)}", "e"))
        w = t.split()
        for _ in range(len(w) // 12):
            w[rng.randrange(len(w))] = rng.choice(["changed", "", "added word"])
        rows.append((100 + i, prose(rng.randint(0, 30)) + " " + " ".join(w) + " " + prose(5), "e"))
        rows.append((200 + i, " ".join(t.split()[: len(t.split()) // 2]), "e"))
    twice = TEMPLATES["mit/line"]
    return rows + [(400, f"{twice}\n{twice} {prose(30)} {twice}", "e"), (10, rows[4][1], "again"), (None, twice, "e")]


def test_equals_full_alignment(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, license string, start int").repartition(4)
    got = L.scan_licenses(df).collect()
    found = {(r.doc_id, r.license): max(r.matched_words, 0) for r in got}
    names = sorted(TEMPLATES)
    for i, t, _ in rows:
        d = words(t)
        if len(d) > 2000:
            continue
        for n in names:
            w = words(TEMPLATES[n])
            best = plain_best(w, d)
            assert ((i, n) in found) == (best >= L.MIN_COVERAGE * len(w)), (i, n, best, len(w))
            if (i, n) in found:
                assert found[i, n] == best
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert words(texts[r.doc_id][r.start : r.stop])[0] in words(TEMPLATES[r.license])
        assert 0.8 <= r.coverage <= 1 and r.template_words == len(words(TEMPLATES[r.license]))
    assert sum(r.doc_id == 400 and r.license == "mit/line" for r in got) == 3
    exact = [r for r in got if r.doc_id == 3]
    assert len(exact) == 1 and texts[3][exact[0].start :] == TEMPLATES["mit/line"].upper()[:-1] + "."
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_winnowing_guarantee():
    index = L.Index.of(TEMPLATES, L.GRAM, L.WINDOW)
    for t, w in enumerate(index.words):
        n = L.GRAM + L.WINDOW - 1
        for a in range(max(1, len(w) - n + 1)):
            assert t in set(index.hits(w[a : a + n])[1])


def test_query(spark):
    out = Q.QUERIES["op2_license_scan"](spark, SF001)
    assert out.columns == ["doc_id", "license", "start", "stop", "matched_words", "template_words", "coverage"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    lines = {n: t for n, t in TEMPLATES.items() if n.endswith("/line")}
    planted = {(i, n) for i, t in docs.items() for n, x in lines.items() if x in t}
    assert planted and planted <= {(r.doc_id, r.license) for r in out.collect()}


@pytest.mark.parametrize("sf", [SF001, "/root/testdata/sf0.01"])
def test_notice_lines_of_documents(spark, sf):
    """Every whole line that speaks of a licence or of rights lies inside a reported span, whatever the templates say."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    notices = [(i, m.start(), m.end()) for i, t in docs.items() for m in re.finditer(r"(?im)^.*(licen[sc]e|rights reserved|copyright|public domain).*$", t) if len(m[0]) < 200]
    spans = {}
    for r in Q.QUERIES["op2_license_scan"](spark, sf).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.stop))
    assert notices
    lost = [docs[i][a:b] for i, a, b in notices if not any(s <= a and b <= e + 1 for s, e in spans.get(i, []))]
    assert not lost


def test_bare_and_full_texts(spark):
    """A bare reservation of rights; the texts behind a licence's first paragraph; the other GNU licences."""
    texts = [
        "Some words.\nALL RIGHTS RESERVED\nMore words.",
        TEMPLATES["mit/text"] + ' The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of '
        "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other "
        "liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999",
        "It is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ]
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.license, texts[0][r.start : r.stop]) for r in got if r.doc_id == 0] == [("all-rights-reserved/bare", "ALL RIGHTS RESERVED")]
    most = {}
    for r in got:
        most[r.doc_id] = max(most.get(r.doc_id, (0, "")), (r.matched_words, r.license))
    assert [most[i][1] for i in (1, 2, 3)] == ["mit/full", "lgpl-2.1/title", "agpl-3.0/header"]
    [full] = [r for r in got if r.license == "mit/full"]
    assert full.coverage == 1 and full.stop >= len(texts[1]) - 1


def test_closest_notice_and_text_ids(spark):
    """Near-equal licences share the words of one header; one of them is the closest. Ids keep their type."""
    header = max((t for n, t in TEMPLATES.items() if n.startswith("gpl")), key=len)
    rows = [("one", "x y z " + header + " a b c"), (None, header), ("two", header + " and then " + TEMPLATES["mit/line"])]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    for i, t in rows:
        own = [r for r in got if r.doc_id == i]
        best = sorted((r for r in own if r.closest), key=lambda r: r.start)
        assert own and best and all(a.stop <= b.start for a, b in zip(best, best[1:]))
        for r in own:  # whatever is not the closest shares words with one that fits better
            assert r.closest or any(b.start < r.stop and r.start < b.stop and b.matched_words >= r.matched_words for b in best)
    assert {r.license for r in got if r.doc_id == "two" and r.closest} >= {"mit/line"}
