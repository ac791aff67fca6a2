"""Operator 7 against all strings counted, with small and with the real threshold."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from scriptorium.llm import queries as Q
from scriptorium.llm import suffixdedup as S


def plain(texts, k):
    """Removed spans of every text (bytes)."""
    n = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - k + 1):
            if n[t[i : i + k]] > 1:
                gone[i : i + k] = True
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def _texts(seed, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    prose = lambda m: " ".join(word() for _ in range(m))
    passages = [prose(60) for _ in range(4)]
    texts = ["", None, "x", "a" * 900, "ab" * 300, "-" * 199, "-" * 200, prose(900)]
    for _ in range(n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 80)
            parts += [p[a : a + rng.randint(100, 300)], prose(rng.randint(0, 40))]
        texts.append(" ".join(parts))
    for _ in range(8):  # near copies
        t = list(texts[rng.randint(10, n)] + prose(80))
        t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return texts + [texts[12], texts[13], texts[13]]


@pytest.mark.parametrize(("threshold", "gram", "group_rows"), [(200, 32, S.GROUP_ROWS), (200, 32, 5), (40, 8, 9), (50, 16, 3)])
def test_equals_plain(spark, threshold, gram, group_rows):
    texts = _texts(threshold + group_rows % 7)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(12, texts[12], "again"), (12, texts[12], "again"), (None, texts[20], "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(7)
    out = S.remove_repeats(df, threshold=threshold, gram=gram, group_rows=group_rows)
    assert out.columns == ["doc_id", "text", "removed_spans", "kept"]
    got = {(r.doc_id, r.text): ([(s.start, s.stop) for s in r.removed_spans], bytes(r.kept)) for r in out.collect()}
    raw = [(t or "").encode() for _, t, _ in rows]
    for (i, t, _), b, want in zip(rows, raw, plain(raw, threshold), strict=True):
        spans, kept = got[i, t]
        assert spans == want, (i, t)
        ends = [0, *[x for s in want for x in s], len(b)]
        assert kept == b"".join(b[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
    assert out.count() == len(rows)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_anchors_cover_every_string():
    rng = random.Random(2)
    raw = bytes(rng.randrange(4) for _ in range(3000)) + b"q" * 500
    at, _ = S.anchor_places(raw, 200, 32)
    for p in range(len(raw) - 199):
        k = np.searchsorted(at, p)
        assert k < len(at) and at[k] <= p + 168


def test_query(spark, tmp_path):
    texts = _texts(11, 40)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.QUERIES["op7_suffix_dedup"](spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    raw = [(t or "").encode() for t in texts]
    want = {}
    for i, (b, spans) in enumerate(zip(raw, plain(raw, 200), strict=True)):
        ends = [0, *[x for s in spans for x in s], len(b)]
        kept = b"".join(b[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
        want[i] = (i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: tuple(r) for r in out.collect()} == want


def test_internal_names_as_input_columns(spark):
    text = "a repeated passage that is long enough to be removed " * 6
    rows = [(i, f"{i} {text}", "k", 1, "g") for i in range(4)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string, start int, gram string"))
    assert out.columns == ["doc_id", "text", "key", "start", "gram", "removed_spans", "kept"]
    assert all(r.key == "k" and r.start == 1 and r.gram == "g" and r.removed_spans for r in out.collect())
