"""Operator 6 against all pairs compared, on documents and on made fingerprints."""

import random

import numpy as np
import pytest
import xxhash
from scriptorium.llm import queries as Q
from scriptorium.llm import simhash as S
from scriptorium.llm.components import connected_components
from tests.llm.conftest import SF001


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, distance=4):
    """(id, fingerprint) rows -> smallest id reachable, by breadth-first search over all pairs."""
    fps = sorted({f for _, f in rows})
    near = {f: [g for g in fps if (f ^ g).bit_count() <= distance] for f in fps}
    top = {}
    for f in fps:
        if f in top:
            continue
        seen, todo = {f}, [f]
        while todo:
            for g in near[todo.pop()]:
                if g not in seen:
                    seen.add(g)
                    todo.append(g)
        best = min((i for i, g in rows if g in seen and i is not None), default=None)
        top |= dict.fromkeys(seen, best)
    return top


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def made_fingerprints(seed, groups=12, size=30, alone=150):
    rng = random.Random(seed)
    out = [0]
    for _ in range(groups):
        f = rng.getrandbits(64)
        for _ in range(size):  # chains: each a few bits from the one before
            out.append(f)
            for _ in range(rng.choice([0, 1, 2, 4, 5, 7])):
                f ^= 1 << rng.randrange(64)
    return out + [rng.getrandbits(64) for _ in range(alone)] + [(1 << 64) - 1]


def test_every_close_pair_meets():
    rng = random.Random(1)
    a = [rng.getrandbits(64) for _ in range(300)]
    b = []
    for x in a:
        for p in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << p
        b.append(x)
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    met = np.zeros(len(a), bool)
    for part in (0, 1):
        home = S.homes(a, part)
        rows, keys = S.anchors(b, part, 2)
        met[rows[home[rows] == keys]] = True
        own_rows, own_keys = S.anchors(a, part, 2)
        assert set(own_rows[home[own_rows] == own_keys]) == set(range(len(a)))
        assert not S.syndrome(home & np.uint64((1 << 31) - 1)).any()
    assert met.all()


def test_fingerprint():
    for t in [None, "", " \n", "One", "one two three", "A b C d E f", "é É à b c d " * 3, "x y z w " * 40_000]:
        assert S.fingerprint((t or "").encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_components(spark, block):
    rows = [(i, f) for i, f in enumerate(made_fingerprints(2))] + [(None, 5), (None, 0)]
    want = plain_components(rows)
    df = spark.createDataFrame([(i, signed(f)) for i, f in rows], "doc_id long, fingerprint long")
    got = S.simhash_components(df, block=block).collect()
    assert {r.fp % (1 << 64): r.component_id for r in got} == want
    assert len(got) == len(want)
    assert S.simhash_components(df.limit(0)).count() == 0


def test_one_large_group(spark):
    rng = random.Random(8)
    f = rng.getrandbits(64)
    near = {f}
    while len(near) < 1500:
        x = f
        for p in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << p
        near.add(x)
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(near)], "doc_id long, fingerprint long")
    links = S.fingerprint_links(df.select(df.fingerprint.alias("fp")), block=500)
    assert links.count() < 400 * len(near)  # stars, not all pairs
    assert {r.component_id for r in S.simhash_components(df, block=500).collect()} == {0}


def test_connected_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[100 + k] for k in range(50)}) == 1
    assert got[0] != got[100] and 200 not in got
    for a, b in links:
        assert a == b or got[a] == got[b]


def test_query(spark):
    out = Q.QUERIES["op6_simhash_near_dedup"](spark, SF001)
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = plain_components(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    assert got == {i: (f"{f:016x}", want[f]) for i, f in rows}


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(3, text, "a", 1), (1, text, "b", 2), (2, text + " end", "c", 3), (9, "", "d", 4), (8, None, "e", 5), (None, "quite another text here", "f", 6), (5, "same row", "g", 7), (5, "same row", "g", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    got = S.keep_one_per_component(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got.collect()) == [(-1, "f"), (1, "b"), (5, "g"), (8, "e")]
    assert S.keep_one_per_component(df.limit(0)).count() == 0
