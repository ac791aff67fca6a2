"""Operator 11 against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from scriptorium.llm import listrank, prefixtrie
from scriptorium.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, node string, no int"


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    members, text_of = defaultdict(list), {}
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - c % 100, [])
        seq = tuple(head[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    out = {}
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = 0 if children[node] else 1
        for k in children[node]:
            leaves += out[k][5]
            saved += out[k][6]
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out[node] = (min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, digest)
    return sorted(out.values(), key=str)


def _rows(seed, n_convs=260):
    rng = random.Random(seed)
    words = ["hi", "yes", "no", "", None, "Zürich 漢字", "a b"]
    rows = []
    for c in rng.sample(range(0, 1200), n_convs):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "bot", None]), rng.choice(words)))
    rows += [(77_700, i, "user", "same") for i in range(400)]  # a long conversation
    rows += [(77_701, i, "user", "same") for i in range(300)]
    rows += [(88_800 + i, 0, "user", "copy") for i in range(90)] + [(88_805, 0, "user", "copy")] * 3  # copies, repeated rows
    rows += [(None, 0, "user", "no id"), (99_999, None, None, None)]
    return rows


@pytest.mark.parametrize("parts", [3, 40])
def test_trie_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(listrank, "REST", 40)
    rows = _rows(parts)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in prefixtrie.prefix_trie(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((g[:8] for g in got), key=str) == _brute(rows)
    places = sorted(p for g in got for p in g[8:])
    assert places == list(range(2 * len(got)))  # every arc of the tour has a place of its own
    tour = {p: (i, p == g[8]) for i, g in enumerate(got) for p in g[8:]}
    depth = 0
    for p in range(2 * len(got)):
        i, enters = tour[p]
        depth -= not enters
        assert got[i][1] == depth
        depth += enters


def test_carries_join_slices():
    turns = [(1, bytes([i]) * 32, 0, 0) for i in range(9)] + [(2, b"x" * 32, 0, 0), (3, b"y" * 32, 0, 0), (3, b"z" * 32, 0, 0)]
    whole = [s[1:] for s in prefixtrie._states(turns, None, 0, 1)]
    for cuts in ([3, 6], [1, 2, 3, 10], [9, 11], [5, 10]):
        slices = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]

        class S:
            pass

        summaries = []
        for i, rows in enumerate(slices):
            s = S()
            *_, last = prefixtrie._states(rows, None, 0, 1)
            s.slice, s.first, s.last, s.n, s.state = i, rows[0][0], rows[-1][0], last[1] + 1, last[3].to_bytes(16, "big")
            summaries.append(s)
        carries = prefixtrie._carries(summaries)
        got = [x[1:] for i, rows in enumerate(slices) for x in prefixtrie._states(rows, *carries.get(i, (None, 0, 1)))]
        assert got == whole


@pytest.mark.parametrize("n", [1, 2, 500])
def test_list_rank(spark, n):
    rng = random.Random(n)
    items = rng.sample(range(10 * n), n)
    weights = [rng.randint(0, 9) for _ in items]
    rows = [(a, b, w, 1) for a, b, w in zip(items, [*items[1:], None], weights)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "item long, next long, w long, one long")
    got = {r["item"]: (r["w"], r["one"]) for r in listrank.list_rank(df, ["w", "one"], rest=20).collect()}
    assert got == {a: (sum(weights[:i]), i) for i, a in enumerate(items)}


def test_empty_tables(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", 1)], SCHEMA)).count() == 0


def test_query(spark):
    from tests.llm.conftest import SF001

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()]
    out = Q.QUERIES["op11_prefix_trie"](spark, SF001)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == _brute(rows)
