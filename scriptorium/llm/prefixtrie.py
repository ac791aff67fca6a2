"""Operator 11: prefix trie of conversations by the Euler-tour technique.

Conversations of a block of 100 ids share the opening of the first one: each is
rebuilt from the first h turns of its block's head and its own turns after its
first h.  Every distinct sequence of first d rebuilt turns is a node.

1. **Prefix states.**  A turn is a SHA-256 digest of role and text; texts are not
   moved any further.  The state of a sequence is a polynomial in its turns modulo 2^127 - 1,
   so states can be joined: the turns are range-sorted, each slice folds its
   own part, and the carries (one row a slice) make the states whole.  A conversation that holds a
   third of all turns is spread over many slices.  The state of a rebuilt prefix follows
   from the states of its two parts; no second sort.
2. **Nodes** are the distinct states, counted with map-side partial counts.
   Sorted by (parent, smallest member) they get numbers, so that the next
   sibling of a node is the next number.
3. **Tour.**  Every node has an enter and an exit arc; the arc after each one
   follows from first child, next sibling and parent.  ``listrank`` ranks the tour, with
   childless nodes and savings as weights of the enter arcs: the sums at the exit
   arc of a node minus those at its enter arc are those of its subtree.
4. **Ends.**  The ids of the conversations that end at a node are range-sorted and
   packed into short runs; SHA-256 has to read them in order, so the runs of one
   node go through one task as a stream, never held together.

Two different prefixes share a state with probability about n^2 l / 2^127 for n nodes of l turns.

Defined results: rows without conv_id are left out; ids are whole numbers, and the block's head is
c - c % 100 with the sign of c (SQL); null role or text counts as empty; a null turn comes first, turns that
tie follow their digests (equal rows are interchangeable and each counts); a
conversation without turns after the rebuild ends at the root; other columns are
ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .listrank import list_rank
from .ordered import numbered, ordered

#: States are polynomials modulo this prime, at this point.
_PRIME = (1 << 127) - 1
_POINT = int.from_bytes(hashlib.sha256(b"prefix state").digest()[:15], "big")
_ROOT = (1).to_bytes(16, "big")  # the state of no turns; so the length counts too
#: Ids of ends in one run.
RUN = 512
#: Longest shared opening; h is below.
OPENINGS = 6


def _states(rows, conv, position, state):
    """Yield (row, position, state before, state after) for sorted turns that follow on the given conversation and state."""
    for row in rows:
        if row[0] != conv:
            conv, position, state = row[0], 0, 1
        before = state
        state = (state * _POINT + int.from_bytes(row[1][:16], "big")) % _PRIME
        yield row, position, before, state
        position += 1


def _rows(batches):
    for batch in batches:
        yield from zip(batch.column("c").to_pylist(), batch.column("digest").to_pylist(), batch.column("chars").to_pylist(), batch.column("__slice").to_pylist(), strict=True)


def _summary(batches):
    """One row for a slice: first and last conversation, and turns and state of the last one inside of the slice."""
    first = last = None
    for row, position, _, state in _states(_rows(batches), None, 0, 1):
        first = row if first is None else first
        last = row, position + 1, state
    if last is not None:
        row, n, state = last
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row[3], first[0], row[0], n, state.to_bytes(16, "big"))], ["slice", "first", "last", "n", "state"])


def _carries(summaries) -> dict[int, tuple[int, int, int]]:
    """slice -> (conversation, turns, state) at its begin."""
    found, conv, n, state = {}, None, 0, 1
    for s in summaries:
        if s.first == conv:
            found[s.slice] = conv, n, state
        inside = int.from_bytes(bytes(s.state), "big")
        if s.first == s.last == conv:  # inside = point^n + part, as it began at the root state 1
            power = pow(_POINT, s.n, _PRIME)
            state = (state * power + inside - power) % _PRIME
            n += s.n
        else:
            conv, n, state = s.last, s.n, inside
    return found


def prefix_states(turns: DataFrame) -> DataFrame:
    """(c, turn, digest, chars) -> (c, position, before, after, chars), states as 16 bytes."""
    sorted_turns = ordered(turns.withColumn("__any", F.monotonically_increasing_id()), ["c", "turn", "digest", "__any"]).select("c", "digest", "chars", "__slice")
    summaries = sorted_turns.mapInArrow(_summary, "slice long, first long, last long, n long, state binary").orderBy("slice").collect()  # one row for each slice
    carries = _carries(summaries)

    def run(batches):
        rows = _rows(batches)
        first = next(rows, None)
        if first is None:
            return
        at = carries.get(first[3], (None, 0, 1))
        out = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["c", "position", "before", "after", "chars"])

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        for row, position, before, after in _states(chain([first], rows), *at):
            out.append((row[0], position, before.to_bytes(16, "big"), after.to_bytes(16, "big"), row[2]))
            if len(out) == 10_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return written(sorted_turns.mapInArrow(run, "c long, position long, before binary, after binary, chars long"), "trie-states")


def _moved(batches):
    """States of own turns behind the block's opening: before and after + (start - own) * point^k."""
    powers = [1]
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("k", "start", "own", "before", "after")]
        nodes, parents = [], []
        for k, start, own, before, after in zip(*cols, strict=True):
            if start == own:
                nodes.append(after)
                parents.append(before)
                continue
            while len(powers) <= k and len(powers) < 4096:
                powers.append(powers[-1] * _POINT % _PRIME)
            power = powers[k - 1] if k <= len(powers) else pow(_POINT, k - 1, _PRIME)
            off = (int.from_bytes(start, "big") - int.from_bytes(own, "big")) * power
            parents.append(((int.from_bytes(before, "big") + off) % _PRIME).to_bytes(16, "big"))
            nodes.append(((int.from_bytes(after, "big") + off * _POINT) % _PRIME).to_bytes(16, "big"))
        keep = [batch.column(c) for c in ("depth", "chars", "c", "ends")]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), *keep], ["node", "parent", "depth", "chars", "c", "ends"])


_MEMBER = "node binary, parent binary, depth long, chars long, c long, ends boolean"


def memberships(conversations: DataFrame, block: int = 100) -> DataFrame:
    """One row for every rebuilt conversation and depth: (node, parent, depth, chars, c, ends)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").cast("long").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    states = prefix_states(turns)
    opening = F.when(F.col("position") < OPENINGS - 1, F.struct("position", "after", "chars"))
    convs = states.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(opening)).alias("openings"))
    convs = written(convs.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % OPENINGS), "trie-conversations")
    heads = convs.where(F.col("c") % block == 0).select(F.col("c").alias("head"), F.col("openings").alias("shared"))
    root = F.lit(bytearray(_ROOT))

    def state(openings, k):
        return F.when(k == 0, root).otherwise(F.get(F.col(openings), (k - 1).cast("int"))["after"])

    joined = convs.join(heads, F.col("c") - F.col("c") % block == F.col("head"), "left")
    joined = joined.withColumn("b", F.least(F.col("h"), F.coalesce(F.size("shared"), F.lit(0)).cast("long")))
    rebuilt = joined.select("c", "n", "h", "b", F.slice(F.coalesce("shared", F.array().cast("array<struct<position:bigint,after:binary,chars:bigint>>")), F.lit(1), F.col("b").cast("int")).alias("shared"), state("shared", F.col("b")).alias("start"), state("openings", F.col("h")).alias("own"))
    rebuilt = written(rebuilt, "trie-rebuilt")

    own = F.col("n") > F.col("h")  # turns of its own follow the opening
    at_root = rebuilt.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "c", ((F.col("b") == 0) & ~own).alias("ends"))
    in_head = rebuilt.select("c", "b", own.alias("own_turns"), "shared", F.explode("shared").alias("s"))
    depth = F.col("s")["position"] + 1
    in_head = in_head.select(
        F.col("s")["after"].alias("node"), F.when(depth == 1, root).otherwise(F.get("shared", (depth - 2).cast("int"))["after"]).alias("parent"), depth.alias("depth"), F.col("s")["chars"].alias("chars"), "c", ((depth == F.col("b")) & ~F.col("own_turns")).alias("ends")
    )
    behind = states.join(rebuilt.where(own).select("c", "n", "h", "b", "start", "own"), "c").where(F.col("position") >= F.col("h"))
    k = F.col("position") - F.col("h") + 1
    in_own = behind.select(k.alias("k"), "start", "own", "before", "after", (F.col("b") + k).alias("depth"), "chars", "c", (F.col("position") == F.col("n") - 1).alias("ends")).mapInArrow(_moved, _MEMBER)
    return written(at_root.unionAll(in_head).unionAll(in_own), "trie-members")


def _runs(batches):
    def rows():
        for batch in batches:
            yield from zip(batch.column("node").to_pylist(), batch.column("c").to_pylist(), strict=True)

    out = []
    for node, found in groupby(rows(), key=lambda r: r[0]):
        run = []
        for _, c in found:
            run.append(c)
            if len(run) == RUN:
                out.append((node, run[0], ",".join(map(str, run))))
                run = []
        if run:
            out.append((node, run[0], ",".join(map(str, run))))
        if len(out) >= 1_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "ids"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "ids"])


def _digests(batches):
    at, digest, done = None, None, []
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == at:
                digest.update(b"," + ids.encode())
                continue
            if at is not None:
                done.append((at, digest.hexdigest()))
            at, digest = node, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["end", "ends_sha256"])
            done = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], ["end", "ends_sha256"])


def ends_digests(members: DataFrame) -> DataFrame:
    """(end, ends_sha256): digest of the sorted ids of the conversations that end at a node."""
    runs = ordered(members.where("ends").select("node", "c"), ["node", "c"]).mapInArrow(_runs, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_digests, "end binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 100) -> DataFrame:
    """One row for every node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the places ``enter`` and ``exit`` of its arcs in the tour."""
    members = memberships(conversations, block)
    nodes = members.groupBy("node", "parent", "depth", "chars").agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"))
    nodes = numbered(nodes, ["parent", "conv_id"], "no")
    family = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("of")).agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(family, nodes["node"] == family["of"], "left").drop("of"), "trie-nodes")
    above = nodes.select(F.col("node").alias("above"), F.col("no").alias("above_no"), F.col("last").alias("above_last"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(nodes.join(above, nodes["parent"] == above["above"], "left").drop("above"), "trie-parents")

    enter, leave = F.col("no") * 2, F.col("no") * 2 + 1
    zero = F.lit(0).cast("long")
    inwards = nodes.select(
        enter.alias("item"), F.coalesce(F.col("first") * 2, leave).alias("next"), F.lit(1).cast("long").alias("at"), F.col("first").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    onwards = F.when(F.col("parent").isNull(), F.lit(None)).when(F.col("no") < F.col("above_last"), enter + 2).otherwise(F.col("above_no") * 2 + 1)
    outwards = nodes.select(leave.alias("item"), onwards.alias("next"), F.lit(1).cast("long").alias("at"), zero.alias("leaves"), zero.alias("saved"))
    places = list_rank(inwards.unionAll(outwards), ["at", "leaves", "saved"], "trie-tour")

    out = F.col("item") % 2 == 1
    signed = lambda c: F.sum(F.when(out, F.col(c)).otherwise(-F.col(c)))
    sums = places.groupBy(F.floor(F.col("item") / 2).alias("node_no")).agg(
        signed("leaves").alias("n_leaves"), signed("saved").alias("saved_tokens"), F.max(F.when(~out, F.col("at"))).alias("enter"), F.max(F.when(out, F.col("at"))).alias("exit")
    )
    ends = ends_digests(members)
    found = nodes.join(sums, nodes["no"] == sums["node_no"]).join(ends, nodes["node"] == ends["end"], "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "enter",
        "exit",
    )
