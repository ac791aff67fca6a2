"""List ranking: prefix sums along a linked list whose items lie anywhere.

Every round throws a coin for each item (a hash of its number and the round).
An item with heads whose next one has tails takes that one over: the weights
add up and the link skips it.  A quarter of the items leave in expectation, so
the joins of all rounds together cost a constant times one join over the list.
Each round is one equi-join of unique keys, so no task meets a hot key.  What is left,
at most ``REST`` items at any input, is walked by one task; then the rounds are
undone: an item that left stands behind the sums of the one that took it over.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Items left for the last walk; bounds the rows of one task.
REST = 8_192


def _coin(item: str, round_no: int) -> Column:
    return F.xxhash64(F.col(item), F.lit(round_no)).bitwiseAND(F.lit(1)) == 1


def _walk(weights: list[str]):
    names = ["item", *weights]

    def run(batches):
        rows = {}
        for batch in batches:
            rows.update((r["item"], r) for r in batch.to_pylist())
        at = next(iter(rows.keys() - {r["next"] for r in rows.values()}), None)
        sums, out = [0] * len(weights), []
        while at is not None and at in rows:
            row = rows.pop(at)
            out.append([at, *sums])
            sums = [s + row[w] for s, w in zip(sums, weights, strict=True)]
            at = row["next"]
        if rows:
            raise ValueError("not one list")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * len(names), names)

    return run


def list_rank(items: DataFrame, weights: list[str], name: str = "list-rank", rest: int | None = None) -> DataFrame:
    """``items`` (item long, next long or null, weights long) -> (item, weights): sums of the weights before each item.

    The items form one list; the last one has no next.  An empty table gives an empty one.
    """
    left = written(items.select("item", "next", *weights), f"{name}-0")
    undo: list[DataFrame] = []
    while left.count() > (REST if rest is None else rest):
        no = len(undo)
        tails = _coin("item", no)
        takes = ~tails & F.col("next").isNotNull() & _coin("next", no)
        taker = left.where(takes).select(F.col("item").alias("taker"), F.col("next").alias("taken"), *[F.col(w).alias(f"t_{w}") for w in weights])
        pair = left.where(tails).join(taker, F.col("item") == F.col("taken"), "left")
        met = pair.select(
            F.coalesce("taker", "item").alias("item"),
            "next",
            *[(F.col(w) + F.coalesce(f"t_{w}", F.lit(0))).alias(w) for w in weights],
            "taken",
            *[f"t_{w}" for w in weights],
        )
        still = left.where(~tails & ~takes).select("item", "next", *weights, F.lit(None).cast("long").alias("taken"), *[F.lit(None).cast("long").alias(f"t_{w}") for w in weights])
        done = written(met.unionAll(still), f"{name}-{no + 1}")
        undo.append(done.where(F.col("taken").isNotNull()).select(F.col("item").alias("taker"), "taken", *[f"t_{w}" for w in weights]))
        left = done.select("item", "next", *weights)
    schema = ", ".join(f"{c} long" for c in ["item", *weights])
    ranked = written(left.repartition(1).mapInArrow(_walk(weights), schema), f"{name}-rest")
    for no, taken in reversed(list(enumerate(undo))):
        back = taken.join(ranked, taken["taker"] == ranked["item"]).select(taken["taken"].alias("item"), *[(ranked[w] + taken[f"t_{w}"]).alias(w) for w in weights])
        ranked = ranked.unionAll(written(back, f"{name}-back-{no}"))
    return ranked
