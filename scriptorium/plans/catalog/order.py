"""Positional, split, sample, shard, batch and set-operation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import mix, order
from ...sources.tables import documents, table
from .. import sqltext as Q
from ..registry import query


def _docs(spark, sf, *cols):
    return documents(spark, sf).select(*(cols or ("doc_id",)))


def _rank(order_by: str) -> str:
    return f"(row_number() OVER (ORDER BY {order_by}) - 1)"


SEED = 42
SEEDED = f"{Q.digest(42, 'doc_id')}, doc_id"


@query("row_index", f"SELECT doc_id, {_rank('lang, doc_id')} AS idx FROM documents")
def row_index(spark, sf):
    return order.row_index(_docs(spark, sf, "doc_id", "lang"), ["lang", "doc_id"]).select("doc_id", "idx")


@query("sort_text_keys", f"SELECT doc_id, {_rank('text, doc_id')} AS idx FROM documents")
def sort_text_keys(spark, sf):
    return order.row_index(_docs(spark, sf, "doc_id", "text"), ["text", "doc_id"]).select("doc_id", "idx")


@query("seeded_order", f"SELECT doc_id, {_rank(SEEDED)} AS idx FROM documents")
def seeded_order(spark, sf):
    return order.seeded_order(_docs(spark, sf), 42, "doc_id").select("doc_id", "idx")


def _take_sql(n: int, seed, take: str, rest: str) -> str:
    return f"SELECT doc_id, CASE WHEN {_rank(Q.digest(seed, 'doc_id') + ', doc_id')} < {n} THEN '{take}' ELSE '{rest}' END AS split FROM documents"


@query("take_skip_split", _take_sql(100, 42, "validation", "train"))
def take_skip_split(spark, sf):
    return order.take_skip(_docs(spark, sf), 100, 42, "doc_id")


@query("split_absolute", _take_sql(40, 7, "test", "train"))
def split_absolute(spark, sf):
    return order.take_skip(_docs(spark, sf), 40, 7, "doc_id", take_name="test", rest_name="train")


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {SEEDED} LIMIT 100")
def sample_n(spark, sf):
    return order.sample_n(_docs(spark, sf), 100, 42, "doc_id")


@query("sample_inspect", f"SELECT doc_id, lang FROM documents ORDER BY {Q.digest(3, 'doc_id')}, doc_id LIMIT 3")
def sample_inspect(spark, sf):
    return order.sample_n(_docs(spark, sf, "doc_id", "lang"), 3, 3, "doc_id")


_SPLIT_90_5_5 = Q.with_ctes(
    [
        ("a", f"SELECT doc_id, {_rank(Q.digest(42, 'doc_id') + ', doc_id')} AS i, count(*) OVER () AS n FROM documents"),
        ("h", f"SELECT doc_id, {_rank(Q.digest(43, 'doc_id') + ', doc_id')} AS j, count(*) OVER () AS m FROM a WHERE i < ceil(n * 0.1)"),
    ],
    "SELECT doc_id, 'train' AS split FROM a WHERE i >= ceil(n * 0.1) "
    "UNION ALL SELECT doc_id, CASE WHEN j < ceil(m * 0.5) THEN 'test' ELSE 'validation' END AS split FROM h",
)


@query("split_90_5_5", _SPLIT_90_5_5)
def split_90_5_5(spark, sf):
    return order.split_90_5_5(_docs(spark, sf), "doc_id", seeds=(42, 43))


@query(
    "split_90_10",
    Q.with_ctes(
        [("a", f"SELECT doc_id, {_rank(Q.digest(1337, 'doc_id') + ', doc_id')} AS i, count(*) OVER () AS n FROM documents")],
        "SELECT doc_id, CASE WHEN i < ceil(n * 0.1) THEN 'valid' ELSE 'train' END AS split FROM a",
    ),
)
def split_90_10(spark, sf):
    return order.fraction_split(_docs(spark, sf), 0.1, 1337, "doc_id", test_name="valid", train_name="train")


@query(
    "select_range",
    f"SELECT doc_id, idx FROM (SELECT doc_id, {_rank('doc_id')} AS idx FROM documents) WHERE (idx >= 0 AND idx < 64) OR (idx >= 65 AND idx < 80)",
)
def select_range(spark, sf):
    return order.select_ranges(_docs(spark, sf), ["doc_id"], [(0, 64), (65, 80)]).select("doc_id", "idx")


@query(
    "holdout_complement",
    f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, {_rank('doc_id')} AS idx FROM documents) WHERE idx < 64)",
)
def holdout_complement(spark, sf):
    """Validation ids = all ids minus the train ids (anti join)."""
    docs = _docs(spark, sf)
    train = order.select_ranges(docs, ["doc_id"], [(0, 64)]).select("doc_id")
    return docs.join(train, "doc_id", "left_anti")


@query(
    "shard_contiguous",
    Q.with_ctes(
        [("a", f"SELECT doc_id, {_rank('doc_id')} AS i, count(*) OVER () AS n FROM documents")],
        "SELECT CASE WHEN n // 7 = 0 THEN i ELSE least(i // (n // 7), 6) END AS shard, count(*)::BIGINT AS rows FROM a GROUP BY 1",
    ),
)
def shard_contiguous(spark, sf):
    s = order.shard_ids(_docs(spark, sf), ["doc_id"], 7)
    return s.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "batch_rows",
    Q.with_ctes(
        [("a", f"SELECT doc_id, {_rank(SEEDED)} AS i, count(*) OVER () AS n FROM documents")],
        "SELECT doc_id, i // 32 AS batch, i % 32 AS pos FROM a WHERE i < (n // 32) * 32",
    ),
)
def batch_rows(spark, sf):
    docs = _docs(spark, sf).withColumn("_sk", order.seeded_key(42, "doc_id"))
    return order.batches(docs, ["_sk", "doc_id"], 32).select("doc_id", "batch", "pos")


@query(
    "union_by_name",
    "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents "
    "UNION ALL SELECT item_id + 1000000000 AS doc_id, NULL AS lang, md5(text) AS text_md5 FROM benchmark",
)
def union_by_name(spark, sf):
    """Benchmark rows have no ``lang``; it comes back NULL."""
    d = documents(spark, sf).select("text", "doc_id", "lang")
    b = table(spark, sf, "benchmark").select("text", (F.col("item_id") + 1000000000).alias("doc_id"))
    return mix.union_by_name([d, b]).select("doc_id", "lang", F.md5("text").alias("text_md5"))


_INTERLEAVE_SRC = (
    "SELECT 0 AS source, doc_id AS id, md5(text) AS text_md5, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents "
    "UNION ALL SELECT 1, item_id, md5(text), row_number() OVER (ORDER BY item_id) - 1, count(*) OVER () FROM benchmark "
    "UNION ALL SELECT 2, page_id, md5(html), row_number() OVER (ORDER BY page_id) - 1, count(*) OVER () FROM pages"
)


def _interleave(spark, sf, partial: bool):
    frames = [
        documents(spark, sf).select(F.col("doc_id").alias("id"), "text"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
        table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")),
    ]
    out = mix.interleave(frames, ["id", "id", "id"], partial_last_round=partial)
    return out.select(F.col("pos").cast("bigint").alias("pos"), F.col("source").cast("int").alias("source"), "id", F.md5("text").alias("text_md5"))


@query(
    "interleave_all_exhausted",
    Q.with_ctes(
        [("s", _INTERLEAVE_SRC), ("m", "SELECT max(n) AS mx FROM s")],
        "SELECT (r * 3 + source)::BIGINT AS pos, source, id, text_md5 FROM (SELECT source, id, text_md5, unnest(range(i, mx, n)) AS r FROM s, m)",
    ),
)
def interleave_all_exhausted(spark, sf):
    return _interleave(spark, sf, False)


@query(
    "interleave_partial",
    Q.with_ctes(
        [
            ("s", _INTERLEAVE_SRC),
            ("m", "SELECT max(n) AS mx FROM s"),
            ("l", "SELECT max(source) AS ls FROM s, m WHERE n = mx"),
        ],
        "SELECT pos, source, id, text_md5 FROM (SELECT (r * 3 + source)::BIGINT AS pos, source, id, text_md5 FROM (SELECT source, id, text_md5, unnest(range(i, mx, n)) AS r FROM s, m)), m, l WHERE pos <= (mx - 1) * 3 + ls",
    ),
)
def interleave_partial(spark, sf):
    return _interleave(spark, sf, True)


EPOCHS = (0, 1, 2)


def _epoch_sql(epoch: int) -> str:
    """The places of one epoch: the Feistel rounds as nested queries, walked until below n."""
    keys = order.EpochOrder(1, SEED, epoch).keys

    def rounds(source: str) -> str:
        sql = f"SELECT *, x >> rb AS l, x & rm AS r FROM ({source})"
        for i, key in enumerate(keys):
            side, other, mask = ("l", "r", "lm") if i % 2 == 0 else ("r", "l", "rm")
            sql = f"SELECT *, xor({other}, {key}) & {order._M31} AS t FROM ({sql})"
            for factor, shift in order._MIX:
                sql = f"SELECT * REPLACE (xor(t, t >> {shift}) AS t) FROM (SELECT * REPLACE ((t * {factor}) & {order._M31} AS t) FROM ({sql}))"
            sql = f"SELECT * EXCLUDE t REPLACE (xor({side}, t & {mask}) AS {side}) FROM ({sql})"
        return f"SELECT doc_id, n, rb, lm, rm, (l << rb) | r AS x FROM ({sql})"

    numbered = (
        "SELECT doc_id, n, rb, ((1::BIGINT << (bits - rb)) - 1)::BIGINT AS lm, ((1::BIGINT << rb) - 1)::BIGINT AS rm, i AS x FROM ("
        "SELECT *, (bits // 2)::INTEGER AS rb FROM (SELECT *, greatest(2, length(bin(n - 1)))::INTEGER AS bits FROM ("
        "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)))"
    )
    return f"e{epoch} AS ({rounds(numbered)} UNION ALL {rounds(f'SELECT * FROM e{epoch} WHERE x >= n')})"


@query(
    "epoch_order",
    "WITH RECURSIVE " + ", ".join(_epoch_sql(e) for e in EPOCHS) + " " + " UNION ALL ".join(f"SELECT {e} AS epoch, doc_id, x AS place FROM e{e} WHERE x < n" for e in EPOCHS),
)
def epoch_order(spark, sf):
    """L2 for training: every document's place in three epochs, from one numbering and without a sort."""
    docs, n = order.indexed(documents(spark, sf).select("doc_id"), "doc_id", out="i")
    frames = [order.epoch_order(docs, "i", n, SEED, e).select(F.lit(e).alias("epoch"), "doc_id", "place") for e in EPOCHS]
    return reduce(DataFrame.unionByName, frames)


@query(
    "epoch_batch",
    "WITH RECURSIVE " + _epoch_sql(2) + " SELECT doc_id, x AS place FROM e2 WHERE x < n AND x // 32 = 3",
)
def epoch_batch(spark, sf):
    """One batch of 32 of an epoch, found by the inverse order."""
    docs, n = order.indexed(documents(spark, sf).select("doc_id"), "doc_id", out="i")
    return order.epoch_batch(docs, "i", n, SEED, 2, 3, 32).select("doc_id", "place")
