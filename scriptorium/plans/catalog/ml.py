"""Learned baselines B1-B4 (row checks only: model fitting has no SQL form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...ml import baselines as B
from ...operators import tasks as T
from ...sources.tables import documents, table
from .. import fixtures as FX
from .. import sqltext as Q
from ..registry import query
from .tasks import pairs_sql


@query("baseline_multiclass")
def baseline_multiclass(spark, sf):
    """B1 on the relation table (sample -> target)."""
    abstracts, entities, relations = FX.relation_inputs(documents(spark, sf))
    rel = T.relation_join(abstracts, entities.where(F.col("text").isNotNull()), relations)
    return B.multiclass(rel, "sample", "target", "doc_id")


@query("baseline_multilabel")
def baseline_multilabel(spark, sf):
    """B2 on documents with quality / toxic labels."""
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return B.multilabel(d, "text", ["quality", "toxic"], "doc_id")


@query("baseline_pair_regression")
def baseline_pair_regression(spark, sf):
    """B3 on sentence pairs from conversations."""
    p = FX.sentence_pairs(table(spark, sf, "conversations"))
    return B.pair_regression(p, "sentence1", "sentence2", "score", "conv_id")


@query("baseline_tagger")
def baseline_tagger(spark, sf):
    """B4 on the tag sequences."""
    t = FX.tag_sequences(documents(spark, sf))
    return B.tagger(t, "tokens", "gold", "doc_id")


def _held_out(source: str, key: str) -> str:
    order_by = Q.digest(1337, key)
    return f"SELECT *, row_number() OVER (ORDER BY {order_by}, {key}) - 1 AS i, count(*) OVER () AS n FROM ({source})"


@query(
    "baseline_split_sizes",
    Q.with_ctes(
        [("l", _held_out("SELECT d.doc_id, quality, toxic FROM documents d JOIN labels USING (doc_id)", "doc_id"))],
        "SELECT CASE WHEN i < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS rows, sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic FROM l GROUP BY 1",
    ),
)
def baseline_split_sizes(spark, sf):
    """B2's inputs: rows and positive labels of the two splits it trains and tests on."""
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "quality", "toxic")
    train, test = B._split(d, "doc_id")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("quality").cast("bigint").alias("quality"), F.sum("toxic").cast("bigint").alias("toxic"))


@query(
    "baseline_pair_features",
    Q.with_ctes(
        pairs_sql() + [("t", f"SELECT conv_id, turn, {Q.tokens('lower(sentence1)')} AS a, {Q.tokens('lower(sentence2)')} AS b FROM pairs")],
        "SELECT conv_id, turn, len(a)::BIGINT AS n1, len(b)::BIGINT AS n2, len(list_intersect(a, b))::BIGINT AS common FROM t",
    ),
)
def baseline_pair_features(spark, sf):
    """B3's features: words of both sentences and distinct words in common."""
    p = FX.sentence_pairs(table(spark, sf, "conversations"))
    f = B.pair_features(p, "sentence1", "sentence2")
    return f.select("conv_id", "turn", *[F.col(c).cast("bigint").alias(c) for c in ("n1", "n2", "common")])


_TERMS = ("1.0", "n1", "n2", "common")


def _det(rows: list[list[str]]) -> str:
    """Determinant of a matrix of SQL expressions."""
    if len(rows) == 1:
        return rows[0][0]
    parts = []
    for k, x in enumerate(rows[0]):
        minor = _det([[c for j, c in enumerate(r) if j != k] for r in rows[1:]])
        parts.append(f"{'-' if k % 2 else '+'} {x} * ({minor})")
    return " ".join(parts)


def _normal_equations() -> str:
    sums = ", ".join(f"sum({a} * {b})::DOUBLE AS m{i}{j}" for i, a in enumerate(_TERMS) for j, b in enumerate(_TERMS) if i <= j)
    sums += ", " + ", ".join(f"sum({a} * score)::DOUBLE AS y{i}" for i, a in enumerate(_TERMS))
    matrix = [[f"m{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
    names = ("intercept", "n1", "n2", "common")
    solved = [[["y%d" % i if j == k else matrix[i][j] for j in range(4)] for i in range(4)] for k in range(4)]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS term, round(({_det(s)}) / ({_det(matrix)}), 8) AS coefficient FROM sums" for n, s in zip(names, solved))
    return Q.with_ctes(
        pairs_sql()
        + [
            ("t", f"SELECT score::DOUBLE AS score, {Q.tokens('lower(sentence1)')} AS a, {Q.tokens('lower(sentence2)')} AS b FROM pairs"),
            ("f", "SELECT score, len(a)::DOUBLE AS n1, len(b)::DOUBLE AS n2, len(list_intersect(a, b))::DOUBLE AS common FROM t"),
            ("sums", f"SELECT {sums} FROM f"),
        ],
        rows,
    )


@query("baseline_pair_coefficients", _normal_equations())
def baseline_pair_coefficients(spark, sf):
    """B3's coefficients on all sentence pairs, against the normal equations solved by Cramer's rule."""
    model = B.pair_model(FX.sentence_pairs(table(spark, sf, "conversations")), "sentence1", "sentence2", "score")
    found = [("intercept", float(model.intercept)), *zip(("n1", "n2", "common"), map(float, model.coefficients.toArray()))]
    return spark.createDataFrame(found, "term string, coefficient double").select("term", F.round("coefficient", 8).alias("coefficient"))
