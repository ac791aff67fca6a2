"""Connected components of a link table, by random contraction.

In every round each node looks at the hashes of its neighbours and itself and
takes the node with the smallest one as parent; links then join the parents.  The links left
shrink by a constant factor in expectation, so the rounds grow with the
logarithm of the nodes.  A hub's links are pre-aggregated before the shuffle
(``min``) and split by the skew join; the driver only learns whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (a long, b long) -> (node, root): one row for every linked node.

    Loops and repeated links do no harm; an empty table gives an empty one.
    """
    spark = links.sparkSession
    left = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(rounds))
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("n"))
        parents = written(nearest.select(F.col("a").alias("node"), F.least(F.col("m"), own)["n"].alias("root")), f"{name}-parents")
        rounds.append(parents)
        pa = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(pa, "a").join(pb, "b").where("ra <> rb")
        left = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-links")
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    found = rounds[-1]
    for parents in reversed(rounds[:-1]):
        above = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = parents.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return found
