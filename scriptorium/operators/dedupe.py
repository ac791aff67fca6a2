"""Exact duplicate removal.

Rule (the corpus scripts sort by text and keep the last row of each equal
run): among rows with equal text keep the one with the highest id (ids are
unique).

Plan: (digest, id) pairs, 16 + 8 bytes a row, are aggregated by digest (hash
aggregate with a partial step, so a text repeated in a third of all rows leaves
each map task as one row).  The ids that lose are joined back (anti join): rows
and texts never enter an aggregate, and columns that are not selected later
are not read.  Two different texts sharing an md5 digest would be merged (probability
about n^2 / 2^129).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def text_digest(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.unhex(F.md5(c))


def losing_ids(df: DataFrame, text: str, order_id: str) -> DataFrame:
    """Ids of the rows whose text has a row with a higher id."""
    pairs = checkpoint(df.select(text_digest(text).alias("_h"), F.col(order_id).alias("_lost")))
    best = pairs.groupBy("_h").agg(F.max("_lost").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h", "_best")
    # null-safe: rows without a text are duplicates of each other
    same = pairs["_h"].eqNullSafe(best["_h"])
    return pairs.join(best, same & (pairs["_lost"] < best["_best"])).select("_lost")


def dedupe_exact(df: DataFrame, text: str, order_id: str, computed: bool = False) -> DataFrame:
    """``computed``: the rows come out of costly work, not out of a scan.  They are written once; otherwise the
    input is read twice, the second time without the text if that is not selected."""
    if computed:
        df = checkpoint(df)
    lost = losing_ids(df, text, order_id)
    return df.join(lost, df[order_id] == lost["_lost"], "left_anti")
