"""Range-sorted tables: a row's place and running states without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

_SHIFT = 1 << 33  # monotonically_increasing_id = partition << 33 | row


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in slices that follow each other and are sorted, with the slice's number as ``__slice``.

    The bounds come from a sample, so the result is a reliable checkpoint.
    """
    return checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__slice", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Append the place (from 0) of each row in the order of ``keys``."""
    spark = df.sparkSession
    rows = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.monotonically_increasing_id().alias("__m")))
    slice_no = F.shiftright("__m", 33)
    offsets, total = [], 0
    for s, n in sorted(map(tuple, rows.groupBy(slice_no.alias("s")).count().collect())):  # one row for each slice
        offsets.append((s, total))
        total += n
    before = F.broadcast(spark.createDataFrame(offsets, "s long, before long"))
    return rows.join(before, slice_no == before["s"]).select(*df.columns, (F.col("before") + F.col("__m") % _SHIFT).alias(out))
