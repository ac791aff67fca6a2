"""Parquet table access (S10) for the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: deal the rows of ``documents`` to so many tasks after the scan.  Unset (the
#: default, and right for a large input) the scan's own splits stand and nothing is shuffled.
SPREAD_CONF = "spark.scriptorium.scan.tasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; spread if the session asks for it (a file of one row group is one task)."""
    df = table(spark, sf_dir, "documents")
    tasks = spark.conf.get(SPREAD_CONF, None)
    return df.repartition(int(tasks)) if tasks else df
