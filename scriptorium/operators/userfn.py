"""User-function surface (UF1-UF3, UF5 is ``plans.recipes``).

Column expressions are the default (``DataFrame.transform(op)`` chains).
These helpers are the escape hatches for logic that has no column form:
Arrow-batched pandas functions, never row-at-a-time Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """UF1 escape hatch: ``fn`` maps each Arrow batch (a pandas frame) to output rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def keep_where(df: DataFrame, predicate: Column) -> DataFrame:
    """UF2: row predicate as a column expression."""
    return df.where(predicate)


def collate(df: DataFrame, batch: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """UF3: per-batch function (a collator).  Batches come from W5, so every
    group holds at most ``batch_size`` rows."""
    return df.groupBy(batch).applyInPandas(fn, schema)
