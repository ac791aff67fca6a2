"""Flattening nested records and column housekeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws


def flatten_abstract(
    df: DataFrame,
    title: str = "MedlineCitation.Article.ArticleTitle",
    abstract: str = "MedlineCitation.Article.Abstract.AbstractText",
    out: str = "text",
) -> DataFrame:
    """``collapse(title + ' ' + abstract)``; NULL when either part is NULL.

    Nested-schema pruning on parquet reads only the two leaf fields.
    """
    return df.withColumn(out, collapse_ws(F.concat(F.col(title), F.lit(" "), F.col(abstract))))


def project_rename(df: DataFrame, drop=(), rename=None, keep=None) -> DataFrame:
    """Drop, rename and optionally keep a column subset, in that order."""
    out = df.drop(*drop)
    for old, new in (rename or {}).items():
        out = out.withColumnRenamed(old, new)
    if keep is not None:
        out = out.select(*keep)
    return out
