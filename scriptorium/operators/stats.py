"""Corpus statistics A1, A2, A6, A7 (all single-pass aggregates with map-side combine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count


def word_total(df: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """A1: total whitespace words of a text column."""
    return df.agg(F.sum(word_count(text).cast("bigint")).alias(out))


def page_word_total(df: DataFrame, pages: str = "pages", out: str = "words") -> DataFrame:
    """A2: total words over an ``array<string>`` column of pages."""
    per_row = F.aggregate(F.transform(F.col(pages), lambda p: word_count(p).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return df.agg(F.sum(per_row).alias(out))


def corpus_counts(df: DataFrame, group: str, text: str, chars: str | None = None) -> DataFrame:
    """Rows, newline-separated lines and characters per group."""
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.size(F.split(F.col(text), "\n", -1)).cast("bigint")).alias("lines"),
    ]
    if chars:
        aggs.append(F.sum(F.col(chars)).cast("bigint").alias("chars"))
    return df.groupBy(group).agg(*aggs)


def length_audit(df: DataFrame, text: str, group: str | None = None, limits=(512, 4096)) -> DataFrame:
    """Documents over each length limit, longest document, total words."""
    w = word_count(text)
    scored = df.select(*([group] if group else []), w.alias("_w"))
    aggs = [F.count(F.lit(1)).alias("docs")]
    aggs += [F.count_if(F.col("_w") > lim).alias(f"over_{lim}") for lim in limits]
    aggs += [F.max("_w").cast("bigint").alias("max_words"), F.sum(F.col("_w").cast("bigint")).alias("words")]
    return (scored.groupBy(group) if group else scored).agg(*aggs)


def length_percentiles(df: DataFrame, text: str, group: str, quantiles=(0.5, 0.9, 0.99)) -> DataFrame:
    """Exact percentiles (nearest rank) of words per document.

    Counted from the histogram of lengths per group: the window runs over distinct
    lengths, not over documents, so a group with most of the rows is no larger than its lengths.
    """
    hist = df.select(group, word_count(text).alias("_w")).groupBy(group, "_w").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group)
    run = hist.withColumn("_upto", F.sum("_n").over(w.orderBy("_w"))).withColumn("_all", F.sum("_n").over(w))
    return run.groupBy(group).agg(*[F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(q)), F.col("_w"))).cast("bigint").alias(f"p{int(q * 100)}") for q in quantiles])
