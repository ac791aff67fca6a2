"""Ordered stage recipes (UF5): a recipe is a list of DataFrame -> DataFrame steps.

A stage is a small frozen dataclass holding its parameters; running a recipe
is ``reduce(DataFrame.transform, stages)``, so the whole chain stays one lazy
plan that Catalyst optimises end to end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.sections import clean_articles, fence
from ..functions.text import word_count_blanks
from ..operators.dedupe import dedupe_exact
from ..operators.filters import useful_content
from ..operators.order import split_90_5_5
from ..session import checkpoint


@dataclass(frozen=True)
class Clean:
    source: str = "article"
    target: str = "text"

    def __call__(self, df: DataFrame) -> DataFrame:
        return fence(clean_articles(df, self.source, self.target))


@dataclass(frozen=True)
class UsefulContent:
    column: str = "text"
    min_words: int = K.MIN_USEFUL_WORDS

    def __call__(self, df: DataFrame) -> DataFrame:
        return useful_content(df, self.column, self.min_words)


@dataclass(frozen=True)
class DedupeExact:
    column: str = "text"
    order_id: str = "doc_id"

    def __call__(self, df: DataFrame) -> DataFrame:
        return dedupe_exact(df, self.column, self.order_id, computed=True)


@dataclass(frozen=True)
class SplitFractions:
    """L5 as the corpus scripts do it: 90 / 5 / 5, both cuts with one seed; drops and renames columns."""

    key: str = "doc_id"
    seed: int = 42
    drop: tuple[str, ...] = ("article",)
    rename: tuple[tuple[str, str], ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        out = split_90_5_5(df.drop(*self.drop), self.key, seeds=(self.seed, self.seed))
        return out.withColumnsRenamed(dict(self.rename)) if self.rename else out


def run(df: DataFrame, stages) -> DataFrame:
    return reduce(lambda acc, stage: acc.transform(stage), stages, df)


CORPUS_V4 = (Clean(target="clean_text"), UsefulContent("clean_text"), DedupeExact("clean_text"))
#: The published form: split, without the raw article, the cleaned text named ``text``.
CORPUS_V4_SPLIT = (*CORPUS_V4, SplitFractions(rename=(("clean_text", "text"),)))


def cleaned_corpus(articles: DataFrame, stages=CORPUS_V4) -> DataFrame:
    """Articles -> C1..C7 -> P5 -> W2 (the v4 corpus), columns (doc_id, lang, text)."""
    return run(articles, stages).select("doc_id", "lang", F.col("clean_text").alias("text"))


def published_corpus(articles: DataFrame, stages=CORPUS_V4_SPLIT) -> DataFrame:
    """C -> P5 -> W2 -> L5 (the whole recipe), columns (doc_id, lang, text, split).

    The cleaned corpus is written once; the split reads ids only to find its bounds.
    """
    cleaned = checkpoint(run(articles, stages[:-1]))
    return stages[-1](cleaned).select("doc_id", "lang", "text", "split")


def counts_by_lang(corpus: DataFrame) -> DataFrame:
    """Flagship aggregate: rows and whitespace words per language."""
    return corpus.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(word_count_blanks("text").cast("bigint")).alias("words"),
    )
