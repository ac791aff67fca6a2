"""Row predicates P5-P10 as DataFrame -> DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import word_count, word_count_blanks


def useful_content_flag(text, min_words: int = K.MIN_USEFUL_WORDS, collapsed: bool = True):
    """P5 predicate: mentions a useful-content word and has enough words."""
    c = F.lower(F.col(text))
    mentions = c.contains(K.USEFUL_WORDS[0]) | c.contains(K.USEFUL_WORDS[1])
    words = word_count_blanks(text) if collapsed else word_count(text)
    return mentions & (words >= min_words)


def useful_content(df: DataFrame, text: str = "text", min_words: int = K.MIN_USEFUL_WORDS, collapsed: bool = True) -> DataFrame:
    """P5. ``collapsed=True`` when the text came out of ``clean_articles``
    (only blanks and newlines left), which allows the cheap word count."""
    return df.where(useful_content_flag(text, min_words, collapsed))


def filter_labelled(df: DataFrame, target: str | None = None, labels: str | None = None, none_id: int = K.NONE_LABEL_ID) -> DataFrame:
    """Non-empty string target; non-empty label list that is not the lone none class."""
    cond = F.lit(True)
    if target is not None:
        cond = cond & (F.length(F.col(target)) > 0)
    if labels is not None:
        cond = cond & (F.size(F.col(labels)) > 0) & (F.col(labels) != F.array(F.lit(none_id)))
    return df.where(cond)


def split_malformed(lines: DataFrame, fields: int = 6, value: str = "value", line_no: str | None = None):
    """Bounded tab split; returns (good rows with ``parts``, rejected rows).

    Empty lines and lines with fewer than ``fields`` fields are rejected; the
    caller can count or store the side output.
    """
    parts = lines.withColumn("parts", F.split(F.col(value), "\t", fields))
    ok = (F.length(F.col(value)) > 0) & (F.size("parts") >= fields)
    return parts.where(ok), parts.where(~ok).drop("parts")


def drop_blank_pages(df: DataFrame, pages: str = "pages") -> DataFrame:
    """Remove empty pages from a page array; NULL page arrays go away."""
    return df.where(F.col(pages).isNotNull()).withColumn(pages, F.filter(F.col(pages), lambda p: p != ""))


def books_without_pages(df: DataFrame, pages: str = "pages") -> DataFrame:
    """P8 side output: the rows that ``drop_blank_pages`` loses (no page array)."""
    return df.where(F.col(pages).isNull())
