"""Article cleaning C1-C7 as built-in column expressions (no UDF).

Paragraph semantics: the article is lower-cased and split on ``\\n`` only;
each paragraph is stripped of Unicode whitespace.  The section runs from the
first paragraph that starts or ends with the start marker (one past it when
the paragraph *ends* with the marker) up to the first later non-start
paragraph carrying a conclusion marker (kept, plus one following paragraph)
or an end marker (excluded).  Kept paragraphs are whitespace-collapsed,
caption paragraphs and digit-heavy paragraphs are dropped, and the rest is
joined with newlines.

Everything runs inside the JVM: ``translate`` for whitespace, ``split`` and
higher-order ``transform``/``filter`` for the paragraph array.  The functions
take a DataFrame so the paragraph array is projected once and reused by the
later steps instead of being recomputed per reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .text import affix_any, blank_whitespace, digit_runs, let


def paragraphs(text) -> Column:
    """Lower-case, split on newline, strip every paragraph."""
    text = F.col(text) if isinstance(text, str) else text
    blanked = blank_whitespace(F.lower(text), keep_newline=True)
    return F.transform(F.split(blanked, "\n", -1), lambda p: F.trim(p))


def _is_start(p: Column) -> Column:
    return affix_any(p, [K.INTRO_MARKER])


def section_start(ps: Column) -> tuple[Column, Column]:
    """Returns (1-based position of the first start paragraph or 0, start index)."""
    first = F.array_position(F.transform(ps, _is_start), True)
    bump = F.when(F.get(ps, (first - 1).cast("int")).endswith(K.INTRO_MARKER), 1).otherwise(0)
    start = F.when(first == 0, F.lit(0)).otherwise((first - 1 + bump).cast("int"))
    return first, start


def section_end(ps: Column, first: Column, start: Column) -> Column:
    """Exclusive end index or NULL (no end, or end <= start)."""

    def scan(b):
        def candidate(p, i):
            after_start = (b["first"] > 0) & (i > b["first"] - 1) & ~_is_start(p)
            return F.when(
                after_start,
                F.when(affix_any(p, K.CONCLUSION_MARKERS), i + 2).when(affix_any(p, K.END_MARKERS), i),
            )

        hit = F.get(F.filter(F.transform(ps, candidate), lambda z: z.isNotNull()), 0)
        return F.when(hit > b["start"], hit)

    # first/start are read inside the per-paragraph lambda: bind them once
    return let(F.struct(first.alias("first"), start.alias("start")), scan)


def with_sections(df: DataFrame, text: str = "article") -> DataFrame:
    """Adds ``_ps`` (paragraph array), ``sec_start`` and ``sec_end``."""
    df = df.withColumn("_ps", paragraphs(text))
    first, start = section_start(F.col("_ps"))
    df = df.withColumn("_first", first).withColumn("sec_start", start)
    return df.withColumn("sec_end", section_end(F.col("_ps"), F.col("_first"), F.col("sec_start"))).drop("_first")


def kept_paragraphs(ps: Column, start: Column, end: Column) -> Column:
    """C4: slice to the section, drop empty paragraphs, collapse blanks."""
    def keep(b):
        return F.filter(ps, lambda p, i: (i >= b["start"]) & (b["end"].isNull() | (i < b["end"])) & (p != ""))

    inside = let(F.struct(start.alias("start"), end.alias("end")), keep)
    return F.transform(inside, lambda p: F.regexp_replace(p, " {2,}", " "))


def not_caption(p: Column) -> Column:
    """C5 predicate: paragraph does not start with a caption prefix."""
    return ~(p.startswith(K.CAPTION_PREFIXES[0]) | p.startswith(K.CAPTION_PREFIXES[1]))


def digit_share(p: Column) -> Column:
    """C6 measure: digit runs per word of a collapsed, non-empty paragraph.

    Empty paragraphs are dropped before this step, so the word count is at
    least 1 and the zero-safe ratio (P12) is not needed here.
    """
    return digit_runs(p) / F.size(F.split(p, " ", -1))


def filter_paragraphs(kept: Column) -> Column:
    """C5 + C6."""
    no_caption = F.filter(kept, not_caption)
    return F.filter(no_caption, lambda p: digit_share(p) < K.MAX_DIGIT_SHARE)


def join_paragraphs(ps: Column) -> Column:
    """Newline join, remove the front-matter residue, strip."""
    return F.trim(F.replace(F.array_join(ps, "\n"), F.lit(K.FRONT_RESIDUE), F.lit("")), F.lit(" \n"))


def clean_articles(df: DataFrame, text: str = "article", out: str = "text", keep_bounds: bool = False) -> DataFrame:
    """C1-C7 on a DataFrame column; adds ``out`` with the cleaned text."""
    df = with_sections(df, text)
    df = df.withColumn("_kept", kept_paragraphs(F.col("_ps"), F.col("sec_start"), F.col("sec_end")))
    df = df.withColumn(out, join_paragraphs(filter_paragraphs(F.col("_kept"))))
    drop = ["_ps", "_kept"] + ([] if keep_bounds else ["sec_start", "sec_end"])
    return df.drop(*drop)


def paragraph_reasons(df: DataFrame, text: str = "article") -> DataFrame:
    """One row per in-section paragraph with its C5/C6 verdict.

    Output adds ``para_idx`` (position among kept paragraphs), ``paragraph``,
    ``is_caption``, ``digit_share`` and ``kept``.
    """
    df = with_sections(df, text)
    df = df.withColumn("_kept", kept_paragraphs(F.col("_ps"), F.col("sec_start"), F.col("sec_end")))
    # posexplode_outer: the inner form makes Catalyst infer ``size(_kept) > 0``
    # and push it below the projections, which would inline (and re-run) the
    # whole paragraph chain inside that filter.
    df = df.select(*[c for c in df.columns if c not in ("_ps", "_kept")], F.posexplode_outer("_kept").alias("para_idx", "paragraph"))
    df = df.where(F.col("paragraph").isNotNull())
    share = digit_share(F.col("paragraph"))
    caption = ~not_caption(F.col("paragraph"))
    return (
        df.withColumn("is_caption", caption)
        .withColumn("digit_share", share)
        .withColumn("kept", ~caption & (share < K.MAX_DIGIT_SHARE))
    )


def fence(df: DataFrame) -> DataFrame:
    """Evaluate every column of ``df`` exactly once, here.

    Catalyst pushes a filter through projections by substituting the projected
    expressions into the predicate, and through repartitions.  After the
    paragraph chain that would (a) re-run the chain inside the predicate once
    per reference and (b) move it in front of a spreading shuffle.  A one-row
    ``inline_outer`` generator computes the struct once per row and a predicate
    over its output cannot move below it.  Column pruning still applies above.
    """
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(c) for c in df.columns]))))
