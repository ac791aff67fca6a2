"""Corpus queries: cleaning chain, filters, dedupe, text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions import sections as S
from ...functions.text import collapse_ws, tokenise_ws, word_count
from ...operators.dedupe import dedupe_exact
from ...operators.filters import drop_blank_pages, filter_labelled, split_malformed, useful_content
from ...operators import stats
from ...sources.tables import documents, table
from .. import fixtures as FX
from .. import recipes
from .. import sqltext as Q
from ..registry import query


def articles(spark, sf):
    return FX.articles(documents(spark, sf))


def cleaned(spark, sf):
    return S.clean_articles(articles(spark, sf), "article", "text", keep_bounds=True)


ART = ("f1", Q.articles_cte())


def _clean_sql(final: str) -> str:
    return Q.with_ctes([ART] + Q.clean_ctes("f1"), final)


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = _clean_sql(
    f"""SELECT lang, count(*)::BIGINT AS rows, sum({Q.words_blanks('text')})::BIGINT AS words
FROM c2 WHERE {Q.useful()} AND doc_id IN (SELECT max(doc_id) FROM c2 WHERE {Q.useful()} GROUP BY text)
GROUP BY lang"""
)


@query("corpus_v4_counts_by_lang", FLAGSHIP_SQL)
def corpus_v4_counts_by_lang(spark, sf):
    """F1 -> C1..C7 -> P5 -> W2 -> rows and words per language (the flagship)."""
    return recipes.counts_by_lang(recipes.cleaned_corpus(articles(spark, sf)))


# ---------------------------------------------------------------- C1..C7


@query(
    "article_sections",
    Q.with_ctes([ART] + Q.sections_ctes("f1"), "SELECT doc_id, sec_start::BIGINT AS sec_start, coalesce(sec_end, -1)::BIGINT AS sec_end FROM s5"),
)
def article_sections(spark, sf):
    df = S.with_sections(articles(spark, sf), "article")
    end = F.coalesce(F.col("sec_end"), F.lit(-1)).cast("bigint")
    return df.select("doc_id", F.col("sec_start").cast("bigint").alias("sec_start"), end.alias("sec_end"))


@query("article_clean", _clean_sql("SELECT doc_id, text FROM c2"))
def article_clean(spark, sf):
    return S.clean_articles(articles(spark, sf), "article", "text").select("doc_id", "text")


_PARA_KEEP = "list_filter(ps, lambda p, i: i - 1 >= sec_start AND (sec_end IS NULL OR i - 1 < sec_end) AND p <> '')"
_PARA_CTES = (
    [ART]
    + Q.sections_ctes("f1")
    + [
        (
            "k",
            f"SELECT doc_id, unnest(list_transform({_PARA_KEEP}, lambda p: regexp_replace(p, ' {{2,}}', ' ', 'g'))) AS paragraph, "
            f"unnest(generate_series(0, len({_PARA_KEEP}) - 1)) AS para_idx FROM s5",
        ),
        (
            "r",
            "SELECT doc_id, para_idx, (starts_with(paragraph, 'fig.') OR starts_with(paragraph, 'table')) AS is_caption, "
            "len(regexp_extract_all(paragraph, '\\p{Nd}+')) / len(string_split(paragraph, ' ')) AS share FROM k",
        ),
        ("pf", "SELECT doc_id, para_idx::BIGINT AS para_idx, is_caption, round(share, 6) AS digit_share, (NOT is_caption AND share < 0.3) AS kept FROM r"),
    ]
)
_PARA_SQL = Q.with_ctes(_PARA_CTES, "SELECT * FROM pf")


@query("paragraph_filter", _PARA_SQL)
def paragraph_filter(spark, sf):
    df = S.paragraph_reasons(articles(spark, sf), "article")
    return df.select(
        "doc_id",
        F.col("para_idx").cast("bigint").alias("para_idx"),
        "is_caption",
        F.round("digit_share", 6).alias("digit_share"),
        "kept",
    )


@query(
    "caption_table_drop",
    Q.with_ctes(
        _PARA_CTES,
        "SELECT count(*)::BIGINT AS paragraphs, count_if(is_caption)::BIGINT AS captions, "
        "count_if(NOT is_caption AND NOT kept)::BIGINT AS digit_heavy, count_if(kept)::BIGINT AS kept FROM pf",
    ),
)
def caption_table_drop(spark, sf):
    df = paragraph_filter(spark, sf)
    return df.agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.count_if("is_caption").alias("captions"),
        F.count_if(~F.col("is_caption") & ~F.col("kept")).alias("digit_heavy"),
        F.count_if("kept").alias("kept"),
    )


@query("useful_content", _clean_sql(f"SELECT doc_id, lang FROM c2 WHERE {Q.useful()}"))
def useful_content_q(spark, sf):
    return useful_content(S.fence(S.clean_articles(articles(spark, sf), "article", "text"))).select("doc_id", "lang")


@query(
    "dedupe_exact",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY text)",
)
def dedupe_exact_q(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "n_chars")
    return dedupe_exact(docs, "text", "doc_id").select("doc_id", "n_chars")


_V4 = f"SELECT doc_id, lang, text FROM c2 WHERE {Q.useful()} AND doc_id IN (SELECT max(doc_id) FROM c2 WHERE {Q.useful()} GROUP BY text)"
_RANK42 = f"(row_number() OVER (ORDER BY {Q.digest(42, 'doc_id')}, doc_id) - 1)"


@query(
    "recipe_corpus_v4",
    Q.with_ctes(
        [ART]
        + Q.clean_ctes("f1")
        + [
            ("v4", _V4),
            ("a", f"SELECT *, {_RANK42} AS i, count(*) OVER () AS n FROM v4"),
            ("h", f"SELECT doc_id, {_RANK42} AS j, count(*) OVER () AS m FROM a WHERE i < ceil(n * 0.1)"),
        ],
        "SELECT a.doc_id, a.lang, a.text, CASE WHEN i >= ceil(n * 0.1) THEN 'train' WHEN j < ceil(m * 0.5) THEN 'test' ELSE 'validation' END AS split "
        "FROM a LEFT JOIN h ON h.doc_id = a.doc_id",
    ),
)
def recipe_corpus_v4(spark, sf):
    """UF5: the ordered recipe Clean -> UsefulContent -> DedupeExact -> SplitFractions."""
    return recipes.published_corpus(articles(spark, sf))


# ---------------------------------------------------------------- P1..P13


@query("collapse_ws", f"SELECT doc_id, {Q.collapse('text')} AS text FROM documents")
def collapse_ws_q(spark, sf):
    return documents(spark, sf).select("doc_id", collapse_ws("text").alias("text"))


@query(
    "tokenise_ws",
    f"SELECT doc_id, len({Q.tokens('text')})::BIGINT AS n_tokens, array_to_string({Q.tokens('text')}, '|') AS tokens FROM documents",
)
def tokenise_ws_q(spark, sf):
    t = tokenise_ws("text")
    return documents(spark, sf).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


_F3 = "SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN NULL ELSE source END AS title, text AS abstract FROM documents"


@query(
    "flatten_abstract",
    Q.with_ctes([("f3", _F3)], "SELECT doc_id, " + Q.collapse("title || ' ' || abstract") + " AS text FROM f3"),
)
def flatten_abstract(spark, sf):
    docs = documents(spark, sf)
    nested = docs.select(
        "doc_id",
        F.struct(
            F.struct(
                F.when(F.col("doc_id") % 40 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("ArticleTitle"),
                F.struct(F.col("text").alias("AbstractText")).alias("Abstract"),
            ).alias("Article")
        ).alias("MedlineCitation"),
    )
    from ...operators.projection import flatten_abstract as op

    return op(nested).select("doc_id", "text")


@query("project_rename", "SELECT doc_id, text AS content, lang FROM documents")
def project_rename(spark, sf):
    from ...operators.projection import project_rename as op

    return op(documents(spark, sf), drop=["n_chars", "source"], rename={"text": "content"})


_F7_LABELS = (
    "SELECT doc_id, lang AS target, CASE WHEN doc_id % 5 = 0 THEN []::INTEGER[] ELSE "
    "list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END, CASE WHEN quality = 0 AND toxic = 0 THEN 7 END], lambda x: x IS NOT NULL) END AS labels "
    "FROM labels JOIN documents USING (doc_id)"
)


def labelled(spark, sf):
    lab = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    arr = F.filter(
        F.array(
            F.when(F.col("quality") == 1, F.lit(0)),
            F.when(F.col("toxic") == 1, F.lit(1)),
            F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(K.NONE_LABEL_ID)),
        ),
        lambda x: x.isNotNull(),
    )
    arr = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<int>")).otherwise(arr)
    return lab.select("doc_id", F.col("lang").alias("target"), arr.alias("labels"))


@query(
    "filter_labelled",
    Q.with_ctes([("f", _F7_LABELS)], "SELECT doc_id, target, array_to_string(labels, ',') AS labels FROM f WHERE length(target) > 0 AND len(labels) > 0 AND labels <> [7]"),
)
def filter_labelled_q(spark, sf):
    out = filter_labelled(labelled(spark, sf), target="target", labels="labels")
    return out.select("doc_id", "target", F.array_join("labels", ",").alias("labels"))


_LINES_SQL = (
    "SELECT CAST(doc_id AS VARCHAR) || chr(9) || 'CPR' || chr(9) || 'Y' || chr(9) || 'CPR:' || CAST(doc_id % 7 AS VARCHAR) || chr(9) || 'Arg1:T1' || chr(9) || 'Arg2:T2' AS value FROM documents "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR) || chr(9) || replace(text, chr(10), ' ') AS value FROM documents "
    "UNION ALL SELECT '' AS value FROM documents WHERE doc_id % 9 = 0"
)


@query(
    "split_malformed",
    Q.with_ctes(
        [("l", _LINES_SQL), ("p", "SELECT value, length(value) > 0 AND len(string_split(value, chr(9))) >= 6 AS ok FROM l")],
        "SELECT CASE WHEN ok THEN 'ok' ELSE 'rejected' END AS kind, count(*)::BIGINT AS n FROM p GROUP BY 1",
    ),
)
def split_malformed_q(spark, sf):
    docs = documents(spark, sf)
    rel = docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit("CPR"), F.lit("Y"), F.concat(F.lit("CPR:"), (F.col("doc_id") % 7).cast("string")), F.lit("Arg1:T1"), F.lit("Arg2:T2")).alias("value"))
    abs_ = docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    empty = docs.where(F.col("doc_id") % 9 == 0).select(F.lit("").alias("value"))
    good, bad = split_malformed(rel.unionByName(abs_).unionByName(empty), 6)
    return good.select(F.lit("ok").alias("kind")).unionByName(bad.select(F.lit("rejected").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_F6 = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_append(string_split(text, chr(10)), '') ELSE string_split(text, chr(10)) END AS pages FROM documents"


@query(
    "drop_blank_pages",
    Q.with_ctes([("f6", _F6)], "SELECT doc_id, len(pages)::BIGINT AS pages_before, len(list_filter(pages, lambda p: p <> ''))::BIGINT AS pages_after FROM f6"),
)
def drop_blank_pages_q(spark, sf):
    b = FX.books(documents(spark, sf))
    return drop_blank_pages(b.withColumn("pages_before", F.size("pages").cast("bigint"))).select(
        "doc_id", "pages_before", F.size("pages").cast("bigint").alias("pages_after")
    )


# ---------------------------------------------------------------- A1, A2, A6, A7


@query("word_total", f"SELECT sum({Q.words('text')})::BIGINT AS words FROM documents")
def word_total(spark, sf):
    return stats.word_total(documents(spark, sf), "text")


@query(
    "page_word_total",
    Q.with_ctes([("f6", _F6)], f"SELECT sum(list_sum(list_transform(pages, lambda p: {Q.words('p')})))::BIGINT AS words FROM f6"),
)
def page_word_total(spark, sf):
    return stats.page_word_total(FX.books(documents(spark, sf)), "pages")


@query(
    "corpus_counts",
    "SELECT source, count(*)::BIGINT AS rows, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source",
)
def corpus_counts(spark, sf):
    return stats.corpus_counts(documents(spark, sf), "source", "text", "n_chars")


@query(
    "length_audit",
    f"""SELECT lang, count(*)::BIGINT AS docs, count_if(w > 512)::BIGINT AS over_512, count_if(w > 4096)::BIGINT AS over_4096,
max(w)::BIGINT AS max_words, sum(w)::BIGINT AS words FROM (SELECT lang, {Q.words('text')} AS w FROM documents) GROUP BY lang""",
)
def length_audit(spark, sf):
    return stats.length_audit(documents(spark, sf), "text", group="lang", limits=(512, 4096))


@query("map_batches_words", f"SELECT doc_id, {Q.words('text')}::BIGINT AS words FROM documents")
def map_batches_words(spark, sf):
    """UF1 escape hatch: per-row Python (``len(text.split())``) over Arrow batches."""
    import pandas as pd

    from ...operators.userfn import map_batches

    def fn(pdf):
        return pd.DataFrame({"doc_id": pdf["doc_id"], "words": pdf["text"].map(lambda t: len(t.split()) if t is not None else None)})

    return map_batches(documents(spark, sf).select("doc_id", "text"), fn, "doc_id long, words long")


@query(
    "length_percentiles",
    Q.with_ctes(
        [("w", f"SELECT lang, {Q.words('text')} AS w FROM documents"), ("r", "SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY w) AS i, count(*) OVER (PARTITION BY lang) AS n FROM w")],
        "SELECT lang, " + ", ".join(f"min(w) FILTER (i >= ceil(n * {q}))::BIGINT AS p{int(q * 100)}" for q in (0.5, 0.9, 0.99)) + " FROM r GROUP BY lang",
    ),
)
def length_percentiles(spark, sf):
    """Exact percentiles of words per document."""
    return stats.length_percentiles(documents(spark, sf), "text", group="lang")


@query("row_predicate", "SELECT doc_id FROM documents WHERE length(text) > 500 AND lang <> 'de'")
def row_predicate(spark, sf):
    """UF2: a user's predicate as a column."""
    from ...operators.userfn import keep_where

    return keep_where(documents(spark, sf), (F.length("text") > 500) & (F.col("lang") != "de")).select("doc_id")


@query("char_ratio", "SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE len(string_split(text, chr(10))) / length(text) END, 9) AS ratio FROM documents")
def char_ratio(spark, sf):
    """Lines per character, 0 for an empty text."""
    from ...functions.text import safe_ratio

    return documents(spark, sf).select("doc_id", F.round(safe_ratio(F.size(F.split("text", "\n", -1)), F.length("text")), 9).alias("ratio"))
