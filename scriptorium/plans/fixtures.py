"""Derived inputs F1-F9 built from the supplied tables with Spark.

The supplied ``documents`` carry no section headings, relation files or tag
sequences, so the operators are exercised on inputs that Spark derives from
the real tables (the same expressions exist in DuckDB SQL for the oracles).
All of them scale with the base tables; none is a fixed literal table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_rows, let, tokenise_ws

NL = "\n"

# F1 shapes: prefix / suffix wrapped around the document text by doc_id % 6.
ARTICLE_SHAPES = {
    0: ("Front matter\nIntroduction\n", "\nConclusion\nFinal words here\nReferences\nRef 1 2 3"),
    1: ("Introduction to it\n", "\nFunding\nnone"),
    2: ("", ""),
    3: ("An introduction\nReferences\n", ""),
    4: ("", "\nConclusions"),
    5: ("==== Front\nIntroduction\nFig. 1 a\n  Table 2 b\n1 2 3 a\n", ""),
}


def articles(documents: DataFrame) -> DataFrame:
    """``(doc_id, lang, article)``."""
    shape = F.col("doc_id") % 6
    expr = None
    for k, (pre, post) in ARTICLE_SHAPES.items():
        body = F.concat(F.lit(pre), F.col("text"), F.lit(post))
        expr = F.when(shape == k, body) if expr is None else expr.when(shape == k, body)
    return documents.select("doc_id", "lang", expr.alias("article"))


def spread_words(text_col: str = "text", n: int = 2):
    """``n`` words spread evenly over the whole text, from the first to the last one."""
    parts = F.split(F.replace(F.col(text_col), F.lit(NL), F.lit(" ")), " ", -1)
    return [F.get(parts, F.floor(F.lit(i) * (F.size(parts) - 1) / (n - 1)).cast("int")) for i in range(n)]


def relation_inputs(documents: DataFrame):
    """abstracts, entity rows and relation rows as they would come out of
    the three tab-separated files.

    entities: ``(doc_id, entity_id, text, line_no)``; ``T2`` is missing where
    ``doc_id % 50 = 0`` (orphans) and ``T1`` of every tenth document appears a
    second time with a higher line number (last wins).
    relations: ``(doc_id, grp, arg1, arg2, line_no)``.
    """
    e1, e2 = spread_words()
    base = documents.select("doc_id", "text", e1.alias("e1"), e2.alias("e2"))
    abstracts = base.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def entity(name, text, line, there=None):
        e = F.struct(F.lit(name).alias("entity_id"), text.alias("text"), (F.col("doc_id") * 3 + line).alias("line_no"))
        return e if there is None else F.when(there, e)

    found = F.array(
        entity("T1", F.col("e1"), 0),
        entity("T2", F.col("e2"), 1, F.col("doc_id") % 50 != 0),
        entity("T1", F.concat(F.col("e1"), F.lit("!")), 2, F.col("doc_id") % 10 == 0),
    )
    entities = explode_rows(base.select(F.col("doc_id").cast("string").alias("doc_id"), found.alias("_e")), "_e", "e").select("doc_id", "e.*")
    relations = base.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("CPR:"), (F.col("doc_id") % 7).cast("string")).alias("grp"),
        F.lit("Arg1:T1").alias("arg1"),
        F.lit("Arg2:T2").alias("arg2"),
        F.col("doc_id").alias("line_no"),
    )
    return abstracts, entities, relations


def entity_lines(entities: DataFrame) -> DataFrame:
    """F2 entities rendered as tab-separated lines (tabs inside the last field kept)."""
    return entities.select(
        F.concat_ws("\t", "doc_id", "entity_id", F.lit("Chemical"), F.lit("0"), F.lit("1"), "text").alias("value"), "line_no"
    )


def relation_lines(relations: DataFrame) -> DataFrame:
    return relations.select(F.concat_ws("\t", "doc_id", F.lit("CPR"), F.lit("Y"), "grp", "arg1", "arg2").alias("value"), "line_no")


PICO_TYPES = ("Participant", "Intervention", "Outcome")


def annotated(documents: DataFrame) -> DataFrame:
    """``(doc_id, text, entities array<struct<text, annotation_type>>)``.

    Entities, over the whole text: every word whose md5 starts with 0, typed by
    the next digit; then the first two words as one entity, and word 1 again
    with another type (the later entry wins).
    """
    base = documents.select("doc_id", "text", tokenise_ws("text").alias("_toks"))

    def entity(w):
        digit = F.conv(F.substring(F.md5(w), 2, 1), 16, 10).cast("int") % 3
        return F.struct(w.alias("text"), F.get(F.array(*[F.lit(t) for t in PICO_TYPES]), digit).alias("annotation_type"))

    chosen = F.transform(F.filter("_toks", lambda w: F.substring(F.md5(w), 1, 1) == "0"), entity)
    first, second = F.get("_toks", 0), F.get("_toks", 1)
    more = F.array(
        F.struct(F.concat_ws(" ", first, second).alias("text"), F.lit("Outcome").alias("annotation_type")),
        F.struct(first.alias("text"), F.lit("Outcome").alias("annotation_type")),
    )
    arr = F.filter(F.concat(chosen, more), lambda e: e["text"].isNotNull())
    return base.select("doc_id", "text", arr.alias("entities"))


def qa_contexts(conversations: DataFrame) -> DataFrame:
    """F5 (QA form): question = turn 0, contexts = other turns in turn order."""
    q = conversations.where(F.col("turn") == 0).select("conv_id", F.col("text").alias("question"))
    ctx = (
        conversations.where(F.col("turn") > 0)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_c"))
        .select("conv_id", F.col("_c.text").alias("contexts"))
    )
    return q.join(ctx, "conv_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def sentence_pairs(conversations: DataFrame) -> DataFrame:
    """F5 (pair form): every turn with the next one, score = word-count ratio (next / this)."""
    a = conversations.select("conv_id", "turn", F.col("text").alias("sentence1"))
    b = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    p = a.join(b, ["conv_id", "turn"])
    n1 = F.size(tokenise_ws("sentence1"))
    n2 = F.size(tokenise_ws("sentence2"))
    return p.withColumn("score", F.when(n1 == 0, F.lit(0.0)).otherwise(n2 / n1))


def books(documents: DataFrame) -> DataFrame:
    """``pages = split(text, newline)`` plus an empty page every third document."""
    pages = F.split(F.col("text"), NL, -1)
    pages = F.when(F.col("doc_id") % 3 == 0, F.concat(pages, F.array(F.lit("")))).otherwise(pages)
    return documents.select("doc_id", pages.alias("pages"))


def predictions(labels: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(doc_id, ref, pred, ref2)``; pred flips quality when the first hex
    digit of md5('pred|' || doc_id) is 0, 1 or 2."""
    d = F.substring(F.md5(F.concat(F.lit("pred|"), F.col("doc_id").cast("string"))), 1, 1)
    flip = d.isin("0", "1", "2")
    out = labels.select(
        "doc_id",
        F.col("quality").alias("ref"),
        F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("pred"),
        F.col("toxic").alias("ref2"),
    )
    return out


def tag_sequences(documents: DataFrame) -> DataFrame:
    """F7 tags over every word of the document: gold IOB2-ish tags from
    md5('g|doc|pos'), predicted tags from salt 'p' on a quarter of positions."""
    toks = tokenise_ws("text")

    def digests(salt, tokens):
        # what all positions of a document share is put together once
        start = F.concat(F.lit(salt + "|"), F.col("doc_id").cast("string"), F.lit("|"))
        return let(start, lambda s: F.transform(tokens, lambda t, i: F.md5(F.concat(s, i.cast("string")))))

    def tag(h):
        # hex digits sort like the numbers they stand for: first one 0-2, 3-5, others; second one even or odd
        typ = F.when(F.substring(h, 2, 1).isin(*"02468ace"), F.lit("x")).otherwise(F.lit("y"))
        return F.when(h < "3", F.concat(F.lit("B-"), typ)).when(h < "6", F.concat(F.lit("I-"), typ)).otherwise(F.lit("O"))

    def pred(t, i):
        return let(F.md5(F.concat(F.lit("p|"), F.col("doc_id").cast("string"), F.lit("|"), i.cast("string"))), tag)

    df = documents.select("doc_id", toks.alias("tokens"))
    df = df.withColumn("gold", F.transform(digests("g", F.col("tokens")), tag))
    return df.withColumn("pred", F.transform(F.arrays_zip(F.col("gold").alias("t"), digests("q", F.col("gold")).alias("h")), lambda z, i: F.when(z["h"] < "4", pred(z["t"], i)).otherwise(z["t"])))


def training_log(events: DataFrame) -> DataFrame:
    """F8: ``(step, loss, epoch)``; a quarter of the steps carry no epoch (NULL)."""
    return events.select(F.col("event_id").alias("step"), F.col("value").alias("loss"), F.when(F.col("event_id") % 4 < 3, F.col("event_id") % 4).alias("epoch"))
