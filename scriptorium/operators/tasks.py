"""Task-table operators: relation assembly (J1, J2, J6, P4), token annotation
(J3), label dimensions and encoding (A4, A5, J4, J5, E10), structured fields
(E1-E4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import explode_rows, tokenise_ws
from .lookup import row_lookup
from .order import row_index


def relation_prompt(e1, e2, text) -> Column:
    """``find relation between entities - {e1} and {e2} in {text}``."""
    pre, rest = K.RELATION_PROMPT.split("{e1}")
    mid, rest = rest.split("{e2}")
    mid2, post = rest.split("{text}")
    return F.concat(F.lit(pre), e1, F.lit(mid), e2, F.lit(mid2), text, F.lit(post))


def after_colon(c) -> Column:
    """``Arg1:T7`` -> ``T7`` (text after the first colon; '' without one)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"^[^:]*:(.*)$", 1)


def latest_entities(entities: DataFrame) -> DataFrame:
    """Entity key (doc_id, entity_id) -> text; a repeated key keeps its last line."""
    return entities.groupBy("doc_id", "entity_id").agg(F.max_by("text", "line_no").alias("text"))


def relation_join(abstracts: DataFrame, entities: DataFrame, relations: DataFrame, strict: bool = False) -> DataFrame:
    """Relations x entities (both arguments) x abstracts -> (sample, target).

    The entities of a document are gathered once into a small map (id -> text,
    the last line wins), so both arguments are read from one join on
    ``doc_id``; Catalyst picks broadcast or shuffle joins from sizes and AQE
    splits skewed keys.  Relations with a missing key drop out and are reported
    by ``relation_orphans``; ``strict`` raises instead.
    """
    if strict:
        relation_orphans(abstracts, entities, relations, strict=True)
    ents = latest_entities(entities).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "text"))).alias("_ents"))
    rel = relations.select("doc_id", "grp", after_colon("arg1").alias("a1"), after_colon("arg2").alias("a2"))
    j = rel.join(ents, "doc_id").join(abstracts.select("doc_id", "text"), "doc_id")
    j = j.withColumn("e1", F.col("_ents")[F.col("a1")]).withColumn("e2", F.col("_ents")[F.col("a2")]).where("e1 IS NOT NULL AND e2 IS NOT NULL")
    return j.select("doc_id", relation_prompt(F.col("e1"), F.col("e2"), F.col("text")).alias("sample"), F.col("grp").alias("target"))


def relation_orphans(abstracts: DataFrame, entities: DataFrame, relations: DataFrame, strict: bool = False) -> DataFrame:
    """Relations whose argument entity or abstract is missing, with the reason."""
    keys = entities.select("doc_id", "entity_id").distinct()
    rel = relations.select("doc_id", "grp", after_colon("arg1").alias("a1"), after_colon("arg2").alias("a2"))
    m1 = rel.join(keys.withColumnRenamed("entity_id", "a1"), ["doc_id", "a1"], "left_anti").select("doc_id", F.lit("arg1").alias("missing"))
    m2 = rel.join(keys.withColumnRenamed("entity_id", "a2"), ["doc_id", "a2"], "left_anti").select("doc_id", F.lit("arg2").alias("missing"))
    m3 = rel.join(abstracts.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("abstract").alias("missing"))
    out = m1.unionByName(m2).unionByName(m3)
    if strict and out.limit(1).count() > 0:
        raise KeyError("relations reference missing entities or abstracts")
    return out


def ddi_relations(sentences: DataFrame, keep=(), strict: bool = False) -> DataFrame:
    """J2 + P9: per sentence, every pair with ddi = 'true' and a type -> prompt.

    Entities are looked up inside the sentence's own array (no shuffle).  An
    argument must match exactly one entity: any other pair is dropped, or, if
    ``strict``, fails the job.
    """
    keep = list(keep)
    pairs = explode_rows(sentences.select(*keep, "_text", "pair", "entity"), "pair", "p")
    pairs = pairs.where((F.col("p._ddi") == "true") & F.col("p._type").isNotNull())

    def pick(eid):
        hits = F.filter("entity", lambda e: e["_id"] == F.col(eid))
        other = F.raise_error(F.concat(F.lit("not exactly one entity: "), F.coalesce(F.col(eid), F.lit("NULL")))).cast("string") if strict else F.lit(None).cast("string")
        return F.when(F.size(hits) == 1, F.get(hits, 0)["_text"]).otherwise(other)

    out = pairs.select(
        *keep,
        "_text",
        pick("p._e1").alias("e1"),
        pick("p._e2").alias("e2"),
        F.col("p._type").alias("target"),
    ).where(F.col("e1").isNotNull() & F.col("e2").isNotNull())
    return out.select(*keep, relation_prompt(F.col("e1"), F.col("e2"), F.col("_text")).alias("sample"), "target")


def token_annotate(df: DataFrame, text: str = "text", entities: str = "entities", out_tokens: str = "tokens", out_labels: str = "labels") -> DataFrame:
    """Whitespace tokens, each labelled with the type of the *last* entity
    entry whose text equals the token, else ``<ignore>``."""
    df = df.withColumn(out_tokens, tokenise_ws(text))
    entries = F.coalesce(F.transform(entities, lambda e: F.struct(e["text"].alias("k"), e["annotation_type"].alias("v"))), F.array().cast("array<struct<k: string, v: string>>"))
    return df.withColumn(out_labels, row_lookup(F.col(out_tokens), entries, "string", K.IGNORE_TAG))


def label_dimension(df: DataFrame, labels: str, exclude=(K.IGNORE_TAG,), is_array: bool = True) -> DataFrame:
    """A4: sorted distinct labels with 0-based ids (numbered by W1: any number of labels)."""
    vals = explode_rows(df, labels, "label", keep=[]) if is_array else df.select(F.col(labels).alias("label"))
    vals = vals.where(~F.col("label").isin(*exclude)) if exclude else vals
    return row_index(vals.distinct(), ["label"], "id").withColumn("id", F.col("id").cast("int"))


def label_dimension_first_seen(df: DataFrame, label: str, order: str) -> DataFrame:
    """A5: distinct labels numbered by first occurrence along ``order``."""
    first = df.groupBy(F.col(label).alias("label")).agg(F.min(order).alias("_first"))
    return row_index(first, ["_first", "label"], "id").select("label", F.col("id").cast("int").alias("id"))


def label_encode(df: DataFrame, label: str, dim: DataFrame, out: str = "label_id", strict: bool = True) -> DataFrame:
    """J4 for a scalar label: inner join (unseen labels vanish; ``strict``
    raises instead) or lenient left join with -100."""
    d = dim.select(F.col("label").alias(label), F.col("id").alias(out))
    if strict:
        missing = df.join(d, label, "left_anti").limit(1).count()
        if missing:
            raise KeyError(f"unseen label in {label}")
        return df.join(d, label)
    return df.join(d, label, "left").withColumn(out, F.coalesce(F.col(out), F.lit(K.IGNORE_INDEX)))


def _by_row(df: DataFrame, array_col: str, dim: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """Adds ``_entries``: the (key, value) entries of ``dim`` that a row's array needs.

    Joins the distinct elements of each row with the dimension, whatever its
    size, and gathers them per row id: as many entries as its rows have distinct
    elements.  Rows that share an id (a null one too) share the entries of all of them.
    """
    need = explode_rows(df.select(F.col(row).alias("_row"), F.array_distinct(array_col).alias("_d")), "_d", "_k", keep=["_row"]).distinct()
    found = need.join(dim.select(F.col(key).alias("_k"), F.col(value).alias("_v")), "_k")
    entries = found.groupBy("_row").agg(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_v").alias("v"))).alias("_entries"))
    none = F.array().cast(entries.schema["_entries"].dataType)
    return df.join(entries, df[row].eqNullSafe(entries["_row"]), "left").drop("_row").withColumn("_entries", F.coalesce("_entries", none))


#: Rows of a dimension that becomes part of the expression; beyond, it is joined.
SMALL = 64


def _small(dim: DataFrame, key: str, value: str):
    """(key, value) of a dimension of few rows with distinct keys and no null values, else None."""
    rows = dim.select(F.col(key).alias("k"), F.col(value).alias("v")).limit(SMALL + 1).collect()
    entries = [(r["k"], r["v"]) for r in rows if r["k"] is not None]
    whole = len(rows) <= SMALL and len({k for k, _ in entries}) == len(entries) and all(v is not None for _, v in entries)
    return entries if whole else None


def _by_entries(keys: Column, entries: list[tuple], value_type: str, missing=None) -> Column:
    """``row_lookup`` for few entries that all rows share: no join, and no Python in the tasks."""
    none = F.lit(missing).cast(value_type)

    def one(x):
        found = None
        for k, v in entries:
            then = F.lit(v).cast(value_type)
            found = F.when(x == F.lit(k), then) if found is None else found.when(x == F.lit(k), then)
        return none if found is None else found.otherwise(none)

    return F.transform(keys, one)


def encode_label_array(df: DataFrame, labels: str, dim: DataFrame, out: str, unknown: int | None = K.IGNORE_INDEX, row: str = "doc_id", value: str = "id") -> DataFrame:
    """J4 for per-token label arrays; ``row`` names the rows and may repeat."""
    value_type = dim.schema[value].dataType.simpleString()
    entries = _small(dim, "label", value)
    if entries is not None:
        return df.withColumn(out, _by_entries(F.col(labels), entries, value_type, unknown))
    found = _by_row(df, labels, dim, "label", value, row)
    return found.withColumn(out, row_lookup(F.col(labels), F.col("_entries"), value_type, unknown)).drop("_entries")


def decode_label_array(df: DataFrame, ids: str, dim: DataFrame, out: str, row: str = "doc_id") -> DataFrame:
    """Ids -> labels; an id without a label gives NULL."""
    entries = _small(dim, "id", "label")
    if entries is not None:
        return df.withColumn(out, _by_entries(F.col(ids), entries, "string"))
    found = _by_row(df, ids, dim, "id", "label", row)
    return found.withColumn(out, row_lookup(F.col(ids), F.col("_entries"), "string")).drop("_entries")


def b_to_i(dim: DataFrame) -> DataFrame:
    """Id of ``B-x`` -> id of ``I-x`` when present, else itself."""
    i = dim.select(F.col("label").alias("_il"), F.col("id").alias("_iid"))
    j = dim.join(i, F.regexp_replace(F.col("label"), "^B-", "I-") == F.col("_il"), "left")
    return j.select("label", "id", F.when(F.col("label").startswith("B-") & F.col("_iid").isNotNull(), F.col("_iid")).otherwise(F.col("id")).alias("i_id"))


def pluck(df: DataFrame, array_col: str, field: str, out: str) -> DataFrame:
    """Field of every struct in an array."""
    return df.withColumn(out, F.transform(array_col, lambda e: e[field]))


def qa_pair(df: DataFrame, question: str = "question", contexts: str = "contexts", sep: str = "[SEP]") -> DataFrame:
    """Contexts joined with the separator token, paired with the question."""
    return df.withColumn("context", F.array_join(contexts, sep)).withColumn("pair", F.struct(F.col(question).alias("first"), F.col("context").alias("second")))


def sentence_pair(df: DataFrame, s1: str = "sentence1", s2: str = "sentence2", score: str = "score") -> DataFrame:
    """Two token segments and a float score."""
    return df.select("*", F.struct(tokenise_ws(s1).alias("first"), tokenise_ws(s2).alias("second"), F.col(score).cast("double").alias("score")).alias("pair"))


def multi_hot(df: DataFrame, labels: str, n_labels: int, out: str = "multi_hot") -> DataFrame:
    """Label id list -> 0/1 vector of length ``n_labels``."""
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: F.array_contains(labels, i).cast("int")))
