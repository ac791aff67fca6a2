"""Task-table queries: relations, tagging tables, label dimensions, pairs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions.text import tokenise_ws
from ...operators import observed as OB
from ...operators import tasks as T
from ...session import checkpoint
from ...sources.tables import documents, table
from .. import fixtures as FX
from .. import sqltext as Q
from ..registry import query
from .corpus import labelled, _F7_LABELS

# the fixed template as an SQL expression
PROMPT_SQL = " || ".join(x if x.startswith("{") else Q.lit(x) for x in re.split(r"(\{\w+\})", K.RELATION_PROMPT) if x)

_F2 = [
    ("base", "SELECT doc_id, text, string_split(replace(text, chr(10), ' '), ' ') AS parts FROM documents"),
    ("abstracts", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM base"),
    (
        "entities",
        "SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'T1' AS entity_id, parts[1] AS text, doc_id * 3 AS line_no FROM base "
        "UNION ALL SELECT CAST(doc_id AS VARCHAR), 'T2', parts[len(parts)], doc_id * 3 + 1 FROM base WHERE doc_id % 50 <> 0 "
        "UNION ALL SELECT CAST(doc_id AS VARCHAR), 'T1', parts[1] || '!', doc_id * 3 + 2 FROM base WHERE doc_id % 10 = 0) WHERE text IS NOT NULL",
    ),
    (
        "relations",
        "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'CPR:' || CAST(doc_id % 7 AS VARCHAR) AS grp, 'Arg1:T1' AS arg1, 'Arg2:T2' AS arg2 FROM base",
    ),
    ("rel", "SELECT doc_id, grp, regexp_extract(arg1, '^[^:]*:(.*)$', 1) AS a1, regexp_extract(arg2, '^[^:]*:(.*)$', 1) AS a2 FROM relations"),
]


def _relation_inputs(spark, sf):
    abstracts, entities, relations = FX.relation_inputs(documents(spark, sf))
    return abstracts, entities.where(F.col("text").isNotNull()), relations


@query(
    "relation_join",
    Q.with_ctes(
        _F2 + [("ents", "SELECT doc_id, entity_id, arg_max(text, line_no) AS text FROM entities GROUP BY doc_id, entity_id")],
        "SELECT r.doc_id, "
        + PROMPT_SQL.format(e1="x.text", e2="y.text", text="a.text")
        + " AS sample, r.grp AS target FROM rel r JOIN ents x ON x.doc_id = r.doc_id AND x.entity_id = r.a1 "
        "JOIN ents y ON y.doc_id = r.doc_id AND y.entity_id = r.a2 JOIN abstracts a ON a.doc_id = r.doc_id",
    ),
)
def relation_join(spark, sf):
    return T.relation_join(*_relation_inputs(spark, sf))


@query(
    "relation_orphans",
    Q.with_ctes(
        _F2,
        "SELECT doc_id, 'arg1' AS missing FROM rel r WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.doc_id = r.doc_id AND e.entity_id = r.a1) "
        "UNION ALL SELECT doc_id, 'arg2' FROM rel r WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.doc_id = r.doc_id AND e.entity_id = r.a2) "
        "UNION ALL SELECT doc_id, 'abstract' FROM rel r WHERE NOT EXISTS (SELECT 1 FROM abstracts a WHERE a.doc_id = r.doc_id)",
    ),
)
def relation_orphans(spark, sf):
    return T.relation_orphans(*_relation_inputs(spark, sf))


@query(
    "relation_prompt",
    Q.with_ctes(_F2, "SELECT doc_id, " + PROMPT_SQL.format(e1="parts[1]", e2="parts[len(parts)]", text="text") + " AS sample FROM base"),
)
def relation_prompt(spark, sf):
    e1, e2 = FX.spread_words()
    docs = documents(spark, sf)
    return docs.select("doc_id", T.relation_prompt(e1, e2, F.col("text")).alias("sample"))


def sentences(spark, sf):
    """XML-shaped sentences (entity and pair arrays) derived from documents."""
    docs = documents(spark, sf)
    words = FX.spread_words(n=3)
    ent = F.filter(
        F.array(
            *[F.struct(F.lit(f"e{i}").alias("_id"), words[i].alias("_text")) for i in range(3)],
            # every sixth sentence has two entities e2: its pairs match no single one
            F.struct(F.lit("e2").alias("_id"), F.when(F.col("doc_id") % 6 == 0, F.lit("again")).alias("_text")),
        ),
        lambda e: e["_text"].isNotNull(),
    )
    ddi = F.when(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    typ = F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("mechanism"))
    pair = F.array(
        F.struct(F.lit("e0").alias("_e1"), F.lit("e1").alias("_e2"), ddi.alias("_ddi"), typ.alias("_type")),
        F.struct(F.lit("e1").alias("_e1"), F.lit("e2").alias("_e2"), F.lit("true").alias("_ddi"), F.lit("effect").alias("_type")),
        F.struct(F.lit("e0").alias("_e1"), F.lit("e9").alias("_e2"), F.lit("true").alias("_ddi"), F.lit("advise").alias("_type")),
    )
    return docs.select("doc_id", F.col("text").alias("_text"), ent.alias("entity"), pair.alias("pair"))


_SENT = (
    "SELECT doc_id, text AS _text, list_filter([{'_id': 'e0', '_text': p[1]}, {'_id': 'e1', '_text': p[1 + (len(p) - 1) // 2]}, {'_id': 'e2', '_text': p[len(p)]}, {'_id': 'e2', '_text': CASE WHEN doc_id % 6 = 0 THEN 'again' END}], lambda e: e._text IS NOT NULL) AS entity, "
    "[{'_e1': 'e0', '_e2': 'e1', '_ddi': CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1))::INTEGER % 2 = 0 THEN 'true' ELSE 'false' END, '_type': CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'mechanism' END}, "
    "{'_e1': 'e1', '_e2': 'e2', '_ddi': 'true', '_type': 'effect'}, {'_e1': 'e0', '_e2': 'e9', '_ddi': 'true', '_type': 'advise'}] AS pair "
    "FROM (SELECT doc_id, text, string_split(replace(text, chr(10), ' '), ' ') AS p FROM documents)"
)


@query(
    "ddi_relations",
    Q.with_ctes(
        [
            ("s", _SENT),
            ("u", "SELECT doc_id, _text, entity, unnest(pair) AS p FROM s"),
            (
                "v",
                "SELECT doc_id, _text, CASE WHEN len(list_filter(entity, lambda e: e._id = p._e1)) = 1 THEN list_filter(entity, lambda e: e._id = p._e1)[1]._text END AS e1, "
                "CASE WHEN len(list_filter(entity, lambda e: e._id = p._e2)) = 1 THEN list_filter(entity, lambda e: e._id = p._e2)[1]._text END AS e2, p._type AS target "
                "FROM u WHERE p._ddi = 'true' AND p._type IS NOT NULL",
            ),
        ],
        "SELECT doc_id, " + PROMPT_SQL.format(e1="e1", e2="e2", text="_text") + " AS sample, target FROM v WHERE e1 IS NOT NULL AND e2 IS NOT NULL",
    ),
)
def ddi_relations(spark, sf):
    s = sentences(spark, sf)
    return T.ddi_relations(s, keep=("doc_id",))


def _ents_sql():
    toks = Q.tokens("text")
    types = "[" + ", ".join(f"'{t}'" for t in FX.PICO_TYPES) + "]"
    chosen = f"list_transform(list_filter(t, lambda w: substr(md5(w), 1, 1) = '0'), lambda w: {{'text': w, 'annotation_type': {types}[1 + ('0x' || substr(md5(w), 2, 1))::INTEGER % 3]}})"
    more = "[{'text': concat_ws(' ', t[1], t[2]), 'annotation_type': 'Outcome'}, {'text': t[1], 'annotation_type': 'Outcome'}]"
    return f"SELECT doc_id, text, list_filter(list_concat({chosen}, {more}), lambda e: e.text IS NOT NULL) AS entities FROM (SELECT doc_id, text, {toks} AS t FROM documents)"


_ANN = [
    ("f4", _ents_sql()),
    (
        "ann",
        f"SELECT doc_id, entities, {Q.tokens('text')} AS tokens FROM f4",
    ),
    (
        "lab",
        "SELECT doc_id, entities, tokens, list_transform(tokens, lambda t: coalesce(list_filter(entities, lambda e: e.text = t)[-1].annotation_type, '<ignore>')) AS labels FROM ann",
    ),
]


def annotated(spark, sf):
    return T.token_annotate(FX.annotated(documents(spark, sf)))


@query(
    "token_annotate",
    Q.with_ctes(_ANN, "SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(labels, '|') AS labels FROM lab"),
)
def token_annotate(spark, sf):
    a = annotated(spark, sf)
    return a.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("labels", "|").alias("labels"))


@query(
    "pluck_entities",
    Q.with_ctes(
        _ANN[:1],
        "SELECT doc_id, array_to_string(list_transform(entities, lambda e: e.text), '|') AS texts, array_to_string(list_transform(entities, lambda e: e.annotation_type), '|') AS types FROM f4",
    ),
)
def pluck_entities(spark, sf):
    a = FX.annotated(documents(spark, sf))
    a = T.pluck(T.pluck(a, "entities", "text", "texts"), "entities", "annotation_type", "types")
    return a.select("doc_id", F.array_join("texts", "|").alias("texts"), F.array_join("types", "|").alias("types"))


@query(
    "label_dimension",
    Q.with_ctes(
        _ANN,
        "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS id FROM (SELECT DISTINCT unnest(labels) AS label FROM lab) WHERE label <> '<ignore>'",
    ),
)
def label_dimension(spark, sf):
    return T.label_dimension(annotated(spark, sf), "labels")


@query(
    "label_dimension_first_seen",
    "SELECT source AS label, (row_number() OVER (ORDER BY min(doc_id), source) - 1)::INTEGER AS id FROM documents GROUP BY source",
)
def label_dimension_first_seen(spark, sf):
    return T.label_dimension_first_seen(documents(spark, sf), "source", "doc_id")


@query(
    "label_encode",
    "SELECT d.doc_id, l.id AS label_id FROM documents d JOIN (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS id FROM (SELECT DISTINCT lang FROM documents)) l USING (lang)",
)
def label_encode(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang")
    dim = T.label_dimension(docs, "lang", exclude=None, is_array=False)
    return T.label_encode(docs, "lang", dim, "label_id").select("doc_id", "label_id")


def _tags(spark, sf):
    return FX.tag_sequences(documents(spark, sf))


def _tag_sql(salt: str, i: str) -> str:
    h = f"md5('{salt}|' || CAST(doc_id AS VARCHAR) || '|' || CAST({i} AS VARCHAR))"
    d0 = f"('0x' || substr({h}, 1, 1))::INTEGER"
    typ = f"CASE WHEN ('0x' || substr({h}, 2, 1))::INTEGER % 2 = 0 THEN 'x' ELSE 'y' END"
    return f"CASE WHEN {d0} <= 2 THEN 'B-' || {typ} WHEN {d0} <= 5 THEN 'I-' || {typ} ELSE 'O' END"


def tags_ctes():
    toks = Q.tokens("text")
    q = "md5('q|' || CAST(doc_id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR))"
    return [
        ("t0", f"SELECT doc_id, {toks} AS tokens FROM documents"),
        ("t1", f"SELECT doc_id, tokens, list_transform(tokens, lambda t, i: {_tag_sql('g', 'i - 1')}) AS gold FROM t0"),
        ("tags", f"SELECT doc_id, tokens, gold, list_transform(gold, lambda t, i: CASE WHEN substr({q}, 1, 1) IN ('0', '1', '2', '3') THEN {_tag_sql('p', 'i - 1')} ELSE t END) AS pred FROM t1"),
        ("tagdim", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS id FROM (SELECT DISTINCT unnest(gold) AS label FROM tags)"),
    ]


@query(
    "label_dimension_tags",
    Q.with_ctes(tags_ctes(), "SELECT label, id FROM tagdim"),
)
def label_dimension_tags(spark, sf):
    return T.label_dimension(_tags(spark, sf), "gold", exclude=None)


@query(
    "label_decode",
    Q.with_ctes(
        tags_ctes()
        + [
            ("e", "SELECT doc_id, unnest(gold) AS g, unnest(range(1, len(gold) + 1)) AS pos FROM tags"),
            ("ids", "SELECT e.doc_id, list(d.id ORDER BY pos) AS ids, list(d.label ORDER BY pos) AS labs FROM e JOIN tagdim d ON d.label = e.g GROUP BY e.doc_id"),
        ],
        "SELECT t.doc_id, coalesce(array_to_string(ids, ','), '') AS ids, coalesce(array_to_string(labs, '|'), '') AS decoded FROM tags t LEFT JOIN ids USING (doc_id)",
    ),
)
def label_decode(spark, sf):
    t = _tags(spark, sf)
    dim = checkpoint(T.label_dimension(t, "gold", exclude=None))
    enc = T.encode_label_array(t, "gold", dim, "ids")
    dec = T.decode_label_array(enc, "ids", dim, "decoded")
    return dec.select("doc_id", F.array_join("ids", ",").alias("ids"), F.array_join("decoded", "|").alias("decoded"))


@query(
    "b_to_i_map",
    Q.with_ctes(
        tags_ctes(),
        "SELECT d.label, d.id, CASE WHEN starts_with(d.label, 'B-') AND i.id IS NOT NULL THEN i.id ELSE d.id END AS i_id "
        "FROM tagdim d LEFT JOIN tagdim i ON i.label = regexp_replace(d.label, '^B-', 'I-')",
    ),
)
def b_to_i_map(spark, sf):
    return T.b_to_i(T.label_dimension(_tags(spark, sf), "gold", exclude=None))


_F5_Q = (
    "SELECT q.conv_id, q.text AS question, coalesce(c.contexts, []::VARCHAR[]) AS contexts FROM (SELECT conv_id, text FROM conversations WHERE turn = 0) q "
    "LEFT JOIN (SELECT conv_id, list(text ORDER BY turn) AS contexts FROM conversations WHERE turn > 0 GROUP BY conv_id) c USING (conv_id)"
)


@query("qa_pair", Q.with_ctes([("f5", _F5_Q)], "SELECT conv_id, question, array_to_string(contexts, '[SEP]') AS context FROM f5"))
def qa_pair(spark, sf):
    return T.qa_pair(FX.qa_contexts(table(spark, sf, "conversations"))).select("conv_id", "question", "context")


_F5_P = "SELECT a.conv_id, a.turn, a.text AS sentence1, b.text AS sentence2 FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"


def pairs_sql():
    n1 = f"len({Q.tokens('sentence1')})"
    n2 = f"len({Q.tokens('sentence2')})"
    return [("p0", _F5_P), ("pairs", f"SELECT conv_id, turn, sentence1, sentence2, {n1} AS n1, {n2} AS n2, CASE WHEN {n1} = 0 THEN 0.0 ELSE {n2} / {n1} END AS score FROM p0")]


@query(
    "sentence_pair",
    Q.with_ctes(pairs_sql(), "SELECT conv_id, turn, n1::BIGINT AS n1, n2::BIGINT AS n2, round(score, 6) AS score FROM pairs"),
)
def sentence_pair(spark, sf):
    p = T.sentence_pair(FX.sentence_pairs(table(spark, sf, "conversations")))
    return p.select(
        "conv_id",
        "turn",
        F.size("pair.first").cast("bigint").alias("n1"),
        F.size("pair.second").cast("bigint").alias("n2"),
        F.round("pair.score", 6).alias("score"),
    )


@query(
    "multi_hot",
    Q.with_ctes([("f", _F7_LABELS)], "SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN list_contains(labels, i) THEN 1 ELSE 0 END), ',') AS multi_hot FROM f"),
)
def multi_hot(spark, sf):
    return T.multi_hot(labelled(spark, sf), "labels", 8).select("doc_id", F.array_join("multi_hot", ",").alias("multi_hot"))


def _observed_sql():
    orphan = "NOT EXISTS (SELECT 1 FROM entities e WHERE e.doc_id = r.doc_id AND e.entity_id = r.{a})"
    return Q.with_ctes(
        _F2
        + [
            ("s", _SENT),
            ("u", "SELECT entity, p FROM (SELECT entity, unnest(pair) AS p FROM s) WHERE p._ddi = 'true' AND p._type IS NOT NULL"),
        ],
        f"SELECT 'arg1' AS kind, count(*) FILTER ({orphan.format(a='a1')})::BIGINT AS n FROM rel r "
        f"UNION ALL SELECT 'arg2', count(*) FILTER ({orphan.format(a='a2')})::BIGINT FROM rel r "
        "UNION ALL SELECT 'abstract', count(*) FILTER (NOT EXISTS (SELECT 1 FROM abstracts a WHERE a.doc_id = r.doc_id))::BIGINT FROM rel r "
        "UNION ALL SELECT 'relations', count(*)::BIGINT FROM rel "
        "UNION ALL SELECT 'pairs', count(*)::BIGINT FROM u "
        "UNION ALL SELECT 'ambiguous', count(*) FILTER (len(list_filter(entity, lambda e: e._id = p._e1)) <> 1 OR len(list_filter(entity, lambda e: e._id = p._e2)) <> 1)::BIGINT FROM u "
        "UNION ALL SELECT 'unseen', count(*) FILTER (source IN ('src1', 'src2'))::BIGINT FROM documents "
        "UNION ALL SELECT 'rejected', count(*) FILTER (doc_id % 7 = 0)::BIGINT FROM documents",
    )


@query("observed_losses", _observed_sql())
def observed_losses(spark, sf):
    """What each operator loses, counted in the pass that makes its rows."""
    docs = documents(spark, sf)
    dim = T.label_dimension(docs.where(~F.col("source").isin("src1", "src2")), "source", is_array=False)
    short = F.when(F.col("doc_id") % 7 == 0, F.concat_ws("\t", "doc_id", F.lit("T1"))).otherwise(F.concat_ws("\t", "doc_id", F.lit("T1"), F.lit("x"), F.lit("0"), F.lit("1"), "lang"))
    counts: dict[str, int] = {}
    for rows, seen in (
        OB.relation_join_counted(*_relation_inputs(spark, sf)),
        OB.ddi_relations_counted(sentences(spark, sf)),
        OB.label_encode_counted(docs.select("doc_id", "source"), "source", dim),
        OB.well_formed_lines(docs.select(short.alias("value")), 6),
    ):
        rows.write.format("noop").mode("overwrite").save()
        got = dict(seen.get)
        total = got.pop("rows")
        counts |= got | ({"relations": total} if "arg1" in got else {"pairs": total} if "ambiguous" in got else {})
    return spark.createDataFrame(list(counts.items()), "kind string, n long")
