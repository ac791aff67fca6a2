"""Vocabulary, encoding, padding, alignment and masked-LM queries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions.text import explode_rows
from ...operators import encode as E
from ...operators import mix, order
from ...operators import subword as SW
from ...operators import tasks as T
from ...session import checkpoint
from ...sources.tables import documents, table
from .. import fixtures as FX
from .. import sqltext as Q
from ..registry import query
from .tasks import tags_ctes

VOCAB_K = 32_000
VOCAB_SIZE = VOCAB_K + len(K.SPECIAL_TOKENS)
MAX_LEN = 4096
SEED = 42


def _docs(spark, sf):
    return documents(spark, sf)


def vocab(spark, sf):
    return E.vocab_words(_docs(spark, sf), "text", VOCAB_K)


def encoded(spark, sf, add_special=False, words=None, docs=None):
    """``docs``: rows to encode (all columns but ``text`` are kept); ``words``: a vocabulary learned before."""
    d = (_docs(spark, sf).select("doc_id", "text") if docs is None else docs).withColumn("toks", E.lower_tokens("text")).drop("text")
    return E.encode_ids(d, "toks", vocab(spark, sf) if words is None else words, "ids", add_special=add_special).drop("toks")


def padded(spark, sf, words=None, docs=None):
    ids, mask = E.truncate_pad(F.col("ids"), MAX_LEN)
    return encoded(spark, sf, words=words, docs=docs).withColumn("input_ids", ids).withColumn("attention_mask", mask).drop("ids")


def masked(spark, sf, words=None, docs=None):
    """Truncated, masked, then padded."""
    ids = F.col("input_ids")
    cut = encoded(spark, sf, words=words, docs=docs).withColumn("input_ids", E.truncate(F.col("ids"), MAX_LEN)).drop("ids")
    m = E.mask_columns(cut, "input_ids", "doc_id", SEED, VOCAB_SIZE)
    m = m.withColumn("attention_mask", E.attention(ids, MAX_LEN)).withColumn("input_ids", E.pad_right(ids, MAX_LEN))
    return m.withColumn("masked_ids", E.pad_right(F.col("masked_ids"), MAX_LEN)).withColumn("labels", E.pad_right(F.col("labels"), MAX_LEN, K.IGNORE_INDEX))


def _join(c, sep=","):
    return F.array_join(F.col(c), sep)


_TOK = f"SELECT doc_id, {Q.tokens('lower(text)')} AS toks FROM documents"
VOCAB_CTES = [
    ("tok", _TOK),
    ("w", "SELECT unnest(toks) AS word FROM tok"),
    ("c", "SELECT word, count(*) AS n FROM w GROUP BY word"),
    ("v", f"SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 4)::INTEGER AS id, n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, word) <= {VOCAB_K}"),
]
ENC_CTES = VOCAB_CTES + [
    ("e", "SELECT doc_id, unnest(toks) AS word, unnest(range(1, len(toks) + 1)) AS pos FROM tok"),
    ("g", "SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY pos) AS content FROM e LEFT JOIN v USING (word) GROUP BY e.doc_id"),
    ("enc", "SELECT t.doc_id, coalesce(g.content, []::INTEGER[]) AS content FROM tok t LEFT JOIN g USING (doc_id)"),
]


def _zeros(n: str, v: int = 0) -> str:
    return f"list_transform(range(0, {n}), lambda z: {v})"


PAD_CTES = ENC_CTES + [
    ("ids", f"SELECT doc_id, list_concat([{K.CLS_ID}], content[1:{MAX_LEN - 2}], [{K.SEP_ID}]) AS ids FROM enc"),
    (
        "pad",
        f"SELECT doc_id, list_concat(ids, {_zeros(f'greatest({MAX_LEN} - len(ids), 0)')}) AS input_ids, "
        f"list_concat({_zeros('len(ids)', 1)}, {_zeros(f'greatest({MAX_LEN} - len(ids), 0)')}) AS attention_mask FROM ids",
    ),
]


def _u(part: int) -> str:
    h = f"md5('{SEED}|' || CAST(doc_id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR))"
    return f"(('0x' || substr({h}, {8 * part + 1}, 8))::BIGINT / 4294967296.0)"


_CHOSEN = f"(x NOT IN ({K.PAD_ID}, {K.CLS_ID}, {K.SEP_ID}) AND {_u(0)} < {K.MLM_PROBABILITY})"
MASK_CTES = PAD_CTES + [
    (
        "msk",
        f"SELECT doc_id, input_ids, attention_mask, list_transform(input_ids, lambda x, i: CASE WHEN {_CHOSEN} THEN x ELSE {K.IGNORE_INDEX} END) AS labels, "
        f"list_transform(input_ids, lambda x, i: CASE WHEN NOT {_CHOSEN} THEN x WHEN {_u(1)} < {K.MASK_REPLACE_SHARE} THEN {K.MASK_ID} "
        f"WHEN {_u(2)} < {K.RANDOM_OF_REST_SHARE} THEN floor({_u(3)} * {VOCAB_SIZE})::INTEGER ELSE x END) AS masked_ids FROM pad",
    )
]


@query("vocab_words", Q.with_ctes(VOCAB_CTES, "SELECT word, id, n FROM v"))
def vocab_words(spark, sf):
    return vocab(spark, sf).select("word", "id", "n")


@query(
    "encode_ids",
    Q.with_ctes(ENC_CTES, f"SELECT doc_id, (len(content) + 2)::BIGINT AS n_ids, array_to_string(list_concat([{K.CLS_ID}], content, [{K.SEP_ID}]), ',') AS ids FROM enc"),
)
def encode_ids(spark, sf):
    e = encoded(spark, sf, add_special=True)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), _join("ids").alias("ids"))


@query(
    "truncate_pad",
    Q.with_ctes(PAD_CTES, "SELECT doc_id, array_to_string(input_ids, ',') AS input_ids, array_to_string(attention_mask, ',') AS attention_mask FROM pad"),
)
def truncate_pad(spark, sf):
    return padded(spark, sf).select("doc_id", _join("input_ids").alias("input_ids"), _join("attention_mask").alias("attention_mask"))


_BATCHED = ENC_CTES + [
    ("b", f"SELECT doc_id, list_concat([{K.CLS_ID}], content, [{K.SEP_ID}]) AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM enc"),
    ("t", "SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch) / 8) * 8)::INTEGER AS padded_len FROM b"),
]
_PADDED = f"SELECT doc_id, batch, array_to_string(list_concat(ids, {_zeros('padded_len - len(ids)', K.PAD_ID)}), ',') AS padded FROM t"


def _batched(spark, sf):
    """Documents in batches of 32 by id: numbered first (ids and text only), encoded after."""
    docs = order.row_index(_docs(spark, sf).select("doc_id", "text"), ["doc_id"], "_i").withColumn("batch", F.floor(F.col("_i") / 32).cast("bigint")).drop("_i")
    return encoded(spark, sf, add_special=True, docs=docs)


@query("pad_dynamic", Q.with_ctes(_BATCHED, _PADDED))
def pad_dynamic(spark, sf):
    p = E.pad_dynamic(_batched(spark, sf), "ids", "batch", multiple_of=8)
    return p.select("doc_id", "batch", _join("padded").alias("padded"))


@query("mlm_labels", Q.with_ctes(MASK_CTES, "SELECT doc_id, array_to_string(labels, ',') AS labels FROM msk"))
def mlm_labels(spark, sf):
    return masked(spark, sf).select("doc_id", _join("labels").alias("labels"))


@query("mlm_inputs", Q.with_ctes(MASK_CTES, "SELECT doc_id, array_to_string(masked_ids, ',') AS input_ids FROM msk"))
def mlm_inputs(spark, sf):
    return masked(spark, sf).select("doc_id", _join("masked_ids").alias("input_ids"))


@query(
    "mlm_audit",
    Q.with_ctes(
        MASK_CTES
        + [("pos", "SELECT unnest(input_ids) AS x, unnest(masked_ids) AS y, unnest(labels) AS l FROM msk")],
        f"SELECT count_if(x NOT IN ({K.PAD_ID}, {K.CLS_ID}, {K.SEP_ID}))::BIGINT AS eligible, count_if(l <> -100)::BIGINT AS chosen, "
        f"count_if(l <> -100 AND y = {K.MASK_ID})::BIGINT AS masked, count_if(l <> -100 AND y = x)::BIGINT AS unchanged, "
        f"count_if(l <> -100 AND y <> x AND y <> {K.MASK_ID})::BIGINT AS randomised FROM pos",
    ),
)
def mlm_audit(spark, sf):
    m = masked(spark, sf)
    z = explode_rows(m.select(F.arrays_zip("input_ids", "masked_ids", "labels").alias("_z")), "_z", "z", keep=[]).select("z.*")
    x, y, l = F.col("input_ids"), F.col("masked_ids"), F.col("labels")
    chosen = l != K.IGNORE_INDEX
    return z.agg(
        F.count_if(~x.isin(K.PAD_ID, K.CLS_ID, K.SEP_ID)).alias("eligible"),
        F.count_if(chosen).alias("chosen"),
        F.count_if(chosen & (y == K.MASK_ID)).alias("masked"),
        F.count_if(chosen & (y == x)).alias("unchanged"),
        F.count_if(chosen & (y != x) & (y != K.MASK_ID)).alias("randomised"),
    )


@query(
    "mlm_examples",
    Q.with_ctes(
        MASK_CTES
        + [("o", f"SELECT *, row_number() OVER (ORDER BY {Q.digest(SEED, 'doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM msk")],
        "SELECT doc_id, i // 8 AS batch, array_to_string(masked_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels, "
        "array_to_string(attention_mask, ',') AS attention_mask FROM o WHERE i < (n // 8) * 8",
    ),
)
def mlm_examples(spark, sf):
    """M4: fixed batches of 8 in seeded order, then encode -> truncate/pad -> mask.

    The order depends on ids only, so documents are numbered before anything is
    encoded, and every text is encoded and masked once.
    """
    docs = _docs(spark, sf).select("doc_id", "text").withColumn("_sk", order.seeded_key(SEED, "doc_id"))
    b = order.batches(docs, ["_sk", "doc_id"], 8).drop("_sk", "pos")
    m = masked(spark, sf, docs=b)
    return m.select("doc_id", "batch", _join("masked_ids").alias("input_ids"), _join("labels").alias("labels"), _join("attention_mask").alias("attention_mask"))


# ---------------------------------------------------------------- sub-words: vocabulary, longest match (V1, V2)

LONGEST = 6
SUBWORD_CTES = [
    ("tok", _TOK),
    ("sw", f"SELECT word, count(*) AS n FROM (SELECT unnest(toks) AS word FROM tok) WHERE length(word) BETWEEN 1 AND {SW.MAX_WORD} GROUP BY word"),
    ("cut", f"SELECT (CASE WHEN i = 1 THEN '' ELSE '##' END) || substr(word, i, l) AS token, n FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM sw), range(1, {LONGEST + 1}) t(l) WHERE i + l - 1 <= length(word)"),
    ("sc", "SELECT token, sum(n)::BIGINT AS n FROM cut GROUP BY token"),
    ("sv", f"SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 4)::INTEGER AS id, n FROM sc QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB_K}"),
]


def _matched(words: str) -> list[tuple]:
    """CTEs that cut the words of a query into the longest pieces: ``pieces`` (word, ids)."""
    return [
        ("mw", f"SELECT DISTINCT word FROM ({words})"),
        (
            "m",
            "SELECT word, 1::BIGINT AS pos, []::INTEGER[] AS ids FROM mw UNION ALL SELECT word, pos + l, list_append(ids, id) FROM ("
            "SELECT m.word, m.pos, m.ids, v.id, t.l, row_number() OVER (PARTITION BY m.word ORDER BY t.l DESC) AS r "
            f"FROM m, range(1, {LONGEST + 1}) t(l), sv v WHERE m.pos + t.l - 1 <= length(m.word) AND length(m.word) <= {SW.MAX_WORD} "
            "AND v.token = (CASE WHEN m.pos = 1 THEN '' ELSE '##' END) || substr(m.word, m.pos, t.l)) WHERE r = 1",
        ),
        ("pieces", f"SELECT word, coalesce(ids, [{K.UNK_ID}]) AS ids FROM mw LEFT JOIN (SELECT word, ids FROM m WHERE pos > length(word)) USING (word)"),
    ]


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def subword_vocab(spark, sf):
    return SW.vocab_substrings(_docs(spark, sf), "text", VOCAB_K, LONGEST)


@query("vocab_substrings", Q.with_ctes(SUBWORD_CTES, "SELECT token, id, n FROM sv"))
def vocab_substrings(spark, sf):
    """V1(c): the 32,000 most frequent pieces of words."""
    return subword_vocab(spark, sf)


@query("vocab_subwords")
def vocab_subwords(spark, sf):
    """L4 -> V1(b): a vocabulary of 32,000 merged pieces learned from a seeded sample of 100,000 rows."""
    return SW.learn_subwords(order.sample_n(_docs(spark, sf).select("doc_id", "text"), 100_000, SEED, "doc_id"), "text", VOCAB_K)


_WORDS_BY_DOC = "SELECT doc_id, unnest(toks) AS word, unnest(range(1, len(toks) + 1)) AS pos FROM tok"


@query(
    "encode_subwords",
    _recursive(
        Q.with_ctes(
            [*SUBWORD_CTES, ("e", _WORDS_BY_DOC), *_matched("SELECT word FROM e")],
            f"SELECT doc_id, (len(content) + 2)::BIGINT AS n_ids, array_to_string(list_concat([{K.CLS_ID}], content, [{K.SEP_ID}]), ',') AS ids FROM ("
            "SELECT doc_id, coalesce(flatten(list(ids ORDER BY pos) FILTER (ids IS NOT NULL)), []::INTEGER[]) AS content FROM tok LEFT JOIN e USING (doc_id) LEFT JOIN pieces USING (word) GROUP BY doc_id)",
        )
    ),
)
def encode_subwords(spark, sf):
    """V2: longest match over a sub-word vocabulary."""
    docs = _docs(spark, sf).select("doc_id", E.lower_tokens("text").alias("toks"))
    e = SW.encode_subwords(docs, "toks", subword_vocab(spark, sf), "ids")
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), _join("ids").alias("ids"))


@query("encode_learned_subwords")
def encode_learned_subwords(spark, sf):
    """V1(b) -> V2: the learned vocabulary of 32,000 merged pieces, longest match over all documents."""
    docs = _docs(spark, sf).select("doc_id", E.lower_tokens("text").alias("toks"))
    e = SW.encode_subwords(docs, "toks", vocab_subwords(spark, sf), "ids")
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), _join("ids").alias("ids"))


# ---------------------------------------------------------------- alignment

ALIGN_LEN = 512


def _align(spark, sf, mode):
    t = FX.tag_sequences(_docs(spark, sf)).select("doc_id", "tokens", "gold")
    # the dimension is learned once and read by every join below
    dim = checkpoint(T.label_dimension(t, "gold", exclude=("O",) if mode == "every" else None))
    ids = T.encode_label_array(t, "gold", dim, "ids", unknown=K.IGNORE_INDEX if mode == "every" else None)
    inside = None
    if mode == "all":
        ids = T.encode_label_array(ids, "gold", T.b_to_i(dim), "inside", unknown=None, value="i_id")
        inside = F.col("inside")
    cut = SW.subword_ids(ids.withColumn("_words", F.transform("tokens", F.lower)), "_words", subword_vocab(spark, sf))
    out = cut.withColumn("pieces", SW.subword_table(F.col("pieces"), ALIGN_LEN))
    return out.select("doc_id", F.array_join(E.align_labels(F.col("pieces"), F.col("ids"), mode, inside), ",").alias("labels"))


def _align_sql(mode):
    dim = "tagdim" if mode != "every" else "tagdim2"
    lab = f"(SELECT map(list(label), list(id)) FROM {dim})"
    ctes = tags_ctes() + [
        *SUBWORD_CTES,
        ("tw", "SELECT doc_id, lower(unnest(tokens)) AS word, unnest(range(0, len(tokens))) AS i FROM tags"),
        *_matched("SELECT word FROM tw"),
        ("tagdim2", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS id FROM (SELECT DISTINCT unnest(gold) AS label FROM tags) WHERE label <> 'O'"),
        ("bi", "SELECT d.id, CASE WHEN starts_with(d.label, 'B-') AND i.id IS NOT NULL THEN i.id ELSE d.id END AS i_id FROM tagdim d LEFT JOIN tagdim i ON i.label = regexp_replace(d.label, '^B-', 'I-')"),
        ("lb", f"SELECT {lab} AS lm, (SELECT map(list(id), list(i_id)) FROM bi) AS bm"),
        ("cutup", "SELECT doc_id, flatten(list(list_transform(range(0, len(ids)), lambda k: {'word': i, 'sub': k}) ORDER BY i)) AS pieces FROM tw JOIN pieces USING (word) GROUP BY doc_id"),
        ("pc", f"SELECT doc_id, gold, coalesce(pieces, [])[1:{ALIGN_LEN - 2}] AS pieces FROM tags LEFT JOIN cutup USING (doc_id)"),
    ]
    word_label = "lm[gold[x.word + 1]]"
    if mode == "first":
        body = f"list_transform(pieces, lambda x: CASE WHEN x.sub = 0 THEN {word_label} ELSE -100 END)"
    elif mode == "all":
        body = f"list_transform(pieces, lambda x: CASE WHEN x.sub = 0 THEN {word_label} ELSE bm[{word_label}] END)"
    else:
        body = f"list_transform(pieces, lambda x: coalesce({word_label}, -100))"
    sql = Q.with_ctes(ctes, f"SELECT doc_id, array_to_string(list_concat([-100], {body}, [-100]), ',') AS labels FROM pc, lb")
    return _recursive(sql)


@query("align_labels_first", _align_sql("first"))
def align_labels_first(spark, sf):
    return _align(spark, sf, "first")


@query("align_labels_all", _align_sql("all"))
def align_labels_all(spark, sf):
    return _align(spark, sf, "all")


@query("align_labels_every", _align_sql("every"))
def align_labels_every(spark, sf):
    return _align(spark, sf, "every")


def _a3_sql():
    from .order import _rank

    ctes = [
        ("a", f"SELECT doc_id, {_rank(Q.digest(42, 'doc_id') + ', doc_id')} AS i, count(*) OVER () AS n FROM documents"),
        ("h", f"SELECT doc_id, {_rank(Q.digest(43, 'doc_id') + ', doc_id')} AS j, count(*) OVER () AS m FROM a WHERE i < ceil(n * 0.1)"),
        (
            "sp",
            "SELECT doc_id, 'train' AS split FROM a WHERE i >= ceil(n * 0.1) "
            "UNION ALL SELECT doc_id, CASE WHEN j < ceil(m * 0.5) THEN 'test' ELSE 'validation' END AS split FROM h",
        ),
        *SUBWORD_CTES,
        ("e", _WORDS_BY_DOC),
        *_matched("SELECT word FROM e"),
        ("dn", "SELECT doc_id, sum(len(ids))::BIGINT AS n FROM e JOIN pieces USING (word) GROUP BY doc_id"),
    ]
    return _recursive(Q.with_ctes(ctes, "SELECT split, sum(coalesce(n, 0))::BIGINT AS pieces FROM sp LEFT JOIN dn USING (doc_id) GROUP BY split"))


@query("subword_total_by_split", _a3_sql())
def subword_total_by_split(spark, sf):
    """A3: sub-word pieces per split of the 90/5/5 split."""
    docs = SW.subword_ids(_docs(spark, sf).select("doc_id", E.lower_tokens("text").alias("toks")), "toks", subword_vocab(spark, sf))
    d = docs.select("doc_id", F.size(F.flatten("pieces")).cast("bigint").alias("n"))
    s = order.split_90_5_5(d, "doc_id")
    return s.groupBy("split").agg(F.sum("n").alias("pieces"))


@query(
    "vocab_first_merge",
    Q.with_ctes(
        [
            ("tok", _TOK),
            ("w", "SELECT word, count(*) AS n FROM (SELECT unnest(toks) AS word FROM tok) GROUP BY word"),
            ("s", "SELECT regexp_extract_all(word, '.') AS c, n FROM w"),
            ("p", "SELECT unnest(list_transform(range(1, len(c)), lambda i: {'a': c[i], 'b': c[i + 1]})) AS pr, n FROM s WHERE len(c) >= 2"),
        ],
        "SELECT pr.a AS a, pr.b AS b, sum(n)::BIGINT AS n FROM p GROUP BY pr.a, pr.b ORDER BY n DESC, a, b LIMIT 1",
    ),
)
def vocab_first_merge(spark, sf):
    """V1(b), first round: the most frequent adjacent symbol pair."""
    words = E.word_table(_docs(spark, sf), "text")
    return E.pair_counts(words).orderBy(F.col("n").desc(), "a", "b").limit(1).select("a", "b", F.col("n").cast("bigint").alias("n"))


MERGES = 24


def _merges_sql():
    """The merges one by one; a symbol is chr(1) || symbol || chr(2)."""
    ctes = [
        ("tok", _TOK),
        ("w", "SELECT word, count(*) AS n FROM (SELECT unnest(toks) AS word FROM tok) GROUP BY word"),
        ("s0", "SELECT regexp_replace(word, '(.)', chr(1) || '\\1' || chr(2), 'gs') AS s, n FROM w"),
    ]
    for r in range(MERGES):
        ctes += [
            (f"y{r}", f"SELECT string_split(trim(replace(s, chr(2) || chr(1), chr(3)), chr(1) || chr(2)), chr(3)) AS c, n FROM s{r}"),
            (f"p{r}", f"SELECT unnest(list_transform(range(1, len(c)), lambda i: {{'a': c[i], 'b': c[i + 1]}})) AS pr, n FROM y{r} WHERE len(c) >= 2"),
            (f"b{r}", f"SELECT pr.a AS a, pr.b AS b, sum(n)::BIGINT AS n FROM p{r} GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 1"),
            (f"s{r + 1}", f"SELECT replace(s.s, chr(1) || b.a || chr(2) || chr(1) || b.b || chr(2), chr(1) || b.a || b.b || chr(2)) AS s, s.n FROM s{r} s, b{r} b"),
        ]
    sql = Q.with_ctes(ctes, " UNION ALL ".join(f"SELECT {r}::INTEGER AS rank, a, b, n FROM b{r}" for r in range(MERGES)))
    return re.sub(r"\b([sb]\d+) AS \(", r"\1 AS MATERIALIZED (", sql)


@query("vocab_merges", _merges_sql())
def vocab_merges(spark, sf):
    """V1(b): the first merges of a sub-word vocabulary."""
    return E.learn_merges(_docs(spark, sf), "text", MERGES)


_SAMPLED = [("sampled", f"SELECT doc_id, text FROM documents ORDER BY {Q.digest(SEED, 'doc_id')}, doc_id LIMIT 100000"), ("tok", _TOK.replace("FROM documents", "FROM sampled"))] + VOCAB_CTES[1:]


@query("vocab_sampled", Q.with_ctes(_SAMPLED, "SELECT word, id, n FROM v"))
def vocab_sampled(spark, sf):
    """L4 -> V1: a vocabulary of 32,000 words learned from a seeded sample of 100,000 rows."""
    return E.vocab_words(order.sample_n(_docs(spark, sf).select("doc_id", "text"), 100_000, SEED, "doc_id"), "text", VOCAB_K)


@query("collate_pad", Q.with_ctes(_BATCHED, _PADDED))
def collate_pad(spark, sf):
    """UF3: dynamic padding by a user's pandas collator, one call per batch."""
    from ...operators.userfn import collate

    def pad(pdf):
        longest = int(pdf["ids"].map(len).max())
        target = -(-longest // 8) * 8
        padded = [",".join(map(str, [*x, *[K.PAD_ID] * (target - len(x))])) for x in pdf["ids"]]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "batch": pdf["batch"], "padded": padded})

    return collate(_batched(spark, sf).select("doc_id", "batch", "ids"), "batch", pad, "doc_id long, batch long, padded string")


def _chain_sql():
    src = [
        ("src", "SELECT 0 AS source, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark"),
        ("num", "SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM src"),
        ("mx", "SELECT max(n) AS mx FROM num"),
        ("documents", "SELECT (r * 2 + source)::BIGINT AS doc_id, text FROM (SELECT source, text, unnest(range(i, mx, n)) AS r FROM num, mx)"),
        ("ord", f"SELECT doc_id, row_number() OVER (ORDER BY {Q.digest(SEED, 'doc_id')}, doc_id) - 1 AS rank FROM documents"),
    ]
    # the vocabulary is that of the documents table; the texts are the interleaved ones
    voc = [("tok", _TOK), *VOCAB_CTES[1:]]
    voc = [(f"{n}0", _renamed(sql)) for n, sql in voc]
    own = [("tok", _TOK), ("v", "SELECT * FROM v0"), *ENC_CTES[len(VOCAB_CTES) :], *MASK_CTES[len(ENC_CTES) :]]
    return Q.with_ctes(
        voc + src + own,
        "SELECT m.doc_id, array_to_string(masked_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM msk m JOIN ord USING (doc_id) WHERE rank >= 100",
    )


def _renamed(sql: str) -> str:
    """The vocabulary's common table names with a 0, so that they do not meet the chain's own."""
    return re.sub(r"\bFROM (tok|w|c)\b", r"FROM \g<1>0", sql).replace("FROM documents", "FROM main.documents")


@query("pretraining_chain", _chain_sql())
def pretraining_chain(spark, sf):
    """Texts of several sources interleaved (U2), the first 100 of a seeded order held out (L3), the rest encoded and masked (M4)."""
    frames = [_docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")]
    mixed = mix.interleave(frames, ["id", "id"], out="doc_id").select("doc_id", "text")
    train = order.take_skip(mixed, 100, SEED, "doc_id").where(F.col("split") == "train").drop("split")
    m = masked(spark, sf, docs=train)
    return m.select("doc_id", _join("masked_ids").alias("input_ids"), _join("labels").alias("labels"))
