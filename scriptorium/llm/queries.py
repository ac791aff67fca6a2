"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table
from .bpe import bpe_encode_decode
from .common import written
from .decontaminate import find_leaks
from .divergence import Audit, source_divergence, term_divergence
from .htmltext import extract_text
from .licenses import scan_licenses
from .linededup import line_dedup
from .lmscore import lm_scores
from .prefixtrie import prefix_trie
from .quality import base_failed, kept, learn_rules, with_statistics
from .secretscan import scan_secrets, train
from .simhash import fingerprint_hex, simhash_components, with_fingerprint
from .suffixdedup import remove_repeats
from .tokencount import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file (never copied into this repository)."""
    import public_tokenizers

    return os.path.realpath(public_tokenizers.path(name))


def token_cache(spark: SparkSession) -> str:
    """One folder for all runs: a later run, also of another session with the same
    ``spark.checkpoint.dir``, reads the counts that earlier ones stored."""
    key = "spark.checkpoint.dir"  # the context's own folder is a fresh one inside of it
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/token-cache"


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), ends AS (
  SELECT *, coalesce((h + 31 * lag(h) OVER (PARTITION BY doc_id ORDER BY i)) % 3 = 0, false) AS ends FROM hashed
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ends
), chunks AS (
  SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS piece FROM numbered GROUP BY ALL
), marked AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, piece ORDER BY doc_id, no) > 1 AS gone FROM chunks
), left_over AS (
  SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed_lines,
         md5(coalesce(string_agg(piece, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS text_md5
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, text_md5
FROM documents d LEFT JOIN left_over USING (doc_id)
"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("closest")


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(with_statistics(docs).drop("text"), "quality-stats")
    rules = learn_rules(stats.where(~base_failed()), table(spark, sf_dir, "labels"))
    s = F.col("quality")
    return stats.select(
        "doc_id",
        s["n_words"].alias("n_words"),
        s["word_chars"].alias("word_chars"),
        s["n_symbols"].alias("n_symbols"),
        s["n_dup_lines"].alias("n_dup_lines"),
        s["n_repeat_words"].alias("n_repeat_words"),
        base_failed().alias("base_failed"),
        kept(rules).alias("kept"),
    )


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, token_cache(spark), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = written(with_fingerprint(docs).select("doc_id", "fingerprint"), "simhash-fingerprints")
    found = simhash_components(marked)
    out = marked.join(found, marked["fingerprint"] == found["fp"], "left")
    return out.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op8_lm_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op9_bpe_encode_decode")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_encode_decode(docs, tokenizer_file("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM docs
), occ AS (
  SELECT row, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM found
), kept AS (
  SELECT lang, term, count(*) AS n_lang FROM occ GROUP BY ALL HAVING count(DISTINCT row) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), v AS (
  SELECT lang, count(*) AS v, sum(n_lang) AS n_lang FROM kept GROUP BY lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n_lang + 1)) // (v.n_lang + v.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value,
                 row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) AS rank
                 FROM shares WHERE n > 0 AND p > q) WHERE rank <= 200
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = Audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
    parts = [("pair", source_divergence(audit)), ("term", term_divergence(audit, top=200))]
    pair, term = (x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in parts)
    return pair.unionByName(term)


PREFIX_TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS item, length(coalesce(text, '')) AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT c, item, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, item) - 1 AS pos FROM t
), convs AS (
  SELECT c, count(*) AS n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) % 6 AS h
  FROM turns GROUP BY c
), shared AS (
  SELECT a.c, a.h, a.n, least(a.h, coalesce(b.n, 0)) AS b FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 100
), rebuilt AS (
  SELECT s.c, t.pos + 1 AS d, t.item, t.chars FROM shared s JOIN turns t ON t.c = s.c - s.c % 100 AND t.pos < s.b
  UNION ALL
  SELECT s.c, t.pos - s.h + s.b + 1, t.item, t.chars FROM shared s JOIN turns t ON t.c = s.c AND t.pos >= s.h
), prefixes AS (
  SELECT c, d, chars, md5(string_agg(item, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, '' FROM convs
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, lead(node) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM prefixes
), nodes AS (
  SELECT node, parent, min(c) AS rep, max(d) AS depth, count(*) AS n, (count(*) - 1) * max(chars) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM linked GROUP BY node, parent
), family AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.parent = n.node) AS children FROM nodes n
), below AS (
  SELECT p.node, count(*) FILTER (f.children = 0) AS leaves, sum(f.saved) AS saved
  FROM family f JOIN prefixes p ON p.c = f.rep AND p.d <= f.depth GROUP BY p.node
)
SELECT f.rep AS conv_id, f.depth::BIGINT AS depth, p.rep AS parent_conv_id, f.n AS n_convs, f.children AS n_children,
       b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM family f JOIN below b USING (node) LEFT JOIN nodes p ON p.node = f.parent
"""


@query("op11_prefix_trie", PREFIX_TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("enter", "exit")


@query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_secrets(docs, train(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "tagged")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
