"""Source and sink queries: write data derived from the tables in a format,
read it back with the source operator, compare with the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...operators import order
from ...operators import tasks as TK
from ...operators.filters import books_without_pages
from ...sources import archives, ranges
from ...sources import readers as R
from ...sources import sinks as K
from ...sources.tables import documents, table
from .. import fixtures as FX
from .. import sqltext as Q
from ..registry import query
from .order import _SPLIT_90_5_5
from .tasks import PROMPT_SQL, _F2, sentences

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
MD5_SQL = "SELECT doc_id, md5(text) AS text_md5 FROM documents"


def _md5(df):
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("scan_jsonl", MD5_SQL)
def scan_jsonl(spark, sf):
    """K1 -> S1 round trip."""
    path = K.write_jsonl(table(spark, sf, "documents").select("doc_id", "text"), K.scratch_path(spark, "jsonl"))
    return _md5(R.read_jsonl(spark, path, DOC_SCHEMA))


@query("scan_json_array", MD5_SQL)
def scan_json_array(spark, sf):
    """One JSON array per file; every task of the writer makes one file of its rows."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.spark_partition_id().alias("task"))
    path = K.write_json_arrays(docs, "task", K.scratch_path(spark, "jsonarray"))
    return _md5(R.read_json_array(spark, path, DOC_SCHEMA))


_EDGE_SQL = "CASE doc_id % 4 WHEN 0 THEN '  ' || text || '  ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END"


@query("scan_csv_notes", f"SELECT doc_id, md5(text) AS text_md5, md5({_EDGE_SQL}) AS note_md5 FROM documents")
def scan_csv_notes(spark, sf):
    """K2 -> S3: quoted multi-line CSV fields, all strings; edge blanks, empty strings and NULLs come back."""
    path = K.write_csv(table(spark, sf, "documents").select("doc_id", "text", _edge("text").alias("note"), "lang"), K.scratch_path(spark, "csv"))
    return _notes_md5(R.read_csv_notes(spark, path))


def _edge(text):
    """Edge blanks, empty strings and NULLs, as in ``_EDGE_SQL``."""
    kind = F.col("doc_id") % 4
    return F.when(kind == 0, F.concat(F.lit("  "), text, F.lit("  "))).when(kind == 1, F.lit("")).when(kind == 3, F.col(text))


def _notes_md5(df):
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), F.md5("note").alias("note_md5"))


# Quotes, separators, doubled quotes and line breaks at the edges of the text.
_QUOTED_SQL = """CASE doc_id % 5 WHEN 0 THEN '"' || text WHEN 1 THEN text || ',"' WHEN 2 THEN '""' || chr(10) || text || chr(10) || '"' WHEN 3 THEN text || chr(10) ELSE text END"""


def _quoted(text):
    kind = F.col("doc_id") % 5
    two = F.when(kind == 0, F.concat(F.lit('"'), text)).when(kind == 1, F.concat(text, F.lit(',"')))
    return two.when(kind == 2, F.concat(F.lit('""\n'), text, F.lit('\n"'))).when(kind == 3, F.concat(text, F.lit("\n"))).otherwise(F.col(text))


@query("scan_csv_one_file", f"SELECT doc_id, md5({_QUOTED_SQL}) AS text_md5, md5({_EDGE_SQL}) AS note_md5 FROM documents")
def scan_csv_one_file(spark, sf):
    """K2 -> S3 by byte ranges: one multi-line file, read by as many tasks as it has ranges."""
    docs = table(spark, sf, "documents").select("doc_id", _quoted("text").alias("text"), _edge("text").alias("note"))
    path = K.write_csv_file(docs, K.scratch_path(spark, "csvfile"))
    return _notes_md5(ranges.read_csv_ranges(spark, path))


# Brackets, quotes and backslashes inside of strings.
_BRACKETS_SQL = """CASE doc_id % 3 WHEN 0 THEN text || '}]' WHEN 1 THEN '{"' || chr(92) || text || chr(92) ELSE text END"""


@query("scan_json_one_file", f"SELECT doc_id, md5({_BRACKETS_SQL}) AS text_md5, md5(lang) AS lang_md5 FROM documents")
def scan_json_one_file(spark, sf):
    """S2 by byte ranges: one JSON array with nested objects, read by as many tasks as it has ranges."""
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.concat("text", F.lit("}]"))).when(kind == 1, F.concat(F.lit('{"\\'), "text", F.lit("\\"))).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text"), F.array(F.struct(F.struct("lang").alias("a"), F.array(F.lit("]"), F.lit("{")).alias("b"))).alias("more"))
    path = K.write_json_array_file(docs, K.scratch_path(spark, "jsonfile"))
    back = ranges.read_json_array_ranges(spark, path, "doc_id long, text string, more array<struct<a: struct<lang: string>, b: array<string>>>")
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.md5(F.col("more")[0]["a"]["lang"]).alias("lang_md5"))


_ONE_LINE_SQL = "replace(text, chr(10), ' ')"


@query("scan_tsv", f"SELECT doc_id, lang, source, md5({_ONE_LINE_SQL}) AS text_md5, md5({_EDGE_SQL.replace('text', _ONE_LINE_SQL)}) AS note_md5 FROM documents")
def scan_tsv(spark, sf):
    """Headered TSV; quotes, edge blanks, empty strings and NULLs come back."""
    docs = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    path = K.write_csv(docs.select("doc_id", "lang", "source", "text", _edge("text").alias("note")), K.scratch_path(spark, "tsv"), sep="\t")
    df = R.read_tsv(spark, path)
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.md5("text").alias("text_md5"), F.md5("note").alias("note_md5"))


@query(
    "scan_bounded_tsv",
    Q.with_ctes(_F2, "SELECT doc_id, entity_id, text FROM entities"),
)
def scan_bounded_tsv(spark, sf):
    """K3 -> S5: header-less entity lines, bounded split on the first five tabs."""
    _, entities, _ = FX.relation_inputs(table(spark, sf, "documents"))
    lines = FX.entity_lines(entities.where(F.col("text").isNotNull()))
    path = K.write_lines(lines, "value", K.scratch_path(spark, "entities"))
    df = R.read_bounded_tsv(spark, path, ["doc_id", "entity_id", "kind", "a", "b", "text"])
    return df.select("doc_id", "entity_id", "text")


@query(
    "scan_lines",
    "SELECT sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(replace(text, chr(10), '')))::BIGINT AS chars FROM documents",
)
def scan_lines(spark, sf):
    """K3 -> S6."""
    path = K.write_lines(table(spark, sf, "documents"), "text", K.scratch_path(spark, "lines"))
    df = R.read_lines(spark, path)
    return df.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value").cast("bigint")).alias("chars"))


@query("scan_whole_files", "SELECT doc_id % 20 AS bucket, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY 1")
def scan_whole_files(spark, sf):
    """Recursive whole-file scan (files written per bucket folder)."""
    docs = table(spark, sf, "documents").select("text", (F.col("doc_id") % 20).alias("bucket"))
    path = K.scratch_path(spark, "files")
    docs.write.mode("overwrite").partitionBy("bucket").text(path)
    files = R.read_whole_files(spark, path, glob="part-*")
    b = F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint")
    return files.groupBy(b.alias("bucket")).agg(F.sum(F.length("text").cast("bigint")).alias("chars"))


def _xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query(
    "xml_abstracts",
    "SELECT CAST(doc_id AS VARCHAR) AS pmid, 0::BIGINT AS idx, " + Q.collapse("text || ' mixed tail'") + " AS text FROM documents "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN chr(945) || ' ' || chr(946) || ' ' || chr(128578) WHEN 3 THEN '<raw> & kept' ELSE 'Second & part' END FROM documents "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 'Third' FROM documents",
)
def xml_abstracts(spark, sf):
    """S8 on a gzip file of records with mixed content and self-closing elements."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 5
    second = (
        F.when(k == 0, F.lit("<AbstractText/>"))
        .when(k == 1, F.lit('<AbstractText Label="A/B"/>'))
        .when(k == 2, F.lit("<AbstractText>&#945; &#x3b2; &#x1F642;</AbstractText>"))
        .when(k == 3, F.lit("<AbstractText><![CDATA[<raw> & kept]]></AbstractText>"))
        .otherwise(F.lit("<AbstractText>Second &amp; part</AbstractText>"))
    )
    rec = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version=\"1\">"),
        F.col("doc_id").cast("string"),
        F.lit('</PMID><Article><Abstract><AbstractText Label="BACKGROUND">'),
        _xml_escape(F.col("text")),
        F.lit(" <i>mixed</i> tail</AbstractText>"),
        second,
        F.lit("<AbstractText>Third</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"),
    )
    path = K.write_lines(d.select(rec.alias("value")), "value", K.scratch_path(spark, "xml"), compression="gzip")
    return R.read_xml_abstracts(spark, path)


@query(
    "xml_sentences",
    Q.with_ctes(
        [
            (
                "s",
                "SELECT doc_id, replace(text, chr(10), ' ') AS _text, list_filter([{'_id': 'e0', '_text': p[1]}, {'_id': 'e1', '_text': p[1 + (len(p) - 1) // 2]}, {'_id': 'e2', '_text': p[len(p)]}, {'_id': 'e2', '_text': CASE WHEN doc_id % 6 = 0 THEN 'again' END}], lambda e: e._text IS NOT NULL) AS entity, "
                "[{'_e1': 'e0', '_e2': 'e1', '_ddi': CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1))::INTEGER % 2 = 0 THEN 'true' ELSE 'false' END, '_type': CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'mechanism' END}, "
                "{'_e1': 'e1', '_e2': 'e2', '_ddi': 'true', '_type': 'effect'}, {'_e1': 'e0', '_e2': 'e9', '_ddi': 'true', '_type': 'advise'}] AS pair "
                "FROM (SELECT doc_id, text, string_split(replace(text, chr(10), ' '), ' ') AS p FROM documents)",
            ),
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
def xml_sentences(spark, sf):
    """S9 -> J2: sentences written as XML elements with attributes, read back with the XML source."""
    s = sentences(spark, sf).withColumn("_text", F.replace(F.col("_text"), F.lit("\n"), F.lit(" ")))
    s = s.select(F.col("doc_id").cast("string").alias("_id"), "_text", "entity", "pair")
    path = K.scratch_path(spark, "sentences")
    s.write.mode("overwrite").format("xml").option("rowTag", "sentence").option("rootTag", "document").save(path)
    back = R.read_xml_sentences(spark, path)
    out = TK.ddi_relations(back, keep=("_id",))
    return out.select(F.col("_id").cast("bigint").alias("doc_id"), "sample", "target")


@query("scan_tar_members", MD5_SQL)
def scan_tar_members(spark, sf):
    """Members of .tar.gz archives (100 documents per archive)."""
    d = table(spark, sf, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text", F.floor(F.col("doc_id") / 100).alias("g")
    )
    path = K.write_tar_archives(d, "name", "text", K.scratch_path(spark, "tar"), "g")
    m = archives.read_tar_members(spark, path)
    return m.select(F.regexp_extract("member", r"^(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"))


@query(
    "load_splits",
    Q.with_ctes(
        [("a", f"SELECT doc_id, (row_number() OVER (ORDER BY {Q.digest(1337, 'doc_id')}, doc_id) - 1) AS i, count(*) OVER () AS n FROM documents")],
        "SELECT doc_id, CASE WHEN i < ceil(n * 0.1) THEN 'valid' ELSE 'train' END AS split, md5(text) AS text_md5 FROM a JOIN documents USING (doc_id)",
    ),
)
def load_splits(spark, sf):
    """Train as JSON lines, valid as CSV; the reader follows the extension."""
    s = order.fraction_split(table(spark, sf, "documents").select("doc_id", "lang", "text"), 0.1, 1337, "doc_id", test_name="valid")
    root = K.scratch_path(spark, "splits")
    K.write_jsonl(s.where(F.col("split") == "train").drop("split"), f"{root}/train.jsonl")
    K.write_csv(s.where(F.col("split") == "valid").drop("split"), f"{root}/valid.csv")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])
    df = R.load_splits(spark, {"train": f"{root}/train.jsonl", "valid": f"{root}/valid.csv"}, schema)
    return df.select("doc_id", "split", F.md5("text").alias("text_md5"))


@query("load_splits_tsv", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split, md5({_EDGE_SQL.replace('text', _ONE_LINE_SQL)}) AS text_md5 FROM documents")
def load_splits_tsv(spark, sf):
    """Train as TSV, valid as Parquet, test as CSV; the reader follows the extension."""
    docs = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))).select("doc_id", _edge("text").alias("text"))
    root, part = K.scratch_path(spark, "splitfiles"), F.col("doc_id") % 3
    K.write_csv(docs.where(part == 2), f"{root}/train.tsv", sep="\t")
    docs.where(part == 0).write.mode("overwrite").parquet(f"{root}/valid.parquet")
    K.write_csv(docs.where(part == 1), f"{root}/test.csv")
    df = R.load_splits(spark, {"train": f"{root}/train.tsv", "valid": f"{root}/valid.parquet", "test": f"{root}/test.csv"}, DOC_SCHEMA)
    return df.select("doc_id", "split", F.md5("text").alias("text_md5"))


@query(
    "sink_splits",
    "WITH x AS (" + _SPLIT_90_5_5 + ") SELECT x.split, x.doc_id, md5(text) AS text_md5 FROM x JOIN documents USING (doc_id)",
)
def sink_splits(spark, sf):
    """K4: partitioned parquet per split, read back."""
    s = order.split_90_5_5(table(spark, sf, "documents"), "doc_id")
    path = K.write_splits(s, K.scratch_path(spark, "splitset"))
    return spark.read.parquet(path).select("split", "doc_id", F.md5("text").alias("text_md5"))


@query(
    "shard_write",
    Q.with_ctes(
        [("a", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) AS i, count(*) OVER () AS n FROM documents")],
        "SELECT CASE WHEN n // 7 = 0 THEN i ELSE least(i // (n // 7), 6) END AS shard, count(*)::BIGINT AS rows FROM a GROUP BY 1",
    ),
)
def shard_write(spark, sf):
    """K5: contiguous shards written as JSON lines under shard=<k>/, read back."""
    path = K.write_shards(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 7, K.scratch_path(spark, "shards"))
    return spark.read.json(path).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


@query("sink_jsonl", "SELECT lang, count(*)::BIGINT AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def sink_jsonl(spark, sf):
    """K1: JSON lines written (overwrite) and read back."""
    path = K.write_jsonl(documents(spark, sf).select("doc_id", "lang", "text"), K.scratch_path(spark, "sinkjsonl"))
    back = spark.read.schema("doc_id long, lang string, text string").json(path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("sink_csv", "SELECT source, count(*)::BIGINT AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def sink_csv(spark, sf):
    """K2: CSV with header, quoted multi-line fields, read back."""
    path = K.write_csv(documents(spark, sf).select("doc_id", "source", "text"), K.scratch_path(spark, "sinkcsv"))
    back = R.read_csv_notes(spark, path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("sink_lines", "SELECT md5(text) AS h, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY 1")
def sink_lines(spark, sf):
    """K3: newline-joined text lines, read back line by line."""
    path = K.write_lines(documents(spark, sf), "text", K.scratch_path(spark, "sinklines"))
    return R.read_lines(spark, path).groupBy(F.md5("value").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tsv_relations",
    Q.with_ctes(
        _F2 + [("ents", "SELECT doc_id, entity_id, arg_max(text, line_no) AS text FROM entities GROUP BY doc_id, entity_id")],
        "SELECT r.doc_id, "
        + PROMPT_SQL.format(e1="x.text", e2="y.text", text="a.text")
        + " AS sample, r.grp AS target FROM rel r JOIN ents x ON x.doc_id = r.doc_id AND x.entity_id = r.a1 "
        "JOIN ents y ON y.doc_id = r.doc_id AND y.entity_id = r.a2 JOIN abstracts a ON a.doc_id = r.doc_id",
    ),
)
def tsv_relations(spark, sf):
    """K3 -> S5 -> J1: entities in two folders of different size, in path order; a repeated key keeps its last line."""
    abstracts, entities, relations = FX.relation_inputs(table(spark, sf, "documents"))
    entities = entities.where(F.col("text").isNotNull())
    first = F.col("line_no") % 3 != 2  # the repeated entries are in the second file
    root = K.scratch_path(spark, "entityfiles")
    K.write_lines(FX.entity_lines(entities.where(first)), "value", f"{root}/a")
    K.write_lines(FX.entity_lines(entities.where(~first)), "value", f"{root}/b")
    back = R.read_bounded_tsv(spark, f"{root}/*", ["doc_id", "entity_id", "kind", "a", "b", "text"])
    path = K.write_lines(FX.relation_lines(relations), "value", K.scratch_path(spark, "relations"))
    return TK.relation_join(abstracts, back, R.read_bounded_tsv(spark, path, ["doc_id", "kind", "use", "grp", "arg1", "arg2"]))


@query(
    "rejected_rows",
    "SELECT 'tsv line' AS kind, count(*)::BIGINT AS rows FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'book', count(*)::BIGINT FROM documents WHERE doc_id % 11 = 0",
)
def rejected_rows(spark, sf):
    """Side outputs: S5 / P7 lines with too few fields, and P8 books without pages."""
    docs = table(spark, sf, "documents")
    short = F.when(F.col("doc_id") % 7 == 0, F.concat_ws("\t", "doc_id", F.lit("T1"))).otherwise(F.concat_ws("\t", "doc_id", F.lit("T1"), F.lit("x"), F.lit("0"), F.lit("1"), "lang"))
    path = K.write_lines(docs.select(short.alias("value")), "value", K.scratch_path(spark, "badlines"))
    lines = R.rejected_tsv_lines(spark, path, 6).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("tsv line").alias("kind"), "rows")
    books = FX.books(docs).withColumn("pages", F.when(F.col("doc_id") % 11 != 0, F.col("pages")))
    lost = books_without_pages(books).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("book").alias("kind"), "rows")
    return lines.unionByName(lost)
