"""File sources S1-S9, S12.

Every reader returns a DataFrame with an explicit schema where the format
allows it (inference only at the edge).  Python is used only where Spark has
no built-in decoder: lenient UTF-8 decoding of whole files (S7).  Tar archives (S11)
are a data source of their own (``archives``), large single files are read by ``ranges``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse_ws, explode_rows
from ..operators.filters import split_malformed


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files holding one JSON array each (possibly pretty-printed).

    A file is one scan task; its rows are dealt to all tasks after it.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path).hint("rebalance")


def read_csv_notes(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S3: headered CSV, every column a string, quoted fields may span lines.

    Edge blanks stay, ``""`` is an empty string and nothing between two
    separators is NULL.  A multi-line file is one scan task; its
    rows are dealt to all tasks after it.
    """
    return _delimited(spark, ",", schema).option("multiLine", True).csv(path).hint("rebalance")


def _delimited(spark: SparkSession, sep: str, schema):
    """Headered values with doubled quotes, all of them kept as they are."""
    r = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    r = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    # a NULL value of its own, or the empty string would count as NULL too
    r = r.option("emptyValue", "").option("nullValue", "\u0000")
    return r.schema(schema) if schema is not None else r.option("inferSchema", False)


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Headered tab-separated file, one row a line; quotes, blanks, empty strings and NULLs as in S3.

    Lines split over tasks, so no value may hold a line break.
    """
    return _delimited(spark, "\t", schema).csv(path)


def read_lines(spark: SparkSession, path: str, line_sep: str = "\n") -> DataFrame:
    """One row per line (``value``)."""
    return spark.read.option("lineSep", line_sep).text(path)


def read_bounded_tsv(spark: SparkSession, path: str, names: list[str], line_sep: str = "\n") -> DataFrame:
    """S5 + P7: header-less TSV split on the first ``len(names) - 1`` tabs only
    (the last field keeps its tabs).

    Adds ``line_no``, a struct that sorts like the lines of the files, taken in
    the order of their paths: (file, start of the split in it, row of the
    split).  Short and empty lines are dropped; ``rejected_tsv_lines`` returns them.
    """
    good, _ = _bounded(spark, path, len(names), line_sep)
    return good.select(*[F.get("parts", i).alias(c) for i, c in enumerate(names)], "line_no")


def rejected_tsv_lines(spark: SparkSession, path: str, fields: int, line_sep: str = "\n") -> DataFrame:
    """P7 side output of S5: the lines with fewer than ``fields`` fields -> (value, line_no)."""
    return _bounded(spark, path, fields, line_sep)[1]


def _bounded(spark: SparkSession, path: str, fields: int, line_sep: str):
    lines = spark.read.option("lineSep", line_sep).text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),  # rises within a split, and only splits of one start compare by it
        ).alias("line_no"),
    )
    return split_malformed(lines, fields)


def read_whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file below ``path`` (recursive) -> (path, text).

    Bytes are decoded as UTF-8 with invalid sequences dropped and ``\\r\\n`` /
    ``\\r`` turned into ``\\n``, as a text-mode ``open(errors="ignore")`` does.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path)

    @F.pandas_udf("string")
    def _decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    text = F.regexp_replace(_decode(F.col("content")), "\r\n?", "\n")
    return files.select("path", text.alias("text"))


# FIXED VALUES: the five predefined XML entities, ampersand replaced last.
XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_CDATA_OPEN, _CDATA_CLOSE = "<![CDATA[", "]]>"


def _code_point(number) -> "F.Column":
    """Character of a code point (UTF-8 bytes put together; out of range gives '')."""
    n = number.cast("int")

    def byte(shift, mark, bits):
        return F.lpad(F.hex(F.shiftright(n, shift).bitwiseAND((1 << bits) - 1).bitwiseOR(mark)), 2, "0")

    tail = [byte(s, 0x80, 6) for s in (12, 6, 0)]
    text = (
        F.when(n < 0x80, byte(0, 0, 7))
        .when(n < 0x800, F.concat(byte(6, 0xC0, 5), tail[2]))
        .when(n < 0x10000, F.concat(byte(12, 0xE0, 4), *tail[1:]))
        .when(n < 0x110000, F.concat(byte(18, 0xF0, 3), *tail))
    )
    return F.coalesce(F.decode(F.unhex(text), "UTF-8"), F.lit(""))


def _unescape(text) -> "F.Column":
    """Numeric references and the predefined entities of markup text."""
    parts = F.split(text, r"&#(?=[0-9]+;|[xX][0-9A-Fa-f]+;)", -1)

    def joined(ps):
        def resolved(p, i):
            ref = F.substring_index(p, ";", 1)
            number = F.when(ref.rlike("^[xX]"), F.conv(F.substr(ref, F.lit(2)), 16, 10)).otherwise(ref)
            return F.when(i == 0, p).otherwise(F.concat(_code_point(number), F.substr(p, F.length(ref) + 2)))

        return F.array_join(F.transform(ps, resolved), "")

    c = F.when(F.contains(text, F.lit("&#")), joined(parts)).otherwise(text)
    for ent, ch in XML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def xml_text(raw) -> "F.Column":
    """Descendant text of an XML fragment: tags and comments dropped, references resolved, CDATA kept as it is."""

    def section(p, i):
        # sections after the first begin inside CDATA, up to its close
        markup = _unescape(F.regexp_replace(F.when(i == 0, p).otherwise(F.substr(p, F.instr(p, _CDATA_CLOSE) + 3)), r"<!--[\s\S]*?-->|<[^>]*>", ""))
        return F.when(i == 0, markup).otherwise(F.concat(F.substring_index(p, _CDATA_CLOSE, 1), markup))

    return collapse_ws(F.array_join(F.transform(F.split(raw, r"<!\[CDATA\[", -1), section), ""))


def read_xml_abstracts(spark: SparkSession, path: str, record_tag: str = "PubmedArticle", element: str = "AbstractText", id_tag: str = "PMID") -> DataFrame:
    """Every ``element`` of every record -> (pmid, idx, text).

    Records are split on the closing record tag (so ``.gz`` files and any
    record size work without an XML tree), the raw elements are taken with a
    regex, mixed content is flattened, and a self-closing element (with
    attributes or without) gives ''.  A gzip file is one scan task; its rows
    are dealt to all tasks before the text work.
    """
    recs = spark.read.option("lineSep", f"</{record_tag}>").text(path).hint("rebalance")
    closed = rf"<{element}(?:\s[^>]*)?/>"
    opened = rf"<{element}(?:\s[^>]*[^/>])?\s*>"
    pat = rf"{closed}|{opened}[\s\S]*?</{element}\s*>"
    body = F.regexp_extract_all(F.col("value"), F.lit(pat), 0)
    pmid = F.regexp_extract(F.col("value"), rf"<{id_tag}[^>]*>([^<]*)</{id_tag}>", 1)
    recs = recs.select(pmid.alias("pmid"), body.alias("els")).where(F.size("els") > 0)
    rows = explode_rows(recs, "els", "el", pos="idx")
    empty = F.col("el").rlike(rf"^{closed}$")
    inner = F.regexp_replace(F.regexp_replace(F.col("el"), rf"^{opened}", ""), rf"</{element}\s*>$", "")
    return rows.select("pmid", F.col("idx").cast("bigint").alias("idx"), xml_text(F.when(empty, F.lit("")).otherwise(inner)).alias("text"))


SENTENCE_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("_text", T.StringType()),
        T.StructField("entity", T.ArrayType(T.StructType([T.StructField("_id", T.StringType()), T.StructField("_text", T.StringType())]))),
        T.StructField(
            "pair",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("_e1", T.StringType()),
                        T.StructField("_e2", T.StringType()),
                        T.StructField("_ddi", T.StringType()),
                        T.StructField("_type", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def read_xml_sentences(spark: SparkSession, path: str, schema=SENTENCE_SCHEMA) -> DataFrame:
    """Relation-corpus XML, one row per ``sentence`` element (attributes as ``_name``)."""
    return spark.read.format("xml").option("rowTag", "sentence").schema(schema).load(path)


def load_splits(spark: SparkSession, files: dict[str, str], schema) -> DataFrame:
    """One file (or folder) per split; the reader follows the extension."""
    frames = []
    for split, path in files.items():
        p = path.rstrip("/")
        if p.endswith((".json", ".jsonl")):
            df = read_jsonl(spark, path, schema)
        elif p.endswith(".csv"):
            df = read_csv_notes(spark, path, schema)
        elif p.endswith(".tsv"):
            df = read_tsv(spark, path, schema)
        elif p.endswith(".parquet"):
            df = spark.read.schema(schema).parquet(path)
        else:
            raise ValueError(f"unsupported extension: {path}")
        frames.append(df.withColumn("split", F.lit(split)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
