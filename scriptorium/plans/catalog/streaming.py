"""Streaming queries over increments (F9): documents written as several
parquet files by ``doc_id % 4``; each query drains the folder with
``availableNow`` and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...sources import archives
from ...sources.sinks import scratch_path, write_tar_archives
from ...sources.tables import table
from ...streaming import ingest as S
from .. import fixtures as FX
from .. import sqltext as Q
from ..registry import query
from .corpus import ART


def _increments(spark, df, name):
    folder = scratch_path(spark, name)
    df.withColumn("part", F.col("doc_id") % 4).write.mode("overwrite").partitionBy("part").parquet(folder)
    return folder, df.schema


def _single_increments(spark, df, name):
    """Increments of one file each, as many as the scan has tasks and not one for each task and part."""
    parts = 4
    per_part = max(1, -(-df.rdd.getNumPartitions() // parts))
    task = F.coalesce(F.pmod(F.col("doc_id"), F.lit(parts)), F.lit(0)) + parts * F.pmod(F.xxhash64("doc_id"), F.lit(per_part))
    dealt = df.repartitionById(parts * per_part, task.cast("int"))
    return _increments(spark, dealt, name)


@query("stream_ingest", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def stream_ingest(spark, sf):
    """SR1: every increment file ingested once into a parquet table."""
    folder, schema = _increments(spark, table(spark, sf, "documents").select("doc_id", "text"), "inc")
    sink = S.ingest(S.increments(spark, folder, schema), scratch_path(spark, "sink"), scratch_path(spark, "ck"))
    return spark.read.parquet(sink).select("doc_id", F.md5("text").alias("text_md5"))


@query("stream_dedupe", "SELECT DISTINCT md5(text) AS h FROM documents")
def stream_dedupe(spark, sf):
    """SR2: digests that survive incremental dedupe (= distinct texts)."""
    folder, schema = _increments(spark, table(spark, sf, "documents").select("doc_id", "text"), "inc")
    sink = S.dedupe(S.increments(spark, folder, schema), "text", scratch_path(spark, "sink"), scratch_path(spark, "ck"))
    return spark.read.parquet(sink).select("h")


@query(
    "stream_word_total",
    Q.with_ctes([ART] + Q.clean_ctes("f1"), f"SELECT lang, count(*)::BIGINT AS rows, sum({Q.words_blanks('text')})::BIGINT AS words FROM c2 WHERE {Q.useful()} GROUP BY lang"),
)
def stream_word_total(spark, sf):
    """SR3: clean + filter + running rows/words per language over increments."""
    folder, schema = _increments(spark, FX.articles(table(spark, sf, "documents")), "inc")
    sink = S.cleaned_word_totals(S.increments(spark, folder, schema), scratch_path(spark, "sink"), scratch_path(spark, "ck"))
    return spark.read.parquet(sink).select("lang", "rows", "words")


@query("stream_dedupe_watermark", "SELECT DISTINCT md5(text) AS h FROM documents")
def stream_dedupe_watermark(spark, sf):
    """SR2 with bounded state: a digest is kept for a day of event time (all rows here lie within one)."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 86_400).alias("seen_at"))
    folder, schema = _increments(spark, docs, "inc")
    sink = S.dedupe(S.increments(spark, folder, schema), "text", scratch_path(spark, "sink"), scratch_path(spark, "ck"), event_time="seen_at", delay="1 day")
    return spark.read.parquet(sink).select("h")


@query("stream_dedupe_latest", "SELECT max(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def stream_dedupe_latest(spark, sf):
    """SR2 with W2's rule: rows of the highest id, over increments of one file each."""
    folder, schema = _single_increments(spark, table(spark, sf, "documents").select("doc_id", "text"), "inc")
    root = S.dedupe_latest(S.increments(spark, folder, schema, max_files=1), "text", "doc_id", scratch_path(spark, "latest"), scratch_path(spark, "ck"))
    return S.latest_rows(spark, root, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("stream_archives", "SELECT doc_id, md5(text) AS text_md5, CASE doc_id // 100 % 2 WHEN 0 THEN 0 ELSE 1 END AS run FROM documents")
def stream_archives(spark, sf):
    """SR1 over archives: the second run reads only the archives that came after the first."""
    docs = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text", F.floor(F.col("doc_id") / 100).alias("g"))
    folder, sink, ck = (scratch_path(spark, n) for n in ("tar", "sink", "ck"))
    for run in (0, 1):
        write_tar_archives(docs.where(F.col("g") % 2 == run), "name", "text", folder, "g")
        S.ingest_batches(archives.stream_tar_members(spark, folder), sink, ck)
    found = spark.read.schema(archives.SCHEMA + ", batch int").parquet(sink)
    return found.select(F.regexp_extract("member", r"^(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), F.col("batch").alias("run"))
