"""Structured Streaming operators SR1-SR3 over a folder of increments.

Each new file in the folder is processed exactly once (the checkpoint records
it); ``availableNow`` drains what is there and stops, which is how daily
increment archives are handled.  Sinks are tables written with ``foreachBatch``
or the file sink, so they work on a cluster (no driver-side collect).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sections import clean_articles, fence
from ..functions.text import word_count_blanks
from ..operators.filters import useful_content


def increments(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """SR1 source: new parquet files in ``folder`` (a folder, not a single file)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def ingest(stream: DataFrame, sink: str, checkpoint: str) -> str:
    """SR1: append every new row once to a parquet table; returns the sink path."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sink


def ingest_batches(stream: DataFrame, sink: str, checkpoint: str) -> str:
    """SR1: every batch becomes the folder ``batch=<n>`` of a parquet table; a replay replaces it."""

    def _store(batch: DataFrame, no: int):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={no}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(_store).trigger(availableNow=True).start().awaitTermination()
    return sink


def dedupe(stream: DataFrame, text: str, sink: str, checkpoint: str, event_time: str | None = None, delay: str = "1 day") -> str:
    """SR2: incremental exact dedupe on the text digest.

    Without an event-time column the state (one digest per distinct text)
    grows without bound; pass ``event_time`` to bound it with a watermark
    (``dropDuplicatesWithinWatermark``).  Which duplicate survives is not
    defined here, so the sink stores digest and row; ``dedupe_latest`` keeps the highest id.
    """
    keyed = stream.withColumn("h", F.md5(F.col(text)))
    if event_time:
        out = keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["h"])
    else:
        out = keyed.dropDuplicates(["h"])
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sink


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``batch=<n>`` folders below ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


_STATE = "h string, id long, replaced long"
_SEEN = "h string, id long"
#: Batches after which the digests seen so far are written as one table.
COMPACT_EVERY = 16


def _seen(spark: SparkSession, root: str, before: int) -> DataFrame:
    """Digest -> highest id of all batches before ``before``: the newest whole table and the batches after it."""
    base = max((b for b in _batches(spark, f"{root}/seen") if b <= before), default=None)
    paths = [f"{root}/seen/batch={base}"] if base is not None else []
    paths += [f"{root}/state/batch={b}" for b in _batches(spark, f"{root}/state") if (base or 0) <= b < before]
    if not paths:
        return spark.createDataFrame([], _SEEN)
    # one scan of all of them: its small files share tasks
    return spark.read.schema(_SEEN).parquet(*paths).groupBy("h").agg(F.max("id").alias("id"))


def store_latest(batch: DataFrame, no: int, text: str, order_id: str, root: str, compact_every: int = COMPACT_EVERY) -> None:
    """One increment of ``dedupe_latest``; a replay of a batch replaces what it wrote before."""
    spark = batch.sparkSession
    keyed = batch.withColumn("__h", F.coalesce(F.md5(F.col(text)), F.lit("null")))
    best = keyed.groupBy(F.col("__h").alias("h")).agg(F.max(order_id).cast("long").alias("id"))
    if no and no % compact_every == 0:
        _seen(spark, root, no).write.mode("overwrite").parquet(f"{root}/seen/batch={no}")
    seen = _seen(spark, root, no).select(F.col("h").alias("__s"), F.col("id").alias("replaced"))
    won = best.join(seen, best["h"] == seen["__s"], "left").where("replaced IS NULL OR id > replaced").select("h", "id", "replaced")
    won.write.mode("overwrite").parquet(f"{root}/state/batch={no}")
    ids = spark.read.schema(_STATE).parquet(f"{root}/state/batch={no}").select(F.col("id").alias("__id"))
    keyed.join(ids, F.col(order_id).cast("long") == F.col("__id"), "left_semi").drop("__h").write.mode("overwrite").parquet(f"{root}/rows/batch={no}")


def dedupe_latest(stream: DataFrame, text: str, order_id: str, root: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> str:
    """SR2 with W2's rule: of the rows with equal text, over all increments, the one with the highest id stays.

    A batch's rows meet the digests seen so far as (digest, highest id); the
    winners are appended, with the id that each one replaces.  The digests are a table
    on disk, not state in memory: a batch reads the newest whole one and the few batches after it.
    Ids are unique whole numbers.  ``latest_rows`` reads the result.
    """

    def _store(batch: DataFrame, no: int):
        store_latest(batch, no, text, order_id, root, compact_every)

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(_store).trigger(availableNow=True).start()
    q.awaitTermination()
    return root


def latest_rows(spark: SparkSession, root: str, order_id: str) -> DataFrame:
    """Rows that no later increment replaced."""
    state = [f"{root}/state/batch={b}" for b in _batches(spark, f"{root}/state")]
    lost = spark.read.schema(_STATE).parquet(*state).where("replaced IS NOT NULL").select(F.col("replaced").alias("__lost"))
    rows = spark.read.parquet(*[f"{root}/rows/batch={b}" for b in _batches(spark, f"{root}/rows")])
    return rows.join(lost, rows[order_id].cast("long") == lost["__lost"], "left_anti")


def cleaned_word_totals(stream: DataFrame, sink: str, checkpoint: str, source: str = "article") -> str:
    """SR3: clean (C1-C7) + useful-content filter + words and rows per language,
    kept as running totals in complete mode; each micro-batch overwrites the
    result table with the current totals."""
    cleaned = useful_content(fence(clean_articles(stream, source, "text")))
    agg = cleaned.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(word_count_blanks("text").cast("bigint")).alias("words"))

    def _store(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(sink)

    q = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(_store).trigger(availableNow=True).start()
    q.awaitTermination()
    return sink
