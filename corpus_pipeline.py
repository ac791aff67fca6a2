"""A training-data pipeline of five stages over ``documents``.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes to the shared folder as Parquet and
rereads as the docs of the next stage.  All but the last return the columns of
``documents``.

1. quality rules: documents that fail the base conditions or meet a learned rule go;
2. line dedup: repeated multi-line chunks leave the texts (no document goes);
3. SimHash near-dedup: one document of each group of near copies stays;
4. benchmark decontamination: documents that leak a benchmark item go;
5. BPE encoding: ids of what is left, and a digest of the text they decode to.

The intermediate tables of a stage are deleted when the next stage begins: by then its result has been
written, and nothing reads them any more.

Null texts fail the quality rules (no words).  Empty tables pass through.  Rows that repeat an id and a text
meet the same decision in every stage but the third, which keeps one of them; of a group of near copies the one with
the smallest id stays, a null id comes last.  Rows with a null id or equal ids are judged by their own texts, but in the fourth stage,
where a leak removes all rows of its id.
SQL cannot express the learned rules, the fingerprints or the encoding, so
there is no ``ORACLE_SQL``; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.bpe import bpe_encode_decode
from scriptorium.llm.common import named_since, remove_folders, shared_folder, written
from scriptorium.llm.decontaminate import without_leaks
from scriptorium.llm.linededup import line_dedup
from scriptorium.llm.quality import base_failed, kept, learn_rules, with_statistics
from scriptorium.llm.queries import tokenizer_file
from scriptorium.llm.simhash import keep_one_per_component
from scriptorium.sources.tables import table

_STATS = "__quality"


class _LeftOver(threading.local):
    """Intermediate tables of the stage before, of this thread's run."""

    def __init__(self):
        self.folders: list[str] = []


_left_over = _LeftOver()


def _stage(fn):
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_folders(spark, _left_over.folders)
        with named_since() as named:
            out = fn(spark, docs, sf_dir)
        _left_over.folders = named
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = written(with_statistics(docs, stats_col=_STATS), "pipeline-quality")
    rules = learn_rules(marked.where(~base_failed(_STATS)).select("doc_id", _STATS), table(spark, sf_dir, "labels"), stats_col=_STATS)
    return marked.where(kept(rules, _STATS)).select(*docs.columns)


@_stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs, lines_col="__lines", removed_col="__removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_component(docs, shingle=4, distance=4).select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@_stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_encode_decode(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("bpe encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "pipeline-" + name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
