"""Operator 5: token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer version, count) in a
shared folder.  A text is looked up by the digest of its normalised content and
the digest of the tokenizer file; only distinct contents that the cache lacks
are encoded, and their counts are appended to it.

The normalisation must not change a count.  The sentencepiece file keeps white
space and case, so the only step is null -> empty text.

The library's own ``encode`` counts the tokens of a miss, as the contract asks
for its counts: without begin and end, special strings read as plain text.

Defined results: a null text counts as an empty one (0 tokens); every input row
keeps its own output row, repeated rows included; an input column with the name
of an output column is replaced; an empty table gives an empty result and adds
nothing to the cache.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named_since, remove_folders, written

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
#: Texts encoded per call of the library; bounds the memory of a batch.
ENCODE_BYTES = 4_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file never reads this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a folder that does not exist yet is an empty cache."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    if not there:
        return spark.createDataFrame([], CACHE_SCHEMA)
    # Two jobs may have appended the same content; the counts are equal.
    return spark.read.schema(CACHE_SCHEMA).parquet(path).dropDuplicates(["content", "tokenizer"])


def _encode_misses(misses: DataFrame, path: str) -> DataFrame:
    def run(batches):
        count = _counter(path)
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), []
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= ENCODE_BYTES:
                    n += count(texts[start : i + 1])
                    start, size = i + 1, 0
            if start < len(texts):
                n += count(texts[start:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return misses.mapInArrow(run, "content binary, n_tokens long")


def count_tokens(df: DataFrame, cache_path: str, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", count_col: str = "n_tokens", bytes_col: str = "n_bytes") -> DataFrame:
    """Append ``n_tokens`` (and the UTF-8 length) to every row; misses are encoded once and cached.

    The digests alone say which contents the cache lacks; the texts are only shuffled if there are any.
    Shuffles: digests, to pick the row with the smallest id of every missing
    content (a content that fills a third of the table meets as partial
    minima); the texts by row id, to the rows picked; digests again, to join
    the counts (a hot content is split by the skew join).  Rows that repeat an
    id and a text are each picked; their equal counts become one.
    """
    spark = df.sparkSession
    version = tokenizer_version(tokenizer_path)
    kept = [c for c in df.columns if c.lower() not in (count_col.lower(), bytes_col.lower())]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = F.unhex(F.sha2(text.cast("binary"), 256))
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version)

    with named_since() as named:
        picked = written(df.groupBy(content.alias("content")).agg(F.min(id_col).alias("__id")).join(known, "content", "left_anti"), "token-misses")
    if not picked.isEmpty():  # without a miss no text moves, and nothing is appended
        texts = df.select(F.col(id_col).alias("__row"), content.alias("__c"), text.alias("__text"))
        misses = texts.join(picked, texts["__row"].eqNullSafe(picked["__id"]) & (texts["__c"] == picked["content"]), "left_semi")
        fresh = _encode_misses(misses.select("__c", "__text"), tokenizer_path).dropDuplicates(["content"])
        fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    remove_folders(spark, named)

    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", F.col("n_tokens").alias("__n"))
    rows = df.select(*kept, F.octet_length(text).cast("long").alias(bytes_col), content.alias("__content"))
    out = rows.join(counts, rows["__content"] == counts["content"], "left")
    return out.select(*[rows[c] for c in kept], rows[bytes_col], F.col("__n").alias(count_col))
