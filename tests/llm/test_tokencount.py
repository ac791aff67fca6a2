"""Operator 5 against the library, and the cache's behaviour."""

import sentencepiece
from scriptorium.llm import queries as Q
from scriptorium.llm.common import shared_folder
from scriptorium.llm.tokencount import count_tokens, read_cache
from scriptorium.session import ensure_checkpoint_dir
from tests.llm.conftest import SF001

PATH = Q.tokenizer_file("piece_bpe_32k.model")


def test_counts_and_cache(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", "  two  blanks ", "<s> </s> <unk>", "héllo wörld 漢字 🙂", "x" * 50_000, "same", "same", "same", "\n\n\tA\x00b", " "]
    rows = [(i, t, "e") for i, t in enumerate(texts)] + [(6, "same", "f"), (None, "no id", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    cache = shared_folder(spark, "t")
    out = count_tokens(df, cache, PATH).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "content", "n_bytes", "n_tokens"}
    for r in out:
        assert r.n_tokens == len(sp.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    stored = read_cache(spark, cache).count()
    assert stored == len({t or "" for _, t, _ in rows})
    more = spark.createDataFrame([(1, "same"), (2, "new one")], "doc_id long, text string")
    assert {r.text: r.n_tokens for r in count_tokens(more, cache, PATH).collect()} == {t: len(sp.encode(t)) for t in ("same", "new one")}
    assert spark.read.parquet(cache).count() == stored + 1  # only the miss was appended
    assert count_tokens(df.limit(0), shared_folder(spark, "t"), PATH).count() == 0


def test_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = Q.QUERIES["op5_token_counts"](spark, SF001)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    got = out.collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


def test_query_reads_stored_counts(spark):
    """A second run of the registered query adds nothing to the cache and gives the same counts."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None) or ensure_checkpoint_dir(spark)
    cache = f"{root.rstrip('/')}/token-cache"
    first = sorted(map(tuple, Q.QUERIES["op5_token_counts"](spark, SF001).collect()))
    stored = read_cache(spark, cache).count()
    assert stored >= len({r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()})
    assert sorted(map(tuple, Q.QUERIES["op5_token_counts"](spark, SF001).collect())) == first
    assert spark.read.parquet(cache).count() == stored


def test_a_second_run_appends_nothing(spark, tmp_path):
    import os

    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)] + [(None, None)], "doc_id long, text string").repartition(3)
    cache = f"{tmp_path}/cache"
    first = sorted(map(str, count_tokens(df, cache, PATH).collect()))
    files = sorted(os.listdir(cache))
    assert files and sorted(map(str, count_tokens(df, cache, PATH).collect())) == first
    assert sorted(os.listdir(cache)) == files
    more = df.unionAll(spark.createDataFrame([(99, "a new text")], "doc_id long, text string"))
    assert count_tokens(more, cache, PATH).count() == 42 and len(os.listdir(cache)) > len(files)
    assert count_tokens(df.limit(0), f"{tmp_path}/other", PATH).count() == 0
