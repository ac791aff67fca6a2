"""Sources and sinks on generated files in a fresh folder."""

import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.sources import archives
from scriptorium.sources import readers as R
from scriptorium.sources import sinks as K


def test_whole_files_invalid_utf8_and_crlf(spark, tmp_dir):
    import os

    os.makedirs(f"{tmp_dir}/sub")
    with open(f"{tmp_dir}/a.txt", "wb") as fh:
        fh.write(b"ok \xff\xfe bytes\r\nnext\rlast")
    with open(f"{tmp_dir}/sub/b.txt", "wb") as fh:
        fh.write("plain é".encode())
    rows = {r.path.rsplit("/", 1)[-1]: r.text for r in R.read_whole_files(spark, tmp_dir).collect()}
    assert rows == {"a.txt": "ok  bytes\nnext\nlast", "b.txt": "plain é"}


def test_xml_abstracts_mixed_content(spark, tmp_dir):
    xml = (
        "<PubmedArticleSet><PubmedArticle><PMID>7</PMID><Abstract>"
        '<AbstractText Label="A">foo <i>bar</i>\n baz &amp; &lt;q&gt;</AbstractText><AbstractText/>'
        "</Abstract></PubmedArticle><PubmedArticle><PMID>8</PMID><Abstract><AbstractText>x  y</AbstractText></Abstract></PubmedArticle></PubmedArticleSet>"
    )
    with gzip.open(f"{tmp_dir}/a.xml.gz", "wt") as fh:
        fh.write(xml)
    rows = sorted((r.pmid, r.idx, r.text) for r in R.read_xml_abstracts(spark, tmp_dir).collect())
    assert rows == [("7", 0, "foo bar baz & <q>"), ("7", 1, ""), ("8", 0, "x y")]


def test_json_array_and_jsonl(spark, tmp_dir):
    with open(f"{tmp_dir}/arr.json", "w") as fh:
        json.dump([{"sample": "s1", "target": "t1"}, {"sample": "s2", "target": "t2"}], fh, indent=2)
    schema = "sample string, target string"
    rows = sorted((r.sample, r.target) for r in R.read_json_array(spark, f"{tmp_dir}/arr.json", schema).collect())
    assert rows == [("s1", "t1"), ("s2", "t2")]
    out = K.write_jsonl(spark.createDataFrame(rows, schema), f"{tmp_dir}/out")
    assert sorted((r.sample, r.target) for r in R.read_jsonl(spark, out, schema).collect()) == rows


def test_csv_multiline_quotes(spark, tmp_dir):
    with open(f"{tmp_dir}/notes.csv", "w") as fh:
        fh.write('ROW_ID,TEXT\n1,"first line\nsecond ""quoted"" line"\n2,plain\n')
    rows = sorted((r.ROW_ID, r.TEXT) for r in R.read_csv_notes(spark, f"{tmp_dir}/notes.csv").collect())
    assert rows == [("1", 'first line\nsecond "quoted" line'), ("2", "plain")]


def test_tar_members(spark, tmp_dir):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tf:
        for name, data in [("x/1.txt", b"one\r\n"), ("x/2.txt", b"two \xff")]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
    with open(f"{tmp_dir}/a.tar.gz", "wb") as fh:
        fh.write(buf.getvalue())
    rows = sorted((r.member, r.text) for r in archives.read_tar_members(spark, tmp_dir).collect())
    assert rows == [("x/1.txt", "one\n"), ("x/2.txt", "two ")]


def test_shards_and_splits_round_trip(spark, tmp_dir):
    df = spark.range(10).select(F.col("id").alias("k"), F.when(F.col("id") < 3, "test").otherwise("train").alias("split"))
    p = K.write_splits(df, f"{tmp_dir}/splits")
    back = spark.read.parquet(p)
    assert sorted((r.k, r.split) for r in back.collect()) == sorted((r.k, r.split) for r in df.collect())
    s = K.write_shards(df.select("k"), ["k"], 3, f"{tmp_dir}/shards")
    got = {r.k: r.shard for r in spark.read.json(s).collect()}
    assert got == {k: min(k // 3, 2) for k in range(10)}


def test_scratch_path_under_checkpoint_dir(spark):
    from scriptorium.session import ensure_checkpoint_dir

    assert K.scratch_path(spark, "x").startswith(ensure_checkpoint_dir(spark).rstrip("/"))
