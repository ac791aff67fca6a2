"""The pipeline's stages, each against a brute-force version on what the stage before kept."""

import hashlib

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F
from scriptorium.llm import quality as R
from scriptorium.llm import queries as Q
from scriptorium.llm.simhash import fingerprint
from tests.llm.conftest import SF001
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_quality import WORD, plain_counts
from tests.llm.test_simhash import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Short documents of the smallest table, with planted leaks, copies, repeated lines and odd rows."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    docs = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{SF001}/documents.parquet").where("n_chars < 1500").orderBy("doc_id").limit(70).collect()]
    prose = " ".join(f"plain{i} words" for i in range(60))
    lines = "\n".join(f"a shared line number {i}" for i in range(20))
    long = [t for _, t, *_ in docs if len(t.split()) > 60]
    extra = [f"{prose} {items[0]} {prose}", f"{items[1]}\n{prose}", long[0], long[1] + " end", f"{prose}\n{lines}", f"{lines}\nother {prose}", None, "", "short", "### $$$ " + " ".join(f"%x{i}% |y{i}|" for i in range(80)), long[2]]
    docs += [(1000 + i, t, "en", "made", len(t or "")) for i, t in enumerate(extra)]
    docs += [docs[3], (None, prose + " without an id", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(d[0], int(sum(c in "#*$%&|<>" for c in d[1] or "") == 0), 0) for d in docs if d[0] is not None and d[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_verdict(rules, text):
    c, t = plain_counts(text), text or ""
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    share = lambda a, b: a / b if b else 0.0
    f = {
        "n_words": c["n_words"],
        "mean_word_chars": share(c["word_chars"], c["n_words"]),
        "symbols_per_word": share(c["n_symbols"], c["n_words"]),
        "digit_share": share(sum(x in "0123456789" for x in t), c["word_chars"]),
        "upper_share": share(sum("A" <= x <= "Z" for x in t), c["word_chars"]),
        "mark_share": share(sum(x in ".,;:!?" for x in t), c["word_chars"]),
        "dup_line_share": share(c["n_dup_lines"], len(lines)),
        "repeat_word_share": share(c["n_repeat_words"], c["n_words"]),
        "distinct_word_share": share(len(set(words)), c["n_words"]),
        "words_per_line": share(c["n_words"], len(lines)),
    }
    if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
        return False
    return not any(all(f[k.feature] > k.threshold if k.above else f[k.feature] <= k.threshold for k in r.conditions) for r in rules)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stats = R.with_statistics(docs)
    rules = R.learn_rules(stats.where(~R.base_failed()), spark.read.parquet(f"{folder}/labels.parquet"))
    (n1, f1), (n2, f2), (n3, f3), (n4, f4), (n5, f5) = P.STAGES
    before = rows(docs)

    a = f1(spark, docs, folder)
    want = [r for r in before if plain_verdict(rules, r[1])]
    assert a.columns == COLUMNS and rows(a) == want and 10 < len(want) < len(before)

    a = spark.createDataFrame(want, docs.schema)
    b = f2(spark, a, folder)
    left = plain_lines([r[:2] for r in want])
    want2 = sorted([(i, t, r[2], r[3], len(t) if gone else r[4]) for r, (i, t, _, gone) in zip(want, left, strict=True)], key=repr)
    assert b.columns == COLUMNS and rows(b) == want2 and any(x[3] for x in left)

    b = spark.createDataFrame(want2, docs.schema)
    c = f3(spark, b, folder)
    marked = [(r[0], plain_fingerprint(r[1])) for r in want2]
    top = plain_components(marked)
    want3 = sorted({r for r, (i, fp) in zip(want2, marked, strict=True) if i == top[fp] and (i is not None or True)}, key=repr)
    assert c.columns == COLUMNS and rows(c) == want3 and len(want3) < len(want2)

    c = spark.createDataFrame(want3, docs.schema)
    d = f4(spark, c, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {i for i, _ in plain_leaks([r[:2] for r in want3], items)}
    want4 = [r for r in want3 if r[0] not in bad]
    assert d.columns == COLUMNS and rows(d) == want4 and bad

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.tokenizer_file("word_bpe_49k.json"))
    e = f5(spark, spark.createDataFrame(want4, docs.schema), folder)
    ids = {r[0]: lib.encode(r[1] or "", add_special_tokens=False).ids for r in want4}
    want5 = sorted([(i, len(x), np.asarray(x, "<u4").tobytes(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids.items()], key=repr)
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in e.collect()), key=repr) == want5
    assert rows(P.run(spark, folder).select("doc_id", "n_tokens")) == sorted([w[:2] for w in want5], key=repr)
    assert [n1, n2, n3, n4, n5] == [n for n, _ in P.STAGES] and fingerprint(b"") == 0


def test_empty_table_and_extra_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.withColumn("fingerprint", F.lit("x")).withColumn("quality", F.lit(1)).withColumn("token_ids", F.lit(2))
    now = odd
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == odd.columns
        now = spark.createDataFrame(now.collect(), odd.schema)
    assert P.STAGES[-1][1](spark, now, folder).count() == now.count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_entry_lists_the_queries():
    import __spark_entry__ as E

    names = E.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
    assert names["pipeline"] is P.run and {"op1_line_dedup", "op11_prefix_trie", "op12_source_divergence"} <= set(E.oracle_sql())
