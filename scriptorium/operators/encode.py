"""Vocabulary, encoding, padding and masked-LM examples.

Re-aim of the tokenizer: a word vocabulary learned with a distributed
``groupBy(word).count`` + bounded top-K; encoding is one Arrow lookup per batch
with no shuffle while the vocabulary is small enough to be shipped to the tasks
(an explode + join + regroup would shuffle one row per token).  Sub-words are in ``subword``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import explode_rows, let, tokenise_ws
from ..session import bound_batches, checkpoint
from .lookup import row_lookup
from .order import indexed, row_index

#: Rows of the largest vocabulary that is sent to the tasks (some 50 MB); beyond, encoding is a join.
SHIPPED = 1_000_000


def lower_tokens(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return tokenise_ws(F.lower(c))


def vocab_words(df: DataFrame, text: str, k: int) -> DataFrame:
    """V1(a): top-K lower-cased whitespace words -> (word, id, n); ids start
    after the special tokens; ties by word ascending."""
    words = explode_rows(df.select(lower_tokens(text).alias("_t")), "_t", "word", keep=[])
    # the distinct-word table is read several times: materialise it once
    counts = checkpoint(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    top = top_k_by_count(counts, k, "word", "n").withColumn("_less", -F.col("n"))
    ranked = row_index(top, ["_less", "word"], "_i")
    return ranked.select("word", "n", (F.col("_i") + len(K.SPECIAL_TOKENS)).cast("int").alias("id"))


def top_k_by_count(counts: DataFrame, k: int, key: str, n: str) -> DataFrame:
    """Exact top ``k`` rows by (``n`` desc, ``key`` asc) without a merge in one task.

    The k-th largest count is read off the histogram of count values (there are
    few distinct counts, and at most k are needed).  All rows above it are in; of the rows that have it,
    however many, the first ones by key are found by their global position (W1).
    """
    hist = counts.groupBy(n).agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.col(n).desc()).limit(k).collect()
    above, cut = 0, None
    for r in hist:
        if above + r["_rows"] >= k:
            cut = r[n]
            break
        above += r["_rows"]
    if cut is None:
        return counts
    need = k - above
    ties, _ = indexed(counts.where(F.col(n) == cut), [key], "_i", keep=lambda i: i < need)
    return counts.where(F.col(n) > cut).unionByName(ties.drop("_i"))


def encode_ids(df: DataFrame, tokens: str, vocab: DataFrame, out: str = "input_ids", add_special: bool = True) -> DataFrame:
    """V2: token array -> id array (unknown -> [UNK]); optional [CLS] ... [SEP].

    A vocabulary of at most ``SHIPPED`` rows is shipped to the tasks, and one Arrow
    lookup serves a whole batch; a larger one is joined with the distinct tokens.
    """
    rows = vocab.select("word", F.col("id").cast("int").alias("id")).limit(SHIPPED + 1).toArrow()
    if rows.num_rows > SHIPPED:
        body = _encode_by_join(df, tokens, vocab, out)
        return body.withColumn(out, F.concat(F.array(F.lit(K.CLS_ID)), F.col(out), F.array(F.lit(K.SEP_ID)))) if add_special else body
    words, ids = rows.column("word").combine_chunks(), rows.column("id").combine_chunks()
    bound_batches(df.sparkSession)
    bc = df.sparkSession.sparkContext.broadcast((words, ids))

    @F.arrow_udf("array<int>")
    def _encode(col: pa.Array) -> pa.Array:
        words, ids = bc.value
        at = pc.index_in(col.flatten(), value_set=words)
        flat = pc.fill_null(ids.take(at), K.UNK_ID).cast(pa.int32())
        sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=col.is_null()) if col.null_count else pa.ListArray.from_arrays(pa.array(ends), flat)

    body = _encode(F.col(tokens))
    return df.withColumn(out, F.concat(F.array(F.lit(K.CLS_ID)), body, F.array(F.lit(K.SEP_ID))) if add_special else body)


def _encode_by_join(df: DataFrame, tokens: str, vocab: DataFrame, out: str) -> DataFrame:
    """Ids from an equi-join of the distinct tokens of each text with the vocabulary, and a lookup in the row.

    Texts are told apart by a digest of their tokens, so equal ones share their entries.
    """
    keyed = df.withColumn("_key", F.xxhash64(tokens))
    need = explode_rows(keyed.select("_key", F.array_distinct(tokens).alias("_d")), "_d", "word", keep=["_key"]).distinct()
    entries = need.join(vocab.select("word", F.col("id").cast("int").alias("id")), "word").groupBy("_key").agg(F.collect_list(F.struct(F.col("word").alias("k"), F.col("id").alias("v"))).alias("_entries"))
    found = keyed.join(entries, "_key", "left").withColumn("_entries", F.coalesce("_entries", F.array().cast("array<struct<k: string, v: int>>")))
    return found.withColumn(out, row_lookup(F.col(tokens), F.col("_entries"), "int", K.UNK_ID)).drop("_key", "_entries")


def truncate_pad(content: Column, max_length: int) -> tuple[Column, Column]:
    """E5: [CLS] + content[:max_length-2] + [SEP], padded with [PAD] to
    ``max_length``; returns (ids, attention_mask)."""
    ids = truncate(content, max_length)
    return pad_right(ids, max_length), attention(ids, max_length)


def truncate(content: Column, max_length: int) -> Column:
    """[CLS] + content[:max_length-2] + [SEP]."""
    return F.concat(F.array(F.lit(K.CLS_ID)), F.slice(content, 1, max_length - 2), F.array(F.lit(K.SEP_ID)))


def pad_right(a: Column, max_length: int, fill: int = K.PAD_ID) -> Column:
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(max_length) - F.size(a), F.lit(0))))


def attention(ids: Column, max_length: int) -> Column:
    """1 for every id, 0 for the padding up to ``max_length``."""
    return pad_right(F.array_repeat(F.lit(1), F.size(ids)), max_length, 0)


def pad_dynamic(df: DataFrame, ids: str, batch: str, multiple_of: int | None = None, pad_id: int = K.PAD_ID, out: str = "padded") -> DataFrame:
    """Pad every row to the longest row of its batch (optionally rounded up
    to a multiple).  The window is partitioned by batch: bounded groups."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    target = longest if not multiple_of else F.ceil(longest / multiple_of).cast("int") * multiple_of
    return df.withColumn("_t", target).withColumn(out, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), (F.col("_t") - F.size(ids)).cast("int")))).drop("_t")


def pad_pairs(a: Column, b: Column, fill: int = K.IGNORE_INDEX) -> tuple[Column, Column]:
    """Pad two arrays to their common (longer) length."""
    n = F.greatest(F.size(a), F.size(b))
    return (
        F.concat(a, F.array_repeat(F.lit(fill), n - F.size(a))),
        F.concat(b, F.array_repeat(F.lit(fill), n - F.size(b))),
    )


def _u(h: Column, part: int) -> Column:
    return F.conv(F.substring(h, 8 * part + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _u_below(h: Column, part: int, p: float) -> Column:
    """``_u(h, part) < p``, read off the hex digits: they sort like the number that they stand for."""
    bound = math.ceil(p * 4294967296)
    digits = F.substring(h, 8 * part + 1, 8)
    return digits.isNotNull() if bound >= 1 << 32 else digits < f"{max(bound, 0):08x}"


def mask_pairs(ids: Column, key: Column, seed, vocab_size: int, p: float = K.MLM_PROBABILITY) -> Column:
    """M1 + M2: array of (input id, label) per position.

    Per position one md5(seed|key|pos) gives four uniforms: chosen (u1 < p and
    not a special id), replaced by [MASK] (u2 < 0.8), random id (u3 < 0.5 of
    the rest, id = floor(u4 * vocab_size)), else unchanged.  Labels keep the
    id at chosen positions and -100 elsewhere.  Random ids may hit a special
    id or the original id, as in the original collator.  Special ids
    (padding above all) are never chosen and not hashed.
    """
    specials = [K.PAD_ID, K.CLS_ID, K.SEP_ID]
    ignore = F.lit(K.IGNORE_INDEX)

    def pair(x, label):
        return F.struct(x.cast("int").alias("i"), label.cast("int").alias("l"))

    def decided(x, h):
        rnd = F.floor(_u(h, 3) * vocab_size).cast("int")
        new = F.when(_u_below(h, 1, K.MASK_REPLACE_SHARE), F.lit(K.MASK_ID)).when(_u_below(h, 2, K.RANDOM_OF_REST_SHARE), rnd).otherwise(x)
        return F.when(_u_below(h, 0, p), pair(new, x)).otherwise(pair(x, ignore))

    def positions(start):
        def position(x, i):
            return F.when(x.isin(*specials), pair(x, ignore)).otherwise(let(F.md5(F.concat(start, i.cast("string"))), lambda h: decided(x, h)))

        return F.transform(ids, position)

    # what all positions of a row share is put together once
    return let(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit("|")), positions)


def mask_columns(df: DataFrame, ids: str, key: str, seed, vocab_size: int, out_ids: str = "masked_ids", out_labels: str = "labels", p: float = K.MLM_PROBABILITY) -> DataFrame:
    """M1 + M2 as DataFrame columns; both read one array of pairs, so a position is hashed once.

    Mask first and pad then: padding is never chosen, and need not be looked at.
    """
    df = df.withColumn("_m", mask_pairs(F.col(ids), F.col(key), seed, vocab_size, p))
    return df.withColumn(out_ids, F.col("_m.i")).withColumn(out_labels, F.col("_m.l")).drop("_m")


def align_labels(pieces: Column, label_ids: Column, mode: str, inside_ids: Column | None = None) -> Column:
    """Per-piece labels from per-word label ids, with -100 on [CLS]/[SEP].

    mode ``first``: first piece of a word gets the word's id, others -100;
    ``all``: other pieces get the id of the I- version (``inside_ids``, by E10);
    ``every``: every piece gets the word's id (unknown labels have -100).
    """
    ign = F.lit(K.IGNORE_INDEX)

    def build(ids):
        if mode == "first":
            return F.transform(pieces, lambda x: F.when(x["sub"] == 0, F.get(ids, x["word"])).otherwise(ign))
        if mode == "every":
            return F.transform(pieces, lambda x: F.get(ids, x["word"]))
        if mode == "all":
            return let(inside_ids, lambda inner: F.transform(pieces, lambda x: F.when(x["sub"] == 0, F.get(ids, x["word"])).otherwise(F.get(inner, x["word"]))))
        raise ValueError(mode)

    # the word labels are read inside the per-piece lambda: bind them once
    return F.concat(F.array(ign), let(label_ids, build), F.array(ign))


# ---------------------------------------------------------------- V1(b): sub-word merges


def chars(word: Column) -> Column:
    """Code points of a word (a regex ``.`` matches a whole code point)."""
    return F.regexp_extract_all(word, F.lit("(?s)."), 0)


def word_table(df: DataFrame, text: str) -> DataFrame:
    """Distinct lower-cased words with counts, as symbol arrays: (symbols, n)."""
    words = explode_rows(df.select(lower_tokens(text).alias("_t")), "_t", "word", keep=[])
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(chars(F.col("word")).alias("symbols"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word count (partial aggregation absorbs hot pairs)."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("symbols") - 2), lambda i: F.struct(F.get(F.col("symbols"), i).alias("a"), F.get(F.col("symbols"), i + 1).alias("b")))
    p = words.where(F.size("symbols") >= 2).select(pairs.alias("_p"), "n")
    rows = explode_rows(p, "_p", "pair", keep=["n"])
    return rows.groupBy(F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).agg(F.sum("n").alias("n"))


#: Pairs looked at per round of merges.
ROUND_PAIRS = 512


def independent_pairs(ranked: list[tuple], want: int) -> list[tuple]:
    """The first pairs of a ranking that one round may merge, as if merged one after the other.

    ``ranked``: (a, b, n) by n falling, then a, b.  A merge changes the counts
    of pairs that share a symbol with it and makes new pairs, none of which is
    more frequent than the pair it came from.  So the next pair is safe
    if it shares no symbol with the pairs taken and is more frequent than every pair that does.
    """
    taken: list[tuple] = []
    used: set[str] = set()
    for i, (a, b, n) in enumerate(ranked):
        if len(taken) == want:
            break
        if taken:
            rival = max((m for x, y, m in ranked[i:] if x in used or y in used), default=0)
            if a in used or b in used or n <= rival or (len(ranked) == ROUND_PAIRS and n <= ranked[-1][2]):
                break
        taken.append((a, b, n))
        used |= {a, b, a + b}
    return taken


def top_pairs(words: DataFrame, limit: int = ROUND_PAIRS) -> list[tuple]:
    """Most frequent pairs; ties by (a, b) ascending."""
    rows = pair_counts(words).orderBy(F.col("n").desc(), "a", "b").limit(limit).collect()
    return [(r["a"], r["b"], int(r["n"])) for r in rows]


def apply_merge(words: DataFrame, a: str, b: str) -> DataFrame:
    """Replace every left-to-right non-overlapping (a, b) by ``a + b``."""
    ab = a + b

    def step(acc, s):
        last = F.element_at(acc, -1)
        hit = (F.size(acc) > 0) & (last == F.lit(a)) & (s == F.lit(b))
        return F.when(hit, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(ab)))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(F.col("symbols"), F.array().cast("array<string>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s)))
    return words.withColumn("symbols", merged)


def learn_merges(df: DataFrame, text: str, rounds: int) -> DataFrame:
    """V1(b): ``rounds`` merges learned over the distinct-word table.

    One small job counts the pairs; all merges that cannot influence each other
    are taken from it at once (``independent_pairs``), with the same result as one
    by one.  The word table's lineage is cut with a reliable checkpoint after
    each.  Returns (rank, a, b, n).
    """
    words = checkpoint(word_table(df, text))
    merges: list[tuple] = []
    while len(merges) < rounds:
        found = independent_pairs(top_pairs(words), rounds - len(merges))
        if not found:
            break
        merges += found
        for a, b, _ in found:
            words = apply_merge(words, a, b)
        words = checkpoint(words)
    return df.sparkSession.createDataFrame([(r, *m) for r, m in enumerate(merges)], "rank int, a string, b string, n long")
