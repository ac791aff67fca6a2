"""Operator 12: source divergence audit over length-bucketed packed terms.

A term is a maximal run of ASCII letters and non-ASCII characters, A-Z in lower
case.  The tasks that read the texts count terms in numpy, a slice of texts at
a time.  Terms are dealt to buckets by their length: those of up to 8 bytes are
packed into one uint64 word, those of up to 16 bytes into two (big-endian, zero
padded: no term holds a zero byte, so packing loses nothing), and every bucket
is sorted by a radix sort over the 16-bit digits that its length can fill, with the
(language, source) group as last digit.  Equal neighbours are one run: its
length is the count, and as the sort is stable, the changes of the document inside
of it are the document count.  Terms of over 16 bytes are sorted as bytes in a
bucket of their own.  A text longer than a slice is counted piece by piece, cut
between terms.

Spark adds up the partial counts by (language, source, term): a hot source is
spread by its terms, a hot term meets as one partial count a task.  A term is
kept where at least ``min_docs`` rows of the language hold it.  All shares are
whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)).

``term_divergence`` compares each group with its language, ``source_divergence``
each group with every other of its language over all kept terms, absent ones
included.  For that the kept counts of a language are dealt to term buckets of
bounded size, each a dense matrix (sources x terms) in numpy; a task makes the
sums of at most ``BLOCK`` sources against all, so languages with many sources are
split too.  The sums of the buckets are added by Spark.

Defined results: null text, language or source counts as an empty one; each row
is a document, repeated rows or ids included; a group or language without kept
terms has no term rows and value 0 with every other source; a language with one
source has no pairs; ties in value rank by item; other columns are ignored, and
columns are read by the names given; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_texts, written

SCALE = 1_000_000_000
#: Bytes of text counted at a time.
SLICE = 8_000_000
#: Sources whose sums one task makes, and count rows in one term bucket.
BLOCK, BUCKET_ROWS = 64, 200_000
#: Cells of the dense matrix held at a time.
CELLS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[97:123] = _IN_TERM[128:] = True
#: Keeps the first k bytes of a big-endian word.
_FIRST = np.array([(2**64 - 1) ^ (2 ** (64 - 8 * k) - 1) for k in range(9)], np.uint64)


def radix_order(words: list[np.ndarray], digits: list[int]) -> np.ndarray:
    """Stable order by words (most significant first): least significant 16-bit digit first.

    ``digits[i]`` leading digits of ``words[i]`` can differ from zero.  numpy sorts uint16 by radix.
    """
    order = np.arange(len(words[0]))
    for word, n in zip(reversed(words), reversed(digits), strict=True):
        for shift in range(64 - 16 * n, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _bytes_of(words: list[np.ndarray], size: np.ndarray) -> pa.Array:
    """Packed words back to strings."""
    flat = np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(len(size), -1)
    data = flat[np.arange(flat.shape[1]) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _runs(words, digits, size, group, doc):
    """(terms, group, count, document count) of one bucket."""
    n = -(-int(group.max()).bit_length() // 16)
    order = radix_order([group.astype(np.uint64) << np.uint64(64 - 16 * n) if n else words[0], *words], [n, *digits])
    keys = [group[order], *(w[order] for w in words)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    doc = doc[order]
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    return _bytes_of([k[first] for k in keys[1:]], size[order][first]), keys[0][first], counts, np.add.reduceat(new_doc.astype(np.int64), first)


def count_terms(texts: list[bytes], groups: np.ndarray):
    """Yield (terms, group, count, document count) arrays for texts that belong to ``groups``."""
    joined = b" ".join(texts) + b" " * 17  # a word is read at any place
    low = _LOWER[np.frombuffer(joined, np.uint8)]
    inside = _IN_TERM[low]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(begins, start, "right") - 1
    windows = np.lib.stride_tricks.as_strided(low, (len(low) - 7, 8), (1, 1))

    def word(at, n):
        return windows[at].view(">u8").ravel().astype(np.uint64) & _FIRST[n]

    pairs = (size + 1) >> 1  # 16-bit digits
    for d in range(1, 6):  # up to 2, 4, 6, 8 and 16 bytes
        pick = np.flatnonzero(pairs == d if d <= 4 else (pairs > 4) & (pairs <= 8))
        if len(pick):
            s, n, k = start[pick], size[pick], doc[pick]
            words = [word(s, n)] if d <= 4 else [word(s, 8), word(s + 8, n - 8)]
            yield _runs(words, [d] if d <= 4 else [4, 4], n, groups[k], k)
    pick = np.flatnonzero(size > 16)
    if len(pick):
        flat = low.tobytes()
        rows = sorted((int(groups[doc[i]]), flat[start[i] : start[i] + size[i]], int(doc[i])) for i in pick)
        runs = [(key, [r[2] for r in found]) for key, found in groupby(rows, key=lambda r: r[:2])]
        yield (
            pa.array([t.decode() for (_, t), _ in runs], pa.string()),
            np.array([g for (g, _), _ in runs]),
            np.array([len(d) for _, d in runs]),
            np.array([len(set(d)) for _, d in runs]),
        )


def _count_long(text: bytes):
    """As ``count_terms`` for one text, a piece at a time."""
    total: dict[str, int] = {}
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and (text[end] >= 128 or chr(text[end]).isalpha()):
            end += 1
        for terms, _, n, _ in count_terms([text[at:end]], np.zeros(1, np.int64)):
            for t, k in zip(terms.to_pylist(), n.tolist(), strict=True):
                total[t] = total.get(t, 0) + k
        at = end
    if total:
        yield pa.array(list(total), pa.string()), np.zeros(len(total), np.int64), np.array(list(total.values())), np.ones(len(total), np.int64)


def _partial_counts(batches):
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        texts = binary_texts(batch.column(2))
        lang, source = (batch.column(i).to_pylist() for i in (0, 1))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < SLICE):
                size += len(texts[end])
                end += 1
            known: dict[tuple, int] = {}
            groups = np.array([known.setdefault(k, len(known)) for k in zip(lang[at:end], source[at:end], strict=True)])
            made = _count_long(texts[at]) if size > SLICE else count_terms(texts[at:end], groups)
            langs, sources = (pa.array([k[i] for k in known], pa.string()) for i in (0, 1))
            for terms, g, n, docs in made:
                g = pa.array(g)
                yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names)
            at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows that hold the term, for every group."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    parts = docs.select(*empty).mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """Kept counts and totals of a table of documents, as tables in the shared folder.

    ``kept``: lang, source, term, n (there), n_lang; ``totals``: lang, source, place (of the
    source in its language), d (N + V of the group), d_lang, v, n_sources, n_rows.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3):
        counts = term_counts(docs, text_col, lang_col, source_col)
        by_term = Window.partitionBy("lang", "term")
        seen = counts.withColumn("n_lang", F.sum("n").over(by_term)).withColumn("in_docs", F.sum("docs").over(by_term)).withColumn("first", F.min("source").over(by_term) == F.col("source"))
        self.kept = written(seen.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "first"), "divergence-kept")
        groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
        sums = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("v"), F.count(F.lit(1)).alias("rows"))
        lang = Window.partitionBy("lang")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        found = groups.join(sums, ["lang", "source"], "left").select(
            "lang",
            "source",
            (F.row_number().over(lang.orderBy("source")) - 1).alias("place"),
            zero("n").alias("n"),
            F.sum(zero("n")).over(lang).alias("n_lang"),
            F.sum(zero("v")).over(lang).alias("v"),
            F.count(F.lit(1)).over(lang).alias("n_sources"),
            F.sum(zero("rows")).over(lang).alias("n_rows"),
        )
        self.totals = written(found.select("lang", "source", "place", (F.col("n") + F.col("v")).alias("d"), (F.col("n_lang") + F.col("v")).alias("d_lang"), "v", "n_sources", "n_rows"), "divergence-totals")


def share(n: Column, d: Column) -> Column:
    """1 + floor(10^9 (n + 1) / d), exact."""
    wide = ((n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", wide, d.cast("decimal(38,0)")) + 1


def term_divergence(audit: Audit, top: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): each group's ``top`` terms that it uses more than its language."""
    rows = audit.kept.join(audit.totals.select("lang", "source", "d", "d_lang"), ["lang", "source"])
    p, q = F.col("p"), F.col("q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("d")).alias("p"), share(F.col("n_lang"), F.col("d_lang")).alias("q")).where(p > q)
    rows = rows.select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), q).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _shares(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """As ``share``: long division in base 1,000 keeps every step inside of 64 bits."""
    left, found = n + 1, np.zeros(np.broadcast_shapes(n.shape, d.shape), np.int64)
    for _ in range(3):
        left = left * 1000
        found = found * 1000 + left // d
        left = left % d
    return found + 1


def _block_sums(key, table):
    """Sums over the terms of one bucket, of the sources of one block against all of the language."""
    lang, _, block = (k.as_py() for k in key)
    cols = {c: table.column(c).combine_chunks() for c in ("place", "n", "d", "term", "source")}
    no_term = np.asarray(cols["term"].is_null())
    place, n = cols["place"].to_numpy(), cols["n"].to_numpy()
    sources = [""] * int(no_term.sum())
    d = np.zeros(len(sources), np.int64)
    all_d = cols["d"].to_numpy()
    for i, s in zip(np.flatnonzero(no_term), cols["source"].filter(pa.array(no_term)).to_pylist(), strict=True):
        sources[place[i]], d[place[i]] = s, all_d[i]
    mine = range(block * BLOCK, min(len(sources), (block + 1) * BLOCK))
    sums = np.zeros((len(mine), len(sources)), np.int64)
    rows = np.flatnonzero(~no_term)
    if len(rows):
        codes = cols["term"].take(pa.array(rows)).dictionary_encode().indices.to_numpy()
        rows = rows[np.argsort(codes, kind="stable")]
        codes = np.sort(codes)
        step = max(1, CELLS // len(sources))
        for first in range(0, int(codes[-1]) + 1, step):
            lo, hi = np.searchsorted(codes, (first, first + step))
            counts = np.zeros((len(sources), int(codes[hi - 1]) + 1 - first), np.int64)
            counts[place[rows[lo:hi]], codes[lo:hi] - first] = n[rows[lo:hi]]
            p = _shares(counts, d[:, None])
            for i, a in enumerate(mine):
                off = p[a] - p
                sums[i] += (off * off // p).sum(axis=1)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(mine)), np.arange(len(sources)), indexing="ij"))
    other = a + block * BLOCK != b
    names = pa.array(sources, pa.string())
    return pa.table(
        {
            "lang": pa.array([lang] * int(other.sum()), pa.string()),
            "source": names.take(pa.array(a[other] + block * BLOCK)),
            "item": names.take(pa.array(b[other])),
            "value": pa.array(sums.ravel()[other]),
        }
    )


def source_divergence(audit: Audit) -> DataFrame:
    """(lang, source, item, value, rank): each group against every other source of its language, over all kept terms."""
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.greatest(F.lit(BUCKET_ROWS), F.col("n_sources") * F.col("n_sources"))))
    totals = audit.totals.withColumn("n_buckets", n_buckets).withColumn("blocks", F.sequence(F.lit(0), F.floor((F.col("n_sources") - 1) / BLOCK)))
    block = F.explode("blocks").alias("block")
    shape = ["lang", "bucket", "block", "place", "source", "term", "n", "d"]
    rows = audit.kept.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", "place", "d", F.pmod(F.xxhash64("term"), "n_buckets").alias("bucket"), block).select(*shape)
    heads = totals.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_buckets") - 1)).alias("bucket")).select("*", block)
    heads = heads.select("lang", "bucket", "block", "place", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "d")
    parts = rows.unionByName(heads).groupBy("lang", "bucket", "block").applyInArrow(_block_sums, "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
