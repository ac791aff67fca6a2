"""Operator 3: benchmark decontamination by spaced-seed hashing.

Words are lower-case runs of letters and digits.  A document leaks an item if
some ``window`` consecutive words of it equal ``window`` consecutive words of the
item in all but at most ``substitutions`` places.  An item shorter than the window
leaks where all its words stand in a document as they are: the mask for it selects
every word.

Each of the fixed masks selects some of the words it spans and ignores the
others; the hash of the selected words is the seed.  Together the masks are
lossless for the default window: wherever the substitutions are, one mask lies
between them, so a leak always shares a seed.  Seeds of documents and items are
joined, and around each hit the aligned words are compared.

The benchmark's seeds go into a bit table of fixed size; of a document only the
positions that the table reports are shuffled, with the words around them
(fewer than three windows).  With N benchmark seeds a share of N / 2^``TABLE_BITS`` of the other
positions is shuffled in vain.  A passage that a third of the documents share
is a hot seed: the skew join splits it.

Defined results: null and empty texts have no words and leak nothing; ids keep their
own type; items with fewer words than ``min_item_words`` (1: none) are left out; documents that repeat an id give one row with the widest span; null
ids are kept as a null id; extra columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bittable
from .common import binary_texts
from .tokenhash import batches_of_words, mix

#: Places that each mask selects, counted from the first (fixed values; tests verify that they are lossless).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 2, 3, 5, 6), (0, 1, 4, 5, 6, 7))
#: log2 of the bits in the table of benchmark seeds: 8 MB.
TABLE_BITS = 26
WINDOW = 12
SUBSTITUTIONS = 2
MIN_ITEM_WORDS = 1
_FACTORS = np.random.default_rng(977).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _span(mask) -> int:
    return mask[-1] + 1


def seeds(words: np.ndarray, number: int, masks=MASKS) -> np.ndarray:
    """Seed of mask ``number`` at every place where it fits."""
    mask = masks[number]
    n = len(words) - _span(mask) + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, number + 1, np.uint64)
    for k, at in enumerate(mask):
        total += words[at : at + n] * _FACTORS[k]
    return mix(total)


def _around(words: np.ndarray, at: np.ndarray, lo: int, hi: int, span: int, window: int):
    """Contexts of seeds at ``at`` inside words[lo:hi]: (packed words, words before the seed)."""
    reach = window - 1
    first = np.maximum(at - reach, lo)
    last = np.minimum(at + span + reach, hi)
    return [words[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], (at - first)


def _all_masks(masks, window: int):
    """The spaced masks, and one for each length of the items below the window: all of their words."""
    return (*masks, *(tuple(range(n)) for n in range(1, window)))


def _item_seeds(items: DataFrame, id_col: str, text_col: str, window: int, min_words: int, masks) -> DataFrame:
    """Seeds of the items; ``masks`` as ``_all_masks`` gives them."""
    spaced = len(masks) - window + 1

    def run(batches):
        for batch in batches:
            texts = binary_texts(batch.column(1))
            ids = batch.column(0)
            for i0, words, ends in batches_of_words(texts):
                lo = 0
                for k, hi in enumerate(ends.tolist()):
                    n = hi - lo
                    for m in range(spaced) if n >= window else [spaced + n - 1] if n else []:
                        mask = masks[m]
                        s = seeds(words[lo:hi], m, masks)
                        if n < min_words or not len(s):
                            continue
                        at = np.arange(lo, lo + len(s))
                        around, before = _around(words, at, lo, hi, _span(mask), window)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(s.view(np.int64)),
                                ids.take(pa.array(np.full(len(s), i0 + k))),
                                pa.array(np.full(len(s), n, np.int32)),
                                pa.array(np.full(len(s), m, np.int32)),
                                pa.array((at - lo).astype(np.int32)),
                                pa.array(before.astype(np.int32)),
                                pa.array(around, pa.binary()),
                            ],
                            ["seed", "item_id", "item_words", "mask", "item_at", "item_before", "item_around"],
                        )
                    lo = hi

    rows = items.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(
        run, f"seed long, item_id {rows.schema[0].dataType.simpleString()}, item_words int, mask int, item_at int, item_before int, item_around binary"
    )


def _document_hits(docs: DataFrame, id_col: str, text_col: str, window: int, table, masks, numbers: list[int]) -> DataFrame:
    """Places of documents that the table of seeds reports, for the masks with these numbers."""

    def run(batches):
        for batch in batches:
            texts = binary_texts(batch.column(1))
            ids = batch.column(0)
            for i0, words, ends in batches_of_words(texts):
                starts = np.concatenate([[0], ends[:-1]])
                for m in numbers:
                    mask = masks[m]
                    s = seeds(words, m, masks)
                    at = np.flatnonzero(bittable.present(table.value, s, TABLE_BITS))
                    k = np.searchsorted(ends, at, side="right")
                    fits = at + _span(mask) <= ends[k] if len(at) else np.zeros(0, bool)  # not across two texts
                    at, k = at[fits], k[fits]
                    if not len(at):
                        continue
                    around, before = _around(words, at, starts[k], ends[k], _span(mask), window)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s[at].view(np.int64)), ids.take(pa.array(i0 + k)), pa.array(at - starts[k]), pa.array(before.astype(np.int32)), pa.array(around, pa.binary())],
                        ["seed", "doc_id", "at", "before", "around"],
                    )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"seed long, doc_id {rows.schema[0].dataType.simpleString()}, at long, before int, around binary")


def overlap(doc: np.ndarray, before: int, item: np.ndarray, item_before: int, span: int, item_words: int, window: int, substitutions: int):
    """Windows through an aligned seed that pass: (first and last word, from the seed on; most equal words), or None."""
    length = min(window, item_words)
    allowed = substitutions if length == window else 0
    left = min(before, item_before)
    n = left + min(len(doc) - before, len(item) - item_before)
    if n < length:
        return None
    same = doc[before - left : before - left + n] == item[item_before - left : item_before - left + n]
    total = np.concatenate([[0], np.cumsum(same)])
    lo, hi = max(0, left + span - length), min(left, n - length)  # windows that hold the whole seed
    if hi < lo:
        return None
    equal = total[lo + length : hi + length + 1] - total[lo : hi + 1]
    passed = np.flatnonzero(equal >= length - allowed)
    if not len(passed):
        return None
    return lo + int(passed[0]) - left, lo + int(passed[-1]) - left + length - 1, int(equal.max())


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    substitutions: int = SUBSTITUTIONS,
    min_item_words: int = MIN_ITEM_WORDS,
    masks=MASKS,
) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, equal_words, hits): every document that leaks an item.

    ``first_word`` and ``last_word`` bound the leaked windows in the document (0-based word numbers);
    ``equal_words`` of the best window; ``hits``: seeds with a window that was verified.
    """
    masks = _all_masks(masks, window)
    wanted = _item_seeds(items, item_id_col, item_text_col, window, min_item_words, masks)
    table = docs.sparkSession.sparkContext.broadcast(bittable.build(wanted.select("seed"), TABLE_BITS))
    used = sorted(r["mask"] for r in wanted.select("mask").distinct().collect())  # no more than there are masks
    hits = _document_hits(docs, id_col, text_col, window, table, masks, used)
    spans = [_span(m) for m in masks]

    def verify(batches):
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("at", "before", "around", "item_words", "mask", "item_before", "item_around")}
            rows, first, last, equal = [], [], [], []
            for i in range(batch.num_rows):
                found = overlap(
                    np.frombuffer(c["around"][i], np.uint64), c["before"][i], np.frombuffer(c["item_around"][i], np.uint64), c["item_before"][i], spans[c["mask"][i]], c["item_words"][i], window, substitutions
                )
                if found:
                    rows.append(i)
                    first.append(c["at"][i] + found[0])
                    last.append(c["at"][i] + found[1])
                    equal.append(found[2])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("item_id").take(take), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(equal, pa.int64())],
                ["doc_id", "item_id", "first", "last", "equal"],
            )

    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (items, item_id_col))]
    verified = hits.join(wanted, "seed").mapInArrow(verify, f"doc_id {kinds[0]}, item_id {kinds[1]}, first long, last long, equal long")
    return verified.groupBy("doc_id", "item_id").agg(
        F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.max("equal").alias("equal_words"), F.count("*").alias("hits")
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item; all input columns."""
    bad = find_leaks(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
