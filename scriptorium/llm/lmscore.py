"""Operator 8: language-model scores of whole texts.

Units (subword ids by rule; nothing is trained to cut words): one of the ``LISTED`` most
frequent words (A-Z in lower case) is a unit; any other word is cut into pieces of ``PIECE`` bytes,
the last one with a word-end mark.  A text is the sequence of its units and one end.  The
``INPUTS`` most frequent words have embeddings of their own, other units share
hashed ones.  The model predicts an output class, and a unit inside its class:

- the ``HEAD`` most frequent words and the end are classes of their own;
- the other listed words are cut into ``TAIL`` classes of like mass, each word with its share of the
  training counts; they are sorted by the most frequent word of the texts that they are mostly found in
  (so that a class holds words of like texts) and then by their bytes;
- the first piece of a word that is not listed belongs to the class of the other words: the word has
  its share of their training counts, mixed with a byte model (three bytes of context, interpolated
  with shorter ones), whose weight is the share of the words found once.

So the probabilities of all texts sum to at most one (a listed word could also be spelled).  Words
found once in training count as spelled where the classes are learned: they stand for the unseen ones.

The logits of the classes are the log of their smoothed share after the last unit, counted over
all training texts, plus what the causal self-attention adds from the context.

Work: (1) all words of all training texts are counted, by 64-bit hash: per batch, then by Spark.
(2) With the listed words known, byte sequences of the other words and (unit, next class) pairs of all
training texts are counted, and the texts are written as unit ids and classes, 4 bytes a token.
(3) Training reads these: the training texts are dealt into ``SHARE`` parts by hash, one for each of the ``ROUNDS``
rounds, so every training text passes through the gradient once.  In a round every partition trains its own copy
of the model on its texts of the part, and Spark averages the copies, in two steps.  (4) One pass
scores all texts.  Both scores take the ``LISTED`` most frequent words from lists of bounded
size, the listed ones; the other words go through a join with the counts, a row per word and text.

Defined results: a null text counts as empty: one token, the end; a null id
counts as the empty id in the choice of held-out texts; rows that repeat an id and a text
get equal results; without training texts all counts are 0; all input columns are returned,
clashing names replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from .common import binary_texts, one_blas_thread, written
from .tokenhash import mix

PIECE = 4
HEAD, TAIL, LISTED = 31, 31, 1 << 18
INPUTS, SHARED = 4096, 256
WIDTH = 16
ROUNDS, SHARE = 2, 2
RATE = 0.015
#: Weight of the classes' overall shares in their shares after a unit, per distinct class found there.
SMOOTH = 2.0
#: Blocks per training step.
STEP_BLOCKS = 128
_SCORE_BLOCKS = 128
_SLICE = 1 << 19
_FREED = 1 << 24
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_AT = np.random.default_rng(1867).integers(1, 1 << 62, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
END_WORD = 1  # hash that stands for the end among the words
WORDS, TEXTS, BYTES, PAIRS, UNITS = 0, 1, 2, 3, 4  # kinds of rows

END_CLASS = HEAD + TAIL
SPELLED = END_CLASS + 1
CLASSES = SPELLED + 1
ORDER = 3  # bytes of context in a spelled word
N_INPUTS = 1 + INPUTS + SHARED


@dataclass
class Cut:
    """Words of a slice: hashes, lengths in bytes, and all their letters."""

    hashes: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray

    def starts(self, words=slice(None)) -> np.ndarray:
        """First 6 bytes of each of these words as a number that sorts like them."""
        begin, lengths = (np.cumsum(self.lengths) - self.lengths)[words], self.lengths[words]
        out = np.zeros(len(begin), np.int64)
        for k in range(6):
            at = np.minimum(begin + k, max(0, len(self.letters) - 1))
            out = out << 8 | np.where(k < lengths, self.letters[at] if len(self.letters) else 0, 0).astype(np.int64)
        return out


def kept_company(c: Cut, ends: np.ndarray):
    """Per kind of word in a slice: hash, count, and a place to sort it by: 15 bits of the most frequent
    word of the texts that most of its occurrences are in, then its first bytes."""
    kinds, at, back = np.unique(c.hashes, return_index=True, return_inverse=True)
    if not len(kinds):
        z = np.zeros(0, np.int64)
        return kinds, z, z
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    pairs, n = np.unique(text * len(kinds) + back, return_counts=True)
    text, kind = pairs // len(kinds), pairs % len(kinds)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    most = np.maximum.reduceat(n * len(kinds) + (len(kinds) - 1 - kind), first)  # of equally frequent words the first kind
    group = (kinds[len(kinds) - 1 - most % len(kinds)] >> np.uint64(49)).astype(np.int64)
    group = group[np.searchsorted(text[first], text)]
    pairs, back2 = np.unique(kind << 15 | group, return_inverse=True)
    sums = np.bincount(back2, n).astype(np.int64)
    kind = pairs >> 15
    order = np.lexsort((-pairs, sums, kind))
    last = order[np.flatnonzero(np.diff(kind[order], append=-1))]  # the group with most occurrences of each kind
    return kinds, np.bincount(kind, sums, len(kinds)).astype(np.int64), (pairs[last] & 0x7FFF) << 48 | c.starts(at)


def cut(raw: bytes) -> Cut:
    return _cut(raw)[0]


def _cut(raw: bytes) -> tuple[Cut, np.ndarray]:
    """The words, and the places where they start."""
    b = np.frombuffer(raw, np.uint8)
    inside = ~np.take(_BLANK, b)
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts = edge[::2]
    if not len(starts):
        return Cut(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)), starts
    lengths = edge[1::2] - starts
    v = np.take(_LOWER, b[inside])
    ends = np.cumsum(lengths)
    place = np.arange(len(v))
    place -= np.repeat(ends - lengths, lengths)
    place &= 4095
    # Sums of the words as differences of running sums: whole numbers of 64 bits, whose overflow cancels out.
    sums = np.take(_AT, place)
    sums *= v + np.uint64(1)
    sums = np.diff(np.cumsum(sums)[ends - 1], prepend=np.uint64(0))
    hashes = mix(sums + lengths.astype(np.uint64))
    return Cut(hashes | np.uint64(2), lengths, v), starts  # never END_WORD


def pieces(lengths: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Ids of the pieces of words: up to 4 bytes, their number and the word-end mark."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    first = np.flatnonzero(place % PIECE == 0)
    size = np.diff(np.append(first, len(letters)))
    ids = np.add.reduceat(letters << (np.uint64(8) * (place % PIECE).astype(np.uint64)), first) | size.astype(np.uint64) << np.uint64(32)
    ids[np.cumsum((lengths + PIECE - 1) // PIECE) - 1] |= np.uint64(1 << 36)
    return ids


def byte_sequences(lengths: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte and the end of each word with the ``ORDER`` symbols before it, as one number; and its word.

    Nine bits a symbol: 0 before the word, 1 to 256 a byte, 257 the end; the symbol itself is lowest.
    """
    n = len(lengths)
    ends = np.cumsum(lengths + ORDER + 1)
    first = ends - lengths - 1
    line = np.zeros(int(ends[-1]) if n else 0, np.int64)
    inside = np.ones(len(line), bool)
    for k in range(1, ORDER + 1):
        inside[first - k] = False
    line[inside] = 257
    inside[ends - 1] = False
    line[inside] = letters.astype(np.int64) + 1
    keys = line[ORDER:].copy()
    for k in range(1, ORDER + 1):
        keys |= line[ORDER - k : len(line) - k] << (9 * k)
    inside[ends - 1] = True
    return keys[inside[ORDER:]], np.repeat(np.arange(n), lengths + 1)


def slices(texts: list[bytes]):
    """(first text, next text, words, ends of the texts among the words): about ``_SLICE`` bytes each."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _SLICE):
            size += len(texts[j])
            j += 1
        if j == i + 1 and size > 4 * _SLICE:
            parts = [cut(x) for x in _long(texts[i])]
            yield i, j, Cut(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("hashes", "lengths", "letters"))), np.array([sum(len(p.hashes) for p in parts)])
        else:
            c, starts = _cut(b" ".join(texts[i:j]))
            yield i, j, c, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[i:j]]))
        i = j


def _long(raw: bytes):
    i = 0
    while i < len(raw):
        j = min(len(raw), i + _SLICE)
        while j < len(raw) and not _BLANK[raw[j]]:
            j += 1
        yield raw[i:j]
        i = j


@dataclass
class Vocabulary:
    """What the counts say, in arrays of bounded size."""

    train_tokens: int
    distinct: int
    texts: int
    listed: np.ndarray  # sorted hashes of the listed words
    counts: np.ndarray
    rank: np.ndarray  # of each listed word by count
    klass: np.ndarray
    inside: np.ndarray  # log10 of a word's share in its class
    others: int = 0  # training count of all words that are not listed
    spell: float = 1.0  # weight of the byte model among the other words
    bytes_: list | None = None  # byte model: per order sorted (context, symbol) numbers, their counts, and the contexts'
    prior: np.ndarray | None = None  # log of a class's share after an input

    def units(self, c: Cut, learning: bool = False, kinds_of=None):
        """Per unit: input id, class (-1: a piece that must follow), log10 inside the class of listed words;
        units per word; the byte sequences of the other words, and the number of the word of each."""
        kinds, back = np.unique(c.hashes, return_inverse=True) if kinds_of is None else kinds_of
        at, known = _find(self.listed, kinds)
        if learning:
            known[known] = self.counts[at[known]] > 1
        inputs = np.zeros(len(kinds), np.int64)
        klass, inside = inputs.copy(), np.zeros(len(kinds))
        if known.any():
            rank = self.rank[at[known]]
            inputs[known] = np.where(rank < INPUTS, 1 + rank, 1 + INPUTS + (kinds[known] >> np.uint64(40) & np.uint64(SHARED - 1)).astype(np.int64))
            klass[known], inside[known] = self.klass[at[known]], self.inside[at[known]]
        whole = known[back]
        per_word = np.where(whole, 1, (c.lengths + PIECE - 1) // PIECE)
        first = np.cumsum(per_word) - per_word
        n = int(per_word.sum())
        out = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
        to, of = first[whole], back[whole]
        for o, x in zip(out, (inputs, klass, inside), strict=True):
            o[to] = np.take(x, of)
        lengths, letters = c.lengths[~whole], c.letters[np.repeat(~whole, c.lengths)]
        keys = word = np.zeros(0, np.int64)
        if len(lengths):
            rest = np.ones(n, bool)
            rest[to] = False
            out[0][rest] = 1 + INPUTS + (mix(pieces(lengths, letters)) & np.uint64(SHARED - 1)).astype(np.int64)
            out[1][first[~whole]] = SPELLED
            keys, word = byte_sequences(lengths, letters)
        return *out, per_word, keys, np.flatnonzero(~whole)[word]

    def spelled(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each symbol after its context: every order is mixed with the next shorter one."""
        kinds, back = np.unique(keys, return_inverse=True)
        p = np.full(len(kinds), 1 / 257)
        for order, (grams, n, contexts, total, followers) in enumerate(self.bytes_):
            if not len(grams):
                continue  # no word was spelled in training
            own = kinds & ((1 << 9 * (order + 1)) - 1)
            at, there = _find(grams, own)
            seen = np.where(there, n[at], 0)
            at, there = _find(contexts, own >> 9)
            t, d = np.where(there, total[at], 0), np.where(there, followers[at], 0)
            p = np.where(t > 0, (seen + d * p) / np.maximum(t + d, 1), p)
        return np.log10(p)[back]


def _find(table: np.ndarray, values: np.ndarray):
    """Places of values in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _keep_memory() -> None:
    """Lets a worker use the memory of freed arrays again.  The C library hands it back to the system, and gets it
    page by page, unless an array as large as this one was freed before; its pages are never touched."""
    np.empty(_FREED, np.uint8)


def held_out(id_col):
    """crc32 of the id as text, modulo 10, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _added(parts) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal ids added."""
    ids, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(back, np.concatenate([p[1] for p in parts]), len(ids)).astype(np.int64)


def count_words(train: DataFrame) -> DataFrame:
    """(kind, id, n, place): words by hash with the place to sort them by, and the number of training texts."""

    def run(batches):
        _keep_memory()
        for batch in batches:
            texts = binary_texts(batch.column(0))
            if not texts:
                continue
            found = [kept_company(c, ends) for _, _, c, ends in slices(texts)]
            ids, n, place = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((-n, ids))  # of each word the place in the slice with most of it
            ids, n, place = ids[order], n[order], place[order]
            at = np.flatnonzero(np.diff(ids.view(np.int64), prepend=~ids[:1].view(np.int64)))
            sums = np.add.reduceat(n, at) if len(at) else n
            columns = [np.full(len(at), WORDS, np.int32), ids[at].view(np.int64), sums, weighed(n[at], place[at])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "id", "n", "place"])
            yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([END_WORD], pa.int64()), pa.array([len(texts)], pa.int64()), pa.array([0], pa.int64())], ["kind", "id", "n", "place"])

    rows = train.mapInArrow(run, "kind int, id long, n long, place long")
    return written(rows.groupBy("kind", "id").agg(F.sum("n").alias("n"), (F.max("place") % (1 << 47)).alias("place")), "lm-words")


def weighed(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A place (15 bits of a word, then the first 4 bytes) behind its count, up to 32,767, as one number:
    the largest is that of the slice with most occurrences, and whole numbers are aggregated without a sort."""
    return np.minimum(n, 0x7FFF) << 47 | (place >> 16)


def pack_units(inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, first: np.ndarray) -> bytes:
    """The blocks of a slice of training texts, 4 bytes a token."""
    return b"".join([np.int64(len(first)).tobytes(), inputs.astype("<u2").tobytes(), targets.astype(np.uint8).tobytes(), real.astype(np.uint8).tobytes(), first.astype(np.uint8).tobytes()])


def unpack_units(raw: bytes):
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    size, at = n * A.BLOCK, 8
    inputs = np.frombuffer(raw, "<u2", size, at).astype(np.int64).reshape(n, A.BLOCK)
    targets, real = (np.frombuffer(raw, np.uint8, size, at + (2 + k) * size).reshape(n, A.BLOCK) for k in (0, 1))
    return inputs, targets.astype(np.int64), real.astype(bool), np.frombuffer(raw, np.uint8, n, at + 4 * size).astype(bool)


def read_into_units(train: DataFrame, v: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Counts (kind, id, n) of byte sequences of words that are not listed and of the pairs of an input and the
    class after it; and the training texts as units (part, units), which the training rounds read in their place."""
    shared = train.sparkSession.sparkContext.broadcast(v)
    names = ["kind", "id", "n", "units"]

    def counted(kind, ids, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.binary())], names)

    def run(batches):
        _keep_memory()
        v = shared.value
        pairs = np.zeros(N_INPUTS * CLASSES, np.int64)
        for batch in batches:
            texts, part = binary_texts(batch.column(0)), batch.column(1).to_numpy()
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for k in np.unique(part):
                for _, _, c, ends in slices([texts[i] for i in np.flatnonzero(part == k)]):
                    inputs, targets, _, real, first, _, keys, _ = _blocked(v, c, ends, True)
                    pairs += np.bincount((inputs * CLASSES + targets)[real], minlength=len(pairs))
                    found.append(np.unique(keys, return_counts=True))
                    yield pa.RecordBatch.from_arrays([pa.array([UNITS], pa.int32()), pa.array([k], pa.int64()), pa.array([0], pa.int64()), pa.array([pack_units(inputs, targets, real, first)], pa.binary())], names)
            yield counted(BYTES, *_added(found))
        at = np.flatnonzero(pairs)
        yield counted(PAIRS, at, pairs[at])

    rows = written(train.mapInArrow(run, "kind int, id long, n long, units binary"), "lm-units")
    counts = rows.where(F.col("kind") != UNITS).groupBy("kind", "id").agg(F.sum("n").alias("n"))
    return written(counts, "lm-unit-counts"), rows.where(F.col("kind") == UNITS).select(F.col("id").alias("part"), "units")


def _most(rows: DataFrame, limit: int, *more: str):
    """The rows above a count that at most ``limit`` rows exceed, by falling count.

    A histogram of the counts says which; no table is sorted.
    """
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.lit(1024) + F.floor(F.log2(F.col("n") / 1024) * 64)).cast("int")
    above, cut_at = 0, 0
    for r in sorted(rows.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        above += r["count"]
        if above > limit:
            cut_at = r["level"]
            break
    got = rows.where(level > cut_at).select("id", "n", *more).toArrow()
    ids, n = got.column("id").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.lexsort((ids, -n))
    return ids[order], n[order], *[got.column(m).to_numpy()[order] for m in more]


def read_words(counts: DataFrame) -> Vocabulary:
    """The totals, and the most frequent words: lists of fixed largest length."""
    total = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    of = lambda kind, what: total[kind][what] if kind in total else 0
    texts = of(TEXTS, "n")
    words = counts.where(F.col("kind") == WORDS)
    ids, n, place = _most(words, LISTED, "place")
    once = words.where("n = 1").count()
    rank = np.arange(len(ids))
    klass = classes_of(ids, n, place)
    inside = np.log10(n / np.bincount(klass, n, CLASSES)[klass]) if len(ids) else np.zeros(0)
    others = of(WORDS, "n") - int(n.sum())
    # Unseen words are as frequent as those found once; all of these were learned as other words.
    spell = min(1.0, once / (others + int((n == 1).sum()))) if others and once else 1.0 if not others else 1e-6
    o = np.argsort(ids)
    return Vocabulary(of(WORDS, "n") + texts, of(WORDS, "kinds") + (texts > 0), texts, ids[o], n[o], rank[o], klass[o], inside[o], others, spell)


def classes_of(ids: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Class of each word, given by falling count."""
    klass = np.arange(len(ids))
    tail = klass[HEAD:]
    if len(tail):
        by_place = tail[np.lexsort((ids[tail], place[tail]))]
        mass = np.cumsum(n[by_place])
        klass[by_place] = HEAD + np.minimum(TAIL - 1, (mass - n[by_place]) * TAIL // mass[-1])
    return klass


def byte_model(orders: list[tuple[np.ndarray, np.ndarray]]) -> list:
    """Per order: sequences and counts, and of their contexts the sums and the numbers of followers.

    ``orders[k]`` holds sequences of k symbols of context and one more, with their counts.
    """
    out = []
    for keys, n in orders:
        grams, total = _added([(keys, n)])
        contexts, sums = _added([(grams >> 9, total)])
        out.append((grams, total, contexts, sums, _added([(grams >> 9, np.ones(len(grams), np.int64))])[1]))
    return out


def byte_counts(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The most frequent byte sequences of each order, counted from all sequences: what a longer
    order leaves out is still in the shorter ones."""
    rows = counts.where(F.col("kind") == BYTES)
    out = []
    for order in range(ORDER + 1):
        cut_down = rows.groupBy(F.col("id").bitwiseAND(F.lit((1 << 9 * (order + 1)) - 1)).alias("id")).agg(F.sum("n").alias("n"))
        keys, n = _most(cut_down, LISTED)
        out.append((keys.view(np.int64), n))
    return out


def read_units(v: Vocabulary, counts: DataFrame) -> Vocabulary:
    """Adds the byte model and the priors of the classes."""
    v.bytes_ = byte_model(byte_counts(counts))
    got = counts.where(F.col("kind") == PAIRS).select("id", "n").toArrow()  # at most inputs x classes rows
    pairs = np.zeros(N_INPUTS * CLASSES)
    pairs[got.column("id").to_numpy()] = got.column("n").to_numpy()
    pairs = pairs.reshape(N_INPUTS, CLASSES)
    overall = pairs.sum(axis=0) + 0.5
    pairs += np.maximum(1.0, SMOOTH * (pairs > 0).sum(axis=1, keepdims=True)) * overall / overall.sum()
    v.prior = np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32)
    return v


def _blocked(v: Vocabulary, c: Cut, ends: np.ndarray, learning: bool = False, kinds_of=None):
    """Texts as rows of BLOCK tokens: inputs, target classes, log10 inside the class, is a class to be
    predicted, is it a text's first block; the text of each block; byte sequences and their words."""
    ids, klass, share, per_word, keys, word = v.units(c, learning, kinds_of)
    ends = np.concatenate([[0], np.cumsum(per_word)])[ends]
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts + 1  # with the end
    rows = (n + A.BLOCK - 1) // A.BLOCK
    at_row = np.cumsum(rows) - rows
    size = int(rows.sum()) * A.BLOCK
    inputs, targets = np.zeros(size + 1, np.int64), np.zeros(size, np.int64)
    inside, real = np.zeros(size), np.zeros(size, bool)
    base = at_row * A.BLOCK
    place = np.arange(len(ids)) + np.repeat(base - starts, ends - starts)
    targets[place], inside[place], real[place] = np.maximum(klass, 0), share, klass >= 0
    inputs[place + 1] = ids  # the input of a token is the unit before it; 0 is the start
    last = base + n - 1
    targets[last], real[last] = END_CLASS, True
    first = np.zeros(int(rows.sum()), bool)
    first[at_row] = True
    shape = (-1, A.BLOCK)
    return inputs[:-1].reshape(shape), targets.reshape(shape), inside.reshape(shape), real.reshape(shape), first, np.repeat(np.arange(len(ends)), rows), keys, word


def train_round(units: DataFrame, prior: np.ndarray, flat: np.ndarray, rate: float) -> np.ndarray:
    """One round: a copy per partition, averaged by tokens; all copies of a bucket are added in a stream."""
    shared = units.sparkSession.sparkContext.broadcast((prior, flat))

    def learn(batches):
        from pyspark import TaskContext

        _keep_memory()
        with one_blas_thread():
            prior, begin = shared.value
            p = A.unpack(begin, N_INPUTS, CLASSES, WIDTH)
            adam, tokens = A.Adam(p, rate), 0
            rng = np.random.default_rng(TaskContext.get().partitionId())
            for batch in batches:
                for raw in batch.column(0):
                    inputs, targets, real, first = unpack_units(raw.as_py())
                    window, masked = A.blocks(inputs, first)
                    order = rng.permutation(len(window))
                    for i in range(0, len(order), STEP_BLOCKS):
                        k = order[i : i + STEP_BLOCKS]
                        _, g = A.gradients(p, prior, window[k], masked[k], targets[k], real[k])
                        adam.step(p, g)
                        tokens += int(real[k].sum())
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([float(tokens)]), pa.array([(A.pack(p) * np.float64(tokens)).astype("<f8").tobytes()], pa.binary())], ["bucket", "tokens", "sums"]
                )

    def add(batches):
        tokens, sums = 0.0, None
        for batch in batches:
            for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens += n
                x = np.frombuffer(x, "<f8")
                sums = x.copy() if sums is None else sums + x
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([tokens]), pa.array([sums.tobytes()], pa.binary())], ["bucket", "tokens", "sums"])

    kind = "bucket int, tokens double, sums binary"
    copies = units.mapInArrow(learn, kind).repartition(64, "bucket").mapInArrow(add, kind).collect()  # at most 64 models
    if not copies:
        return flat
    return (sum(np.frombuffer(r["sums"], "<f8") for r in copies) / sum(r["tokens"] for r in copies)).astype(np.float32)


def _score(v: Vocabulary, p, made, c: Cut, ends, kinds_of=None):
    """log10 probability of every text of a slice but for the other words inside their class, and log10 of
    these by the byte model (0 for listed words)."""
    inputs, targets, inside, real, first, text, keys, word = _blocked(v, c, ends, False, kinds_of)
    window, masked = A.blocks(inputs, first)
    got = np.zeros(len(window))
    for i in range(0, len(window), _SCORE_BLOCKS):
        j = slice(i, i + _SCORE_BLOCKS)
        logs = A.log_probabilities(p, made, v.prior, window[j], masked[j], targets[j])
        got[j] = (logs / math.log(10) * real[j] + inside[j]).sum(axis=1)
    return np.bincount(text, got, len(ends)), np.bincount(word, v.spelled(keys), len(c.hashes))


_ROWS = "__key long, word long, n long, spelled double, tokens long, known long, base double, score double"


def score_rows(texts: DataFrame, v: Vocabulary, flat: np.ndarray) -> DataFrame:
    """Per text (word null): tokens, known and base of the listed words, score;
    per other word of it: its count and what the byte model says."""
    shared = texts.sparkSession.sparkContext.broadcast((v, flat))

    def run(batches):
        _keep_memory()
        with one_blas_thread():
            v, flat = shared.value
            p = A.unpack(flat, N_INPUTS, CLASSES, WIDTH)
            made = A.tables(p)
            for batch in batches:
                keys = batch.column(0).to_numpy()
                for i, j, c, ends in slices(binary_texts(batch.column(1))):
                    kinds, where, back = np.unique(c.hashes, return_index=True, return_inverse=True)
                    score, spelled = _score(v, p, made, c, ends, (kinds, back))
                    text = np.repeat(np.arange(j - i), np.diff(ends, prepend=0))
                    at, listed = _find(v.listed, kinds)
                    logs = np.zeros(len(kinds))
                    logs[listed] = np.log10(v.counts[at[listed]] + 0.1)
                    known = np.bincount(text, listed[back], j - i).astype(np.int64) + (v.texts > 0)
                    base = np.bincount(text, logs[back], j - i) + math.log10(v.texts + 0.1)
                    tokens = np.diff(np.concatenate([[0], ends])) + 1
                    m = j - i
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j]), none, none, pa.nulls(m, pa.float64()), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], _NAMES)
                    rare = np.flatnonzero(~listed[back])
                    if len(rare):
                        pair = text[rare].astype(np.int64) * len(kinds) + back[rare]
                        pair, n = np.unique(pair, return_counts=True)
                        m = len(pair)
                        none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i + pair // len(kinds)]), pa.array(kinds[pair % len(kinds)].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(spelled[where[pair % len(kinds)]]), *none], _NAMES)

    return written(texts.mapInArrow(run, _ROWS), "lm-scores")


_NAMES = ["__key", "word", "n", "spelled", "tokens", "known", "base", "score"]


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, share: int = SHARE, rate: float = RATE) -> DataFrame:
    """Append held_out, n_tokens, n_known, train_tokens, base_score and score (log10) to every row."""
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in df.columns if c.lower() not in added]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col), text)
    train = df.where(~held_out(id_col)).select(text.alias("__text"), F.pmod(F.xxhash64(F.lit(8), F.col(id_col)), F.lit(share)).alias("__part"))
    counts = count_words(train.select("__text"))
    v = read_words(counts)
    unit_counts, units = read_into_units(train, v)
    v = read_units(v, unit_counts)
    flat = A.pack(A.start(N_INPUTS, CLASSES, WIDTH))
    for k in range(rounds):
        flat = train_round(units.where(F.col("part") == k % share).select("units"), v.prior, flat, rate / (k + 1))

    rows = score_rows(df.select(key.alias("__key"), text.alias("__text")), v, flat)
    # Repeated rows have one key, and each sent the same values.
    first = [F.first(c).alias(c) for c in ("tokens", "known", "base", "score")]
    texts = rows.where("word is null").groupBy("__key").agg(F.count("*").alias("copies"), *first)
    rare = rows.where("word is not null").select("__key", "word", "n", "spelled")
    words = counts.where(F.col("kind") == WORDS).select(F.col("id").alias("word"), F.col("n").alias("c"))
    c = F.coalesce(F.col("c"), F.lit(0))
    inside = F.log10((1 - v.spell) * c / max(1, v.others) + F.pow(F.lit(10.0), "spelled") * v.spell + 1e-300)
    rare = rare.join(words, "word", "left").groupBy("__key").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(c + 0.1)).alias("more_base"), F.sum(F.col("n") * inside).alias("more_score")
    )
    per_text = texts.join(rare, "__key", "left").select(
        F.col("__key").alias("__k"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce((F.col("more_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more_base") / F.col("copies"), F.lit(0.0)) - F.col("tokens") * math.log10(v.train_tokens + 0.1 * (v.distinct + 1))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("more_score") / F.col("copies"), F.lit(0.0))).alias("score"),
    )
    left = df.select(*rest, held_out(id_col).alias("held_out"), key.alias("__key"))
    return left.join(per_text, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")
