"""Token sequences as numbers: the hashed words of many sequences in one row, for a linear model that reads them again and again.

The features of a token are its word, the one before and the one after (``w=``, ``p=``, ``n=``), hashed
as ``HashingTF`` does.  Each distinct word of a group of sequences is hashed once; a token is a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, checkpoint

#: Tokens of a group, which shares a list of words, and of a piece, whose own words stay in a core's cache.
GROUP, PIECE = 1 << 22, 1 << 14
#: Bytes of a word that are hashed together with those of the others.
_SHORT = 256
ROLES = "wpn"
#: Words that stand for the place between two sequences and for a missing word.
BETWEEN, MISSING = 0, 1
_SEED = 42


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)


def _stepped(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = h ^ _mixed(k)
    return (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)


def _finished(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = h ^ sizes.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def _long_hash(raw: bytes) -> int:
    h, low = _SEED, 0xFFFFFFFF
    whole = len(raw) // 4
    for k in np.frombuffer(raw, "<u4", whole).tolist():
        k = k * 0xCC9E2D51 & low
        h ^= (k << 15 | k >> 17) * 0x1B873593 & low
        h = ((h << 13 | h >> 19) & low) * 5 + 0xE6546B64 & low
    k = int.from_bytes(raw[4 * whole :], "little") * 0xCC9E2D51 & low
    h ^= ((k << 15 | k >> 17) & low) * 0x1B873593 & low
    return int(_finished(np.array([h], np.uint32), np.array([len(raw)]))[0])


def hashed(words: pa.Array, features: int) -> np.ndarray:
    """(words, roles): ``HashingTF``'s place of ``w=``, ``p=`` and ``n=`` and each word (Murmur3 of its UTF-8 bytes)."""
    if not len(words):
        return np.zeros((0, len(ROLES)), np.int32)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends) + 2
    found = np.zeros((len(words), len(ROLES)), np.uint32)
    order = np.argsort(-sizes, kind="stable")  # long ones first: those that have a block are the first ones
    order = order[np.searchsorted(-sizes[order], -_SHORT) :]
    short = sizes[order]
    first = np.cumsum((short + 3) // 4) - (short + 3) // 4
    flat = np.zeros(int(((short + 3) // 4).sum()) * 4, np.uint8)
    inside = np.arange(int((short - 2).sum())) - np.repeat(np.cumsum(short - 2) - (short - 2), short - 2)
    flat[np.repeat(first * 4 + 2, short - 2) + inside] = raw[np.repeat(ends[order] - ends[0], short - 2) + inside]
    flat[first * 4 + 1] = ord("=")
    blocks, whole = flat.view("<u4"), short // 4
    for r, role in enumerate(ROLES):
        flat[first * 4] = ord(role)
        h = np.full(len(short), _SEED, np.uint32)
        for j in range(whole.max(initial=0)):
            n = np.searchsorted(-whole, -j)  # words of more than j whole blocks
            h[:n] = _stepped(h[:n], blocks[first[:n] + j])
        tail = np.flatnonzero(short % 4)
        h[tail] ^= _mixed(blocks[first[tail] + whole[tail]])
        found[order, r] = _finished(h, short)
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        word = raw[ends[i] - ends[0] : ends[i + 1] - ends[0]].tobytes()
        found[i] = [_long_hash(f"{role}=".encode() + word) for role in ROLES]
    return _folded(found, features)


def _folded(h: np.ndarray, features: int) -> np.ndarray:
    return np.mod(h.astype(np.uint32).view(np.int32).astype(np.int64), features).astype(np.int32)


def vocabulary(words: pa.Array, features: int) -> np.ndarray:
    """``hashed``, after the rows of ``BETWEEN`` and ``MISSING``: no word is there, and its neighbours are at an edge."""
    edge = hashed(pa.array(["<s>", "</s>"]), features)
    none = [int(_folded(np.array([_SEED]), features)[0]), edge[0, 1], edge[1, 2]]
    return np.concatenate([np.array([none, none], np.int32), hashed(words, features)])


def places(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def line_up(words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sequences one after the other, with ``BETWEEN`` around each: word numbers, first place of each, words from number 2 on."""
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    line = np.full(1 + int((sizes + 1).sum()), MISSING, np.int32)
    line[0] = BETWEEN
    line[starts + sizes] = BETWEEN
    coded = words.flatten().dictionary_encode()
    line[places(lengths(words), starts)] = pc.fill_null(coded.indices, MISSING - 2).to_numpy(zero_copy_only=False) + 2
    return line, starts, coded.dictionary


GROUPS = "words binary, line binary, own binary, sizes binary, tags binary, names array<string>, seen binary, moves binary"


def _lists(batches: list[pa.RecordBatch], column: int) -> pa.Array:
    return pa.concat_arrays([b.column(column) for b in batches])


def _group(batches: list[pa.RecordBatch], features: int) -> pa.RecordBatch:
    words, tags = _lists(batches, 0), _lists(batches, 1)
    coded = tags.flatten().dictionary_encode()
    names, of = coded.dictionary, pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    # pairs of tags; what comes before the first one has the last number
    counted = lengths(tags)
    before = np.concatenate([[0], of[:-1]]) if len(of) else of
    before[(np.cumsum(counted) - counted)[counted > 0]] = len(names) + 1
    pairs = np.bincount(before * (len(names) + 1) + of, minlength=(len(names) + 2) * (len(names) + 1)).reshape(len(names) + 2, -1)
    moves = np.delete(pairs, len(names), axis=0)[:, : len(names)]
    # a sequence has a token for each word or tag, whichever are more, if it has both
    both = np.asarray(pc.and_(words.is_valid(), tags.is_valid()).to_numpy(zero_copy_only=False), bool)
    of = of[np.repeat(both, counted)]
    words, counted = words.filter(pa.array(both)), counted[both]
    sizes = np.maximum(lengths(words), counted)
    line, starts, found = line_up(words, sizes)
    tag = np.full(len(line), len(names), np.int16)
    tag[places(counted, starts)] = of
    tag[line == BETWEEN] = -1
    pieces = [np.unique(line[s - 1 : min(s + PIECE, len(line) - 1) + 1], return_inverse=True) for s in range(1, len(line) - 1, PIECE)]
    own = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, np.int32)
    codes = np.concatenate([p[1].astype(np.uint16) for p in pieces]) if pieces else np.zeros(0, np.uint16)
    row = [vocabulary(found, features), codes, own, np.array([len(p[0]) for p in pieces], np.int32), tag]
    binary = [pa.array([x.tobytes()], pa.binary()) for x in row]
    seen = np.bincount(tag[tag >= 0], minlength=len(names) + 1)[: len(names)]
    end = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (seen, moves)]
    return pa.RecordBatch.from_arrays([*binary, pa.array([names.to_pylist()], pa.list_(pa.string())), *end], [c.split()[0] for c in GROUPS.split(", ")])


def _grouped(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(0).flatten()) + batch.num_rows
            if size >= GROUP:
                yield _group(held, features)
                held, size = [], 0
        if held:
            yield _group(held, features)

    return run


def token_groups(df: DataFrame, tokens: str, tags: str, features: int) -> DataFrame:
    """Groups of tagged sequences as numbers, stored (each row some megabytes)."""
    bound_batches(df.sparkSession)
    rows = df.select(F.transform(tokens, F.lower).alias("w"), F.col(tags).alias("t"))
    return checkpoint(rows.mapInArrow(_grouped(features), GROUPS))


def pieces_of(batch: pa.RecordBatch, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The group's own numbers of the words of each piece, and its places by them: one more at both ends than it has tokens."""
    own, sizes, line = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("own", np.int32), ("sizes", np.int32), ("line", np.uint16)))
    at = done = 0
    for k, n in enumerate(sizes.tolist()):
        last = len(line) if k + 1 == len(sizes) else done + PIECE + 2
        yield own[at : at + n], line[done:last]
        at, done = at + n, last
