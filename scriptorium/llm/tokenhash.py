"""Hashes of the words of many texts at once, for operators that compare words only."""

from __future__ import annotations

import numpy as np

_POWERS = 1 << 12


def _letters() -> np.ndarray:
    """Byte -> lower-case letter or digit; 0 for what separates words. Bytes of other alphabets stand for themselves."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isalnum():
            t[b] = ord(c.lower()) if b < 0x80 else b
    return t


LETTERS = _letters()
_rng = np.random.default_rng(20240229)
_AT = _rng.integers(1, 1 << 62, _POWERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # odd factor per place in the word


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: runs of letters and digits, A-Z as a-z."""
    b = np.frombuffer(raw, np.uint8)
    v = LETTERS[b]
    inside = v != 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths  # of each word among the letters
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    return mix(np.add.reduceat(v[inside] * _AT[place & (_POWERS - 1)], begin) + lengths.astype(np.uint64))


def batches_of_words(texts: list[bytes], step: int = 1 << 20):
    """(first text, word hashes, ends by text) for runs of about ``step`` bytes; a long text is hashed in slices."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= step):
            size += len(texts[j]) + 1
            j += 1
        if size > 4 * step:
            words = _long(texts[i], step)
            yield i, words, np.array([len(words)])
        else:
            joined = b"\n".join(texts[i:j])
            words = word_hashes(joined)
            b = LETTERS[np.frombuffer(joined, np.uint8)] != 0
            first = np.diff(b, prepend=False).nonzero()[0]
            first = first[b[first]]
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            yield i, words, np.searchsorted(first, ends)
        i = j


def _long(raw: bytes, step: int) -> np.ndarray:
    parts, i = [], 0
    while i < len(raw):
        j = min(len(raw), i + step)
        while j < len(raw) and LETTERS[raw[j]]:  # never inside a word
            j += 1
        parts.append(word_hashes(raw[i:j]))
        i = j
    return np.concatenate(parts)
