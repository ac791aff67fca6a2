"""Operator 2: license scans.

1. Every template is cut into word grams; winnowing keeps, of any ``window``
   neighbouring grams, the one with the smallest hash.  The kept ones form an inverted
   index gram -> (template, place).  The index is built from the list of templates
   that the caller hands over, not from a table.
2. All grams of a document are looked up.  Hits of one template that lie on nearby
   diagonals (document place - template place) form a candidate region, so a
   notice that shares ``gram + window - 1`` words in a row with the text is always looked at.
3. The template is aligned with the region inside a band around the first
   diagonal: +1 for an equal word, -1 for a substitution, a missing or an added
   word; of the best local alignments the one with most equal words is traced back.  It is reported if the equal words
   cover at least ``min_coverage`` of the template.

Words are runs of letters and digits, A-Z as a-z.  Documents are independent
of each other: nothing is shuffled, whatever their sources or copies.

Defined results: null and empty texts and an empty table give no rows; repeated
rows are each scanned and reported; a null id is kept; of alignments with as
many equal words the one that ends first is taken; other columns are not read.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts
from .licensetexts import TEMPLATES
from .tokenhash import LETTERS, batches_of_words, mix, word_hashes

GRAM = 3
WINDOW = 3
#: Largest distance of the band from its diagonal; a short template has a narrower one.
BAND = 24
MIN_COVERAGE = 0.8
_FACTORS = np.random.default_rng(4711).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    n = len(words) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total += words[k : k + n] * _FACTORS[k]
    return mix(total)


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the kept grams: the last smallest hash of every window; all if there are fewer grams."""
    n = len(hashes)
    if n <= window:
        return list(range(n))
    kept = set()
    for i in range(n - window + 1):
        part = hashes[i : i + window]
        kept.add(i + window - 1 - int(np.argmin(part[::-1])))
    return sorted(kept)


@dataclass
class Index:
    """Templates and the inverted index of their fingerprints, sorted by hash."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray
    gram: int

    @classmethod
    def of(cls, templates: dict[str, str], gram: int, window: int) -> Index:
        names = sorted(templates)
        words = [word_hashes(templates[n].encode()) for n in names]
        rows = []
        for t, w in enumerate(words):
            h = gram_hashes(w, gram)
            rows += [(int(h[p]), t, p) for p in winnow(h, window)]
        rows.sort()
        return cls(names, words, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), gram)

    def band(self, t: int) -> int:
        return min(BAND, max(1, len(self.words[t]) // 4))

    def hits(self, words: np.ndarray):
        """(document place, template, template place) of every fingerprint found."""
        h = gram_hashes(words, self.gram)
        lo = np.searchsorted(self.hashes, h)
        there = (lo < len(self.hashes)) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h) if len(self.hashes) else np.zeros(len(h), bool)
        at = np.flatnonzero(there)
        hi = np.searchsorted(self.hashes, h[at], side="right")
        n = hi - lo[at]
        k = np.repeat(lo[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.template[k], self.place[k]


def regions(index: Index, words: np.ndarray) -> list[tuple[int, int, int]]:
    """(template, diagonal, last document place) of the candidate regions of a document."""
    at, template, place = index.hits(words)
    out = []
    for t in np.unique(template):
        mine = template == t
        band, size = index.band(t), len(index.words[t])
        open_: list[list[int]] = []  # [first diagonal, last place]
        for a, d in sorted(zip(at[mine].tolist(), (at[mine] - place[mine]).tolist(), strict=True)):
            open_, ended = [r for r in open_ if a - r[1] <= size], [r for r in open_ if a - r[1] > size]
            out += [(int(t), r[0], r[1]) for r in ended]
            for r in open_:
                if abs(r[0] - d) <= band:
                    r[1] = a
                    break
            else:
                open_.append([d, a])
        out += [(int(t), r[0], r[1]) for r in open_]
    return out


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int):
    """Best local alignment inside the band: (equal words, first and last document word), or None."""
    m, n = len(template), len(words)
    width = 2 * band + 1
    # A value holds the score and, below it, the equal words: the larger one wins on both.
    one, never = 1 << 20, -(1 << 50)
    value = np.zeros((m + 1, width + 2), np.int64)  # one column of margin on both sides
    step = np.zeros((m + 1, width + 2), np.int8)  # 0 start, 1 diagonal, 2 template word missing, 3 added word
    value[:, 0] = value[:, -1] = never
    best, where = 0, None
    gaps = np.arange(width) * one
    for i in range(1, m + 1):
        j = np.arange(diagonal + i - band, diagonal + i + band + 1)  # 1-based document word of each column
        inside = (j >= 1) & (j <= n)
        equal = np.zeros(width, bool)
        equal[inside] = words[j[inside] - 1] == template[i - 1]
        diag = np.where(inside, value[i - 1, 1:-1] + np.where(equal, one + 1, -one), never)
        up = np.where((j >= 0) & (j <= n), value[i - 1, 2:] - one, never)  # the column of i-1 is one further right
        row = np.maximum(np.maximum(diag, up), 0)
        # Added words: the best value to the left, less one for each column.
        row = np.where(inside, np.maximum.accumulate(row + gaps) - gaps, np.where(j == 0, 0, never))
        value[i, 1:-1] = row
        step[i, 1:-1] = np.where(row <= 0, 0, np.where(diag == row, 1, np.where(up == row, 2, 3)))
        k = int(np.argmax(row))
        if row[k] > best:
            best, where = int(row[k]), (i, k + 1)
    if where is None:
        return None
    i, k = where
    last = diagonal + i + (k - 1 - band) - 1
    equal, first = 0, last
    while i > 0 and step[i, k]:
        j = diagonal + i + (k - 1 - band)
        if step[i, k] == 1:
            equal += int(words[j - 1] == template[i - 1])
            first = j - 1
            i -= 1
        elif step[i, k] == 2:
            i, k = i - 1, k + 1
        else:
            first = j - 1
            k -= 1
    return equal, first, last


def closest(found: list[tuple], sizes: list[int]) -> list[bool]:
    """Of alignments (template, equal words, first, last) that share words, is each one the closest?

    They are taken by most equal words, then by coverage and template; one that shares a
    word with one taken before is not the closest there.
    """
    order = sorted(range(len(found)), key=lambda i: (-found[i][1], -found[i][1] / sizes[found[i][0]], found[i][0], found[i][2]))
    taken: list[tuple[int, int]] = []  # disjoint, sorted
    best = [False] * len(found)
    for i in order:
        _, _, a, b = found[i]
        k = bisect.bisect_left(taken, (a, b))
        if (k and taken[k - 1][1] >= a) or (k < len(taken) and taken[k][0] <= b):
            continue
        taken.insert(k, (a, b))
        best[i] = True
    return best


def scan_words(index: Index, words: np.ndarray, min_coverage: float):
    """(template, equal words, first, last) of the reported alignments, each span once."""
    found = {}
    for t, d, _ in regions(index, words):
        got = align(index.words[t], words, d, index.band(t))
        if got and got[0] >= min_coverage * len(index.words[t]):
            found[t, got[1], got[2]] = got[0]
    return sorted((t, e, a, b) for (t, a, b), e in found.items())


def _word_spans(raw: bytes, firsts: list[int], lasts: list[int]) -> list[tuple[int, int]]:
    """Character spans of runs of words."""
    inside = LETTERS[np.frombuffer(raw, np.uint8)] != 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    return [(len(raw[: starts[a]].decode("utf-8", "replace")), len(raw[: ends[b]].decode("utf-8", "replace"))) for a, b in zip(firsts, lasts, strict=True)]


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    gram: int = GRAM,
    window: int = WINDOW,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """(doc_id, license, start, stop, matched_words, template_words, coverage, closest): every notice found.

    Notices that share words (near-equal licences) are all returned; ``closest`` marks the one
    that fits best there.
    ``start`` and ``stop`` are 0-based character positions in the whole text.
    """
    index = Index.of(TEMPLATES if templates is None else templates, gram, window)

    def run(batches):
        for batch in batches:
            texts, ids = binary_texts(batch.column(1)), batch.column(0)
            out = [[] for _ in range(8)]
            for i0, words, ends in batches_of_words(texts):
                at, _, _ = index.hits(words)
                for k in np.unique(np.searchsorted(ends, at, side="right")).tolist():
                    own = words[ends[k - 1] if k else 0 : ends[k]]
                    found = scan_words(index, own, min_coverage)
                    if not found:
                        continue
                    spans = _word_spans(texts[i0 + k], [f[2] for f in found], [f[3] for f in found])
                    best = closest(found, [len(w) for w in index.words])
                    for (t, equal, _, _), (a, b), own_best in zip(found, spans, best, strict=True):
                        n = len(index.words[t])
                        for o, v in zip(out, (i0 + k, index.names[t], a, b, equal, n, equal / n, own_best), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.string()), *[pa.array(o, pa.int64()) for o in out[2:6]], pa.array(out[6], pa.float64()), pa.array(out[7], pa.bool_())],
                ["doc_id", "license", "start", "stop", "matched_words", "template_words", "coverage", "closest"],
            )

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, license string, start long, stop long, matched_words long, template_words long, coverage double, closest boolean")
