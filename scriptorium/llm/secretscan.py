"""Operator 13: secret scans by a linear-chain conditional random field.

Base patterns find assignments, access keys and long hexadecimal strings.  They are
also the weak labels of a random field (``crf``) that tags tokens as begin,
inside or outside of a secret and is decoded by Viterbi: so secrets are found
that no pattern fits.  Its features are the token's shape (length, kinds of
characters, changes between them), its word and those of its neighbours, their shapes, whether
they touch it, and how many digits and symbols the file holds.

Training takes windows around the secrets, around long tokens that are none, and at
any place, from ``SAMPLE_ROWS`` rows at most in expectation (those with the
smallest digests of their ids) and at most ``WINDOWS`` windows of each kind.  Half of the secrets
are replaced by random ones of other alphabets, and a copy of every window loses its
neighbouring words, so that neither alone decides.

Scanning is map only.  Tokens, shapes and scores of a slice of texts are made in
numpy; tokens that are outside on every best path part the sequences, and
only the others go through the dynamic programme.

Defined results: a null text counts as empty (no spans); positions are code
points, ends exclusive; tagged spans that overlap a base span are left out, base ones
always stay; rows are independent, so repeated rows and ties change nothing; a
table without any secret trains no field and gets base spans only; in texts over
``PIECE`` bytes the field sees pieces with ``MARGIN`` bytes of context on either side (the
patterns see the whole text); an empty table gives an empty one; an input column
with the name of the output column is replaced.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, binary_texts, one_blas_thread
from .crf import BEGIN, IN, Crf

KINDS = ["assign", "access", "hex", "tagged"]
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Fewest characters of a tagged span.
MIN_TAGGED = 8
#: Rows that training looks at (in expectation), and windows of each kind it takes.
SAMPLE_ROWS, WINDOWS = 60_000, 1_000  # Spark limits each task's rows to the windows while these are 1,000 at most
#: Longer texts are tagged in pieces with a margin.
PIECE, MARGIN = 4_000_000, 65_536

# Kinds of bytes: blank, a-f, other lower case, upper case, digit, underscore, non-ASCII, symbol.
_KIND = np.full(256, 7, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32, 0]] = 0
_KIND[97:103], _KIND[103:123], _KIND[65:91], _KIND[48:58], _KIND[95], _KIND[128:] = 1, 2, 3, 4, 5, 6
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_LENGTHS = np.array([2, 4, 8, 12, 16, 24, 32])
_SHARES = np.array([1, 2, 4, 8, 16, 32, 64])
_SHAPES, _WORD_SLOTS = 1024 + 128 + 1, 4096 + 128 + 8 + 1
#: shape; own word; words 1, 2, 3 before and 1 after; shapes before and after; touching; file.
SIZES = [_SHAPES, _WORD_SLOTS, _WORD_SLOTS, _WORD_SLOTS, _WORD_SLOTS, _WORD_SLOTS, _SHAPES, _SHAPES, 4, 64]
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def base_spans(raw: bytes, may_hex: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in bytes, in order."""
    found = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if may_hex:
        found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(raw)]
    return sorted(found)


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, factor in enumerate((_FACTOR, _INVERSE)):
            p = np.full(n, factor, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


class Tokens:
    """Tokens of a slice of texts: runs of word characters, and single symbols; with their features."""

    def __init__(self, texts: list[bytes], file_of: np.ndarray | None = None):
        raw = b" " + b" ".join(texts) + b" "
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        new = np.ones(len(kind), bool)
        word = (kind > 0) & (kind < 7)
        new[1:] = ~(word[1:] & word[:-1]) & ((kind[1:] > 0) | (kind[:-1] > 0))
        edge = np.append(np.flatnonzero(new), len(kind))
        keep = kind[edge[:-1]] > 0
        self.start, self.end = edge[:-1][keep], edge[1:][keep]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(np.append(1, sizes[:-1] + 1)) if len(texts) else np.array([], np.int64)
        self.ends = np.searchsorted(self.start, self.text_start + sizes)  # tokens before the end of each text
        self.text_of = np.searchsorted(self.ends, np.arange(len(self.start)), "right")

        sums = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (1, 2, 3, 4, 6, 7)]
        n_hex, n_lower, n_upper, n_digit, n_wide, n_symbol = (c[self.end] - c[self.start] for c in sums)
        change = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
        switches = change[self.end - 1] - change[self.start]
        size = self.end - self.start
        length = np.searchsorted(_LENGTHS, size, "right")
        mask = (n_digit > 0) * 1 + (n_hex + n_lower > 0) * 2 + (n_upper > 0) * 4 + (n_wide > 0) * 8
        symbol = n_symbol > 0
        code = data[self.start].astype(np.int64) & 127
        shape = np.where(symbol, 1024 + code, ((length * 16 + mask) * 2 + (n_hex + n_digit == size)) * 4 + np.searchsorted([1, 2, 4], switches, "right"))
        to, fro = _power(len(data) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOW[data] * to[: len(data)], dtype=np.uint64)])
        slot = ((prefix[self.end] - prefix[self.start]) * fro[self.start] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)
        words = np.where(symbol, 4096 + code, np.where((n_digit > 0) | (size > 24), 4224 + length, slot.astype(np.int64)))
        if file_of is None:
            stop = self.text_start + sizes
            share = [(c[stop] - c[self.text_start]) * 256 // np.maximum(1, sizes) for c in (sums[3], sums[5])]
            file_of = np.searchsorted(_SHARES, share[0], "right") * 8 + np.searchsorted(_SHARES, share[1], "right")
        self.file_of = file_of
        self.hex_texts = self._hex_texts(sums, sizes)

        def beside(values, by, none):
            out = np.full(len(values), none)
            if by < 0:
                out[-by:] = values[:by]
                out[-by:][self.text_of[-by:] != self.text_of[:by]] = none
            else:
                out[:-by] = values[by:]
                out[:-by][self.text_of[by:] != self.text_of[:-by]] = none
            return out

        touch = np.zeros(len(size), np.int64)
        if len(size):
            glued = self.end[:-1] == self.start[1:]
            touch[1:] += glued
            touch[:-1] += 2 * glued
        none = _WORD_SLOTS - 1
        n = len(size)
        self.features = [
            shape, words, *[beside(words, -k, none) if n > k else np.full(n, none) for k in (1, 2, 3)], beside(words, 1, none) if n > 1 else np.full(n, none),
            beside(shape, -1, _SHAPES - 1) if n > 1 else np.full(n, _SHAPES - 1), beside(shape, 1, _SHAPES - 1) if n > 1 else np.full(n, _SHAPES - 1), touch, file_of[self.text_of] if n else touch,
        ]

    def _hex_texts(self, sums, sizes) -> set[int]:
        """Texts that hold 24 hexadecimal digits in a row."""
        both = sums[0] + sums[3]
        hits = np.flatnonzero(both[24:] - both[:-24] == 24)
        return set((np.searchsorted(self.text_start, hits, "right") - 1).tolist())


def file_feature(raw: bytes) -> int:
    """The file feature of a text, as ``Tokens`` makes it."""
    return int(Tokens([raw]).file_of[0])


def _tagged(model: Crf, tokens: Tokens) -> dict[int, list[tuple[int, int]]]:
    """text -> spans in bytes that the field tags."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in model.decode(tokens.features, tokens.ends):
        k = int(tokens.text_of[a])
        begin = int(tokens.text_start[k])
        out.setdefault(k, []).append((int(tokens.start[a]) - begin, int(tokens.end[b - 1]) - begin))
    return out


def _tagged_long(model: Crf, raw: bytes) -> list[tuple[int, int]]:
    file_of = np.array([file_feature(raw[:PIECE])])
    spans, cut = [], 0
    while cut < len(raw):
        end = cut + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        begin = max(0, cut - MARGIN)
        tokens = Tokens([raw[begin : end + MARGIN]], file_of)
        spans += [(a + begin, b + begin) for a, b in _tagged(model, tokens).get(0, []) if cut <= a + begin < end]
        cut = end
    return spans


def _code_points(raw: bytes, spans) -> list[dict]:
    """Byte spans (start, kind, end) as code points, in one pass over the text."""
    if raw.isascii():
        place = None
    else:
        place, at, n = {}, 0, 0
        for p in sorted({s[0] for s in spans} | {s[2] for s in spans}):
            n += len(raw[at:p].decode("utf-8", "replace"))
            place[p], at = n, p
    return [{"kind": KINDS[k], "start": place[a] if place else a, "end": place[b] if place else b} for a, k, b in spans]


def scan_texts(texts: list[bytes], model: Crf | None) -> list[list[dict]]:
    """Secrets of each text: kind, start, end in order of start and kind."""
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    tokens = Tokens([texts[i] for i in short])
    tagged = _tagged(model, tokens) if model is not None else {}
    out: list[list[dict]] = [[] for _ in texts]
    place = {i: k for k, i in enumerate(short)}
    for i, raw in enumerate(texts):
        k = place.get(i)
        base = [s[:3] for s in base_spans(raw, k is None or k in tokens.hex_texts)]
        more = (_tagged_long(model, raw) if model is not None else []) if k is None else tagged.get(k, [])
        if more:
            more = [(a, 3, b) for a, b in more if b - a >= MIN_TAGGED]
            kept, taken = [], sorted(base)
            at = reach = 0
            for a, kind, b in sorted(more):  # base spans that begin before b, and how far they reach
                while at < len(taken) and taken[at][0] < b:
                    reach = max(reach, taken[at][2])
                    at += 1
                if reach <= a:
                    kept.append((a, kind, b))
            base = sorted(base + kept)
        if base:
            out[i] = _code_points(raw, base)
    return out


def _window(raw: bytes, a: int, b: int, around: int = 70) -> tuple[bytes, int]:
    """The text near a..b, cut at blanks, and its begin."""
    begin, end = max(0, a - around), min(len(raw), b + around)
    if begin and (i := raw.find(b" ", begin, a)) >= 0:
        begin = i + 1
    elif begin:
        begin = a
    if end < len(raw):
        end = i if (i := raw.rfind(b" ", b, end)) >= 0 else b
    return raw[begin:end], begin


_LONG = re.compile(rb"[A-Za-z0-9]*[0-9][A-Za-z0-9]{7,}")


def _sample_windows(batches):
    """At most one window of each kind from a text: (kind, digest, text, values, file)."""
    names = ["kind", "digest", "text", "values", "file"]
    for batch in batches:
        rows = []
        for digest, raw in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), strict=True):
            spans = base_spans(raw)
            rng = random.Random(digest)
            picks = []
            if spans:
                s = rng.choice(spans)
                picks.append((0, *s[3:5]))
            at = rng.randrange(len(raw) + 1)
            others = [m.span() for m in _LONG.finditer(raw, max(0, at - 20_000), at + 20_000)]
            others = [o for o in others if not any(s[0] < o[1] and o[0] < s[2] for s in spans)]
            if others:
                picks.append((1, *rng.choice(others)))
            if rng.random() < 0.1:
                picks.append((2, at, at))
            if not raw:
                continue
            file = file_feature(raw[:PIECE])
            for kind, a, b in picks:
                if b - a > 2_000:
                    continue
                text, begin = _window(raw, a, b)
                values = [(s[3] - begin, s[4] - begin) for s in spans if s[3] >= begin and s[4] <= begin + len(text)]
                rows.append((kind, digest, text, np.array(values, np.int32).tobytes(), file))
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_ALPHABETS = [
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
]


def _example(text: bytes, values: list, file: int, rng: random.Random, replace: bool, blank: bool):
    """Features (tokens, tables) and tags of a window."""
    merged: list = []
    for a, b in sorted(values):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    out, spots, at = b"", [], 0
    for a, b in merged:
        value = "".join(rng.choices(rng.choice(_ALPHABETS), k=rng.randint(20, 64))).encode() if replace else text[a:b]
        out += text[at:a]
        spots.append((len(out), len(out) + len(value)))
        out += value
        at = b
    tokens = Tokens([out + text[at:]], np.array([file]))
    tags = np.zeros(len(tokens.start), np.int64)
    for a, b in spots:
        inside = np.flatnonzero((tokens.start - 1 >= a) & (tokens.end - 1 <= b))
        if len(inside):
            tags[inside] = IN
            tags[inside[0]] = BEGIN
    features = np.stack(tokens.features, axis=1) if len(tags) else np.zeros((0, len(SIZES)), np.int64)
    if blank:
        near = (tags > 0) | (rng.random() < 0.5)
        features[near, 2:6] = _WORD_SLOTS - 1
        if rng.random() < 0.5:
            features[near, 6:8], features[near, 8] = _SHAPES - 1, 0
    return features, tags


def training_set(rows, seed: int = 7, changed: bool = True):
    """Padded (features, tags, real) of sampled windows: as they are, and with ``changed`` in altered copies too."""
    rng = random.Random(seed)
    made = []
    for r in rows:
        values = np.frombuffer(bytes(r["values"]), np.int32).reshape(-1, 2).tolist()
        made.append(_example(bytes(r["text"]), values, r["file"], rng, False, False))
        if changed and values:
            made.append(_example(bytes(r["text"]), values, r["file"], rng, True, False))
        if changed:
            made.append(_example(bytes(r["text"]), values, r["file"], rng, rng.random() < 0.5, True))
    made = [(f[:120], t[:120]) for f, t in made if len(t)]
    if not made:
        return None
    length = max(len(t) for _, t in made)
    features, tags, real = np.zeros((len(made), length, len(SIZES)), np.int64), np.zeros((len(made), length), np.int64), np.zeros((len(made), length), bool)
    for i, (f, t) in enumerate(made):
        features[i, : len(t)], tags[i, : len(t)], real[i, : len(t)] = f, t, True
    return features, tags, real


def sample_windows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, windows: int = WINDOWS) -> list:
    """The windows that training uses, sorted by (kind, digest)."""
    total = df.count()
    digest = F.xxhash64(F.col(id_col).cast("string"), F.when(F.col(id_col).isNull(), F.col(text_col)))
    share = min(1.0, rows / max(1, total))
    picked = df.select(digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    if share < 1:
        picked = picked.where(F.col("digest") <= F.lit(int(-(2**63) + share * 2**64)))
    found = picked.mapInArrow(_sample_windows, "kind int, digest long, text binary, values binary, file int")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("digest", "text"))
    return sorted(found.withColumn("place", place).where(F.col("place") <= windows).collect(), key=lambda r: (r["kind"], r["place"]))


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, windows: int = WINDOWS, rounds: int = 60) -> Crf | None:
    """A random field fitted on the weak labels of a bounded sample; None where no row of it holds a secret."""
    found = sample_windows(df, text_col, id_col, rows, windows)
    if not any(r["kind"] == 0 for r in found):
        return None
    model = Crf(SIZES)
    with one_blas_thread():
        model.fit(*training_set(found), rounds=rounds)
    return model


def scan_secrets(df: DataFrame, model: Crf | None, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """Append ``secrets``: array of (kind, start, end), sorted by start, then kind as listed in ``KINDS``."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batch):
        return [pa.array(scan_texts(binary_texts(batch.column(text_col)), model), kind)]

    return append_columns(df, [T.StructField(out_col, T.ArrayType(span))], scan)
