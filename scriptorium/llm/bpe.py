"""Operator 9: BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can be the last one
of the prefix's encoding.  The last tokens are found from left to right: all
vocabulary entries that end at a position come out of an Aho-Corasick automaton over
the vocabulary (the method's name says suffix automaton; both find the same entries,
and a compiled library has this one); the right one is the entry whose start has a last token that it
is compatible with.  Two neighbouring tokens are compatible if the merges that
made them would have happened before any merge across their border.  Following
the back-pointers from the full word emits the ids.

The vocabulary file is a BPE of words: text is brought to NFC, white space
becomes blanks, letters become lower case, the pattern of the file cuts words
and single symbols, and the last byte of a word carries the word-end mark.
Here the marked bytes are symbols of their own, so that the automaton sees one
plain string per word.  Pieces between ASCII blanks are independent of each
other, so ids are kept per distinct piece (in a bounded store per worker).

Defined results: a null text counts as empty (no ids, empty decoded text); rows
are independent, so repeated rows, ties and extra columns are passed through; an
input column with the name of an output column is replaced.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, binary_texts

#: Pieces and words kept in one half of a store; two halves alternate, so a task holds at most twice as many (some 50 MB).
STORE_PIECES, STORE_WORDS = 60_000, 60_000
_PAIRS_KEPT = 300_000
_LATIN = 0x180
_MARK = 0x1000  # shift of a character that carries the word-end mark


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class PrefixBpe:
    """Vocabulary, merge ranks and the automaton of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        # Only the file's normaliser and splitting pattern are taken from the library.
        self.parts = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.merge: dict[tuple[int, int], int] = {}  # pair -> rank
        self.rank: dict[int, int] = {}  # token -> rank of the merge that makes it
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"] if not isinstance(model["merges"][0], str) else [m.split(" ") for m in model["merges"]]):
            pair = vocab[a], vocab[b]
            token = vocab[a + b]
            self.merge[pair] = r
            if token not in self.rank:
                self.rank[token] = r
                self.halves[token] = pair
        self.fits: dict[int, bool] = {}
        whole = self._whole_tokens()
        self.automaton = ahocorasick.Automaton()
        for t in whole:
            s = self._symbols(self.names[t])
            self.automaton.add_word(s, (t, len(s)))
        self.automaton.make_automaton()
        self.ascii_word = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        # Below _LATIN no character combines with another, and lower case stays there, one for one (but for U+0130).
        kinds = {k: "".join(chr(c) for c in range(0x80, _LATIN) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.latin_word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{kinds['L']}]+|[0-9{kinds['N']}]|[^\sa-z0-9{kinds['L']}{kinds['N']}]+")
        self.as_letters = {b: ord(x) for b, x in enumerate(self.letters)}

    def _symbols(self, token: str) -> str:
        """A vocabulary entry as symbols: the word-end mark moves into the last character."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _MARK)
        return token

    def _whole_tokens(self) -> list[int]:
        """Entries that are encoded as themselves, found in the order of their merges."""
        whole = {t for t in self.names if t not in self.rank and t not in self.specials.values()}
        for t in sorted(self.rank, key=self.rank.get):
            a, b = self.halves[t]
            if a in whole and b in whole and self.compatible(a, b, self.rank[t]):
                whole.add(t)
        return sorted(whole)

    def compatible(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Do ``left`` and ``right`` stay apart when the merges below rank ``until`` have been made?

        Goes back in time along the tokens at the border: the younger of the
        two is undone first, of two with the same rank the right one (merges of
        a rank are made from left to right).  A merge across the border that is
        due before either side was consumed by its own parent parts them wrongly.
        """
        left_end = right_end = until
        while True:
            r = self.merge.get((left, right))
            if r is not None and r < left_end and (r < right_end or r == right_end != until):
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left_end, left = a, self.halves[left][1]
            else:
                right_end, right = b, self.halves[right][0]

    def encode_symbols(self, s: str) -> list[int]:
        """Ids of one word: the unique last token of every prefix, then the back-pointers."""
        n = len(s)
        last: list = [None] * (n + 1)
        size = [0] * (n + 1)
        fits, known = self.fits, self.fits.get
        for end, (token, length) in self.automaton.iter(s):
            end += 1
            if last[end] is not None:
                continue
            if end != length:
                before = last[end - length]
                if before is None:
                    continue
                key = before << 20 | token
                ok = known(key)
                if ok is None:
                    ok = fits[key] = self.compatible(before, token)
                if not ok:
                    continue
            last[end] = token
            size[end] = length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        return ids

    def words(self, piece: str) -> list[str]:
        """Words of a piece in byte letters, with the mark in the last one."""
        if piece.isascii():
            found = self.ascii_word.findall(piece.lower())
            return [w[:-1] + chr(ord(w[-1]) + _MARK) if w.isprintable() else self._marked(w.encode()) for w in found]
        if max(piece) < chr(_LATIN) and "\u0130" not in piece:
            return [self._marked(w.encode()) for w in self.latin_word.findall(piece.lower())]
        normal = self.parts.normalizer.normalize_str(piece)
        return [w[:-1] + chr(ord(w[-1]) + _MARK) for w, _ in self.parts.pre_tokenizer.pre_tokenize_str(normal)]

    def _marked(self, raw: bytes) -> str:
        w = raw.decode("latin-1").translate(self.as_letters)
        return w[:-1] + chr(ord(w[-1]) + _MARK)

    def piece_words(self, raw: bytes) -> list[str]:
        """Words and special tokens of a text without ASCII blanks."""
        piece = raw.decode("utf-8", "replace")
        if not (self.split_specials and "<|" in piece):
            return self.words(piece)
        found: list[str] = []
        for run in self.split_specials.split(piece):
            found += [run] if run in self.specials else self.words(run) if run else []
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one of ``piece_words``."""
        if word in self.specials:
            return [self.specials[word]]
        if len(self.fits) > _PAIRS_KEPT:
            self.fits.clear()
        return self.encode_symbols(word)

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of a text without ASCII blanks."""
        return [i for w in self.piece_words(raw) for i in self.encode_word(w)]

    def decode(self, ids) -> str:
        """Token strings with blanks between them: the file names no decoder."""
        return " ".join(self.names[i] for i in ids)


class _Kept(dict):
    """key -> (packed ids, decoded text and a blank), made by ``make``; refilled from the older half of the store."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)  # the half before that is dropped
            self.clear()


class Store(_Kept):
    """Results of pieces, made of the results of their words: a word comes with many marks and in many cases."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__(self._piece, STORE_PIECES)
        self.bpe, self.words = bpe, _Kept(self._word, STORE_WORDS)

    def _word(self, word: str):
        ids = self.bpe.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), (self.bpe.decode(ids) + " ").encode() if ids else b""

    def _piece(self, raw: bytes):
        kept = self.words
        found = [kept[w] for w in self.bpe.piece_words(raw)]
        if len(found) == 1:
            return found[0]
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def turn(self) -> None:
        super().turn()
        self.words.turn()


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_text(raw: bytes, store: Store) -> tuple[bytes, bytes]:
    """Packed ids (little-endian unsigned 32 bit) and decoded text of one text."""
    pieces = raw.split()
    if len(pieces) > 100_000:  # a very long text: the store turns over between slices
        parts = [encode_text(b" ".join(pieces[i : i + 100_000]), store) for i in range(0, len(pieces), 100_000)]
        return b"".join(p[0] for p in parts), b" ".join(p[1] for p in parts if p[0])
    found = [store[p] for p in pieces]
    store.turn()
    return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])[:-1]


def bpe_encode_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded", packed: bool = True) -> DataFrame:
    """Append the ids of every whole text and the text they decode to.

    ``packed``: ids as one binary value of little-endian unsigned 32-bit
    integers (4 bytes a token); otherwise ``array<bigint>``.
    """

    stores: list[Store] = []  # of the task, empty where it begins

    def encode(batch):
        if not stores:
            stores.append(Store(load(tokenizer_path)))
        store = stores[0]
        made = [encode_text(x, store) for x in binary_texts(batch.column(text_col))]
        if packed:
            ids = pa.array([m[0] for m in made], pa.binary())
        else:
            ends = np.cumsum([0] + [len(m[0]) // 4 for m in made])
            flat = np.frombuffer(b"".join(m[0] for m in made), "<u4").astype("int64")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return [ids, pa.array([m[1] for m in made], pa.binary()).cast(pa.string())]

    kind = T.BinaryType() if packed else T.ArrayType(T.LongType())
    return append_columns(df, [T.StructField(ids_col, kind), T.StructField(decoded_col, T.StringType())], encode, done=stores.clear)
