"""Column -> Column text helpers (P1, P11, P12, P13, word counts).

Python's ``str.split()`` / ``str.strip()`` treat every character for which
``str.isspace()`` holds as whitespace; Java's ``\\s`` and Spark's ``trim`` do
not.  The rule used everywhere here: ``translate`` every such character to a
blank (one pass, no regex), then work with plain blanks only.  The set is
derived from the Unicode database by the same rule Python applies, so it needs
no hand-kept list.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python's str.split() breaks on (29 characters).
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
# Same set without the newline, for paragraph-preserving normalisation.
WHITESPACE_NO_NL = WHITESPACE.replace("\n", "")

# Unicode decimal digits, like Python's re ``\d`` on str patterns.
DIGIT_RUN = r"\p{Nd}+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_whitespace(c, keep_newline: bool = False) -> Column:
    """Map every Unicode whitespace character to a plain blank."""
    chars = WHITESPACE_NO_NL if keep_newline else WHITESPACE
    return F.translate(_col(c), chars, " " * len(chars))


def collapse_ws(c) -> Column:
    """``" ".join(s.split())``. NULL in, NULL out."""
    return F.trim(F.regexp_replace(blank_whitespace(c), " {2,}", " "))


def _character_class(chars: str) -> str:
    """Regex class of ``chars``: those of one byte by name, which makes a bit set, the others behind one range check."""
    near, far = (sorted(c for c in chars if (ord(c) < 256) == here) for here in (True, False))
    return "[" + "".join(f"\\x{ord(c):02x}" for c in near) + f"[\\u{ord(far[0]):04x}-\\u{ord(far[-1]):04x}&&[" + "".join(f"\\u{ord(c):04x}" for c in far) + "]]]"


_WHITESPACE_RUN = _character_class(WHITESPACE) + "+"


def tokenise_ws(c) -> Column:
    """Whitespace tokens as ``array<string>``; empty text -> empty array."""
    # one pass; only the edges of the text can leave empty parts
    return F.array_remove(F.split(_col(c), _WHITESPACE_RUN, -1), "")


def word_count(c) -> Column:
    """``len(s.split())`` without building the collapsed string."""
    trimmed = F.trim(blank_whitespace(c))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " +", -1)))


def word_count_blanks(c) -> Column:
    """Word count for text that is already collapsed (single blanks / newlines)."""
    trimmed = F.trim(_col(c), F.lit(" \n"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \n]+", -1)))


def digit_runs(c) -> Column:
    """Number of maximal runs of Unicode decimal digits."""
    return F.regexp_count(_col(c), F.lit(DIGIT_RUN))


def affix_any(c, patterns) -> Column:
    """Text starts or ends with any of the patterns."""
    c = _col(c)
    return reduce(lambda a, b: a | b, [c.startswith(p) | c.endswith(p) for p in patterns])


def safe_ratio(a, b) -> Column:
    """``a / b``, 0 when ``b`` is 0."""
    a, b = _col(a), _col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn`` as a lambda variable.

    Catalyst inlines a projected column into the expression that uses it when
    it is referenced once - even if that one reference sits inside a lambda
    body that runs once per array element, which turns an O(n) array into
    O(n^2) work.  Binding it as the element of a one-element array fixes the
    evaluation count at one.
    """
    return F.get(F.transform(F.array(value), fn), 0)


def seeded_uniform(seed, *keys) -> Column:
    """Uniform number in [0, 1) from ``md5(seed|key...)``: first 8 hex digits / 2^32.

    Deterministic, identical in any engine with md5, and independent of
    partitioning, so it replaces library RNG state for shuffles, splits and
    masking.
    """
    return F.conv(F.substring(seeded_digest(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def seeded_digest(seed, *keys) -> Column:
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit("|"), _col(k).cast("string")]
    return F.md5(F.concat(*parts))


def explode_rows(df, array_col, out: str, pos: str | None = None, keep=None):
    """Explode an array column into rows without the inferred pre-filter.

    Plain ``explode`` lets Catalyst infer ``size(arr) > 0`` and push it below
    the projections that compute ``arr``, inlining (and re-running) that whole
    computation inside the filter.  The ``_outer`` form infers nothing; empty
    and NULL arrays are dropped right after instead.
    """
    keep = [c for c in df.columns if c != array_col] if keep is None else list(keep)
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array_col).alias(out))
    else:
        rows = df.select(*keep, F.posexplode_outer(array_col).alias(pos, out))
        rows = rows.where(F.col(pos).isNotNull())
        return rows
    return rows.where(F.col(out).isNotNull())
