"""DuckDB SQL fragments for the oracle queries.

The oracle side is written independently in SQL (DuckDB, RE2 regex, 1-based
lists) so a shared bug in a Python helper cannot make both sides agree.  These
helpers only spell recurring SQL snippets.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions.text import WHITESPACE, WHITESPACE_NO_NL

NL = "chr(10)"


def lit(s: str) -> str:
    """SQL string literal; newlines become chr(10) so the SQL stays one line per part."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(quoted) if len(quoted) > 1 else quoted[0]


def chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


WS = f"({chars(WHITESPACE)})"
WS_NO_NL = f"({chars(WHITESPACE_NO_NL)})"
BLANKS = f"repeat(' ', {len(WHITESPACE)})"
BLANKS_NO_NL = f"repeat(' ', {len(WHITESPACE_NO_NL)})"


def blank(x: str, keep_newline: bool = False) -> str:
    return f"translate({x}, {WS_NO_NL if keep_newline else WS}, {BLANKS_NO_NL if keep_newline else BLANKS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({blank(x)}, ' {{2,}}', ' ', 'g'), ' ')"


def words(x: str) -> str:
    """len(x.split()) for raw text."""
    t = f"trim({blank(x)}, ' ')"
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, ' +')) END)"


def words_blanks(x: str) -> str:
    t = f"trim({x}, ' ' || {NL})"
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '[ \\n]+')) END)"


def tokens(x: str) -> str:
    c = collapse(x)
    return f"(CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, ' ') END)"


def affix(x: str, patterns) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(p)}) OR ends_with({x}, {lit(p)})" for p in patterns) + ")"


def uniform(seed, *keys) -> str:
    return f"(('0x' || substr({digest(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0)"


def digest(seed, *keys) -> str:
    parts = [lit(str(seed))]
    for k in keys:
        parts += ["'|'", f"CAST({k} AS VARCHAR)"]
    return "md5(" + " || ".join(parts) + ")"


def articles_cte(src: str = "documents") -> str:
    from .fixtures import ARTICLE_SHAPES

    cases = " ".join(f"WHEN {k} THEN {lit(pre)} || text || {lit(post)}" for k, (pre, post) in ARTICLE_SHAPES.items())
    return f"SELECT doc_id, lang, CASE doc_id % 6 {cases} END AS article FROM {src}"


def sections_ctes(src: str, text: str = "article") -> list[tuple[str, str]]:
    """CTEs producing ps, first, sec_start, sec_end over ``src``."""
    intro = affix("p", [K.INTRO_MARKER])
    concl = affix("p", K.CONCLUSION_MARKERS)
    endm = affix("p", K.END_MARKERS)
    return [
        ("s1", f"SELECT *, list_transform(string_split({blank(f'lower({text})', True)}, {NL}), lambda p: trim(p, ' ')) AS ps FROM {src}"),
        ("s2", f"SELECT *, coalesce(list_position(list_transform(ps, lambda p: {intro}), true), 0) AS first FROM s1"),
        (
            "s3",
            f"SELECT *, CASE WHEN first = 0 THEN 0 ELSE first - 1 + CASE WHEN ends_with(ps[first], '{K.INTRO_MARKER}') THEN 1 ELSE 0 END END AS sec_start FROM s2",
        ),
        (
            "s4",
            "SELECT *, list_filter(list_transform(ps, lambda p, i: CASE WHEN first > 0 AND i > first AND NOT "
            f"{intro} THEN CASE WHEN {concl} THEN i + 1 WHEN {endm} THEN i - 1 END END), lambda z: z IS NOT NULL)[1] AS hit FROM s3",
        ),
        ("s5", "SELECT *, CASE WHEN hit > sec_start THEN hit END AS sec_end FROM s4"),
    ]


def clean_ctes(src: str, text: str = "article") -> list[tuple[str, str]]:
    """CTEs ending in ``c2`` with column ``text`` = cleaned article."""
    keep = "list_transform(list_filter(ps, lambda p, i: i - 1 >= sec_start AND (sec_end IS NULL OR i - 1 < sec_end) AND p <> ''), lambda p: regexp_replace(p, ' {2,}', ' ', 'g'))"
    capt = " OR ".join(f"starts_with(p, {lit(c)})" for c in K.CAPTION_PREFIXES)
    dig = f"len(regexp_extract_all(p, '\\p{{Nd}}+')) / len(string_split(p, ' ')) < {K.MAX_DIGIT_SHARE}"
    joined = f"array_to_string(list_filter(list_filter(kept, lambda p: NOT ({capt})), lambda p: {dig}), {NL})"
    return sections_ctes(src, text) + [
        ("c1", f"SELECT *, {keep} AS kept FROM s5"),
        ("c2", f"SELECT * EXCLUDE (ps, first, hit, kept, {text}), trim(replace({joined}, {lit(K.FRONT_RESIDUE)}, ''), ' ' || {NL}) AS text FROM c1"),
    ]


def useful(x: str = "text", min_words: int = K.MIN_USEFUL_WORDS) -> str:
    return f"((contains(lower({x}), 'introduction') OR contains(lower({x}), 'conclusion')) AND {words_blanks(x)} >= {min_words})"


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + final
