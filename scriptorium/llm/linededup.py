"""Operator 1: line dedup with content-defined chunks.

A text is cut at ``\\n`` into lines.  A rolling hash over the hashes of the last
``window`` lines chooses the chunk ends (hash divisible by ``modulus``), so that a
passage pasted anywhere is cut at the same inner lines.  A chunk of at
least ``min_lines`` lines that occurs more than once, in one text or in several, stays only
where it occurs first (smallest id, then smallest chunk number).  Equal digests only nominate chunks:
their texts are grouped and compared byte by byte before anything is removed.

Built-in functions only: no Python runs on the executors.

Shuffles: (id, digest) of the chunks, pre-aggregated, then joined with the repeated
digests (a hot digest is split by the skew join); the texts once, to their
nominated chunks; the distinct nominated texts.  The texts with their
nominations are written once and read for the comparison and for the result.

Defined results: a null text has no lines and stays null; an empty text is one
empty line; rows that repeat an id and a text count as one document and get
equal results; null ids come after all others; all input columns are returned
(a clashing name is replaced); a text may end up empty, but no row is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import written

#: Multiplier of the rolling hash, one power per line further back.
BASE = 31


def line_hash(line: Column) -> Column:
    """First 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunk_digest(piece: Column) -> Column:
    """Nominates equal chunks; it need not be free of collisions."""
    return F.unhex(F.md5(piece))


def _ends(hashes: Column, window: int, modulus: int) -> Column:
    """0-based numbers of the lines that end a chunk; the last line always does."""

    def rolling(i: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for back in range(window):
            total = total + F.get(hashes, i - back) * F.lit(BASE**back)
        return total

    numbers = F.sequence(F.lit(0), F.size(hashes) - 1)
    return F.filter(numbers, lambda i: (i == F.size(hashes) - 1) | ((i >= window - 1) & F.coalesce(rolling(i) % modulus == 0, F.lit(False))))


def _chunks(lines: Column, window: int, modulus: int) -> Column:
    """Chunks of an array of lines as (first line, number of lines)."""
    empty = F.array().cast("array<struct<first:int,lines:int>>")

    def spans(ends: Column) -> Column:
        return F.transform(
            ends,
            lambda end, k: F.struct(
                F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1).cast("int").alias("first"),
                F.when(k == 0, end + 1).otherwise(end - F.get(ends, k - 1)).cast("int").alias("lines"),
            ),
        )

    found = let(F.transform(lines, line_hash), lambda h: let(_ends(h, window, modulus), spans))
    return F.when(F.size(lines) > 0, found).otherwise(empty)


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"] + 1, chunk["lines"]), "\n")


def _key(id_col: str, text_col: str) -> Column:
    """One document: an id and a text."""
    return F.unhex(F.md5(F.concat_ws("/", F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.col(id_col).cast("string"), F.col(text_col).isNull().cast("string"))))


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2,
    modulus: int = 3,
    min_lines: int = 2,
    lines_col: str = "n_lines",
    removed_col: str = "n_removed_lines",
) -> DataFrame:
    """All rows, with repeated multi-line chunks removed from the text, and the line counts."""
    added = {lines_col.lower(), removed_col.lower()}
    rest = [c for c in df.columns if c.lower() not in added]
    docs = df.select(*rest, _key(id_col, text_col).alias("__key"))

    cut = docs.select("__key", F.col(id_col).alias("__id"), _lines(F.col(text_col)).alias("__lines"))
    cut = cut.select("*", _chunks(F.col("__lines"), window, modulus).alias("__chunks"))
    digests = let(
        F.col("__lines"),
        lambda lines: F.filter(
            F.transform(F.col("__chunks"), lambda c, no: F.struct(no.alias("no"), F.when(c["lines"] >= min_lines, chunk_digest(_chunk_text(lines, c))).alias("digest"))),
            lambda x: x["digest"].isNotNull(),
        ),
    )
    chunks = cut.select("__key", "__id", F.explode_outer(digests).alias("c")).where("c is not null")
    chunks = chunks.select("__key", "__id", F.col("c.no").alias("no"), F.col("c.digest").alias("digest"))

    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("no").alias("no"))
    repeated = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    nominated = chunks.join(repeated, "digest").select("__key", "no", "digest", ((F.col("first.key") == F.col("__key")) & (F.col("first.no") == F.col("no"))).alias("first"))
    # One list per document, no longer than its own chunks; repeated rows give equal entries.
    lists = nominated.groupBy("__key").agg(F.collect_set(F.struct("no", "digest", "first")).alias("__found"))
    docs = written(docs.join(lists, "__key", "left"), "line-dedup")

    # Byte comparison: the distinct texts of every nominated digest.
    again = docs.where("__found is not null").select("__found", _lines(F.col(text_col)).alias("__lines"))
    again = again.select("*", _chunks(F.col("__lines"), window, modulus).alias("__chunks"))
    pieces = let(
        F.col("__lines"),
        lambda lines: let(
            F.col("__chunks"),
            lambda cs: F.transform(F.col("__found"), lambda x: F.struct(x["digest"].alias("digest"), _chunk_text(lines, F.get(cs, x["no"])).alias("piece"))),
        ),
    )
    pieces = again.select(F.explode_outer(pieces).alias("x")).select("x.digest", "x.piece").distinct()
    unequal = written(pieces.groupBy("digest").count().where("count > 1").select("digest"), "line-dedup-unequal")
    if not unequal.isEmpty():
        docs = _without_unequal(docs, unequal, id_col, text_col, window, modulus)

    done = docs.select("*", _lines(F.col(text_col)).alias("__lines"))
    done = done.select("*", _chunks(F.col("__lines"), window, modulus).alias("__chunks"))
    gone = F.transform(F.filter(F.coalesce(F.col("__found"), F.array().cast(docs.schema["__found"].dataType)), lambda x: ~x["first"]), lambda x: x["no"])
    done = done.select("*", gone.alias("__gone"))

    def left_over(lines: Column, cs: Column) -> Column:
        stay = F.array_except(F.when(F.size(cs) > 0, F.sequence(F.lit(0), F.size(cs) - 1)).otherwise(F.array().cast("array<int>")), F.col("__gone"))
        return F.array_join(F.transform(stay, lambda k: _chunk_text(lines, F.get(cs, k))), "\n")

    rebuilt = let(F.col("__lines"), lambda lines: let(F.col("__chunks"), lambda cs: left_over(lines, cs)))
    removed = let(F.col("__chunks"), lambda cs: F.aggregate(F.col("__gone"), F.lit(0).cast("bigint"), lambda n, k: n + F.get(cs, k)["lines"]))
    return done.select(
        *[F.when(F.size("__gone") == 0, F.col(c)).otherwise(rebuilt).alias(c) if c == text_col else F.col(c) for c in rest],
        F.size("__lines").cast("long").alias(lines_col),
        F.when(F.size("__gone") == 0, F.lit(0).cast("bigint")).otherwise(removed).alias(removed_col),
    )


def _without_unequal(docs: DataFrame, unequal: DataFrame, id_col: str, text_col: str, window: int, modulus: int) -> DataFrame:
    """Nominations anew for digests that different texts share: firsts by the texts themselves."""
    step = docs.select("__key", F.col(id_col).alias("__id"), "__found", _lines(F.col(text_col)).alias("__lines"))
    step = step.select("*", _chunks(F.col("__lines"), window, modulus).alias("__chunks"))
    step = step.where("__found is not null").select("__key", "__id", "__lines", "__chunks", F.explode("__found").alias("x"))
    step = step.select("__key", "__id", F.col("x.no").alias("no"), F.col("x.digest").alias("digest"), "x.first", let(F.col("__lines"), lambda lines: _chunk_text(lines, F.get(F.col("__chunks"), F.col("x.no")))).alias("piece"))
    shared = step.join(unequal, "digest", "left_semi")
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("no").alias("no"))
    firsts = shared.groupBy("digest", "piece").agg(F.min(order).alias("o")).select("digest", F.col("o.key").alias("__key"), F.col("o.no").alias("no"), F.lit(True).alias("own"))
    fixed = shared.select("__key", "no", "digest").join(firsts, ["digest", "__key", "no"], "left").select("__key", "no", "digest", F.coalesce("own", F.lit(False)).alias("first"))
    others = step.join(unequal, "digest", "left_anti").select("__key", "no", "digest", "first")
    lists = others.unionByName(fixed).groupBy("__key").agg(F.collect_set(F.struct("no", "digest", "first")).alias("__found"))
    return docs.drop("__found").join(lists, "__key", "left")
