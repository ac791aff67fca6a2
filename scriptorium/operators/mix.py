"""Set operators U1 (union by name) and U2 (round-robin interleave)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import indexed

#: Most copies of a row of a short source.
SALTS = 256


def union_by_name(frames: list[DataFrame], source_col: str | None = None) -> DataFrame:
    """Concatenate by column name; missing columns become NULL."""
    tagged = frames if source_col is None else [f.withColumn(source_col, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def interleave(frames: list[DataFrame], orders: list, partial_last_round: bool = False, out: str = "pos", source_col: str = "source") -> DataFrame:
    """Round-robin interleave until every source is exhausted.

    Source ``s`` with ``n_s`` rows contributes its row ``i`` to rounds
    ``i, i + n_s, i + 2 n_s, ... < max n`` (short sources restart), so a complete
    run has ``k * max n`` rows at positions ``round * k + s``.  With
    ``partial_last_round`` the output stops right after the longest source's
    last row, as a lazy iterator would.  Frames must share a schema (use
    ``union_by_name`` first otherwise); each needs its own total order.

    The positions are generated in slices over all tasks and joined with the
    rows by (source, round mod n_s).  The rows of a short source are asked for
    many times: they are copied to up to ``SALTS`` salts, and the rounds are
    dealt to the salts, so one row's positions spread over as many tasks.
    """
    k = len(frames)
    spark = frames[0].sparkSession
    tagged = [f.withColumn(source_col, F.lit(s)).withColumn("_o", F.struct(*[F.col(c) for c in ([o] if isinstance(o, str) else o)])) for s, (f, o) in enumerate(zip(frames, orders))]
    allrows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    glob, _ = indexed(allrows, [source_col, "_o"], "_g")
    # per-source start offset and size: k rows
    stats = glob.groupBy(source_col).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    sizes = {r[source_col]: (r["_first"], r["_n"]) for r in stats}
    max_n = max((n for _, n in sizes.values()), default=0)
    if max_n == 0:
        return glob.drop("_g", "_o").withColumn(out, F.lit(None).cast("bigint")).limit(0)

    def per_source(value) -> F.Column:
        expr = F.lit(None).cast("bigint")
        for s, (first, n) in sizes.items():
            expr = F.when(F.col(source_col) == s, F.lit(value(first, n)).cast("bigint")).otherwise(expr)
        return expr

    size, salts = per_source(lambda _, n: n), per_source(lambda _, n: min(SALTS, -(-max_n // n)))
    rows = glob.withColumn("_i", F.col("_g") - per_source(lambda first, _: first)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    asked = spark.range(max_n * k).select(F.col("id").alias(out), (F.col("id") % k).cast("int").alias(source_col), F.floor(F.col("id") / k).alias("_round"))
    asked = asked.where(F.col(source_col).isin(*sizes))
    if partial_last_round:
        longest = max(s for s, (_, n) in sizes.items() if n == max_n)
        asked = asked.where(F.col(out) <= (max_n - 1) * k + longest)
    asked = asked.withColumn("_i", F.col("_round") % size).withColumn("_salt", F.floor(F.col("_round") / size) % salts)
    return asked.join(rows, [source_col, "_i", "_salt"]).drop("_g", "_o", "_i", "_salt", "_round")
