"""Operator 4: quality rules - a learned decision list over text statistics.

``with_statistics`` adds one struct of counts and shares per document, made of
built-in functions only.  ``learn_rules`` learns from labelled rows by
sequential covering: a rule is grown one threshold condition at a time (largest
information gain for the rejected class, on the growing fold), then cut back to
the prefix that does best on the pruning fold; the rows it covers leave, and the
next rule is learned.  Every step reads a histogram (statistic, bin, class) that
Spark counts over all labelled rows: nothing is sampled, and the driver sees
statistics x bins rows.  ``verdict`` turns the list into one ordered
``when ... otherwise`` expression.

Defined results: a null text counts as empty (all counts 0, shares 0); rows are
independent, so repeated rows and ties get equal results; labels that are null
or have no document are left out; without labelled rows of both classes the
list is empty and every document passes.  The struct is the only added column;
an input column of its name is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import BLANKS, written

#: Statistics that rules may test, all doubles.
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "digit_share", "upper_share", "mark_share", "dup_line_share", "repeat_word_share", "distinct_word_share", "words_per_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, stats: str) -> Column:
        value = F.col(stats)[self.feature].cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """Reject what meets all conditions; counts are of the labelled rows left when it was learned."""

    conditions: tuple[Condition, ...]
    rejected: int
    kept: int


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows' hashes are sorted with their positions, equal neighbours are
    kept, and the windows' union is measured.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def repeated(sorted_windows: Column) -> Column:
        same = F.filter(
            sorted_windows,
            lambda x, k: F.coalesce(x["h"] == F.get(sorted_windows, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_windows, k + 1)["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.size(hashes) - 2),
            lambda x, i: F.struct(F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")),
        )

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(F.sort_array(windows(h)), repeated))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found)


def with_statistics(df: DataFrame, text_col: str = "text", stats_col: str = "quality") -> DataFrame:
    """Append the struct of statistics of every whole text."""
    rest = [c for c in df.columns if c.lower() != stats_col.lower()]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(F.col("__text"), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    step = df.select(*rest, text.alias("__text"))
    step = step.select("*", words.alias("__words"), lines.alias("__lines"))
    counted = step.select(
        *rest,
        F.size("__words").cast("long").alias("__n"),
        F.length(F.array_join("__words", "")).cast("long").alias("__chars"),
        F.size(F.array_distinct("__words")).alias("__distinct"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("__symbols"),
        F.regexp_count("__text", F.lit(r"[0-9]")).alias("__digits"),
        F.regexp_count("__text", F.lit(r"[A-Z]")).alias("__upper"),
        F.regexp_count("__text", F.lit(r"[.,;:!?]")).alias("__marks"),
        _repeat_words(F.col("__words")).cast("long").alias("__repeat"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a).cast("double") / F.col(b))

    stats = F.struct(
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        share("__chars", "__n").alias("mean_word_chars"),
        share("__symbols", "__n").alias("symbols_per_word"),
        share("__digits", "__chars").alias("digit_share"),
        share("__upper", "__chars").alias("upper_share"),
        share("__marks", "__chars").alias("mark_share"),
        share("__dup", "__n_lines").alias("dup_line_share"),
        share("__repeat", "__n").alias("repeat_word_share"),
        share("__distinct", "__n").alias("distinct_word_share"),
        share("__n", "__n_lines").alias("words_per_line"),
    )
    return counted.select(*rest, stats.alias(stats_col))


def base_failed(stats_col: str = "quality", min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """Too short, or more than that percentage of the words in repeated 3-word windows."""
    s = F.col(stats_col)
    return (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _best_condition(bins: dict, p0: int, n0: int, min_covered: int):
    """The condition with the largest gain: (gain, feature index, above, bin); bins: (feature, bin) -> (p, n)."""
    best = None
    for f in sorted({f for f, _ in bins}):
        mine = sorted((b, c) for (g, b), c in bins.items() if g == f)
        p = n = 0
        for b, (dp, dn) in mine[:-1]:
            p, n = p + dp, n + dn
            for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(p0, n0, p1, n1)
                if p1 >= min_covered and gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, above, b
    return best


def learn_rules(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    stats_col: str = "quality",
    n_bins: int = 32,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_covered: int = 5,
    min_precision: float = 0.8,
) -> list[Rule]:
    """Learn the ordered rules from all labelled rows (label 0: reject, other: keep).

    Thresholds are approximate quantiles over the labelled rows.  One id in three, by hash, belongs to
    the pruning fold.
    """
    named = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == 0).cast("long").alias("p"))
    known = stats.select(F.col(id_col).alias("__row"), F.col(stats_col).alias("s")).join(named, F.col("__row") == F.col("__id"))
    known = written(known.select("p", (F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).alias("pruning"), *[F.col("s")[f].cast("double").alias(f) for f in FEATURES]), "quality-labelled")
    at = [k / n_bins for k in range(1, n_bins)]
    # The quantiles of the rejected rows are added: they may be too few to shape those of all rows.
    cuts = known.agg(
        *[F.percentile_approx(f, at, 10_000).alias(f"{f}_all") for f in FEATURES],
        *[F.percentile_approx(F.when(F.col("p") == 1, F.col(f)), at, 10_000).alias(f"{f}_bad") for f in FEATURES],
    ).first()
    thresholds = {f: sorted({*(cuts[f"{f}_all"] or []), *(cuts[f"{f}_bad"] or [])}) for f in FEATURES}
    binned = known.select("p", "pruning", *[sum([(F.col(f) > F.lit(t)).cast("int") for t in thresholds[f]], F.lit(0)).alias(f"b{k}") for k, f in enumerate(FEATURES)])
    # Equal rows count once, with their number: what is left to read grows with the distinct bins only.
    binned = written(binned.groupBy(*binned.columns).agg(F.count("*").alias("w")), "quality-binned")

    def meets(conditions) -> Column:
        test = F.lit(True)
        for f, above, b in conditions:
            test = test & (F.col(f"b{f}") > b if above else F.col(f"b{f}") <= b)
        return test

    def counts(rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * (1 - F.col("p"))).alias("n")).first()
        return r["p"] or 0, r["n"] or 0

    rules: list[Rule] = []
    left = binned
    for _ in range(max_rules):
        grown: list[tuple[int, bool, int]] = []
        for _ in range(max_conditions):
            rows = left.where(~F.col("pruning") & meets(grown))
            pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b{k}").alias("b")) for k in range(len(FEATURES))])).alias("x")
            hist = rows.select("p", "w", pairs).groupBy("x.f", "x.b").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * (1 - F.col("p"))).alias("n"))
            bins = {(r["f"], r["b"]): (r["p"], r["n"]) for r in hist.collect()}
            p0 = sum(c[0] for (f, _), c in bins.items() if f == 0)
            n0 = sum(c[1] for (f, _), c in bins.items() if f == 0)
            best = _best_condition(bins, p0, n0, min_covered) if p0 and n0 else None
            if best is None:
                break
            grown.append(best[1:])
        if not grown:
            break
        # Pruning: of all prefixes, the one with the best (rejected - kept) / covered on the pruning fold.
        sums = []
        for k in range(1, len(grown) + 1):
            m = meets(grown[:k])
            for fold in (False, True):
                hit = m & (F.col("pruning") == fold)
                sums += [F.sum(F.when(hit, F.col("w") * F.col("p"))).alias(f"p{k}{fold}"), F.sum(F.when(hit, F.col("w") * (1 - F.col("p")))).alias(f"n{k}{fold}")]
        r = left.agg(*sums).first()

        def worth(k: int) -> float:
            p, n = r[f"p{k}True"] or 0, r[f"n{k}True"] or 0
            return (p - n) / (p + n) if p + n else -2.0

        k = max(range(1, len(grown) + 1), key=lambda k: (worth(k), -k))
        p, n = ((r[f"p{k}False"] or 0) + (r[f"p{k}True"] or 0), (r[f"n{k}False"] or 0) + (r[f"n{k}True"] or 0))
        pruned_p, pruned_n = r[f"p{k}True"] or 0, r[f"n{k}True"] or 0
        precise = p / (p + n) >= min_precision and (pruned_p + pruned_n == 0 or pruned_p / (pruned_p + pruned_n) >= min_precision)
        if not precise:
            break
        kept = grown[:k]
        rules.append(Rule(tuple(Condition(FEATURES[f], above, float(thresholds[FEATURES[f]][b])) for f, above, b in kept), p, n))
        left = left.where(~meets(kept))
    return rules


def verdict(rules: list[Rule], stats_col: str = "quality") -> Column:
    """The decision list as one ordered conditional expression: the number of the first rule met, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule.conditions:
            test = test & c.column(stats_col)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def kept(rules: list[Rule], stats_col: str = "quality") -> Column:
    """True for a document that the base conditions and every rule let pass."""
    return ~base_failed(stats_col) & (verdict(rules, stats_col) == 0)
