"""Evaluation metrics and decoding.

All metrics are plain aggregates over prediction tables (partial aggregation
before the single small shuffle).  Span extraction (W6) is done per sequence
with array functions, so no shuffle is needed to find spans; only the final
per-type counts are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import explode_rows, let
from ..functions.text import safe_ratio as _ratio
from ..session import checkpoint


def accuracy(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """A8."""
    return df.agg(F.avg((F.col(pred) == F.col(ref)).cast("double")).alias("accuracy"))


def f1_micro(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Micro precision/recall/F1 from per-class TP/FP/FN sums (one label per row)."""
    hit = (F.col(pred) == F.col(ref)).cast("bigint")
    agg = df.agg(F.sum(hit).alias("tp"), F.sum(1 - hit).alias("fp"), F.sum(1 - hit).alias("fn"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def multilabel_positive(df: DataFrame, pred_vec: str, ref_vec: str) -> DataFrame:
    """A10: positions whose reference is 1, scored as micro-F1 (= recall on positives)."""
    z = explode_rows(df.select(F.arrays_zip(F.col(pred_vec).alias("p"), F.col(ref_vec).alias("r")).alias("_z")), "_z", "z", keep=[])
    pos = z.where(F.col("z.r") == 1)
    return pos.agg(F.coalesce(F.avg((F.col("z.p") == F.col("z.r")).cast("double")), F.lit(0.0)).alias("f1"))


def pearson(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """A11."""
    return df.agg(F.corr(F.col(pred).cast("double"), F.col(ref).cast("double")).alias("pearson"))


def _prefix(t: Column) -> Column:
    """``B`` or ``I`` of an IOB2 tag; an unprefixed tag goes on like ``I``."""
    return F.when(t.startswith("B-"), F.lit("B")).otherwise(F.lit("I"))


def _type(t: Column) -> Column:
    """Class of a tag: what follows ``B-`` / ``I-``, or the whole token if it has no prefix; NULL outside."""
    return F.when(t == "O", F.lit(None).cast("string")).when(t.startswith("B-") | t.startswith("I-"), F.substr(t, F.lit(3))).otherwise(t)


def spans(tags: Column) -> Column:
    """IOB2 spans of a tag array as ``array<struct<type, start, end>>``.

    A span starts at ``B-x``, or at ``I-x`` after ``O``, after the sequence
    start or after another type; it runs until the next start or ``O``.  Tags
    without a prefix (plain class names) count as ``I-`` of the whole token.
    """
    return let(tags, _spans)


def _spans(tags: Column) -> Column:
    n = F.size(tags)

    def info_at(t, i):
        prev = F.get(tags, i - 1)
        st = (t != "O") & ((_prefix(t) == "B") | (i == 0) | (prev == "O") | (_type(prev) != _type(t)))
        return F.struct(_type(t).alias("type"), st.alias("st"), (st | (t == "O")).alias("bd"))

    # per position (type, starts a span, is a boundary), computed once
    info = F.transform(tags, info_at)

    def from_info(inf):
        # boundaries = span starts and O tags, in order; a span ends just
        # before the next boundary (or at the sequence end): O(n) per sequence
        bounds = F.filter(F.transform(inf, lambda x, i: F.when(x["bd"], i)), lambda j: j.isNotNull())

        def mark(b):
            marked = F.transform(
                b,
                lambda s, k: F.struct(
                    F.get(inf, s)["type"].alias("type"),
                    s.alias("start"),
                    (F.coalesce(F.get(b, k + 1), n) - 1).alias("end"),
                    F.get(inf, s)["st"].alias("_st"),
                ),
            )
            return F.transform(F.filter(marked, lambda x: x["_st"]), lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end")))

        return let(bounds, mark)

    return let(info, from_info)


def span_counts(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Per type: gold spans, predicted spans and exact matches."""
    s = df.select(spans(F.col(gold)).alias("g"), spans(F.col(pred)).alias("p"))
    sep = "\u0001"

    def keys(arr):
        # spans as strings: array_intersect hashes atomic values, but compares
        # struct elements pairwise (quadratic in the number of spans)
        return F.transform(arr, lambda x: F.concat_ws(sep, x["type"], x["start"].cast("string"), x["end"].cast("string")))

    def tagged(arr, kind):
        return F.transform(arr, lambda k: F.struct(F.substring_index(k, sep, 1).alias("type"), F.lit(kind).alias("kind")))

    s = s.select(keys(F.col("g")).alias("g"), keys(F.col("p")).alias("p"))
    # one array per row (gold, predicted and matched spans) -> one explode, so
    # the upstream plan runs once
    allspans = F.concat(tagged(F.col("g"), "gold"), tagged(F.col("p"), "pred"), tagged(F.array_intersect("g", "p"), "tp"))
    rows = explode_rows(s.select(allspans.alias("a")), "a", "x", keep=[])
    return rows.groupBy(F.col("x.type").alias("type")).agg(
        F.count_if(F.col("x.kind") == "gold").alias("gold"),
        F.count_if(F.col("x.kind") == "pred").alias("pred"),
        F.count_if(F.col("x.kind") == "tp").alias("tp"),
    )


def _prf(df: DataFrame) -> DataFrame:
    p = _ratio(F.col("tp"), F.col("pred"))
    r = _ratio(F.col("tp"), F.col("gold"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2 * p * r, p + r))


def span_metrics_by_type(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """A12 per type: precision, recall, f1, support (= gold spans)."""
    return _prf(span_counts(df, gold, pred)).select("type", "precision", "recall", "f1", F.col("gold").alias("support"))


def span_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """A12 overall (micro over types)."""
    c = span_counts(df, gold, pred).agg(F.sum("gold").alias("gold"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    return _prf(c).select("precision", "recall", "f1")


def flatten_by_type(by_type: DataFrame, types, metrics=("precision", "recall", "f1", "support")) -> DataFrame:
    """A12 flattening: per-type rows -> one row with ``{type}_{metric}`` columns.

    ``types`` is the (small, known) label-type list; a type without spans gets 0.
    """
    aggs = []
    for t in types:
        for m in metrics:
            aggs.append(F.coalesce(F.max(F.when(F.col("type") == t, F.col(m))), F.lit(0)).alias(f"{t}_{m}"))
    return by_type.agg(*aggs)


def token_accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """A12 token accuracy: share of gold positions whose tags agree (a missing prediction does not)."""
    same = F.aggregate(F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p")), F.lit(0).cast("bigint"), lambda a, z: a + F.coalesce(z["g"] == z["p"], F.lit(False)).cast("bigint"))
    return df.agg(_ratio(F.sum(same), F.sum(F.size(gold).cast("bigint"))).alias("accuracy"))


def masked_cross_entropy(df: DataFrame, logits: str, label: str) -> DataFrame:
    """Mean of ``logsumexp(logits) - logits[label]`` over rows whose label is not -100."""
    lg = F.col(logits).cast("array<double>")
    m = F.array_max(lg)
    lse = m + F.log(F.aggregate(lg, F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    nll = lse - F.get(lg, F.col(label))
    keep = F.col(label) != K.IGNORE_INDEX
    return df.agg(_ratio(F.sum(F.when(keep, nll)), F.count_if(keep).cast("double")).alias("loss"))


def dedupe_predictions(df: DataFrame, example_id: str) -> DataFrame:
    """One row per example id (gathered batches may repeat rows).  The
    smallest row is kept, so the choice is deterministic."""
    rest = [c for c in df.columns if c != example_id]
    return df.groupBy(example_id).agg(F.min(F.struct(*rest)).alias("_r")).select(example_id, *[F.col(f"_r.{c}").alias(c) for c in rest])


def drop_ignored(pred: Column, ref: Column) -> Column:
    """(pred, ref) pairs whose reference is not -100."""
    return F.filter(F.arrays_zip(pred.alias("pred"), ref.alias("ref")), lambda z: z["ref"] != K.IGNORE_INDEX)


def argmax(v: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def threshold(v: Column, t: float = 0.5) -> Column:
    """Raw scores >= t -> 1 else 0."""
    return F.transform(v, lambda x: (x >= t).cast("int"))


# ---------------------------------------------------------------- training-log windows


def running_stats(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Distributed running sum and count of ``value`` within ``group`` along
    ``order`` (adds ``run_sum``, ``run_n``).

    A window partitioned by ``group`` alone would put a hot group (one epoch
    holding a third of the log) in one task.  Instead: range-partition on
    (group, order) so every task holds a contiguous slice, compute running
    sums inside each slice, then add the totals of the earlier slices of the
    same group (a summary of at most partitions x groups rows).
    """
    from pyspark.sql import Window

    keys = [group] + order
    sliced = checkpoint(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    w_local = Window.partitionBy("_pid", group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_ls", F.sum(value).over(w_local)).withColumn("_ln", F.count(F.lit(1)).over(w_local))
    summary = sliced.groupBy("_pid", group).agg(F.sum(value).alias("_ts"), F.count(F.lit(1)).alias("_tn"))
    w_prev = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        F.col("_pid").alias("_cp"), F.col(group).alias("_cg"), F.coalesce(F.sum("_ts").over(w_prev), F.lit(0.0)).alias("_cs"), F.coalesce(F.sum("_tn").over(w_prev), F.lit(0)).alias("_cn")
    )
    # null-safe: a NULL group is a group like any other
    out = local.join(carry, (F.col("_pid") == F.col("_cp")) & F.col(group).eqNullSafe(F.col("_cg"))).drop("_cp", "_cg")
    return out.withColumn("run_sum", F.col("_ls") + F.col("_cs")).withColumn("run_n", F.col("_ln") + F.col("_cn")).drop("_pid", "_ls", "_ln", "_cs", "_cn")


def loss_running_mean(log: DataFrame, epoch: str = "epoch", step: str = "step", loss: str = "loss", digits: int = 6) -> DataFrame:
    """Sum, steps and mean of the loss since the start of the epoch, per step.

    The sum is rounded before the division, so the order of summation does not show.
    """
    r = running_stats(log, epoch, [step], loss)
    total = F.round("run_sum", digits)
    return r.withColumn("running_sum", total).withColumn("running_steps", F.col("run_n")).withColumn("running_mean", total / F.col("run_n")).drop("run_sum", "run_n")


def loss_bucket_mean(log: DataFrame, k: int, epoch: str = "epoch", step: str = "step", loss: str = "loss") -> DataFrame:
    """Per epoch, mean loss over each full block of ``k`` consecutive steps
    (logged when ``(local_step + 1) % k == 0``; an incomplete tail is never logged)."""
    r = running_stats(log, epoch, [step], loss).withColumn("_pos", F.col("run_n") - 1)
    b = r.withColumn("bucket", F.floor(F.col("_pos") / k).cast("bigint"))
    g = b.groupBy(epoch, "bucket").agg(F.sum(loss).alias("_s"), F.count(F.lit(1)).alias("_c"))
    return g.where(F.col("_c") == k).select(epoch, "bucket", (F.col("_s") / k).alias("mean_loss"))


def val_loss_mean(log: DataFrame, loss: str = "loss", order: list[str] | None = None, max_batches: int | None = None) -> DataFrame:
    """Mean validation loss over all batches (the intended behaviour), or
    over the first ``max_batches`` in ``order``."""
    src = log if max_batches is None else log.orderBy(*(order or [])).limit(max_batches)
    return src.agg(F.avg(loss).alias("val_loss"))
