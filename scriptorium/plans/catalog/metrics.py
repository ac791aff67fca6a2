"""Metric, decoding and training-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions.text import explode_rows
from ...operators import encode as E
from ...operators import metrics as M
from ...operators import tasks as T
from ...session import checkpoint
from ...sources.tables import documents, table
from .. import fixtures as FX
from .. import sqltext as Q
from ..registry import query
from .encode import MASK_CTES, VOCAB_K, masked, vocab
from .tasks import tags_ctes


def _r(c, name):
    return F.round(F.col(c), 6).alias(name)


_PR = (
    "SELECT l.doc_id, quality AS ref, CASE WHEN substr(md5('pred|' || CAST(l.doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') THEN 1 - quality ELSE quality END AS pred, "
    "toxic AS ref2, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS en, "
    "CASE WHEN substr(md5('p2|' || CAST(l.doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 1 - toxic ELSE toxic END AS pred2 "
    "FROM labels l JOIN documents d USING (doc_id)"
)


def predictions(spark, sf):
    p = FX.predictions(table(spark, sf, "labels"))
    d = documents(spark, sf).select("doc_id", (F.col("lang") == "en").cast("int").alias("en"))
    flip2 = F.substring(F.md5(F.concat(F.lit("p2|"), F.col("doc_id").cast("string"))), 1, 1).isin("0", "1", "2", "3")
    return p.join(d, "doc_id").withColumn("pred2", F.when(flip2, 1 - F.col("ref2")).otherwise(F.col("ref2")))


@query("metric_accuracy", Q.with_ctes([("pr", _PR)], "SELECT round(avg(CASE WHEN pred = ref THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr"))
def metric_accuracy(spark, sf):
    return M.accuracy(predictions(spark, sf), "pred", "ref").select(_r("accuracy", "accuracy"))


@query(
    "metric_f1_micro",
    Q.with_ctes(
        [("pr", _PR), ("c", "SELECT sum(CASE WHEN pred = ref THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = ref THEN 0 ELSE 1 END) AS fp FROM pr")],
        "SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fp), 6) AS recall, round(tp / (tp + fp), 6) AS f1 FROM c",
    ),
)
def metric_f1_micro(spark, sf):
    return M.f1_micro(predictions(spark, sf), "pred", "ref").select(_r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


@query(
    "metric_multilabel_pos",
    Q.with_ctes(
        [("pr", _PR), ("z", "SELECT unnest([pred, pred2, en]) AS p, unnest([ref, ref2, en]) AS r FROM pr")],
        "SELECT round(coalesce(avg(CASE WHEN p = r THEN 1.0 ELSE 0.0 END), 0.0), 6) AS f1 FROM z WHERE r = 1",
    ),
)
def metric_multilabel_pos(spark, sf):
    p = predictions(spark, sf).select(F.array("pred", "pred2", "en").alias("pv"), F.array("ref", "ref2", "en").alias("rv"))
    return M.multilabel_positive(p, "pv", "rv").select(_r("f1", "f1"))


@query(
    "metric_pearson",
    Q.with_ctes(
        [("p0", "SELECT a.text AS s1, b.text AS s2 FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")],
        f"SELECT round(corr(CASE WHEN length(s1) = 0 THEN 0.0 ELSE length(s2) / length(s1) END, CASE WHEN len({Q.tokens('s1')}) = 0 THEN 0.0 ELSE len({Q.tokens('s2')}) / len({Q.tokens('s1')}) END), 6) AS pearson FROM p0",
    ),
)
def metric_pearson(spark, sf):
    p = FX.sentence_pairs(table(spark, sf, "conversations")).withColumn("pred", F.when(F.length("sentence1") == 0, F.lit(0.0)).otherwise(F.length("sentence2") / F.length("sentence1")))
    return M.pearson(p, "pred", "score").select(_r("pearson", "pearson"))


def _class_sql(x: str) -> str:
    return f"(CASE WHEN substr({x}, 1, 2) IN ('B-', 'I-') THEN substr({x}, 3) ELSE {x} END)"


def _start_sql(t: str, i: str) -> str:
    return f"({t}[{i}] <> 'O' AND (starts_with({t}[{i}], 'B-') OR {i} = 1 OR {t}[{i} - 1] = 'O' OR {_class_sql(f'{t}[{i} - 1]')} <> {_class_sql(f'{t}[{i}]')}))"


def _bounds_sql(t: str) -> str:
    return f"list_filter(range(1, len({t}) + 1), lambda j: {_start_sql(t, 'j')} OR {t}[j] = 'O')"


def _spans_sql(t: str, b: str) -> str:
    marked = (
        f"list_transform({b}, lambda s, k: {{'type': {_class_sql(t + '[s]')}, 'start': s - 1, "
        f"'end': coalesce({b}[k + 1], len({t}) + 1) - 2, 'st': {_start_sql(t, 's')}}})"
    )
    return f"list_transform(list_filter({marked}, lambda x: x.st), lambda x: {{'type': x.type, 'start': x.start, 'end': x.end}})"


SPAN_CTES = tags_ctes() + [
    ("bd", f"SELECT doc_id, gold, pred, {_bounds_sql('gold')} AS bg, {_bounds_sql('pred')} AS bp FROM tags"),
    ("sp", f"SELECT doc_id, {_spans_sql('gold', 'bg')} AS g, {_spans_sql('pred', 'bp')} AS p FROM bd"),
    ("sm", "SELECT g, p, list_intersect(g, p) AS m FROM sp"),
    (
        "k",
        "SELECT x.type AS type, 'gold' AS kind FROM (SELECT unnest(g) AS x FROM sm) UNION ALL SELECT x.type, 'pred' FROM (SELECT unnest(p) AS x FROM sm) "
        "UNION ALL SELECT x.type, 'tp' FROM (SELECT unnest(m) AS x FROM sm)",
    ),
    ("cnt", "SELECT type, count_if(kind = 'gold') AS gold, count_if(kind = 'pred') AS pred, count_if(kind = 'tp') AS tp FROM k GROUP BY type"),
]


def _prf_sql(src: str, extra: str = "") -> str:
    p = "CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END"
    r = "CASE WHEN gold = 0 THEN 0.0 ELSE tp / gold END"
    return (
        f"SELECT {extra}round({p}, 6) AS precision, round({r}, 6) AS recall, "
        f"round(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 6) AS f1 FROM {src}"
    )


def _tags(spark, sf):
    return FX.tag_sequences(documents(spark, sf))


@query("metric_spans", Q.with_ctes(SPAN_CTES + [("tot", "SELECT sum(gold) AS gold, sum(pred) AS pred, sum(tp) AS tp FROM cnt")], _prf_sql("tot")))
def metric_spans(spark, sf):
    return M.span_metrics(_tags(spark, sf), "gold", "pred").select(_r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


@query("metric_spans_by_type", Q.with_ctes(SPAN_CTES, _prf_sql("cnt", "type, gold::BIGINT AS support, ")))
def metric_spans_by_type(spark, sf):
    m = M.span_metrics_by_type(_tags(spark, sf), "gold", "pred")
    return m.select("type", "support", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


@query(
    "metric_token_accuracy",
    Q.with_ctes(
        tags_ctes(),
        "SELECT round(sum(len(list_filter(range(1, len(gold) + 1), lambda i: gold[i] = pred[i]))) / sum(len(gold)), 6) AS accuracy FROM tags",
    ),
)
def metric_token_accuracy(spark, sf):
    return M.token_accuracy(_tags(spark, sf), "gold", "pred").select(_r("accuracy", "accuracy"))


_XENT = (
    "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS lg, "
    "CASE WHEN vec_id % 5 = 0 THEN -100 ELSE ((label % len(embedding)) + len(embedding)) % len(embedding) END AS lab FROM embeddings"
)


def _xent_input(spark, sf):
    e = table(spark, sf, "embeddings")
    lab = F.when(F.col("vec_id") % 5 == 0, F.lit(K.IGNORE_INDEX)).otherwise(F.pmod(F.col("label"), F.size("embedding"))).cast("int")
    return e.select("vec_id", F.col("embedding").alias("logits"), lab.alias("label"))


@query(
    "metric_masked_xent",
    Q.with_ctes(
        [("x", _XENT), ("y", "SELECT lab, list_max(lg) + ln(list_sum(list_transform(lg, lambda v: exp(v - list_max(lg))))) - lg[lab + 1] AS nll FROM x WHERE lab <> -100")],
        "SELECT round(sum(nll) / count(*), 6) AS loss FROM y",
    ),
)
def metric_masked_xent(spark, sf):
    return M.masked_cross_entropy(_xent_input(spark, sf), "logits", "label").select(_r("loss", "loss"))


@query("argmax_decode", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS pred FROM embeddings")
def argmax_decode(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", M.argmax(F.col("embedding")).alias("pred"))


@query(
    "threshold_decode",
    "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0.5 THEN 1 ELSE 0 END), ',') AS pred FROM embeddings",
)
def threshold_decode(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.array_join(M.threshold(F.col("embedding")), ",").alias("pred"))


@query(
    "mask_slot_decode",
    Q.with_ctes(
        MASK_CTES
        + [
            ("slots", f"SELECT doc_id, unnest(list_filter(range(0, len(masked_ids)), lambda i: masked_ids[i + 1] = {K.MASK_ID})) AS pos FROM msk"),
            ("ev", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1) AS best, len(embedding) AS dim, count(*) OVER () AS n FROM embeddings"),
            ("best", f"SELECT s.doc_id, s.pos, (5 + (e.best + e.dim * s.pos) % {VOCAB_K})::INTEGER AS token_id FROM slots s LEFT JOIN ev e ON e.vec_id = s.doc_id % e.n"),
        ],
        "SELECT b.doc_id, b.pos::BIGINT AS pos, b.token_id, v.word AS token FROM best b LEFT JOIN v ON v.id = b.token_id",
    ),
)
def mask_slot_decode(spark, sf):
    """Every [MASK] position of the masked ids, the best token of its scores, decoded through the vocabulary.

    The score vector of a document is row ``doc_id mod rows`` of ``embeddings``; its best entry is
    shifted by the position, so all of the vocabulary can be hit.
    """
    words = vocab(spark, sf)
    m = masked(spark, sf, words).select("doc_id", "masked_ids")
    slots = explode_rows(m, "masked_ids", "tok", pos="pos", keep=["doc_id"]).where(F.col("tok") == K.MASK_ID)
    e = table(spark, sf, "embeddings").select("vec_id", M.argmax(F.col("embedding")).alias("best"), F.size("embedding").alias("dim"))
    n = e.count()
    j = slots.join(e, F.col("doc_id") % F.lit(max(n, 1)) == F.col("vec_id"), "left")
    token_id = (5 + (F.col("best") + F.col("dim") * F.col("pos")) % VOCAB_K).cast("int")
    best = j.select("doc_id", F.col("pos").cast("bigint").alias("pos"), token_id.alias("token_id"))
    v = words.select(F.col("id").alias("token_id"), F.col("word").alias("token"))
    return best.join(v, "token_id", "left").select("doc_id", "pos", "token_id", "token")


@query(
    "dedupe_predictions",
    Q.with_ctes([("pr", _PR)], "SELECT DISTINCT doc_id, ref, pred FROM (SELECT doc_id, ref, pred FROM pr UNION ALL SELECT doc_id, ref, pred FROM pr WHERE doc_id % 7 = 0)"),
)
def dedupe_predictions(spark, sf):
    p = predictions(spark, sf).select("doc_id", "ref", "pred")
    gathered = p.unionByName(p.where(F.col("doc_id") % 7 == 0))
    return M.dedupe_predictions(gathered, "doc_id")


def _tag_ids(spark, sf):
    t = _tags(spark, sf)
    dim = checkpoint(T.label_dimension(t, "gold", exclude=None))
    t = T.encode_label_array(t, "gold", dim, "gold_ids")
    t = T.encode_label_array(t, "pred", dim, "pred_ids")
    return t.withColumn("ref_ids", F.transform("gold_ids", lambda x, i: F.when(i % 5 == 4, F.lit(K.IGNORE_INDEX)).otherwise(x)))


_TAG_IDS = tags_ctes() + [
    ("mp", "SELECT map(list(label), list(id)) AS lm FROM tagdim"),
    (
        "ti",
        "SELECT doc_id, list_transform(pred, lambda x: lm[x]) AS pred_ids, list_transform(gold, lambda x, i: CASE WHEN (i - 1) % 5 = 4 THEN -100 ELSE lm[x] END) AS ref_ids, "
        "list_transform(gold, lambda x: lm[x]) AS gold_ids FROM tags, mp",
    ),
]


@query(
    "drop_ignored",
    Q.with_ctes(
        _TAG_IDS + [("z", "SELECT doc_id, list_filter(range(1, len(ref_ids) + 1), lambda i: ref_ids[i] <> -100) AS keep, pred_ids, ref_ids FROM ti")],
        "SELECT doc_id, len(keep)::BIGINT AS n_kept, array_to_string(list_transform(keep, lambda i: pred_ids[i]), ',') AS pred, "
        "array_to_string(list_transform(keep, lambda i: ref_ids[i]), ',') AS ref FROM z",
    ),
)
def drop_ignored(spark, sf):
    t = _tag_ids(spark, sf)
    z = t.select("doc_id", M.drop_ignored(F.col("pred_ids"), F.col("ref_ids")).alias("z"))
    return z.select(
        "doc_id",
        F.size("z").cast("bigint").alias("n_kept"),
        F.array_join(F.transform("z", lambda x: x["pred"]), ",").alias("pred"),
        F.array_join(F.transform("z", lambda x: x["ref"]), ",").alias("ref"),
    )


@query(
    "pad_pairs",
    Q.with_ctes(
        _TAG_IDS + [("q", "SELECT doc_id, pred_ids AS a, list_filter(gold_ids, lambda x, i: (i - 1) % 2 = 0) AS b FROM ti")],
        "SELECT doc_id, array_to_string(list_concat(a, list_transform(range(0, greatest(len(a), len(b)) - len(a)), lambda z: -100)), ',') AS a, "
        "array_to_string(list_concat(b, list_transform(range(0, greatest(len(a), len(b)) - len(b)), lambda z: -100)), ',') AS b FROM q",
    ),
)
def pad_pairs(spark, sf):
    t = _tag_ids(spark, sf)
    # every second gold position: arrays of two lengths
    a, b = E.pad_pairs(F.col("pred_ids"), F.filter("gold_ids", lambda x, i: i % 2 == 0))
    return t.select("doc_id", F.array_join(a, ",").alias("a"), F.array_join(b, ",").alias("b"))


# ---------------------------------------------------------------- training log (F8)

# every 4th epoch number is NULL: steps that were logged without an epoch
_F8 = "SELECT event_id AS step, value AS loss, nullif(event_id % 4, 3) AS epoch FROM events"


def _log(spark, sf):
    return FX.training_log(table(spark, sf, "events"))


@query(
    "loss_running_mean",
    Q.with_ctes(
        [("f8", _F8)],
        "SELECT step, coalesce(epoch, -1) AS epoch, round(sum(loss) OVER w, 6) AS running_sum, count(*) OVER w AS running_steps, round(sum(loss) OVER w, 6) / count(*) OVER w AS running_mean FROM f8 "
        "WINDOW w AS (PARTITION BY epoch ORDER BY step ROWS UNBOUNDED PRECEDING)",
    ),
)
def loss_running_mean(spark, sf):
    """W3 (steps without an epoch form a group of their own, shown as -1)."""
    r = M.loss_running_mean(_log(spark, sf))
    return r.select("step", F.coalesce("epoch", F.lit(-1)).alias("epoch"), "running_sum", "running_steps", "running_mean")


@query(
    "loss_bucket_mean",
    Q.with_ctes(
        [("f8", _F8), ("b", "SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY step) - 1) // 50 AS bucket, loss FROM f8")],
        "SELECT coalesce(b.epoch, -1) AS epoch, bucket, round(sum(loss) / 50, 6) AS mean_loss FROM b GROUP BY b.epoch, bucket HAVING count(*) = 50",
    ),
)
def loss_bucket_mean(spark, sf):
    m = M.loss_bucket_mean(_log(spark, sf), 50)
    return m.select(F.coalesce("epoch", F.lit(-1)).alias("epoch"), "bucket", _r("mean_loss", "mean_loss"))


@query("val_loss_mean", Q.with_ctes([("f8", _F8)], "SELECT round(avg(loss), 6) AS val_loss FROM f8"))
def val_loss_mean(spark, sf):
    return M.val_loss_mean(_log(spark, sf)).select(_r("val_loss", "val_loss"))


@query("val_loss_first_batches", Q.with_ctes([("f8", _F8)], "SELECT round(avg(loss), 6) AS val_loss FROM (SELECT loss FROM f8 ORDER BY step LIMIT 100)"))
def val_loss_first_batches(spark, sf):
    return M.val_loss_mean(_log(spark, sf), order=["step"], max_batches=100).select(_r("val_loss", "val_loss"))


def _flat_sql():
    cols = []
    for t in ("x", "y"):
        for m in ("precision", "recall", "f1", "support"):
            cols.append(f"coalesce(max(CASE WHEN type = '{t}' THEN {m} END), 0) AS {t}_{m}")
    return Q.with_ctes(SPAN_CTES + [("bt", _prf_sql("cnt", "type, gold::BIGINT AS support, "))], "SELECT " + ", ".join(cols) + " FROM bt")


@query("metric_spans_flat", _flat_sql())
def metric_spans_flat(spark, sf):
    """A12 flattened to ``{type}_{metric}`` columns."""
    m = M.span_metrics_by_type(_tags(spark, sf), "gold", "pred")
    m = m.select("type", "support", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))
    return M.flatten_by_type(m, ["x", "y"])


# PICO-like tags: plain class names without a prefix, made of the same digests
_PLAIN_CTES = [
    (name, sql.replace("FROM tags", "FROM plain"))
    for name, sql in SPAN_CTES
    if name not in ("t0", "t1", "tags", "tagdim")
]
_PLAIN = [
    c for c in SPAN_CTES if c[0] in ("t0", "t1", "tags")
] + [
    (
        "plain",
        "SELECT doc_id, list_transform(gold, lambda t: CASE WHEN t = 'O' THEN t WHEN substr(t, 3) = 'x' THEN 'Baseline' ELSE 'Outcome' END) AS gold, "
        "list_transform(pred, lambda t: CASE WHEN t = 'O' THEN t WHEN substr(t, 3) = 'x' THEN 'Baseline' ELSE 'Outcome' END) AS pred FROM tags",
    )
]


@query("metric_spans_plain_tags", Q.with_ctes(_PLAIN + _PLAIN_CTES, _prf_sql("cnt", "type, gold::BIGINT AS support, ")))
def metric_spans_plain_tags(spark, sf):
    """A12 over tags without a prefix: the whole token is the class."""

    def plain(c):
        return F.transform(c, lambda t: F.when(t == "O", t).when(F.substr(t, F.lit(3)) == "x", F.lit("Baseline")).otherwise(F.lit("Outcome")))

    t = _tags(spark, sf).select("doc_id", plain("gold").alias("gold"), plain("pred").alias("pred"))
    m = M.span_metrics_by_type(t, "gold", "pred")
    return m.select("type", "support", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


@query(
    "metric_token_accuracy_unequal",
    Q.with_ctes(
        tags_ctes() + [("u", "SELECT gold, pred[1:(len(pred) * 3) // 4] AS pred FROM tags")],
        "SELECT round(sum(len(list_filter(range(1, len(gold) + 1), lambda i: i <= len(pred) AND gold[i] = pred[i]))) / sum(len(gold)), 6) AS accuracy FROM u",
    ),
)
def metric_token_accuracy_unequal(spark, sf):
    """A12 token accuracy where predictions stop after three quarters of a sequence: the rest counts as wrong."""
    t = _tags(spark, sf).withColumn("pred", F.slice("pred", F.lit(1), F.floor(F.size("pred") * 3 / 4).cast("int")))
    return M.token_accuracy(t, "gold", "pred").select(_r("accuracy", "accuracy"))
