"""Strictness in the same pass: operators that count what they lose while they run (``DataFrame.observe``).

Each function returns (rows, observation); after an action on the rows,
``observation.get`` holds the counts.  Nothing is read or joined a second time.
With ``strict`` the job itself fails at the first row that would be lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .filters import drop_blank_pages
from .tasks import after_colon, latest_entities, relation_prompt


def counted(df: DataFrame, name: str, lost: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Observe the number of rows and of those that meet each condition."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in lost.items()]), seen


def _kept(df: DataFrame, keep: Column, strict: bool, message: str) -> DataFrame:
    if strict:
        keep = F.when(keep, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(keep)


def relation_join_counted(abstracts: DataFrame, entities: DataFrame, relations: DataFrame, strict: bool = False) -> tuple[DataFrame, Observation]:
    """J1 + J6: as ``relation_join``; counts relations without their first or second entity or their abstract."""
    ents = latest_entities(entities).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "text"))).alias("_ents"))
    rel = relations.select("doc_id", "grp", after_colon("arg1").alias("a1"), after_colon("arg2").alias("a2"))
    texts = abstracts.select("doc_id", "text", F.lit(True).alias("_there"))
    j = rel.join(ents, "doc_id", "left").join(texts, "doc_id", "left")
    lost = {arg: ~F.coalesce(F.map_contains_key("_ents", F.col(a)), F.lit(False)) for arg, a in (("arg1", "a1"), ("arg2", "a2"))}
    lost["abstract"] = F.col("_there").isNull()
    j, seen = counted(j, "relations", lost)
    j = _kept(j, ~(lost["arg1"] | lost["arg2"] | lost["abstract"]), strict, "relations reference missing entities or abstracts")
    j = j.withColumn("e1", F.col("_ents")[F.col("a1")]).withColumn("e2", F.col("_ents")[F.col("a2")]).where("e1 IS NOT NULL AND e2 IS NOT NULL")
    return j.select("doc_id", relation_prompt(F.col("e1"), F.col("e2"), F.col("text")).alias("sample"), F.col("grp").alias("target")), seen


def label_encode_counted(df: DataFrame, label: str, dim: DataFrame, out: str = "label_id", strict: bool = False) -> tuple[DataFrame, Observation]:
    """As ``label_encode``; counts the rows whose label is not in the dimension (they drop out)."""
    j = df.join(dim.select(F.col("label").alias(label), F.col("id").alias(out)), label, "left")
    unseen = F.col(out).isNull()
    j, seen = counted(j, "labels", {"unseen": unseen})
    return _kept(j, ~unseen, strict, f"unseen label in {label}"), seen


def well_formed_lines(lines: DataFrame, fields: int = 6, value: str = "value", strict: bool = False) -> tuple[DataFrame, Observation]:
    """The good rows of ``split_malformed`` (with ``parts``); counts the rejected ones."""
    parts = lines.withColumn("parts", F.split(F.col(value), "\t", fields))
    good = F.coalesce((F.length(F.col(value)) > 0) & (F.size("parts") >= fields), F.lit(False))
    parts, seen = counted(parts, "lines", {"rejected": ~good})
    return _kept(parts, good, strict, "malformed line"), seen


def pages_counted(df: DataFrame, pages: str = "pages") -> tuple[DataFrame, Observation]:
    """As ``drop_blank_pages``; counts rows without pages, and rows that lose blank ones."""
    blank = F.exists(F.col(pages), lambda p: p == "")
    df, seen = counted(df, "pages", {"without": F.col(pages).isNull(), "with_blank": F.coalesce(blank, F.lit(False))})
    return drop_blank_pages(df, pages), seen


def ddi_relations_counted(sentences: DataFrame, keep=()) -> tuple[DataFrame, Observation]:
    """J2 + P9: as ``ddi_relations``; counts the pairs with an argument that is not exactly one entity."""
    keep = list(keep)
    chosen = F.filter("pair", lambda p: (p["_ddi"] == "true") & p["_type"].isNotNull())
    rows = sentences.select(*keep, "_text", "entity", F.explode_outer(chosen).alias("p")).where(F.col("p").isNotNull())

    def hits(eid):
        return F.filter("entity", lambda e: e["_id"] == F.col(eid))

    rows = rows.select(*keep, "_text", "p", hits("p._e1").alias("h1"), hits("p._e2").alias("h2"))
    ambiguous = ~F.coalesce((F.size("h1") == 1) & (F.size("h2") == 1), F.lit(False))
    rows, seen = counted(rows, "pairs", {"ambiguous": ambiguous})
    e1, e2 = (F.get(F.col(h), 0)["_text"] for h in ("h1", "h2"))
    out = rows.where(~ambiguous).withColumn("e1", e1).withColumn("e2", e2).where("e1 IS NOT NULL AND e2 IS NOT NULL")
    return out.select(*keep, relation_prompt(F.col("e1"), F.col("e2"), F.col("_text")).alias("sample"), F.col("p._type").alias("target")), seen
