"""Indexes of a compiled state: events, entities and claims under ids that never change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.functions import names as N
from vespera.functions import text as X
from vespera.operators import graph, merge

IDS = "key string, num long"


def _ids(rows: DataFrame, prefix: str, prior: DataFrame | None) -> DataFrame:
    old = rows.sparkSession.createDataFrame([], IDS) if prior is None else prior
    return merge.stable_ids(old, rows.select("key", "seq"), prefix)


def numbers(index: DataFrame, id_col: str) -> DataFrame:
    """key, num of an index, as the next build takes them."""
    return index.select("key", F.regexp_extract(id_col, r"(\d+)$", 1).cast("long").alias("num"))


def events(merged: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """event_id, key, ts, event_type, description, source_path, evidence_text, confidence. merged: seq, ts, description, path."""
    e = merged.withColumn("key", F.concat_ws("|", "ts", "description", "path"))
    x = e.join(_ids(e, "evt", prior), "key")
    return x.select(F.col("id").alias("event_id"), "key", "ts", X.event_type(F.col("description")).alias("event_type"), "description", F.col("path").alias("source_path"), F.col("description").alias("evidence_text"), F.lit("Medium").alias("confidence"))


def entities(merged: DataFrame, iocs: DataFrame, claims: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """entity_id, key, entity_type, value, source_paths, related_pages (the entities page, and those whose indicators or hypotheses hold the value)."""
    e = merged.withColumn("key", F.concat_ws(":", "type", "key"))
    labels = e.select(F.col("value").alias("label"), "key")
    in_iocs = graph.matches(iocs.select(F.lit("iocs").alias("qid"), F.concat_ws(" ", "artifact", "reason").alias("question")), labels)
    told = F.concat_ws(" ", F.array_join("facts", " "), "inference", F.array_join("supporting", " "))
    in_claims = graph.matches(claims.select(F.lit("hypotheses").alias("qid"), told.alias("question")), labels)
    pages = in_iocs.unionByName(in_claims).groupBy("key").agg(F.collect_set("qid").alias("named"))  # two values at most
    x = e.join(_ids(e, "ent", prior), "key").join(pages, "key", "left")
    related = F.array_sort(F.concat(F.array(F.lit("entities")), F.coalesce("named", F.array().cast("array<string>"))))
    return x.select(F.col("id").alias("entity_id"), "key", F.col("type").alias("entity_type"), "value", F.col("sources").alias("source_paths"), related.alias("related_pages"))


def claims(claimed: DataFrame, against: DataFrame) -> DataFrame:
    """claim_id, claim_type, claim_text, confidence, supporting_evidence, contradicting_evidence (source_path, evidence_text), linked_pages."""
    cited = F.filter(F.transform("facts", lambda f: F.struct(N.source_path(f).alias("source_path"), f.alias("evidence_text"))), lambda x: x["source_path"] != "")
    b = against.where(F.col("claim_b").contains("(Source: ")).groupBy("path").agg(F.array_sort(F.collect_set("claim_b")).alias("said"))
    by_claim = claimed.select("claim_id", F.explode("contradicting").alias("path")).join(b, "path", "left")
    contra = by_claim.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("source_path"), F.array_join("said", " ").alias("evidence_text")))).alias("contradicting_evidence"))
    x = claimed.join(contra, "claim_id", "left")
    none = F.expr("cast(array() as array<struct<source_path:string,evidence_text:string>>)")
    pages = F.when(F.size("contradicting") > 0, F.array(F.lit("contradictions"), F.lit("hypotheses"))).otherwise(F.array(F.lit("hypotheses")))
    return x.select("claim_id", F.lit("hypothesis").alias("claim_type"), F.concat("title", F.when(F.col("inference") != "", F.concat(F.lit(": "), "inference")).otherwise("")).alias("claim_text"), "confidence", cited.alias("supporting_evidence"), F.coalesce("contradicting_evidence", none).alias("contradicting_evidence"), pages.alias("linked_pages"))
