"""Queries of a given extractor, a given embedder, JSON of unknown shape and the advice on critical findings, with SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vespera.catalog import ORACLES, query, t
from vespera.functions import text as X
from vespera.operators import embed, lint, vector_index
from vespera.sources import extractor, shapes, storage

MAIL = r"[a-z0-9._]+@[a-z0-9.-]+"


def _addresses(texts):
    """An extractor in the form that one which asks a model has: a list of facts a text."""
    ip, mail = re.compile(X.IP), re.compile(MAIL)
    return [[{"type": " IP ", "value": v, "confidence": "High"} for v in ip.findall(s)] + [{"type": "Mail Box", "value": v} for v in mail.findall(s)] for s in texts]


@query(f"""WITH f AS (SELECT 'd' || doc_id AS path, regexp_extract_all(text, '{X.IP}') AS ips, regexp_extract_all(text, '{MAIL}') AS mails FROM documents),
 e AS (SELECT path, len(ips) AS k, unnest(list_concat(ips, mails)) AS value, generate_subscripts(list_concat(ips, mails), 1) - 1 AS n FROM f)
 SELECT path, n, CASE WHEN n < k THEN 'ip' ELSE 'other' END AS type, value, CASE WHEN n < k THEN 'High' ELSE 'Low' END AS confidence, CASE WHEN n >= k THEN 'unknown type kept as other: Mail Box' END AS note FROM e""")
def extract_facts(spark, sf_dir):
    """Half of the documents are asked first; the other run finds their answers kept."""
    memo = storage.scratch(spark, "memo")
    files = t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha"), "text")
    extractor.answered(files.where(F.col("sha") < "8"), _addresses, memo)
    return extractor.facts(files, _addresses, memo)


@query(ORACLES["hash_cosine_topk"])
def embedded_topk(spark, sf_dir):
    """Documents through an embedder into a stored index; an exact search of it."""
    root, docs = storage.scratch(spark, "embedded"), t(spark, sf_dir, "documents")
    vector_index.build(embed.embedded(docs), root, "doc_id")
    asked = embed.embedded(docs.where("doc_id = 1")).first()
    found = vector_index.search(spark, root, asked["embedding"], 10, digits=6)
    return found.select(F.col("id").alias("doc_id"), "cosine").where("cosine > 0")


SHAPES = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"who": "' || event_type || '", "n": ' || user_id || ', "tags": ["a", ' || event_id || ']}'
 WHEN 2 THEN '{"in": {"k": ' || user_id || '}, "gone": null, "ok": true}' WHEN 3 THEN '[1, 2]' ELSE '{"broken' END"""


@query(f"""WITH s AS (SELECT event_id, {SHAPES} AS j FROM events), o AS (SELECT event_id, j::JSON AS j FROM s WHERE event_id % 5 < 3), m AS (SELECT event_id, j, unnest(json_keys(j)) AS name FROM o)
 SELECT event_id, name, CASE json_type(j, '$.' || name) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE json_type(j, '$.' || name) END AS type, replace(json_extract_string(j, '$.' || name), ', ', ',') AS value FROM m""")
def json_members(spark, sf_dir):
    """Objects of several shapes, arrays and broken texts in one column."""
    return shapes.members(t(spark, sf_dir, "events").select("event_id", F.expr(SHAPES).alias("j")), "event_id", "j")


@query(f"SELECT 'ARRAY<BIGINT>' AS shape, count(*) FILTER (event_id % 5 = 3) AS n, count(*) FILTER (event_id % 5 = 4) AS n_broken FROM (SELECT event_id, {SHAPES} AS j FROM events WHERE event_id % 5 > 2)")
def json_shape(spark, sf_dir):
    return shapes.shape(t(spark, sf_dir, "events").where("event_id % 5 > 2").select(F.expr(SHAPES).alias("j")), "j")


@query("""WITH f AS (SELECT CASE WHEN html LIKE '%<table%' THEN 'C2' ELSE 'L2' END AS rule, CASE WHEN html LIKE '%<table%' THEN 'Critical' ELSE 'Low' END AS severity, page_id || '' AS page, url AS detail FROM pages)
 SELECT * FROM f UNION ALL SELECT 'C5', 'Critical', '(meta)', 'critical findings: hold risky changes for review' FROM f WHERE severity = 'Critical' HAVING count(*) > 0""")
def lint_c5(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    bad = F.contains("html", F.lit("<table"))
    page = F.col("page_id").cast("string")
    return lint.with_meta(lint.finding(p.where(bad), "C2", "Critical", page, F.col("url")).unionByName(lint.finding(p.where(~bad), "L2", "Low", page, F.col("url"))))
