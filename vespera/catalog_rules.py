"""Queries of rules, answers, evaluation, review, replay and pages over the tables, and SQL over the tables for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.catalog import ROUTE, TOKENS, _array, _list, query, t
from vespera.functions import names as N
from vespera.functions import text as X
from vespera.operators import evaluate, graph, lint, merge, retrieval, review
from vespera.plans import answers, methods, pages, replay, report

def _none():
    return F.array().cast("array<string>")


# ---- lint: one scene of pages, claims, contradictions, entities, indicators, files; one query a rule

SCENE = """WITH body AS (SELECT 'p' || doc_id AS page, text || chr(10) || '[[p' || (doc_id + 1) || ']] [[p' || doc_id || 'x.md|X]] (Source: docs/' || (doc_id % 40) || '.txt) claim_' || lpad((doc_id % 90) || '', 4, '0') || ' claim_' || (7000 + doc_id % 90) || chr(10)
   || CASE doc_id % 4 WHEN 0 THEN 'a Confirmed Malware here' WHEN 1 THEN 'the analyst says confirmed malware' WHEN 2 THEN 'data was stolen, definite malware' ELSE 'Contradiction ' || doc_id END AS body FROM documents),
 cl AS (SELECT doc_id, printf('claim_%04d', doc_id) AS claim_id, 'Claim ' || doc_id AS title, CASE WHEN quality = 1 AND toxic = 1 THEN 'High' WHEN quality = 1 THEN 'Medium' WHEN toxic = 1 THEN 'Confirmed' ELSE 'Low' END AS confidence,
   CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'on it' END AS inference, CASE doc_id % 4 WHEN 0 THEN 0 ELSE 1 END AS n_facts, CASE doc_id % 4 WHEN 1 THEN 'seen (Source: docs/1.txt)' ELSE 'a bare fact' END AS fact, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS n_sup, doc_id % 6 = 0 AS against FROM labels),
 con AS (SELECT 'Contradiction ' || n_nationkey AS title, n_nationkey || ' contradicts' AS claim_a FROM nation), f AS (SELECT DISTINCT 'docs/' || (doc_id % 30) || '.txt' AS path FROM documents), mf AS (SELECT DISTINCT 'docs/' || (doc_id % 20) || '.txt' AS path FROM documents),
 en AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'process' ELSE 'host' END AS type, p_brand || '_' || (p_partkey % 50) AS value, 'docs/' || (p_partkey % 9) || '.txt' AS source FROM part),
 io AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Brand#1_' || s_suppkey END AS artifact, 'docs/' || (s_suppkey % 12) || '.txt' AS source FROM supplier)"""
RULES: dict[str, str] = {
    "H1": "SELECT 'H1' AS rule, 'High' AS severity, page, '' AS detail FROM (VALUES ('index'), ('p1'), ('timeline')) AS n(page) WHERE page NOT IN (SELECT page FROM body)",
    "C1": "SELECT 'C1' AS rule, 'Critical' AS severity, page, CASE WHEN contains(lower(line), 'confirmed malware') THEN 'confirmed malware' ELSE 'definite malware' END AS detail FROM (SELECT page, unnest(string_split(body, chr(10))) AS line FROM body) WHERE (contains(lower(line), 'confirmed malware') OR contains(lower(line), 'definite malware')) AND NOT contains(lower(line), 'analyst')",
    "C2": "SELECT 'C2' AS rule, 'Critical' AS severity, page, 'confirmed malware' AS detail FROM body WHERE page = 'p1'",
    "C3": "SELECT DISTINCT 'C3' AS rule, 'Critical' AS severity, page, d AS detail FROM (SELECT page, 'docs/' || (substr(page, 2)::INT % 40) || '.txt' AS d FROM body) WHERE d NOT IN (SELECT path FROM f)",
    "C4": "SELECT 'C4' AS rule, 'Critical' AS severity, page, 'data was stolen' AS detail FROM body WHERE contains(body, 'data was stolen')",
    "H2": "SELECT 'H2' AS rule, 'High' AS severity, path AS page, '' AS detail FROM f WHERE path NOT IN (SELECT path FROM mf)",
    "H3": "SELECT 'H3' AS rule, 'High' AS severity, 'hypotheses' AS page, title AS detail FROM cl WHERE confidence IN ('High', 'Confirmed')",
    "H4": "SELECT 'H4' AS rule, 'High' AS severity, page, d AS detail FROM (SELECT page, unnest(['claim_' || lpad((substr(page, 2)::INT % 90) || '', 4, '0'), 'claim_' || (7000 + substr(page, 2)::INT % 90)]) AS d FROM body WHERE page = 'p1') WHERE d NOT IN (SELECT claim_id FROM cl)",
    "M1": "SELECT 'M1' AS rule, 'Medium' AS severity, 'hypotheses' AS page, title AS detail FROM cl WHERE NOT against AND doc_id NOT IN (SELECT n_nationkey FROM nation)",
    "M2": "SELECT 'M2' AS rule, 'Medium' AS severity, 'hypotheses' AS page, title AS detail FROM cl WHERE (inference <> '' AND n_facts = 0) OR n_sup = 0",
    "M3": "SELECT 'M3' AS rule, 'Medium' AS severity, 'hypotheses' AS page, title AS detail FROM cl WHERE n_facts = 1 AND fact = 'a bare fact'",
    "M4": "SELECT 'M4' AS rule, 'Medium' AS severity, 'e' || event_id AS page, '' AS detail FROM events WHERE ts + INTERVAL 5 SECOND < TIMESTAMP '2024-01-10 00:00:00'",
    "M5": "SELECT 'M5' AS rule, 'Medium' AS severity, page, d AS detail FROM (SELECT page, 'p' || (substr(page, 2)::INT + 1) AS d FROM body UNION ALL SELECT page, page || 'x' FROM body) WHERE d NOT IN (SELECT page FROM body)",
    "M6": "SELECT 'M6' AS rule, 'Medium' AS severity, 'contradictions' AS page, title AS detail FROM con WHERE NOT EXISTS (SELECT 1 FROM body WHERE page = 'p7' AND contains(lower(body), lower(title)))",
    "L1": "SELECT 'L1' AS rule, 'Low' AS severity, 'entities' AS page, lower(value) AS detail FROM en GROUP BY lower(value) HAVING count(DISTINCT type) > 1 AND bool_or(type = 'host')",
    "L2": "SELECT 'L2' AS rule, 'Low' AS severity, page, '' AS detail FROM body WHERE page NOT IN (SELECT 'p' || (substr(page, 2)::INT + 1) FROM body)",
    "L3": "SELECT 'L3' AS rule, 'Low' AS severity, 'entities' AS page, value AS detail FROM (SELECT type, min(value) AS value FROM en GROUP BY type, lower(value)) WHERE NOT EXISTS (SELECT 1 FROM body WHERE contains(lower(body), lower(value)))",
    "L5": "SELECT 'L5' AS rule, 'Low' AS severity, 'iocs' AS page, artifact AS detail FROM io WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.source = io.source AND lower(en.value) <> lower(artifact))",
}


def scene(spark, sf_dir, weak: bool = False) -> dict[str, DataFrame]:
    """Findings by rule over the scene. weak: no claim is strong, the report is p1 and names contradictions p7 as their page."""
    d, at = t(spark, sf_dir, "documents"), F.col("doc_id")
    said = F.when(at % 4 == 0, "a Confirmed Malware here").when(at % 4 == 1, "the analyst says confirmed malware").when(at % 4 == 2, "data was stolen, definite malware").otherwise(F.concat(F.lit("Contradiction "), at))
    body = d.select(F.concat(F.lit("p"), at).alias("page"), F.expr("text || chr(10) || '[[p' || (doc_id + 1) || ']] [[p' || doc_id || 'x.md|X]] (Source: docs/' || (doc_id % 40) || '.txt) claim_' || lpad((doc_id % 90) || '', 4, '0') || ' claim_' || (7000 + doc_id % 90) || chr(10)").alias("body"), said.alias("said"))
    body = body.select("page", F.concat("body", "said").alias("body"))
    good, tox = F.col("quality") == 1, F.col("toxic") == 1
    sure = F.when(good & tox, "High").when(good, "Medium").when(tox, "Confirmed").otherwise("Low") if not weak else F.lit("Low")
    claims = t(spark, sf_dir, "labels").select(
        F.format_string("claim_%04d", at).alias("claim_id"), F.concat(F.lit("Claim "), at).alias("title"), sure.alias("confidence"), F.when(at % 3 == 0, "").otherwise("on it").alias("inference"),
        F.when(at % 4 == 0, _none()).when(at % 4 == 1, F.array(F.lit("seen (Source: docs/1.txt)"))).otherwise(F.array(F.lit("a bare fact"))).alias("facts"),
        F.when(at % 5 == 0, _none()).otherwise(F.array(F.lit("docs/1.txt"))).alias("supporting"), F.when(at % 6 == 0, F.array(F.lit("x"))).otherwise(_none()).alias("contradicting"),
    )
    con = t(spark, sf_dir, "nation").select(F.concat(F.lit("Contradiction "), "n_nationkey").alias("title"), F.concat("n_nationkey", F.lit(" contradicts")).alias("claim_a"))
    path = lambda k: d.select(F.concat(F.lit("docs/"), at % k, F.lit(".txt")).alias("path")).distinct()
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    en = t(spark, sf_dir, "part").select(F.when(p % 3 == 0, "file").when(p % 3 == 1, "process").otherwise("host").alias("type"), F.concat("p_brand", F.lit("_"), p % 50).alias("value"), F.concat(F.lit("docs/"), p % 9, F.lit(".txt")).alias("source"), p.alias("seq"))
    io = t(spark, sf_dir, "supplier").select(F.when(s % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("Brand#1_"), s)).alias("artifact"), F.concat(F.lit("docs/"), s % 12, F.lit(".txt")).alias("source"))
    stale = lint.stale(t(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("page"), F.col("ts").alias("modified")), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    entities = merge.merge_entities(en)
    if weak:
        body = body.withColumn("page", F.when(F.col("page") == "p7", "contradictions").otherwise(F.col("page")))
    return lint.rules(body, body.select("page"), claims, con, entities, io, path(20), path(30), stale, ("index", "p1", "timeline", "p2") if not weak else ("p2",), "p1" if weak else "p2")


def _rule(name: str) -> None:
    # C2 needs a state without a strong claim; M6 a page of contradictions
    weak = name in ("C1", "C2", "C4", "H4", "M6")

    def run(spark, sf_dir):
        return scene(spark, sf_dir, weak)[name]

    run.__name__, run.__module__ = f"lint_{name.lower()}", __name__
    query(f"{SCENE} {RULES[name]}")(run)


for _name in RULES:
    _rule(_name)


# ---- words, names, types

@query(f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x NOT IN {_list(X.QUESTION_STOPWORDS)}), ' ') AS tokens FROM conversations")
def question_tokens(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.question_tokens(F.col("text")), " ").alias("tokens"))


@query(f"""WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_type || ' ' WHEN 1 THEN 'Registry Key' WHEN 2 THEN 'IP' ELSE 'Url ' END AS label FROM part)
 SELECT p_partkey, CASE WHEN replace(lower(trim(label)), ' ', '_') IN {_list(N.ENTITY_TYPES)} THEN replace(lower(trim(label)), ' ', '_') ELSE 'other' END AS type, CASE WHEN replace(lower(trim(label)), ' ', '_') IN {_list(N.ENTITY_TYPES)} THEN NULL ELSE 'unknown type kept as other: ' || label END AS note FROM l""")
def known_types(spark, sf_dir):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, F.concat(F.lit(" "), "p_type", F.lit(" "))).when(k == 1, "Registry Key").when(k == 2, "IP").otherwise("Url ")
    return t(spark, sf_dir, "part").select("p_partkey", N.known_type(label).alias("x")).select("p_partkey", "x.type", "x.note")


@query(rf"SELECT value, NOT (starts_with(value, '10.') OR starts_with(value, '192.168.') OR starts_with(value, '172.16.') OR starts_with(value, '127.')) AS notable, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{X.IP}')) AS value FROM documents UNION ALL SELECT '10.0.0.' || s_suppkey FROM supplier) GROUP BY 1")
def notable_ips(spark, sf_dir):
    a = t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(X.IP), F.lit(0))).alias("value"))
    b = t(spark, sf_dir, "supplier").select(F.concat(F.lit("10.0.0."), "s_suppkey").alias("value"))
    return a.unionByName(b).groupBy("value", N.notable_ip(F.col("value")).alias("notable")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS echoed FROM documents""")
def echoed_overclaims(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Definitely "), F.lit("MALICIOUS"))).otherwise(" definitely not"))
    return t(spark, sf_dir, "documents").select("doc_id", N.echoes(text).alias("echoed"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE source || '/' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 2 = 0 THEN '(Source: ' || source || ')' ELSE '[[' || source || ']]' END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' - ' || lang END AS cited FROM documents")
def citations(spark, sf_dir):
    k = F.col("doc_id")
    path = F.concat("source", F.lit("/"), k, F.lit(".txt"))
    text = F.when(k % 3 == 0, F.concat(F.lit("seen (Source: "), path, F.lit(").,; and more"))).when(k % 3 == 1, F.concat(F.lit("Evidence: "), path, F.lit(");"))).otherwise("nothing cited")
    note = F.when(k % 10 == 0, F.lit(None)).when(k % 5 == 0, "").otherwise(F.col("lang"))
    return t(spark, sf_dir, "documents").select("doc_id", N.source_path(text).alias("path"), N.citation(F.when(k % 2 == 0, "source").otherwise("page"), F.col("source"), note).alias("cited"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_extract(replace(url, '/', chr(92)), '[^' || chr(92) || chr(92) || ']*$') AS same FROM pages")
def base_names(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.basename(F.col("url")).alias("base"), X.basename(F.replace("url", F.lit("/"), F.lit("\\"))).alias("same"))


@query("""WITH b AS (SELECT doc_id AS page, 'see [[p' || (doc_id % 7) || '#part|Name]] and [[dir/q' || (doc_id % 3) || '.md]] [[ r ]]' AS body FROM documents) SELECT page, 'p' || (page % 7) AS target FROM b UNION ALL SELECT page, 'q' || (page % 3) FROM b UNION ALL SELECT page, 'r' FROM b""")
def page_links(spark, sf_dir):
    body = F.expr("'see [[p' || (doc_id % 7) || '#part|Name]] and [[dir/q' || (doc_id % 3) || '.md]] [[ r ]]'")
    return lint.links(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), body.alias("body")))


# ---- matching names in texts

@query("SELECT doc_id, label FROM documents, (SELECT n_name AS label FROM nation UNION SELECT DISTINCT event_type FROM events UNION SELECT 'token' UNION SELECT 'li' UNION SELECT 'e' UNION SELECT 'idiot') AS l WHERE contains(lower(text), lower(label))")
def labels_in_texts(spark, sf_dir):
    few = spark.createDataFrame([("token",), ("li",), ("e",), ("idiot",)], "label string")
    labels = t(spark, sf_dir, "nation").select(F.col("n_name").alias("label")).unionByName(t(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()).unionByName(few)
    return graph.matches(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question")), labels).select(F.col("qid").alias("doc_id"), "label")


def _asked_nations(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("Which source files mention "), "n_name", F.lit("?")).alias("question"))


NAMED = """WITH n AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM nation o WHERE o.n_name <> nation.n_name AND starts_with(nation.n_name, o.n_name)) THEN 1 ELSE 0 END AS longer FROM nation), tell AS (SELECT 'events/' || (event_id % 40) || '.csv' AS path, 'Nation_' || (user_id % 30) || ' did ' || event_type AS d FROM events),
 m AS (SELECT n_nationkey AS qid, n_name AS label, 'nations/' || (n_regionkey) || '.txt' AS path FROM nation UNION SELECT n_nationkey, n_name, path FROM nation JOIN tell ON contains(lower(d), lower(n_name)) UNION SELECT n_nationkey, n_name, 'files/' || n_name || '_report.txt' FROM nation
  UNION SELECT a.n_nationkey, a.n_name, 'files/' || b.n_name || '_report.txt' FROM nation a JOIN nation b ON contains(lower(b.n_name), lower(a.n_name)))"""


@query(NAMED + " SELECT qid, label, string_agg(path, ',' ORDER BY path) AS paths FROM m GROUP BY 1, 2")
def sources_that_mention(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    path = F.concat(F.lit("nations/"), "n_regionkey", F.lit(".txt"))
    entities = n.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("seq"), F.lit("host").alias("type"), F.lower("n_name").alias("key"), F.array(path).alias("sources"))
    events = t(spark, sf_dir, "events").select(F.concat(F.lit("events/"), F.col("event_id") % 40, F.lit(".csv")).alias("path"), F.concat(F.lit("Nation_"), F.col("user_id") % 30, F.lit(" did "), "event_type").alias("description"))
    files = n.select(F.concat(F.lit("files/"), "n_name", F.lit("_report.txt")).alias("path"), F.lit("nothing").alias("text"))
    found = answers.mentioning(answers.named(_asked_nations(spark, sf_dir), entities), events, files)
    return found.select("qid", "label", F.array_join("paths", ",").alias("paths"))


# ---- answers

PHRASES = (
    "is this confirmed malware?", "is it signed?", "does it persist", "any beacon in the network", "which evidence contradicts the claim", "what next step should we look at", "was data stolen",
    "overall assessment please", "which source files mention nation_", "idle tools", "hello",
)
CLAIMS = (("claim_0001", "Persistence of a tool", "Medium", "It starts at logon."), ("claim_0002", "Outbound beacon to a public address", "Low", "It talks."))
_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda x: x NOT IN {_list(X.QUESTION_STOPWORDS)} AND x <> ''))"
STATE = f"""WITH a AS (SELECT conv_id * 100 + turn AS qid, coalesce(text, '') || ' ' || {_array(PHRASES)}[(conv_id % 11 + 1)::INT] || CASE WHEN conv_id % 11 = 8 THEN (conv_id % 30) || '' ELSE '' END AS question FROM conversations WHERE role = 'user'),
 q AS (SELECT *, {ROUTE} AS route FROM (SELECT *, lower(question) AS q FROM a)), w AS (SELECT qid, unnest({_WORDS.format('question')}) AS w FROM q WHERE route = 'generic'),
 c(claim_id, title, confidence, inference) AS (VALUES {', '.join(map(str, CLAIMS))}), mh AS (SELECT qid, arg_min(c, claim_id) AS h FROM w JOIN (SELECT c, claim_id, unnest({_WORDS.format("title || ' ' || inference")}) AS w FROM c) USING (w) GROUP BY 1),
 mi AS (SELECT qid, arg_min(r_name, r_regionkey) AS i FROM w JOIN (SELECT r_name, r_regionkey, unnest({_WORDS.format("r_name || ' seen'")}) AS w FROM region) USING (w) GROUP BY 1),
 e AS (SELECT o_orderkey AS k, 'net' || (o_orderkey % 5) || '.csv' AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'tool' || o_orderkey || '.exe connected to 203.0.113.' || (o_orderkey % 7) ELSE 'idle' END AS d FROM orders),
 e5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k % 2 ORDER BY k) AS r FROM e) WHERE r <= 5), met AS (SELECT DISTINCT qid, k, path, d FROM w JOIN (SELECT *, unnest({_WORDS.format('d')}) AS w FROM e5) USING (w)),
 me AS (SELECT qid, least(5, count(*)) AS n, arg_min(d, k) AS d, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k) AS r FROM met) WHERE r <= 5 GROUP BY 1),
 ms AS (SELECT qid, arg_max(n_name, length(n_name) * 1000 - n_nationkey) AS label, arg_max(n_regionkey, length(n_name) * 1000 - n_nationkey) AS region FROM q JOIN nation ON route = 'sources' AND contains(q, lower(n_name)) GROUP BY 1)"""


def _state(spark, sf_dir) -> answers.Tables:
    more = ((["auto (Source: a.reg)", "more (Source: b.reg)"], ["a.reg", "b.reg"], ["s.txt"]), (["seen (Source: n.csv)"], ["n.csv"], []))
    claims = spark.createDataFrame([(*c, *m) for c, m in zip(CLAIMS, more)], "claim_id string, title string, confidence string, inference string, facts array<string>, supporting array<string>, contradicting array<string>")
    o, r, n = (t(spark, sf_dir, x) for x in ("orders", "region", "nation"))
    events = o.select(F.lit("unknown").alias("ts"), F.format_string("%09d", "o_orderkey").alias("seq"), F.concat(F.lit("net"), F.col("o_orderkey") % 5, F.lit(".csv")).alias("path"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("tool"), "o_orderkey", F.lit(".exe connected to 203.0.113."), F.col("o_orderkey") % 7)).otherwise("idle").alias("description"))
    con = r.select(F.col("r_name").alias("title"), F.lit("a").alias("claim_a"), F.concat(F.lit("no (Source: "), "r_name", F.lit(".txt)")).alias("claim_b"))
    iocs = r.select(F.col("r_name").alias("artifact"), F.lit("host").alias("type"), F.lit("High").alias("confidence"), F.lit("seen").alias("reason"), F.format_string("%09d", "r_regionkey").alias("seq"))
    entities = n.select(F.col("n_name").alias("value"), F.format_string("%09d", "n_nationkey").alias("seq"), F.lit("host").alias("type"), F.lower("n_name").alias("key"), F.array(F.concat(F.lit("nations/"), "n_regionkey", F.lit(".txt"))).alias("sources"))
    return answers.Tables(claims, iocs, con, events, entities, n.select(F.col("n_name").alias("path")))


@query(STATE + """, x AS (SELECT count(*) AS n_con, string_agg(r_name || '.txt', ',' ORDER BY r_name) AS con FROM region), y AS (SELECT count(*) FILTER (o_orderkey % 2 = 0) AS n_net, min(o_orderkey) FILTER (o_orderkey % 2 = 0) AS first FROM orders), s AS (SELECT string_agg(n_name, ',' ORDER BY n_name) AS src FROM nation),
 five AS (SELECT string_agg(DISTINCT 'net' || (o_orderkey % 5) || '.csv', ',' ORDER BY 'net' || (o_orderkey % 5) || '.csv') AS nets FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderkey LIMIT 5)),
 z AS (SELECT *, route = 'signature' OR (route = 'sources' AND label IS NULL) OR (route = 'generic' AND h IS NULL AND i IS NULL AND n IS NULL) AS insufficient FROM q LEFT JOIN mh USING (qid) LEFT JOIN mi USING (qid) LEFT JOIN me USING (qid) LEFT JOIN ms USING (qid))
 SELECT qid, route, insufficient, CASE WHEN insufficient THEN 'Evidence is insufficient.' WHEN route IN ('malware', 'exfiltration', 'compromise') THEN 'No. ' || upper(route[1]) || substr(route, 2) || ' is not confirmed.' WHEN route = 'persistence' THEN 'Persistence is a hypothesis: Persistence of a tool.'
   WHEN route = 'network' THEN 'Yes. ' || n_net || ' network event(s) are on record. A remote address to note: 203.0.113.' || (first % 7) || '.' WHEN route = 'contradiction' THEN n_con || ' contradiction(s) are on record.' WHEN route = 'next_steps' THEN 'Steps and questions that the hypotheses leave:'
   WHEN route = 'sources' THEN label || ' is mentioned in: nations/' || region || '.txt.' WHEN h IS NOT NULL THEN 'Hypothesis on record: ' || h.title || ' (confidence: ' || h.confidence || '). ' || h.inference WHEN i IS NOT NULL THEN 'Indicator on record: ' || i || ' (host, confidence: High). seen' ELSE n || ' event(s) of the timeline match. The first: ' || d END AS body,
  CASE WHEN insufficient OR route = 'network' THEN 'Low' WHEN route = 'sources' THEN 'High' WHEN route <> 'generic' THEN 'Medium' WHEN h IS NOT NULL THEN h.confidence WHEN i IS NOT NULL THEN 'High' ELSE 'Medium' END AS confidence,
  CASE WHEN insufficient THEN '' WHEN route IN ('malware', 'exfiltration', 'compromise') THEN src WHEN route = 'persistence' THEN 'a.reg,b.reg' WHEN route = 'network' THEN nets WHEN route = 'contradiction' THEN con WHEN route = 'sources' THEN 'nations/' || region || '.txt' WHEN route = 'generic' THEN coalesce(paths, '') ELSE '' END AS sources FROM z, x, y, s, five""")
def answers_routed(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") % 11 + 1).cast("int"))
    c = t(spark, sf_dir, "conversations").where("role = 'user'")
    named = F.concat(asked, F.when(F.col("conv_id") % 11 == 8, (F.col("conv_id") % 30).cast("string")).otherwise(""))
    q = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), named).alias("question"))
    x = answers.answers(q, _state(spark, sf_dir))
    return x.select("qid", "route", "insufficient", "body", "confidence", F.array_join(F.when(F.col("route") == "network", F.array_sort("sources")).otherwise(F.col("sources")), ",").alias("sources"))


GENERIC = f"""WITH q AS (SELECT n_nationkey AS qid, lower('tell about ' || n_name || ' ' || (['widget', 'bolt', 'error', 'nothingatall'])[(n_nationkey % 4 + 1)::INT]) AS question FROM nation),
 w AS (SELECT DISTINCT qid, unnest(list_filter(regexp_extract_all(question, '[a-z]+'), lambda x: x NOT IN {_list(X.QUESTION_STOPWORDS)})) AS w FROM q),
 h AS (SELECT p_partkey AS k, 'Part ' || p_name AS title, unnest(regexp_extract_all(lower('Part ' || p_name), '[a-z]+')) AS w FROM part WHERE p_name LIKE '%widget'), i AS (SELECT p_partkey AS k, p_name AS artifact, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part WHERE p_name LIKE '%bolt'),
 e AS (SELECT event_id AS k, event_type || ' of user' AS d, unnest([event_type, 'user']) AS w FROM events),
 mh AS (SELECT qid, min(printf('%09d', k) || title) AS x FROM w JOIN h USING (w) GROUP BY 1), mi AS (SELECT qid, min(printf('%09d', k) || artifact) AS x FROM w JOIN i USING (w) GROUP BY 1), me AS (SELECT qid, least(5, count(DISTINCT k)) AS n, arg_min(d, k) AS x FROM w JOIN e USING (w) GROUP BY 1)"""


@query(GENERIC + """ SELECT qid, CASE WHEN mh.x IS NOT NULL THEN 'Hypothesis on record: ' || substr(mh.x, 10) || ' (confidence: Low). why' WHEN mi.x IS NOT NULL THEN 'Indicator on record: ' || substr(mi.x, 10) || ' (part, confidence: High). sold' ELSE me.n || ' event(s) of the timeline match. The first: ' || me.x END AS body,
 CASE WHEN mh.x IS NOT NULL THEN 'hypothesis' WHEN mi.x IS NOT NULL THEN 'inference' ELSE 'fact' END AS classification FROM q LEFT JOIN mh USING (qid) LEFT JOIN mi USING (qid) LEFT JOIN me USING (qid) WHERE mh.x IS NOT NULL OR mi.x IS NOT NULL OR me.x IS NOT NULL""")
def answers_generic(spark, sf_dir):
    n, p, e = (t(spark, sf_dir, x) for x in ("nation", "part", "events"))
    q = n.select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("tell about "), "n_name", F.lit(" "), F.element_at(F.array(*map(F.lit, ("widget", "bolt", "error", "nothingatall"))), (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("question"))
    num = lambda c: F.format_string("%09d", c)
    claims = p.where("p_name like '%widget'").select(num("p_partkey").alias("claim_id"), F.concat(F.lit("Part "), "p_name").alias("title"), F.lit("Low").alias("confidence"), F.lit("why").alias("inference"))
    iocs = p.where("p_name like '%bolt'").select(num("p_partkey").alias("seq"), F.col("p_name").alias("artifact"), F.lit("part").alias("type"), F.lit("High").alias("confidence"), F.lit("sold").alias("reason"))
    events = e.select(num("event_id").alias("seq"), F.concat("event_type", F.lit(" of user")).alias("description"), F.lit("e.csv").alias("path"))
    return answers.generic(q, answers.Tables(claims, iocs, None, events, None, None)).select("qid", "body", "classification")


@query("SELECT conv_id, turn, 'Answer:' || chr(10) || role || chr(10) || chr(10) || 'Evidence:' || chr(10) || '- e' || conv_id || chr(10) || '- f' || chr(10) || chr(10) || 'Confidence:' || chr(10) || 'Low (fact)' || chr(10) || chr(10) || 'Pages:' || chr(10) || '- [[timeline]]' AS answer FROM conversations WHERE turn > 0 UNION ALL SELECT conv_id, turn, 'none' FROM conversations WHERE turn = 0")
def answers_rendered(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    x = c.select("conv_id", "turn", (F.col("turn") == 0).alias("insufficient"), F.when(F.col("turn") == 0, "none").otherwise(F.col("role")).alias("body"), F.array(F.concat(F.lit("e"), "conv_id"), F.lit("f")).alias("evidence"), _none().alias("caveats"), F.array(F.lit("timeline")).alias("pages"), _none().alias("sources"), F.lit("Low").alias("confidence"), F.lit("fact").alias("classification"))
    return x.select("conv_id", "turn", answers.rendered().alias("answer"))


@query("SELECT doc_id AS qid, doc_id % 2 = 0 AND doc_id % 3 > 0 AS insufficient, doc_id % 2 = 0 AND doc_id % 3 = 0 AS fell_back FROM documents")
def answers_fallback(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    told = d.select(F.col("doc_id").alias("qid"), F.lit("r").alias("route"), F.lit("hypothesis").alias("classification"), F.lit("Low").alias("confidence"), (F.col("doc_id") % 2 == 0).alias("insufficient"), F.lit("x").alias("answer"))
    found = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("qid"), F.col("source").alias("snippet"))
    return answers.with_fallback(told, found).select("qid", "insufficient", "fell_back")


# ---- retrieval for many questions

MANY = f"""WITH d AS (SELECT doc_id, {TOKENS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(greatest(len(ts), 1)) AS avgdl FROM d), q AS (SELECT item_id AS qid, t, count(*) AS weight FROM (SELECT item_id, unnest({TOKENS}) AS t FROM benchmark) GROUP BY ALL),
 tf AS (SELECT doc_id, greatest(len(ts), 1) AS dl, x AS t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS x FROM d) WHERE x IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
 sc AS (SELECT qid, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY 1, 2)"""


@query(MANY + " SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0) WHERE rank <= 5")
def bm25_many(spark, sf_dir):
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return retrieval.bm25_many(t(spark, sf_dir, "documents"), q, 5)


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), s AS (SELECT doc_id, l, i AS chunk_no, 6 * i AS s FROM l, unnest(range(0, greatest(0, ceil((len(l) - 8) / 6))::INT + 1)) AS u(i) WHERE len(l) > 0)
 SELECT doc_id, array_to_string(l[s + 1:s + 8], chr(10)) AS text, min(chunk_no)::INT AS chunk_no FROM s GROUP BY 1, 2""")
def chunks_distinct(spark, sf_dir):
    return retrieval.distinct_chunks(t(spark, sf_dir, "documents")).select("doc_id.path", "doc_id.chunk_no", "text").withColumnRenamed("path", "doc_id")


GRAPH = """WITH n AS (SELECT 'n' || n_nationkey AS id, n_name AS label, n_nationkey AS seq, 'n' || n_nationkey AS node FROM nation), e AS (SELECT 'n' || (s_nationkey) AS a, 's' || s_suppkey AS b, s_name AS name FROM supplier),
 q AS (SELECT conv_id AS qid, 'about nation_' || (conv_id % 30) || ' and nation_' || (conv_id % 7) AS question FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _nations(spark, sf_dir):
    n, s = t(spark, sf_dir, "nation"), t(spark, sf_dir, "supplier")
    seq = lambda c: F.format_string("%09d", c)
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("host").alias("type"), F.col("n_name").alias("label"), seq("n_nationkey").alias("seq"))
    nodes = nodes.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("file").alias("type"), F.col("s_name").alias("label"), seq("s_suppkey").alias("seq")))
    edges = s.select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"), F.lit("sells_to").alias("type"), F.lit("x.txt").alias("evidence"))
    q = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid")).distinct().withColumn("question", F.expr("'about nation_' || (qid % 30) || ' and nation_' || (qid % 7)"))
    return nodes, edges, q


@query(GRAPH + """, m AS (SELECT qid, arg_max(id, length(label) * 1000 - seq) AS id, arg_max(label, length(label) * 1000 - seq) AS label FROM q JOIN n ON contains(question, lower(label)) GROUP BY 1),
 r AS (SELECT qid, label || ' sells to ' || name AS line, row_number() OVER (PARTITION BY qid ORDER BY name) AS r FROM m JOIN e ON a = id) SELECT qid, string_agg('- ' || line || ' (Source: x.txt)', chr(10) ORDER BY r) AS block FROM r WHERE r <= 5 GROUP BY 1""")
def graph_relations(spark, sf_dir):
    return methods.relations(*_nations(spark, sf_dir))


@query(GRAPH + """, m AS (SELECT qid, id, label FROM q JOIN n ON contains(question, lower(label))), r AS (SELECT qid, id, label, name, row_number() OVER (PARTITION BY qid, id ORDER BY name) AS r, count(*) OVER (PARTITION BY qid, id) AS k FROM m JOIN e ON a = id),
 b AS (SELECT qid, id, label, '- ' || label || ' (host): ' || any_value(k) || ' relationship(s):' || chr(10) || string_agg('    - sells to ' || name || ' (Source: x.txt)', chr(10) ORDER BY r) || CASE WHEN any_value(k) > 5 THEN chr(10) || '    - and ' || (any_value(k) - 5) || ' more' ELSE '' END AS text FROM r WHERE r <= 5 GROUP BY 1, 2, 3)
 SELECT qid, string_agg(text, chr(10) ORDER BY label, id) AS block FROM b GROUP BY 1""")
def graph_surroundings(spark, sf_dir):
    return methods.surroundings(*_nations(spark, sf_dir))


# ---- evaluation

CARD = """WITH c(k, category, inc, exc, src, refuse, best) AS (VALUES (0, 'relationship_retrieval', 'the', 'idiot', 'books', false, 'web_1'), (1, 'contradiction_detection', 'le', 'clown', 'none.txt', true, 'x'), (2, 'hypothesis_evolution', 'die', 'trash', 'x/y', false, 'web_2')),
 a AS (SELECT doc_id, source AS method, lower(text) || CASE WHEN doc_id % 5 = 0 THEN ' not confirmed' ELSE '' END AS low, c.* FROM documents JOIN c ON doc_id % 3 = k),
 f AS (SELECT *, (NOT contains(low, inc))::INT + contains(low, exc)::INT + (NOT contains(low, regexp_extract(src, '[^/]*$')))::INT + (refuse AND NOT (contains(low, 'not confirmed') OR contains(low, chr(10) || 'no.') OR contains(low, chr(10) || 'no ')))::INT AS n, contains(low, exc)::INT AS un, (NOT contains(low, regexp_extract(src, '[^/]*$')))::INT AS mi,
  (contains(low, 'not confirmed') OR contains(low, chr(10) || 'no.') OR contains(low, chr(10) || 'no ')) AS refused FROM a)"""


def _cards(spark, sf_dir):
    rows = [(0, "relationship_retrieval", ["the"], ["idiot"], ["books"], False, "web_1"), (1, "contradiction_detection", ["le"], ["clown"], ["none.txt"], True, "x"), (2, "hypothesis_evolution", ["die"], ["trash"], ["x/y"], False, "web_2")]
    kinds = spark.createDataFrame(rows, "k long, category string, must_include array<string>, must_not_include array<string>, required_sources array<string>, expect_refusal boolean, expected_best_method string")
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("method"), F.concat("text", F.when(F.col("doc_id") % 5 == 0, " not confirmed").otherwise("")).alias("answer"), (F.col("doc_id") % 3).alias("k"))
    return d.drop("k"), d.select("id", "k").join(F.broadcast(kinds), "k").drop("k")  # three rows


@query(CARD + """ SELECT method, count(*) AS total, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed, sum(un)::BIGINT AS unsupported_failures, sum(mi)::BIGINT AS missing_source_failures, round(coalesce(count(*) FILTER (refused AND refuse) / nullif(count(*) FILTER (refuse), 0), 0), 6) AS refusal_accuracy,
 count(*) FILTER (k = 1 AND n > 0) AS contradiction_misses, round(coalesce(count(*) FILTER (k = 0 AND n = 0) / nullif(count(*) FILTER (k = 0), 0), 0), 6) AS relationship_coverage, round(coalesce(count(*) FILTER (k = 2 AND n = 0) / nullif(count(*) FILTER (k = 2), 0), 0), 6) AS narrative_state_quality, count(*) FILTER (n = 0 AND best = method) AS expected_best_wins FROM f GROUP BY 1""")
def method_scorecard(spark, sf_dir):
    return evaluate.scorecard(*_cards(spark, sf_dir))


@query(CARD + " SELECT doc_id AS id, method, n = 0 AS passed, n AS n_failures FROM f")
def eval_results(spark, sf_dir):
    return evaluate.results(evaluate.checks(*_cards(spark, sf_dir))).withColumn("n_failures", F.col("n_failures").cast("int"))


# ---- review

REVIEW = """WITH o AS (SELECT 'p' || printf('%06d', doc_id) AS page, text AS body FROM documents WHERE doc_id % 3 > 0), n AS (SELECT 'p' || printf('%06d', doc_id) AS page, text || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Confirmed malware, data was stolen' WHEN doc_id % 4 = 1 THEN chr(10) || 'the analyst: confirmed malware' ELSE '' END AS body, doc_id FROM documents),
 r AS (SELECT page, row_number() OVER (ORDER BY page) AS n FROM n WHERE doc_id % 4 = 0), free AS (SELECT num, row_number() OVER (ORDER BY num) AS n FROM (SELECT unnest(range(1, (SELECT count(*) FROM r) + 6)) AS num) WHERE num NOT IN (2, 3, 5, 8, 99999)),
 q AS (SELECT printf('rev_%04d', num) AS review_id, r.page, 'pending' AS status, o.page IS NOT NULL AS known FROM r JOIN free USING (n) LEFT JOIN o ON o.page = r.page)"""


def _review(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.format_string("p%06d", "doc_id").alias("page"), F.col("text").alias("body"), "doc_id")
    more = F.when(F.col("doc_id") % 4 == 0, "\nConfirmed malware, data was stolen").when(F.col("doc_id") % 4 == 1, "\nthe analyst: confirmed malware").otherwise("")
    old, new = d.where("doc_id % 3 > 0").drop("doc_id"), d.select("page", F.concat("body", more).alias("body"))
    return old, new, review.queue(old, new, spark.createDataFrame([(2,), (3,), (5,), (8,), (99999,)], "num long"))


@query(REVIEW + " SELECT review_id, page, status, 'confirmed malware,data was stolen' AS phrases, known FROM q")
def review_queue(spark, sf_dir):
    return _review(spark, sf_dir)[2].select("review_id", "page", "status", F.array_join("phrases", ",").alias("phrases"), F.col("prior").isNotNull().alias("known"))


@query(REVIEW + " SELECT n.page, CASE WHEN doc_id % 4 > 0 THEN n.body ELSE o.body END AS body FROM n LEFT JOIN o USING (page) WHERE doc_id % 4 > 0 OR o.body IS NOT NULL")
def review_held_pages(spark, sf_dir):
    _, new, queued = _review(spark, sf_dir)
    return review.held_back(new, queued)


@query("SELECT o_orderkey AS review_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'approved' WHEN o_orderstatus = 'O' THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'approved' END AS status FROM orders")
def review_decisions(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "rejected").otherwise("approved").alias("status"))
    verdicts = o.select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderkey") % 2 == 0, "approved").otherwise("rejected").alias("verdict"))
    return review.decide(items, verdicts)


# ---- replay, pages, report

STEPS = """WITH e AS (SELECT 'step_' || strftime(ts, '%d') AS step, event_type, user_id FROM events), f AS (SELECT 'event' AS kind, event_type || user_id AS key, min(step) AS step FROM e GROUP BY 2 UNION ALL SELECT 'entity', 'u' || user_id, min(step) FROM e GROUP BY 2 UNION ALL SELECT 'ioc', event_type, min(step) FROM e WHERE event_type = 'error' GROUP BY 2),
 g AS (SELECT DISTINCT step, kind FROM e, (VALUES ('event'), ('entity'), ('ioc'), ('hypothesis')) AS k(kind)), c AS (SELECT g.step, g.kind, count(f.key) AS n_new FROM g LEFT JOIN f ON f.step = g.step AND f.kind = g.kind GROUP BY 1, 2)"""


@query(STEPS + " SELECT step, kind, n_new, sum(n_new) OVER (PARTITION BY kind ORDER BY step)::BIGINT AS n_total FROM c")
def replay_steps(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.concat(F.lit("step_"), F.date_format("ts", "dd"), F.lit("/x.csv")).alias("path"), "event_type", "user_id")
    seen = lambda rows, key, kind: replay.first_seen(rows, key, "path").select(F.lit(kind).alias("kind"), "step")
    first = seen(e, ["event_type", "user_id"], "event").unionByName(seen(e, ["user_id"], "entity")).unionByName(seen(e.where("event_type = 'error'"), ["event_type"], "ioc"))
    return replay.running(first, replay.steps(e))


@query("SELECT 'timeline' AS page, '---' || chr(10) || 'page: timeline' || chr(10) || 'lines: ' || count(*) || chr(10) || '---' || chr(10) || '# timeline' || chr(10) || chr(10) || string_agg('- ' || CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || ' ' || event_type || ' (Source: e' || (event_id % 9) || ')', chr(10) ORDER BY event_id % 7 = 0, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, event_id) AS body FROM events")
def page_timeline(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    ts = F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = e.select(ts.alias("ts"), F.col("event_type").alias("description"), F.concat(F.lit("e"), F.col("event_id") % 9).alias("path"), F.col("event_id").alias("seq"))
    return pages.timeline(rows)


@query("SELECT '## Timeline' || chr(10) || chr(10) || string_agg('- ' || o_orderkey || ': ' || o_orderpriority, chr(10) ORDER BY o_orderpriority, o_orderkey) AS body FROM orders")
def report_section(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return report.section("Timeline", o, [F.col("o_orderpriority"), F.col("o_orderkey")], F.concat(F.lit("- "), "o_orderkey", F.lit(": "), "o_orderpriority"))


@query("""SELECT '# Final report' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || 'The strongest hypothesis is: ' || arg_min(title, k) || ' (confidence: ' || min(c) || '). It is not a fact.' AS head, count(*) AS n FROM (SELECT 'Claim ' || doc_id AS title, doc_id AS k, CASE WHEN toxic = 1 THEN 'High' ELSE 'Low' END AS c FROM labels) WHERE c = 'High'""")
def report_summary(spark, sf_dir):
    l = t(spark, sf_dir, "labels")  # noqa: E741
    claims = l.select(F.format_string("claim_%04d", "doc_id").alias("claim_id"), F.concat(F.lit("Claim "), "doc_id").alias("title"), F.when(F.col("toxic") == 1, "High").otherwise("Low").alias("confidence"), F.lit("").alias("inference"), _none().alias("facts"), _none().alias("supporting"), _none().alias("contradicting"))
    empty = lambda schema: spark.createDataFrame([], schema)
    made = report.render(empty("ts string, description string, path string, seq string"), empty("type string, value string"), empty("artifact string, type string, confidence string, reason string, source string"), claims, empty("title string, claim_a string, claim_b string"), empty("claim_id string, pos int, text string"), empty("path string"))
    return made.select(F.split_part("body", F.lit("\n\n## Timeline"), F.lit(1)).alias("head")).crossJoin(F.broadcast(l.agg(F.count_if(F.col("toxic") == 1).alias("n"))))


@query("""WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, line FROM o WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 'new line' FROM documents WHERE doc_id % 7 = 0), a AS (SELECT doc_id, line, count(*) AS k FROM o GROUP BY 1, 2), b AS (SELECT doc_id, line, count(*) AS k FROM n GROUP BY 1, 2)
 SELECT doc_id AS page, CASE WHEN coalesce(b.k, 0) > coalesce(a.k, 0) THEN '+' ELSE '-' END AS sign, line, abs(coalesce(b.k, 0) - coalesce(a.k, 0)) AS n FROM a FULL JOIN b USING (doc_id, line) WHERE coalesce(a.k, 0) <> coalesce(b.k, 0)""")
def page_line_diff(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("text").alias("body"))
    more = F.concat_ws("\n", F.when(F.col("page") % 5 > 0, F.col("body")), F.when(F.col("page") % 7 == 0, "new line"))
    return pages.line_diff(d, d.where("page % 5 > 0 or page % 7 = 0").select("page", more.alias("body")))


@query()
def page_unified_diff(spark, sf_dir):
    """A unified diff is beyond SQL; tests hold it against the standard library's."""
    from vespera.operators import diff

    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("text").alias("body"))
    return diff.unified(d, d.withColumn("body", F.when(F.col("page") % 4 == 0, F.concat(F.lit("first\n"), "body", F.lit("\nlast"))).otherwise(F.col("body"))))
