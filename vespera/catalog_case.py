"""Queries of the evidence engine over evidence files that are composed from the tables, and SQL over the tables for the same rows.

The expressions that compose a file's lines are SQL that both engines read; chr(92) is a backslash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.catalog import query, t
from vespera.functions.text import source_kind
from vespera.operators import graph
from vespera.plans import evidence as P
from vespera.plans import index
from vespera.sources import evidence as S
from vespera.sources import storage

BS = "chr(92)"
EVENT = {
    "path": "'step_' || (user_id % 4 + 1) || '/u' || lpad(user_id || '', 6, '0') || '_sysmon.csv'",
    "code": "CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE '5' END",
    "folder": f"CASE event_id % 5 WHEN 1 THEN 'C:' || {BS} || 'Windows' || {BS} WHEN 4 THEN 'C:' || {BS} || 'Apps' || {BS} ELSE '' END",
    "parent": "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'explorer.exe' WHEN 3 THEN 'PowerShell.exe' ELSE event_type || '.exe' END",
    "dir": f"CASE WHEN event_id % 13 = 0 THEN '' ELSE 'C:' || {BS} || 'Temp' || {BS} END",
    "image": "event_type || (user_id % 7) || '.exe'",
    "account": f"'CORP' || {BS} || 'u' || (user_id % 20)",
    "command": "CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ' --id ' || event_id END",
}
ORDER = {
    "path": "'step_' || (o_custkey % 4 + 1) || '/c' || lpad((o_custkey % 500) || '', 6, '0') || '_netflow.csv'",
    "remote": "CASE o_orderkey % 4 WHEN 0 THEN '10.0.' || (o_orderkey % 200) || '.5' WHEN 1 THEN '203.0.' || (o_orderkey % 250) || '.' || (o_orderkey % 99) WHEN 2 THEN '172.20.1.' || (o_orderkey % 9) ELSE '' END",
    "process": "CASE o_orderkey % 5 WHEN 0 THEN 'Outlook.exe' WHEN 1 THEN 'svchost.exe' WHEN 2 THEN 'tool.exe' WHEN 3 THEN 'agent' ELSE 'sync.exe' END",
    "bytes": "(o_orderkey % 1000) || ''",
    "local": "'10.1.1.' || (o_custkey % 9)",
}
CUSTOMER = {
    "path": "'step_' || (c_nationkey % 4 + 1) || '/n' || lpad(c_nationkey || '', 6, '0') || '_keys.reg'",
    "hive": f"'HKCU' || {BS} || 'Software' || {BS} || c_mktsegment || CASE WHEN c_mktsegment < 'F' THEN {BS} || 'Run' ELSE {BS} || 'Services' END",
    "program": "CASE WHEN c_custkey % 10 = 0 THEN 'OneDrive.exe' ELSE 'cust' || c_custkey || '.exe' END",
}
TURN = {"path": "'step_1/t' || lpad((conv_id % 30) || '', 6, '0') || '_powershell_history.txt'", "line": "CASE WHEN turn % 3 = 2 THEN '' ELSE role || ' ' || conv_id || '.' || turn END"}
SUPPLIER = {"path": "'step_2/s' || lpad(s_suppkey || '', 6, '0') || '_defender_scan.txt'", "threats": "(s_suppkey % 3) || ''"}
PART = {"path": "'step_3/p' || lpad(p_partkey || '', 6, '0') || '_hash_reputation.txt'", "hits": "(p_partkey % 3) || ''", "verdict": "CASE p_partkey % 4 WHEN 0 THEN 'Unknown file' WHEN 1 THEN 'malicious' WHEN 2 THEN 'inconclusive result' ELSE 'clean' END"}
ITEM = {"path": "'step_4/i' || lpad(item_id || '', 6, '0') || '_analyst.md'", "first": "'item ' || item_id || CASE WHEN item_id % 3 = 0 THEN ' may be Malware' ELSE ' is fine' END"}


def _cols(df: DataFrame, known: dict, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.expr(v).alias(k) for k, v in known.items()])


def _joined(rows: DataFrame, head: str, line, order: str) -> DataFrame:
    """path, text: a file of a first line and a line a row."""
    x = rows.select("path", F.struct(order, line.alias("line")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return x.select("path", F.concat(F.lit(head), F.array_join(F.transform("l", lambda y: y["line"]), "\n")).alias("text"))


#: Where the composed files of this application are, by folder of tables and kinds.
_COMPOSED: dict[tuple, str] = {}


def composed(spark, sf_dir, *kinds: str) -> DataFrame:
    """path, kind, sha, text, seq: evidence files of the named tables (all by default), composed once."""
    key = (spark.sparkContext.applicationId, sf_dir, kinds)
    if key not in _COMPOSED:
        path = storage.scratch(spark, "files")
        _composed(spark, sf_dir, *kinds).write.parquet(path)
        _COMPOSED[key] = path
    return spark.read.parquet(_COMPOSED[key])


def _composed(spark, sf_dir, *kinds: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    parts = {}
    e = _cols(t(spark, sf_dir, "events"), EVENT, "event_id", "ts")
    row = F.concat_ws(",", F.when(F.col("event_id") % 11 == 0, "").otherwise(stamp), "code", F.concat("folder", "parent"), F.concat("dir", "image"), "account", "command")
    parts["events"] = lambda: _joined(e, "timestamp,event_id,parent_image,image,user,command_line\n", row, "event_id")
    o = _cols(t(spark, sf_dir, "orders"), ORDER, "o_orderkey", "o_orderdate")
    net = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), "local", F.lit("50000"), "remote", F.lit("443"), F.lit("TCP"), "process", "bytes")
    parts["orders"] = lambda: _joined(o, "timestamp,local_address,local_port,remote_address,remote_port,protocol,process,bytes_sent\n", net, "o_orderkey")
    c = _cols(t(spark, sf_dir, "customer"), CUSTOMER, "c_custkey")
    value = F.expr(f"'\"c' || c_custkey || '\"=\"C:' || {BS} || {BS} || 'T' || {BS} || {BS} || program || ' /q\"'")
    heads = c.select("path", F.concat(F.lit("["), "hive", F.lit("]")).alias("line"), F.col("hive").alias("a"), F.lit(-1).cast("long").alias("b")).distinct()
    keys = heads.unionByName(c.select("path", value.alias("line"), F.col("hive").alias("a"), F.col("c_custkey").cast("long").alias("b"))).withColumn("o", F.struct("a", "b"))
    parts["customer"] = lambda: _joined(keys, "Windows Registry Editor Version 5.00\n\n", F.col("line"), "o")
    v = _cols(t(spark, sf_dir, "conversations"), TURN, "conv_id", "turn").withColumn("o", F.struct("conv_id", "turn"))
    parts["conversations"] = lambda: _joined(v, "start\n", F.col("line"), "o")
    s = _cols(t(spark, sf_dir, "supplier"), SUPPLIER, "s_suppkey")
    parts["supplier"] = lambda: s.select("path", F.when(F.col("s_suppkey") % 5 == 4, "No result\n").otherwise(F.concat(F.lit("Completed : 2026-01-02 03:04:05\nThreats Found : "), "threats", F.lit("\n"))).alias("text"))
    p = _cols(t(spark, sf_dir, "part"), PART, "p_partkey")
    parts["part"] = lambda: p.select("path", F.concat(F.lit("Target file : part"), "p_partkey", F.lit(".exe\nSHA-256 : "), F.md5(F.col("p_partkey").cast("string")), F.lit("\nDetections : "), "hits", F.lit(" / 70\nVerdict : "), "verdict", F.lit("\n")).alias("text"))
    b = _cols(t(spark, sf_dir, "benchmark"), ITEM, "item_id")
    parts["benchmark"] = lambda: b.select("path", F.concat(F.lit("- "), "first", F.lit("\n  goes on\nplain\n- second\n")).alias("text"))
    parts["documents"] = lambda: t(spark, sf_dir, "documents").select(F.expr("'docs/d' || lpad(doc_id || '', 8, '0') || '.txt'").alias("path"), "text")
    every = None
    for k in kinds or parts:
        every = parts[k]() if every is None else every.unionByName(parts[k]())
    return every.select("path", source_kind(F.col("path")).alias("kind"), F.sha2("text", 256).alias("sha"), "text", F.array_join(F.split("path", "/"), "\x01").alias("seq"))


def _sql(known: dict, table: str, *keep: str) -> str:
    return "SELECT " + ", ".join([*keep, *[f"{v} AS {k}" for k, v in known.items()]]) + f" FROM {table}"


BASE = f"""WITH e AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS seen FROM ({_sql(EVENT, 'events', 'event_id', 'user_id', 'ts')})), o AS ({_sql(ORDER, 'orders', 'o_orderkey', "strftime(o_orderdate, '%Y-%m-%d') AS seen")}),
c AS ({_sql(CUSTOMER, 'customer', 'c_custkey')}), v AS ({_sql(TURN, 'conversations', 'conv_id', 'turn')}), s AS ({_sql(SUPPLIER, 'supplier', 's_suppkey')}), p AS ({_sql(PART, 'part', 'p_partkey')}), i AS ({_sql(ITEM, 'benchmark', 'item_id')})"""

EVENTS = f"""{BASE}, vn AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY conv_id, turn) AS n FROM v),
ev AS (
  SELECT path, seen AS ts, CASE code WHEN '1' THEN CASE WHEN parent = '' THEN 'unknown parent' ELSE parent END || ' spawned ' || image || CASE WHEN command = '' THEN '' ELSE ' (' || command || ')' END
    WHEN '3' THEN image || ' initiated network activity (' || CASE WHEN command = '' THEN 'no detail' ELSE command END || ')' ELSE 'event_id=5: ' || CASE WHEN command = '' THEN image ELSE command END END AS description FROM e
  UNION ALL SELECT path, seen, process || ' connected to ' || remote || ':443 (TCP, sent ' || bytes || ' bytes)' FROM o
  UNION ALL SELECT path, 'unknown', 'Registry value ''c' || c_custkey || ''' set under ' || hive || ' = C:' || {BS} || 'T' || {BS} || program || ' /q' FROM c
  UNION ALL SELECT path, 'unknown', 'PowerShell command #' || (n + 1) || ': ' || line FROM vn WHERE line <> ''
  UNION ALL SELECT DISTINCT path, 'unknown', 'PowerShell command #1: start' FROM v
  UNION ALL SELECT path, '2026-01-02 03:04:05', 'Windows Defender full scan completed; ' || threats || ' threats found.' FROM s WHERE s_suppkey % 5 <> 4
  UNION ALL SELECT path, 'unknown', 'Hash reputation lookup for part' || p_partkey || '.exe returned ' || hits || ' / 70 detections; verdict: ' || verdict || ' (sha256: ' || left(md5(p_partkey || ''), 16) || '…)' FROM p
  UNION ALL SELECT path, 'unknown', 'Investigator note: ' || first FROM i UNION ALL SELECT path, 'unknown', 'Investigator note: second' FROM i
)"""


@query(EVENTS + " SELECT path, ts, description FROM ev")
def case_events(spark, sf_dir):
    return P.events(composed(spark, sf_dir)).select("path", "ts", "description")


@query(EVENTS + " SELECT path, ts, description, count(*) AS n FROM (SELECT DISTINCT * FROM ev) GROUP BY ALL")
def case_events_merged(spark, sf_dir):
    state = P.merged(P.extract(composed(spark, sf_dir)))
    return state.events.groupBy("path", "ts", "description").agg(F.count("*").alias("n"))


@query(f"""{BASE} SELECT path, 'sysmon_csv' AS kind, event_id AS n, to_json(map_from_entries([('timestamp', CASE WHEN seen = 'unknown' THEN '' ELSE seen END), ('event_id', code), ('parent_image', folder || parent), ('image', dir || image), ('user', account), ('command_line', command)]))::VARCHAR AS row
 FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY path ORDER BY event_id) - 1 AS event_id) FROM e)""")
def case_csv_rows(spark, sf_dir):
    x = S.csv_rows(composed(spark, sf_dir, "events"))
    return x.select("path", "kind", F.col("row_no").cast("long").alias("n"), F.to_json("row").alias("row"))


@query(f"{BASE} SELECT path, hive AS key, 'c' || c_custkey AS name, 'C:' || {BS} || 'T' || {BS} || program || ' /q' AS value FROM c")
def case_registry_values(spark, sf_dir):
    return S.registry_values(composed(spark, sf_dir, "customer")).select("path", "key", "name", "value")


@query(f"""{BASE} SELECT 'spawned' AS relation, parent AS actor, image AS target, path FROM e WHERE code = '1' AND parent LIKE '%.exe'
 UNION ALL SELECT 'connected_to', process, remote, path FROM o WHERE process LIKE '%.exe' AND remote <> '' UNION ALL SELECT 'references', hive, program, path FROM c""")
def case_relations(spark, sf_dir):
    x = P.events(composed(spark, sf_dir, "events", "orders", "customer", "benchmark")).where("relation is not null")
    return x.select("relation", "actor", F.explode("targets").alias("target"), "path")


IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
MENTIONS = f"""{BASE}, m AS (
  SELECT path, 'process' AS type, image AS value FROM e UNION ALL SELECT path, 'process', parent FROM e UNION ALL SELECT path, 'file', dir || image FROM e WHERE dir <> '' UNION ALL SELECT path, 'file', folder || parent FROM e WHERE folder <> ''
  UNION ALL SELECT path, 'user', account FROM e UNION ALL SELECT path, 'command', command FROM e
  UNION ALL SELECT path, 'ip', remote FROM o UNION ALL SELECT path, 'ip', local FROM o UNION ALL SELECT path, 'process', process FROM o
  UNION ALL SELECT path, 'registry_key', hive FROM c UNION ALL SELECT path, 'file', program FROM c UNION ALL SELECT path, 'file', 'part' || p_partkey || '.exe' FROM p
), d AS (SELECT type, lower(value) AS key, path FROM m WHERE value <> '')"""


#: Entities found in the documents' texts.
TEXTS = rf"""WITH f AS (SELECT 'docs/d' || lpad(doc_id || '', 8, '0') || '.txt' AS path, text FROM documents), m AS (
  SELECT path, 'ip' AS type, unnest(regexp_extract_all(text, '{IP}')) AS value FROM f
  UNION ALL SELECT path, 'domain', x FROM (SELECT path, unnest(regexp_extract_all(text, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}\b')) AS x FROM f) WHERE NOT regexp_matches(x, '(?i)\.(exe|reg|csv|txt|md)$')
  UNION ALL SELECT path, 'file', x FROM (SELECT path, unnest(regexp_extract_all(text, '\b[A-Za-z0-9_.\-]+\.exe\b')) AS x FROM f) WHERE lower(x) <> 'powershell.exe'
  UNION ALL SELECT path, 'user', unnest(regexp_extract_all(text, '\b[A-Z][A-Z0-9_-]{{2,}}\\[a-zA-Z][a-zA-Z0-9_.\-]+\b')) FROM f)
"""


@query(f"""{MENTIONS}, u AS (SELECT type, key, path FROM d UNION ALL SELECT 'user', 'hkcu' || {BS} || 'software', path FROM c UNION ALL SELECT 'user', lower(substr(hive, 15)), path FROM c
 UNION ALL SELECT type, lower(value), path FROM ({TEXTS}SELECT path, type, value FROM m))
SELECT type, key, count(DISTINCT path) AS n_sources, min(path) AS first_source FROM u GROUP BY 1, 2""")
def case_entities(spark, sf_dir):
    x = P.merge.merge_entities(P.entities(composed(spark, sf_dir)))
    return x.select("type", "key", "n_sources", F.array_min("sources").alias("first_source"))


@query(f"{BASE} SELECT DISTINCT type, key, path FROM (SELECT 'registry_key' AS type, lower(hive) AS key, path FROM c UNION ALL SELECT 'file', lower(program), path FROM c)")
def case_registry_entities(spark, sf_dir):
    x = P.entities(composed(spark, sf_dir, "customer", "benchmark")).where("type in ('registry_key', 'file')")
    return x.select("type", F.lower("value").alias("key"), F.col("source").alias("path")).distinct()


@query(TEXTS + "SELECT path, type, value, count(*) AS n FROM m GROUP BY ALL")
def case_text_entities(spark, sf_dir):
    return P.entities(composed(spark, sf_dir, "documents")).groupBy(F.col("source").alias("path"), "type", "value").agg(F.count("*").alias("n"))


IOCS = f"""{BASE}, x AS (
  SELECT program AS artifact, 'file' AS type, 'unknown' AS first_seen, path, 'Medium' AS confidence, 'persistence' AS rule, 'Starts at logon through ' || hive || ': c' || c_custkey || ' = C:' || {BS} || 'T' || {BS} || program || ' /q' AS reason, c_custkey AS k FROM c WHERE contains(hive, {BS} || 'Run') AND program <> 'OneDrive.exe'
  UNION ALL SELECT image, 'file', CASE WHEN seen = 'unknown' THEN '' ELSE seen END, path, 'Medium', 'execution', 'Started by ' || lower(parent) || ', which often runs code for others', event_id FROM e WHERE lower(parent) IN ('powershell.exe', 'cmd.exe')
  UNION ALL SELECT remote, 'ip', seen, path, 'Low', 'beacon', process || ' reached the public address ' || remote || ', port 443', o_orderkey FROM o WHERE remote LIKE '203.%' AND process NOT IN ('Outlook.exe', 'svchost.exe'))"""


@query(IOCS + " SELECT artifact, type, first_seen, path, confidence, rule, reason FROM x")
def case_iocs(spark, sf_dir):
    return P.iocs(composed(spark, sf_dir)).select("artifact", "type", "first_seen", F.col("source").alias("path"), "confidence", "rule", "reason")


CONFLICTS = f"""{BASE}, k AS (
  SELECT path, 'reputation' AS rule, 'The hash lookup leaves the malware suspicion open' AS title FROM p WHERE verdict IN ('Unknown file', 'inconclusive result') OR hits = '0'
  UNION ALL SELECT path, 'clean', 'Suspicious activity, but the scanner found nothing' FROM s WHERE s_suppkey % 5 <> 4 AND threats = '0'
  UNION ALL SELECT path, 'note', 'Notes say more than the evidence shows' FROM i WHERE item_id % 3 = 0)"""


@query(CONFLICTS + " SELECT path, rule, title FROM k")
def case_conflicts(spark, sf_dir):
    return P.conflicts(composed(spark, sf_dir)).select("path", "rule", "title")


@query(CONFLICTS + " SELECT title, min(path) AS path FROM k GROUP BY 1")
def case_contradictions(spark, sf_dir):
    files = composed(spark, sf_dir, "customer", "supplier", "part", "benchmark")
    return P.contradictions(P.conflicts(files), P.iocs(files)).select("title", "path")


@query(f"{BASE} SELECT min(path) AS path FROM i WHERE item_id % 3 = 0")
def case_contradictions_unsuspected(spark, sf_dir):
    """Without any indicator a clean scan contradicts nothing."""
    files = composed(spark, sf_dir, "supplier", "benchmark")
    return P.contradictions(P.conflicts(files), P.iocs(files)).select("path")


HYPOTHESES = IOCS + """, h(rule, title, confidence) AS (VALUES ('persistence', 'Autostart persistence of an unfamiliar program', 'Medium'), ('execution', 'Execution chain from a script host', 'Medium'), ('beacon', 'Outbound beacon to a public address', 'Low')),
l AS (SELECT rule, count(DISTINCT reason || ' (Source: ' || path || ')') AS n_facts, count(DISTINCT path) AS n_supporting, min(replace(path, '/', chr(1))) AS first FROM x GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY first) AS k FROM l JOIN h USING (rule))"""


def _claimed(spark, sf_dir):
    raw = P.extract(composed(spark, sf_dir))
    return P.claims(raw["raw_iocs"], P.merged(raw).contradictions)


@query(HYPOTHESES + " SELECT printf('claim_%04d', k) AS claim_id, title, confidence, n_facts, n_supporting FROM n")
def case_claims(spark, sf_dir):
    return _claimed(spark, sf_dir).select("claim_id", "title", "confidence", F.size("facts").cast("long").alias("n_facts"), F.size("supporting").cast("long").alias("n_supporting"))


@query(HYPOTHESES + """, f(pos, kind, title, text) AS (VALUES (0, 'step', 'Execution chain from a script host', 'Collect the whole process tree around the start'), (1, 'step', 'Execution chain from a script host', 'Read the script host''s logs'))
SELECT printf('claim_%04d', k) AS claim_id, pos, text FROM n JOIN f USING (title)""")
def case_next_steps(spark, sf_dir):
    return P.follow_up(_claimed(spark, sf_dir).where("title like 'Execution%'")).where("kind = 'step'").select("claim_id", "pos", "text")


@query("""SELECT * FROM (VALUES ('Who typed the commands, and when?'), ('When was the registry value written?'), ('What did the connections carry?'), ('Were the scanner''s signatures current?'), ('Will a later lookup of the hash differ?'),
 ('Is the program signed?'), ('Who installed the program?'), ('Do other hosts hold the same entry?'), ('What started the script host?'), ('Did a person start the chain?'), ('What was sent?'), ('Is the address known to the organisation?'), ('Does the traffic repeat?')) AS q(text)""")
def case_open_questions(spark, sf_dir):
    return P.open_questions(composed(spark, sf_dir), _claimed(spark, sf_dir))


NODES = MENTIONS + """, w AS (SELECT CASE type WHEN 'ip' THEN 'ip_address' ELSE type END AS type, key, path FROM d),
ends AS (SELECT 'process' AS type, lower(parent) AS key FROM e WHERE code = '1' AND parent LIKE '%.exe' UNION ALL SELECT 'file', lower(image) FROM e WHERE code = '1' AND parent LIKE '%.exe' UNION ALL SELECT 'process', lower(process) FROM o WHERE process LIKE '%.exe' AND remote <> '' UNION ALL SELECT 'ip_address', remote FROM o WHERE process LIKE '%.exe' AND remote <> ''),
nodes AS (SELECT type || ':' || key AS id, type FROM w WHERE type <> 'registry_key' AND path LIKE '%.csv' UNION SELECT type || ':' || key, type FROM ends UNION SELECT 'source:' || path, 'source' FROM w WHERE type <> 'registry_key' AND path LIKE '%.csv'),
mi AS (SELECT DISTINCT type || ':' || key AS a, path FROM w WHERE path LIKE '%.csv'),
edges AS (SELECT a AS source, 'source:' || path AS target, 'mentioned_in' AS type, path AS evidence FROM mi
 UNION ALL SELECT a.a, b.a, 'related_to', min(a.path) FROM mi a JOIN mi b ON a.path = b.path AND a.a < b.a GROUP BY 1, 2
 UNION ALL SELECT 'process:' || lower(parent), 'file:' || lower(image), 'spawned', min(path) FROM e WHERE code = '1' AND parent LIKE '%.exe' GROUP BY 1, 2
 UNION ALL SELECT 'process:' || lower(process), 'ip_address:' || remote, 'connected_to', min(path) FROM o WHERE process LIKE '%.exe' AND remote <> '' GROUP BY 1, 2)"""


def _graph(spark, sf_dir):
    files = composed(spark, sf_dir, "events", "orders")
    return P.graph(P.entities(files), P.events(files))


@query(NODES + " SELECT id, type FROM nodes")
def case_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("id", "type")


@query(NODES + " SELECT source, target, type, evidence FROM edges")
def case_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(NODES + " SELECT type, count(*) AS n FROM edges GROUP BY 1")
def graph_edges_by_type(spark, sf_dir):
    return graph.edges_by_type(_graph(spark, sf_dir)[1])


@query("""WITH n AS (SELECT 'brand' AS type, p_brand AS label FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'name', p_name FROM part), d AS (SELECT DISTINCT type, label FROM n),
 r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY label) AS r, count(*) OVER (PARTITION BY type) AS n FROM d)
 SELECT type, any_value(n) AS n, string_agg(label, '|' ORDER BY r) AS labels FROM r WHERE r <= 12 GROUP BY 1""")
def graph_nodes_by_type(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    one = lambda k, c: p.select(F.lit(k).alias("type"), F.col(c).alias("label"))
    return graph.nodes_by_type(one("brand", "p_brand").unionByName(one("type", "p_type")).unionByName(one("name", "p_name"))).select("type", "n", F.array_join("labels", "|").alias("labels"))


@query("""WITH n AS (SELECT DISTINCT p_brand AS label FROM part), c AS (SELECT count(*) AS k FROM n), f AS (SELECT string_agg(label, ', ' ORDER BY label) AS l FROM (SELECT * FROM n ORDER BY label LIMIT 12))
 SELECT 'nodes' AS section, '- **brand** (' || k || '): ' || l || CASE WHEN k > 12 THEN ', and ' || (k - 12) || ' more' ELSE '' END AS line FROM c, f
 UNION ALL SELECT 'edges', '- **' || o_orderpriority || '**: ' || count(*) FROM orders GROUP BY o_orderpriority""")
def graph_summary(spark, sf_dir):
    nodes = t(spark, sf_dir, "part").select(F.lit("brand").alias("type"), F.col("p_brand").alias("label"))
    return graph.summary(nodes, t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type")))


INDEX = EVENTS + """, u AS (SELECT ts, description, path FROM ev WHERE path LIKE '%.csv' GROUP BY ALL)"""


@query(INDEX + """ SELECT ts, description, path AS source_path, CASE WHEN regexp_matches(lower(description), 'spawn|powershell command|cmd\\.exe') THEN 'process_execution' WHEN regexp_matches(lower(description), 'connect|outbound|tcp|udp') THEN 'network_connection'
 WHEN lower(description) LIKE '%registry value%' THEN 'registry_change' WHEN regexp_matches(lower(description), 'defender|scan') THEN 'av_scan' WHEN lower(description) LIKE '%investigator note%' THEN 'investigator_note' ELSE 'other' END AS event_type, count(*) OVER () AS n_ids, 1 AS n FROM u""")
def case_event_index(spark, sf_dir):
    raw = P.extract(composed(spark, sf_dir, "events", "orders"))
    x = index.events(P.merge.first_wins(raw["raw_events"], ["ts", "description", "path"]))
    total = x.agg(F.count_distinct("event_id").alias("n_ids"))
    return x.crossJoin(F.broadcast(total)).select("ts", "description", "source_path", "event_type", "n_ids", F.lit(1).alias("n"))


@query("""WITH m AS (SELECT 'user' AS type, 'User' || user_id AS value, 'e' || (event_id % 7) AS source, event_id AS seq FROM events), g AS (SELECT type || ':' || lower(value) AS key, min(seq) AS seq, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM m GROUP BY 1),
 o AS (SELECT key, row_number() OVER (ORDER BY seq) AS num FROM (SELECT key, min(seq) AS seq FROM g WHERE seq % 2 = 0 GROUP BY 1)), a AS (SELECT key, num FROM o UNION ALL SELECT key, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY seq, key) FROM g WHERE key NOT IN (SELECT key FROM o)),
 i AS (SELECT DISTINCT lower('User' || (user_id * 2)) AS t FROM events WHERE event_type = 'error'), h AS (SELECT DISTINCT lower('fact of User' || (user_id * 3)) AS t FROM events WHERE event_type = 'view')
 SELECT printf('ent_%04d', num) AS entity_id, key, sources, 'entities' || CASE WHEN EXISTS (SELECT 1 FROM h WHERE contains(h.t, split_part(key, ':', 2))) THEN ',hypotheses' ELSE '' END || CASE WHEN EXISTS (SELECT 1 FROM i WHERE contains(i.t, split_part(key, ':', 2))) THEN ',iocs' ELSE '' END AS pages FROM g JOIN a USING (key)""")
def entity_index(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    m = e.select(F.lit("user").alias("type"), F.concat(F.lit("User"), "user_id").alias("value"), F.concat(F.lit("e"), F.col("event_id") % 7).alias("source"), F.col("event_id").alias("seq"))
    merged = P.merge.merge_entities(m)
    old = P.merge.numbered(merged.where("seq % 2 = 0").select(F.concat_ws(":", "type", "key").alias("key"), "seq"), ["seq"], name="num").select("key", "num")
    iocs = e.where("event_type = 'error'").select(F.concat(F.lit("User"), F.col("user_id") * 2).alias("artifact"), F.lit("").alias("reason")).distinct()
    none = F.array().cast("array<string>")
    claims = e.where("event_type = 'view'").select(F.array(F.concat(F.lit("fact of User"), F.col("user_id") * 3)).alias("facts"), F.lit("").alias("inference"), none.alias("supporting")).distinct()
    x = index.entities(merged, iocs, claims, old)
    return x.select("entity_id", "key", F.array_join("source_paths", ",").alias("sources"), F.array_join("related_pages", ",").alias("pages"))


@query("""WITH l AS (SELECT doc_id, printf('claim_%04d', doc_id) AS claim_id, 'Claim ' || doc_id AS title, CASE WHEN quality = 1 THEN 'because' ELSE '' END AS inference, toxic FROM labels)
 SELECT claim_id, title || CASE WHEN inference = '' THEN '' ELSE ': because' END AS claim_text, CASE WHEN toxic = 1 THEN 'contradictions,hypotheses' ELSE 'hypotheses' END AS pages, 'docs/' || doc_id || '.txt=seen (Source: docs/' || doc_id || '.txt).' AS supporting,
 CASE WHEN toxic = 1 THEN 'docs/x' || (doc_id % 3) || '.txt=no (Source: docs/x' || (doc_id % 3) || '.txt)' ELSE '' END AS contradicting FROM l""")
def claim_index(spark, sf_dir):
    l, d = t(spark, sf_dir, "labels"), F.col("doc_id")  # noqa: E741
    path = F.concat(F.lit("docs/x"), d % 3, F.lit(".txt"))
    claims = l.select(
        F.format_string("claim_%04d", d).alias("claim_id"), F.concat(F.lit("Claim "), d).alias("title"), F.when(F.col("quality") == 1, "because").otherwise("").alias("inference"), F.lit("Low").alias("confidence"),
        F.array(F.concat(F.lit("seen (Source: docs/"), d, F.lit(".txt).")), F.lit("no source")).alias("facts"), F.when(F.col("toxic") == 1, F.array(path)).otherwise(F.array().cast("array<string>")).alias("contradicting"),
    )
    against = spark.range(3).select(F.concat(F.lit("docs/x"), "id", F.lit(".txt")).alias("path"), F.concat(F.lit("no (Source: docs/x"), "id", F.lit(".txt)")).alias("claim_b"))
    say = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["source_path"], F.lit("="), x["evidence_text"])), "|")
    x = index.claims(claims, against)
    return x.select("claim_id", "claim_text", F.array_join("linked_pages", ",").alias("pages"), say("supporting_evidence").alias("supporting"), say("contradicting_evidence").alias("contradicting"))
