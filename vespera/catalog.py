"""Named queries over the tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vespera.functions import text as X
from vespera.operators import diff, evaluate, graph, history, lint, merge, retrieval
from vespera.sources import shapes, storage

QUERIES: dict = {}
ORACLES: dict = {}
QUESTION = "Which license and version covers the public token, and is the trash idiot clown of this world pathetic?"
PHRASES = ("license", "token", "idiot", "worthless")
MARKERS = ("version", "public")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _array(words) -> str:
    return "[" + _list(words)[1:-1] + "]"


TERMS = X.query_terms(QUESTION)
TOKENS = rf"list_filter(list_transform(regexp_extract_all(text, '{X.TOKEN}'), lambda x: lower(x)), lambda x: x NOT IN {_list(X.SEARCH_STOPWORDS)})"
BM25 = f"""
WITH d AS (SELECT doc_id, text, {TOKENS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(greatest(len(ts), 1)) AS avgdl FROM d),
tf AS (SELECT doc_id, greatest(len(ts), 1) AS dl, x AS t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS x FROM d) WHERE x IN {_list(set(TERMS))} GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), q AS (SELECT unnest({_array(TERMS)}) AS t),
sc AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY doc_id),
top AS (SELECT * FROM sc WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10)"""


@query(BM25 + " SELECT * FROM top")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(t(spark, sf_dir, "documents"), QUESTION, 10)


@query(BM25 + rf""", l AS (SELECT doc_id, ls[i + 1] AS line, i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents JOIN top USING (doc_id)), unnest(range(len(ls))) AS u(i)),
h AS (SELECT doc_id, i, line, len(list_intersect(list_distinct(list_transform(regexp_extract_all(line, '{X.TOKEN}'), lambda x: lower(x))), {_array(sorted(set(TERMS)))})) AS hits FROM l WHERE trim(line) <> '')
SELECT doc_id, score, i::INT AS line_no, trim(line) AS snippet FROM top JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS r FROM h) USING (doc_id) WHERE r = 1""")
def bm25_snippet(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    top = storage.stored(retrieval.bm25(docs, QUESTION, 10), "top")
    return top.join(retrieval.snippet(docs.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi"), QUESTION), "doc_id")


@query(f"SELECT t, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY t")
def term_df(spark, sf_dir):
    x = t(spark, sf_dir, "documents").select("doc_id", F.explode(X.search_tokens(F.col("text"))).alias("t")).groupBy("t", "doc_id").agg(F.count("*").alias("tf"))
    return x.groupBy("t").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n_docs, round(avg(greatest(len(ts), 1)), 6) AS avgdl, sum(len(ts))::BIGINT AS n_tokens FROM (SELECT {TOKENS} AS ts FROM documents)")
def corpus_stats(spark, sf_dir):
    n = F.size(X.search_tokens(F.col("text")))
    return t(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.greatest(n, F.lit(1))), 6).alias("avgdl"), F.sum(n).alias("n_tokens"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def source_fingerprint(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query("""WITH n AS (SELECT doc_id AS path, sha256(text) AS sha FROM documents),
m AS (SELECT path, CASE WHEN path % 5 = 1 THEN 'x' ELSE sha END AS old, CASE WHEN path % 5 = 2 THEN 'error' ELSE 'processed' END AS status FROM n WHERE path % 5 > 0)
SELECT path, CASE WHEN status IS NULL THEN 'new' WHEN sha IS DISTINCT FROM old THEN 'changed' WHEN status <> 'processed' THEN 'failed' ELSE 'unchanged' END AS state FROM n LEFT JOIN m USING (path)""")
def manifest_delta(spark, sf_dir):
    now = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    r = F.col("path") % 5
    before = now.where(r > 0).select("path", F.when(r == 1, "x").otherwise(F.col("sha")).alias("sha"), F.when(r == 2, "error").otherwise("processed").alias("status"))
    return merge.changed_sources(now, before)


NAMES = "['PowerShell_Console.txt', 'run_keys.reg', 'sysmon.csv', 'conn_log.csv', 'av_scan.txt', 'hash_rep.txt', 'analyst.md', 'x.csv', 'y.markdown', 'z.bin']"


@query(f"""WITH f AS (SELECT doc_id, source || '/' || {NAMES}[(doc_id % 10 + 1)::INT] AS path FROM documents), n AS (SELECT *, lower(regexp_extract(path, '[^/\\\\]*$')) AS n FROM f)
SELECT doc_id, path, CASE WHEN n LIKE '%powershell%' AND (n LIKE '%history%' OR n LIKE '%console%') THEN 'powershell_history' WHEN n LIKE '%.reg' OR n LIKE '%registry%' THEN 'registry_reg'
 WHEN n LIKE '%sysmon%' AND n LIKE '%.csv' THEN 'sysmon_csv' WHEN regexp_matches(n, 'network|netflow|conn') AND n LIKE '%.csv' THEN 'network_csv' WHEN regexp_matches(n, 'defender|av_scan|antivirus') THEN 'defender_scan'
 WHEN (n LIKE '%hash%' AND regexp_matches(n, 'rep|virustotal')) OR n LIKE '%reputation%' THEN 'hash_reputation' WHEN regexp_matches(n, 'investigator|analyst|notes') THEN 'investigator_notes'
 WHEN n LIKE '%.csv' THEN 'generic_csv' WHEN regexp_matches(n, '\\.(md|markdown)$') THEN 'generic_markdown' ELSE 'generic_text' END AS kind FROM n""")
def source_kind(spark, sf_dir):
    names = F.expr("array" + "(" + NAMES[1:-1] + ")")
    p = t(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.element_at(names, (F.col("doc_id") % 10 + 1).cast("int"))).alias("path"))
    return p.withColumn("kind", X.source_kind(F.col("path")))


def _found(spark, sf_dir, pattern):
    return t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "value"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EACH = "SELECT doc_id, (i - 1)::INT AS pos, m[i] AS value FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m FROM documents), unnest(range(1, len(m) + 1)) AS u(i)"


@query(_EACH.format(p=X.IP) + "")
def extract_ips(spark, sf_dir):
    return _found(spark, sf_dir, X.IP)


@query(_EACH.format(p=EMAIL))
def extract_emails(spark, sf_dir):
    return _found(spark, sf_dir, EMAIL)


_DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"


@query(rf"SELECT doc_id, value, count(*) AS n FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(url, '{_DOMAIN}')) AS value FROM pages) WHERE NOT regexp_matches(value, '{X.NOT_A_DOMAIN}') GROUP BY ALL")
def extract_domains(spark, sf_dir):
    d = t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("url", F.lit(X.DOMAIN), F.lit(0))).alias("value"))
    return d.where(~F.col("value").rlike(X.NOT_A_DOMAIN)).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(rf"SELECT value, count(*) AS n, NOT regexp_matches(value, '{X.PRIVATE_IP}') AND value <> '0.0.0.0' AS is_public FROM (SELECT unnest(regexp_extract_all(text, '{X.IP}')) AS value FROM documents) GROUP BY value")
def ip_public_flag(spark, sf_dir):
    return _found(spark, sf_dir, X.IP).groupBy("value").agg(F.count("*").alias("n")).withColumn("is_public", X.is_public_ip(F.col("value")))


@query(rf"""WITH m AS (SELECT 'email' AS type, unnest(regexp_extract_all(text, '{EMAIL}')) AS value, source, doc_id AS seq FROM documents UNION ALL SELECT 'host', split_part(split_part(url, '://', 2), '/', 1), split_part(url, ':', 1), page_id FROM pages)
SELECT type, lower(value) AS key, arg_min(value, seq) AS value, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(DISTINCT source) AS n_sources, min(seq) AS seq FROM m GROUP BY 1, 2""")
def entity_merge(spark, sf_dir):
    a = t(spark, sf_dir, "documents").select(F.lit("email").alias("type"), F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("value"), "source", F.col("doc_id").alias("seq"))
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    b = t(spark, sf_dir, "pages").select(F.lit("host").alias("type"), host.alias("value"), F.split_part("url", F.lit(":"), F.lit(1)).alias("source"), F.col("page_id").alias("seq"))
    return merge.merge_entities(a.unionByName(b)).withColumn("sources", F.array_join("sources", ","))


def _sent_again(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "user_id", "event_type", "value")
    e = e.withColumn("seen_at", F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.col("seen_at"))).withColumn("seq", F.col("event_id"))
    return e.unionByName(e.where("event_id % 10 = 0").withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("value", F.lit(-1.0)))


AGAIN = """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS seen_at, user_id, event_type, value, event_id AS seq FROM events),
s AS (SELECT * FROM e UNION ALL SELECT event_id, seen_at, user_id, event_type, -1.0, seq + 1000000000 FROM e WHERE event_id % 10 = 0)"""


@query(AGAIN + " SELECT event_id, seen_at, user_id, event_type, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY event_id, seen_at, event_type ORDER BY seq) AS r FROM s) WHERE r = 1")
def event_dedup(spark, sf_dir):
    return merge.first_wins(_sent_again(spark, sf_dir), ["event_id", "seen_at", "event_type"])


@query(AGAIN + " SELECT event_id, seen_at, row_number() OVER (ORDER BY seen_at = 'unknown', seen_at, seq) AS n FROM e")
def event_timeline_rank(spark, sf_dir):
    e = _sent_again(spark, sf_dir).where("seq < 1000000000").select("event_id", "seen_at", "seq", (F.col("seen_at") == "unknown").alias("last"))
    return merge.numbered(e, ["last", "seen_at", "seq"]).select("event_id", "seen_at", "n")


KINDS = "['A spawned B', 'x.exe connected to 1.2.3.4', 'Registry value set', 'Defender full scan', 'Investigator note: ok', 'login']"


@query(f"""WITH d AS (SELECT event_id, {KINDS}[(event_id % 6 + 1)::INT] || ' ' || event_type AS description FROM events), l AS (SELECT *, lower(description) AS d FROM d)
SELECT event_id, description, CASE WHEN regexp_matches(d, 'spawn|powershell command|cmd\\.exe') THEN 'process_execution' WHEN regexp_matches(d, 'connect|outbound|tcp|udp') THEN 'network_connection'
 WHEN d LIKE '%registry value%' THEN 'registry_change' WHEN regexp_matches(d, 'defender|scan') THEN 'av_scan' WHEN d LIKE '%investigator note%' THEN 'investigator_note' ELSE 'other' END AS kind FROM l""")
def event_type_infer(spark, sf_dir):
    kinds = F.expr("array(" + KINDS[1:-1] + ")")
    e = t(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")), "event_type").alias("description"))
    return e.withColumn("kind", X.event_type(F.col("description")))


@query("""WITH r AS (SELECT user_id AS key, min(event_id) AS seq FROM events GROUP BY 1), p AS (SELECT key, row_number() OVER (ORDER BY seq) AS num FROM (SELECT user_id AS key, min(event_id) AS seq FROM events WHERE event_id % 4 = 0 AND user_id % 2 = 0 GROUP BY 1)),
n AS (SELECT key, (SELECT coalesce(max(num), 0) FROM p) + row_number() OVER (ORDER BY seq, key) AS num FROM r WHERE key NOT IN (SELECT key FROM p))
SELECT key, printf('ent_%04d', num) AS id FROM (SELECT * FROM p UNION ALL SELECT * FROM n)""")
def stable_ids_incremental(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    old = e.where("seq % 4 = 0 and key % 2 = 0").groupBy("key").agg(F.min("seq").alias("seq"))
    return merge.stable_ids(merge.numbered(old, ["seq"], name="num").select("key", "num"), e, "ent")


IOC = """WITH i AS (SELECT 'User' || user_id AS artifact, event_type AS type, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS first_seen, 'src' || (event_id % 20) AS source,
 ['Low', 'Medium', 'High'][(event_id % 3 + 1)::INT] AS confidence, 'reason ' || event_id AS reason, event_id AS seq FROM events)"""


@query(IOC + """ SELECT type, lower(artifact) AS key, arg_min(artifact, seq) AS artifact, coalesce(arg_min(first_seen, seq) FILTER (first_seen <> 'unknown'), 'unknown') AS first_seen, arg_min(source, seq) AS source,
 arg_max(confidence, CASE confidence WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END) AS confidence, arg_min(reason, seq) AS reason, min(seq) AS seq FROM i GROUP BY 1, 2""")
def ioc_merge(spark, sf_dir):
    e, i = t(spark, sf_dir, "events"), F.col("event_id")
    conf = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (i % 3 + 1).cast("int"))
    seen = F.when(i % 3 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return merge.merge_iocs(e.select(F.concat(F.lit("User"), "user_id").alias("artifact"), F.col("event_type").alias("type"), seen.alias("first_seen"), F.concat(F.lit("src"), i % 20).alias("source"), conf.alias("confidence"), F.concat(F.lit("reason "), i).alias("reason"), i.alias("seq")))


@query("""WITH p AS (SELECT 'Customer ' || o_custkey AS title, ['Low', 'Medium', 'High', 'Confirmed'][(o_orderkey % 4 + 1)::INT] AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS inference, o_orderstatus || o_orderpriority AS fact, o_orderkey AS seq FROM orders),
f AS (SELECT lower(title) AS key, string_agg(fact, '|' ORDER BY s) AS facts FROM (SELECT title, fact, min(seq) AS s FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT lower(title) AS key, arg_min(title, seq) AS title, arg_max(confidence, CASE confidence WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END) AS confidence, coalesce(arg_min(inference, seq) FILTER (inference <> ''), '') AS inference, any_value(facts) AS facts FROM p JOIN f ON lower(title) = f.key GROUP BY 1""")
def hypothesis_merge(spark, sf_dir):
    o, k = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    conf = F.element_at(F.array(*map(F.lit, merge.RANKS)), (k % 4 + 1).cast("int"))
    return merge.merge_hypotheses(o.select(F.concat(F.lit("Customer "), "o_custkey").alias("title"), conf.alias("confidence"), F.when(k % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("inference"), F.concat("o_orderstatus", "o_orderpriority").alias("fact"), k.alias("seq"))).withColumn("facts", F.array_join("facts", "|"))


@query("""WITH s AS (SELECT bool_or(event_type = 'error') AS active FROM events)
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'good but toxic' WHEN quality = 0 AND toxic = 0 AND active THEN 'poor while errors persist' END AS title, source FROM labels JOIN documents USING (doc_id), s WHERE quality = toxic AND (toxic = 1 OR active)""")
def contradiction_detect(spark, sf_dir):
    state = t(spark, sf_dir, "events").agg(F.bool_or(F.col("event_type") == "error").alias("active"))
    x = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").crossJoin(F.broadcast(state)).where("quality = toxic and (toxic = 1 or active)")
    return x.select("doc_id", F.when(F.col("toxic") == 1, "good but toxic").otherwise("poor while errors persist").alias("title"), "source")


LINK = f"list_distinct(list_filter(string_split_regex(translate(lower({{c}}), './', '  '), '\\s+'), lambda x: length(x) > 2 AND x NOT IN {_list(X.LINK_STOPWORDS)}))"


@query(f"""WITH b AS (SELECT item_id, unnest({LINK.format(c="text")}) AS w FROM benchmark), l AS (SELECT page_id, unnest({LINK.format(c="replace(url, '-', ' ')")}) AS w FROM pages)
SELECT item_id, page_id, count(*) AS n_shared FROM b JOIN l USING (w) GROUP BY ALL""")
def claim_token_overlap(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark").select("item_id", F.explode(X.link_tokens(F.col("text"))).alias("w"))
    p = t(spark, sf_dir, "pages").select("page_id", F.explode(X.link_tokens(F.replace("url", F.lit("-"), F.lit(" ")))).alias("w"))
    return b.join(p, "w").groupBy("item_id", "page_id").agg(F.count("*").alias("n_shared"))


@query("SELECT 'part:' || l_partkey AS node, 'order:' || l_orderkey AS source, count(*) AS n FROM lineitem GROUP BY ALL")
def graph_mentions(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("part:"), "l_partkey").alias("node"), F.concat(F.lit("order:"), "l_orderkey").alias("source")).agg(F.count("*").alias("n"))


def _mentions(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("source"))


RELATED = "WITH m AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS source FROM lineitem), e AS (SELECT a.node AS a, b.node AS b, min(source) AS evidence, count(*) AS n_shared FROM m a JOIN m b USING (source) WHERE a.node < b.node GROUP BY 1, 2), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"


@query(RELATED + " SELECT * FROM e")
def graph_related(spark, sf_dir):
    return graph.related(_mentions(spark, sf_dir))


@query(RELATED + " SELECT a AS node, count(*) AS degree FROM w GROUP BY 1")
def graph_degree(spark, sf_dir):
    return graph.degrees(graph.related(_mentions(spark, sf_dir)))


@query(RELATED + " SELECT DISTINCT a AS node, b AS neighbour FROM w WHERE a IN (1, 2, 3)")
def graph_neighbors(spark, sf_dir):
    return graph.neighbours_of(_mentions(spark, sf_dir), spark.createDataFrame([(1,), (2,), (3,)], "node long"))


@query(RELATED + " SELECT row_number() OVER (ORDER BY a, b)::INT AS n, '    n_' || a || ' --> n_' || b AS line FROM (SELECT a, b FROM e ORDER BY a, b LIMIT 200) UNION ALL SELECT 201, '    %% ' || (count(*) - 200) || ' more edge(s) left out' FROM e HAVING count(*) > 200")
def mermaid_export(spark, sf_dir):
    return graph.mermaid(graph.related(_mentions(spark, sf_dir)))


@query("""SELECT qid, arg_max(label, length(label) * 1000000 - seq) AS label FROM (SELECT n_nationkey AS qid, 'Which supplier of ' || n_name || ' in region ' || r_name || ' ships?' AS question FROM nation JOIN region ON n_regionkey = r_regionkey),
 (SELECT n_name AS label, n_nationkey AS seq FROM nation UNION ALL SELECT r_name, 1000 + r_regionkey FROM region) WHERE contains(lower(question), lower(label)) GROUP BY qid""")
def graph_longest_match(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    q = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("Which supplier of "), "n_name", F.lit(" in region "), "r_name", F.lit(" ships?")).alias("question"))
    labels = n.select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("seq")).unionByName(r.select(F.col("r_name").alias("label"), (F.col("r_regionkey") + 1000).alias("seq")))
    return graph.longest_match(q, labels)


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), s AS (SELECT doc_id, l, i AS chunk_no, 6 * i AS s FROM l, unnest(range(0, greatest(0, ceil((len(l) - 8) / 6))::INT + 1)) AS u(i) WHERE len(l) > 0)
SELECT doc_id, chunk_no::INT AS chunk_no, len(l[s + 1:s + 8])::INT AS n_lines, array_to_string(l[s + 1:s + 8], chr(10)) AS chunk FROM s""")
def chunk_windows(spark, sf_dir):
    return retrieval.chunks(t(spark, sf_dir, "documents"))


VECTOR = f"""WITH k AS (SELECT doc_id, {TOKENS} AS ts FROM documents), g AS (SELECT doc_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1]))) AS g FROM k), f AS (SELECT doc_id, g, count(*) AS tf, md5(g) AS m FROM g GROUP BY 1, 2),
r AS (SELECT doc_id, ('0x' || m[1:2])::INT AS dim, sum((CASE WHEN ('0x' || m[9:10])::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (1 + ln(tf))) AS v FROM f GROUP BY 1, 2),
x AS (SELECT doc_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS norm FROM r)"""


@query(VECTOR + " SELECT doc_id, dim, round(value, 5) + 0.0 AS value FROM x WHERE norm > 1e-9 AND abs(value) > 1e-9")
def hash_vector(spark, sf_dir):
    v = retrieval.hash_vectors(t(spark, sf_dir, "documents")).select("doc_id", F.inline("vector")).where(F.abs("value") > 1e-9)
    return v.select("doc_id", "dim", (F.round("value", 5) + 0.0).alias("value"))


@query(VECTOR + ", q AS (SELECT dim, value AS q FROM x WHERE doc_id = 1 AND norm > 1e-9), c AS (SELECT doc_id, round(sum(value * q), 6) AS cosine FROM x JOIN q USING (dim) WHERE norm > 1e-9 GROUP BY 1) SELECT * FROM c WHERE cosine > 0 ORDER BY cosine DESC, doc_id LIMIT 10")
def hash_cosine_topk(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return retrieval.hash_cosine(docs, docs.where("doc_id = 1"), 10)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe)), 4) AS cosine FROM v, q WHERE vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT 10""")
def dense_cosine_topk(spark, sf_dir):
    return retrieval.dense_cosine(t(spark, sf_dir, "embeddings"), 0, 10)


ASKED = (
    "What is the overall assessment?", "Which evidence contradicts the malware claim?", "Is this confirmed malware?", "Was any data stolen or a file copied?", "Is the binary signed?",
    "Which source files mention the host?", "Does it persist after reboot?", "Is there a beacon to a c2 server?", "What should we investigate next?", "Hello there",
)


def _like(c, *words):
    return "(" + " OR ".join(f"{c} LIKE '%{w}%'" for w in words) + ")"


#: The route of a question q (in lower case).
ROUTE = f"""CASE WHEN q LIKE '%compromise%' OR (q LIKE '%overall%' AND q LIKE '%assessment%') THEN 'compromise'
 WHEN {_like('q', 'contradict', 'conflict')} AND {_like('q', 'malware', 'claim', 'hypothesis', 'evidence', 'assessment')} THEN 'contradiction'
 WHEN {_like('q', 'confirm', 'is this', 'is there', 'is it', 'before')} AND {_like('q', 'malware', 'malicious', 'infected')} THEN 'malware'
 WHEN ({_like('q', 'steal', 'stole')} AND {_like('q', 'data', 'file', 'document')}) OR {_like('q', 'exfil', 'data theft', 'data loss', 'data leak')} THEN 'exfiltration'
 WHEN {_like('q', 'signed', 'signature', 'authenticode')} AND {_like('q', 'is', 'was', 'any', 'valid', 'digital')} THEN 'signature'
 WHEN {_like('q', 'which', 'what', 'list')} AND {_like('q', 'source', 'file')} AND {_like('q', 'mention', 'reference', 'about', 'touch')} THEN 'sources'
 WHEN {_like('q', 'persist', 'autostart', 'run key')} THEN 'persistence' WHEN {_like('q', 'network', 'c2', 'beacon', 'outbound')} THEN 'network'
 WHEN ({_like('q', 'next', 'should', 'recommend')} AND {_like('q', 'investigat', 'step', 'do', 'look')}) OR q LIKE '%what next%' THEN 'next_steps' ELSE 'generic' END"""


@query(f"""WITH a AS (SELECT conv_id, turn, text || ' ' || {_array(ASKED)}[(conv_id % 10 + 1)::INT] AS question FROM conversations WHERE role = 'user'), q AS (SELECT *, lower(question) AS q FROM a)
SELECT conv_id, turn, {ROUTE} AS route FROM q""")
def route_questions(spark, sf_dir):
    asked = F.array(*map(F.lit, ASKED))
    c = t(spark, sf_dir, "conversations").where("role = 'user'")
    q = F.concat_ws(" ", "text", F.element_at(asked, (F.col("conv_id") % 10 + 1).cast("int")))
    return c.select("conv_id", "turn", X.route(q).alias("route"))


RISKY = f"""WITH l AS (SELECT doc_id, i, lower(ls[i + 1]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS u(i)),
r AS (SELECT doc_id AS page, i::INT AS line_no, phrase FROM l, (SELECT unnest({_array(PHRASES)}) AS phrase) WHERE contains(line, phrase) AND NOT (contains(line, 'version') OR contains(line, 'public')))"""


@query(RISKY + " SELECT * FROM r")
def risky_lines(spark, sf_dir):
    return lint.risky_lines(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("text").alias("body")), PHRASES, MARKERS)


@query(RISKY + ", o AS (SELECT DISTINCT page, phrase FROM r WHERE phrase <> 'token') SELECT DISTINCT page, phrase FROM r WHERE phrase = 'token'")
def newly_risky(spark, sf_dir):
    p = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("text").alias("body"))
    return lint.newly_risky(p.withColumn("body", F.regexp_replace("body", "(?iu)token", "-")), p, phrases=PHRASES, markers=MARKERS)


LINT = """WITH f AS (SELECT 'H2' AS rule, 'High' AS severity, doc_id::VARCHAR AS page FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT 'M5', 'Medium', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE contains(text, ','))
 UNION ALL SELECT 'L2', 'Low', n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
 UNION ALL SELECT 'C2', 'Critical', page_id::VARCHAR FROM pages WHERE contains(url, 'spam'))"""


def _findings(spark, sf_dir):
    docs, labels = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    a = lint.missing(docs, labels, "doc_id", "H2", "High")
    b = lint.missing(labels, docs.where(F.contains("text", F.lit(","))), "doc_id", "M5", "Medium")
    linked = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    c = lint.missing(t(spark, sf_dir, "nation"), linked, "n_name", "L2", "Low")
    d = t(spark, sf_dir, "pages").where(F.col("url").contains("spam")).select(F.lit("C2").alias("rule"), F.lit("Critical").alias("severity"), F.col("page_id").cast("string").alias("page"))
    return a.unionByName(b).unionByName(c).unionByName(d)


@query(LINT + " SELECT * FROM f")
def lint_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


@query(LINT + " SELECT count(*) FILTER (severity = 'Critical') AS n_critical, count(*) FILTER (severity = 'High') AS n_high, count(*) FILTER (severity = 'Medium') AS n_medium, count(*) FILTER (severity = 'Low') AS n_low FROM f")
def lint_summary(spark, sf_dir):
    return lint.summary(_findings(spark, sf_dir))


@query("""SELECT key, array_to_string(list_sort(t), ',') AS types FROM (SELECT lower(c_name) AS key, list(DISTINCT type) AS t FROM (SELECT p_type AS c_name, 'part' AS type FROM part UNION ALL SELECT p_brand, 'file' FROM part UNION ALL SELECT p_brand, 'process' FROM part
 UNION ALL SELECT p_type, CASE WHEN p_size % 2 = 0 THEN 'file' ELSE 'host' END FROM part) GROUP BY 1) WHERE len(t) > 1 AND len(list_filter(t, lambda x: x NOT IN ('file', 'process', 'command'))) > 0""")
def lint_duplicates(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    row = lambda v, k: p.select(F.col(v).alias("value"), k.alias("type"))
    x = row("p_type", F.lit("part")).unionByName(row("p_brand", F.lit("file"))).unionByName(row("p_brand", F.lit("process"))).unionByName(row("p_type", F.when(F.col("p_size") % 2 == 0, "file").otherwise("host")))
    return lint.incompatible_types(x)


CASES = [(0, ["the"], ["idiot"], False), (1, ["license"], ["token"], False), (2, ["la"], ["trash"], True)]
EVAL = """WITH c(k, inc, exc, refuse) AS (VALUES (0, 'the', 'idiot', false), (1, 'license', 'token', false), (2, 'la', 'trash', true)), a AS (SELECT doc_id AS id, source AS method, lower(text) AS low, c.* FROM documents JOIN c ON doc_id % 3 = k),
k AS (SELECT id, method, 'must_include' AS kind, inc AS term, contains(low, inc) AS passed FROM a UNION ALL SELECT id, method, 'must_not_include', exc, NOT contains(low, exc) FROM a
 UNION ALL SELECT id, method, 'refusal', '', contains(low, 'not confirmed') OR starts_with(ltrim(low), 'answer:' || chr(10) || 'no') OR contains(low, chr(10) || 'no.') OR contains(low, chr(10) || 'no ') FROM a WHERE refuse),
r AS (SELECT id, method, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS n_failures FROM k GROUP BY 1, 2)"""


def _checks(spark, sf_dir):
    cases = spark.createDataFrame(CASES, "k long, must_include array<string>, must_not_include array<string>, expect_refusal boolean")
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("method"), F.col("text").alias("answer"), (F.col("doc_id") % 3).alias("k"))
    return evaluate.checks(docs.drop("k"), docs.select("id", "k").join(F.broadcast(cases), "k").drop("k"))


@query(EVAL + " SELECT * FROM k")
def eval_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(EVAL + " SELECT method, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, sum(n_failures)::BIGINT AS failures FROM r GROUP BY 1")
def eval_summary(spark, sf_dir):
    return evaluate.summary(evaluate.results(_checks(spark, sf_dir)))


@query("SELECT source AS method, count(*) AS total, round(coalesce(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (toxic = 0), 0), 0), 6) AS coverage, round(coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 0), 6) AS refusal FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def method_metrics(spark, sf_dir):
    x = t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("method")).join(t(spark, sf_dir, "labels"), "doc_id")
    good, tox = F.col("quality") == 1, F.col("toxic") == 1
    return x.groupBy("method").agg(F.count("*").alias("total"), evaluate.ratio(good, ~tox).alias("coverage"), evaluate.ratio(good, tox).alias("refusal"))


HISTORY = """WITH h AS (SELECT user_id, date_trunc('week', ts)::DATE AS step, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2),
c AS (SELECT user_id, step, n, CASE WHEN n >= 4 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM h), l AS (SELECT *, lag(confidence) OVER (PARTITION BY user_id ORDER BY step) AS before FROM c)"""


def _errors(spark, sf_dir):
    h = t(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("step")).agg(F.count("*").alias("n"))
    return h.withColumn("confidence", F.when(F.col("n") >= 4, "high").when(F.col("n") >= 2, "medium").otherwise("low"))


@query(HISTORY + " SELECT user_id, step::VARCHAR AS step, n, confidence, before FROM l")
def hypothesis_history(spark, sf_dir):
    return history.trajectory(_errors(spark, sf_dir), ["user_id"], "step", "confidence").withColumn("step", F.col("step").cast("string"))


WEEKS = HISTORY + ", z AS (SELECT min(step) AS a, max(step) AS b FROM c), old AS (SELECT * FROM c, z WHERE step = a), now AS (SELECT * FROM c, z WHERE step = b)"


def _weeks(spark, sf_dir):
    """The first and the last week's rows."""
    h = _errors(spark, sf_dir)
    ends = h.agg(F.min("step").alias("a"), F.max("step").alias("b"))
    x = h.crossJoin(F.broadcast(ends))
    return x.where("step = a"), x.where("step = b")


@query(WEEKS + " SELECT user_id, old.confidence AS old, now.confidence AS new FROM old JOIN now USING (user_id) WHERE old.confidence <> now.confidence")
def confidence_changes(spark, sf_dir):
    return history.changed(*_weeks(spark, sf_dir), ["user_id"], "confidence")


@query(WEEKS + " SELECT user_id, n FROM now WHERE user_id NOT IN (SELECT user_id FROM old)")
def new_since_prior(spark, sf_dir):
    return history.new_rows(*_weeks(spark, sf_dir), ["user_id"]).select("user_id", "n")


@query("""WITH h AS (SELECT DISTINCT 'Source ' || source AS title, 'one' AS step FROM documents WHERE doc_id % 2 = 0), c AS (SELECT 'SOURCE ' || source AS title, count(*) FILTER (quality = 1) AS s, count(*) FILTER (quality = 0) AS x FROM documents JOIN labels USING (doc_id) GROUP BY source)
 SELECT title, step, 'low' AS confidence, 0 AS s, 0 AS x FROM h UNION ALL SELECT title, 'two', 'high', s::INT, x::INT FROM c UNION ALL SELECT title, 'one', 'high', s::INT, x::INT FROM c WHERE lower(title) NOT IN (SELECT lower(title) FROM h)""")
def history_steps(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    h = d.where("doc_id % 2 = 0").select(F.concat(F.lit("Source "), "source").alias("title"), F.lit("").alias("claim_id"), F.lit("one").alias("step"), F.lit("low").alias("confidence"), F.lit("").alias("assessment"), F.lit(0).alias("supporting_count"), F.lit(0).alias("contradicting_count")).distinct()
    x = d.join(t(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.collect_list(F.when(F.col("quality") == 1, "y")).alias("supporting"), F.collect_list(F.when(F.col("quality") == 0, "n")).alias("contradicting"))
    claims = x.select(F.concat(F.lit("SOURCE "), "source").alias("title"), F.lit("").alias("claim_id"), F.lit("High").alias("confidence"), "supporting", "contradicting")
    for step in ("two", "one"):
        h = history.with_step(h, history.steps_of(claims, step, F.lit("")))
    return h.select("title", "step", "confidence", F.col("supporting_count").alias("s"), F.col("contradicting_count").alias("x"))


@query("""WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN line || ' changed' ELSE line END AS line FROM o),
a AS (SELECT doc_id, line, count(*) AS k FROM o GROUP BY 1, 2), b AS (SELECT doc_id, line, count(*) AS k FROM n GROUP BY 1, 2)
SELECT doc_id, line, coalesce(a.k, 0) AS removed, coalesce(b.k, 0) AS added FROM a FULL JOIN b USING (doc_id, line) WHERE a.k IS DISTINCT FROM b.k""")
def snapshot_line_diff(spark, sf_dir):
    o = t(spark, sf_dir, "documents").select("doc_id", "text")
    n = o.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat(F.replace("text", F.lit("\n"), F.lit(" changed\n")), F.lit(" changed"))).otherwise(F.col("text")))
    return diff.line_counts(o, n, "doc_id", "text")


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({LINK.format(c='text')}, [source, lang]))), ',') AS pages FROM documents")
def hybrid_union(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_union(X.link_tokens(F.col("text")), F.array("source", "lang"))), ",").alias("pages"))


@query("SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(spark, sf_dir):
    return shapes.members(t(spark, sf_dir, "events"), "event_id", "props").select("event_id", F.col("name").alias("key"), "value")


@query("SELECT source AS page, string_agg('- ' || doc_id || ' (' || lang || ')', chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY source")
def page_render(spark, sf_dir):
    x = t(spark, sf_dir, "documents").groupBy(F.col("source").alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))).alias("l"))
    return x.select("page", F.array_join(F.transform("l", lambda y: F.concat(F.lit("- "), y["doc_id"], F.lit(" ("), y["lang"], F.lit(")"))), "\n").alias("body"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_incremental_merge(spark, sf_dir):
    from vespera.streaming.incremental import merge_stream

    root = storage.scratch(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    got = merge_stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema, f"{root}/out", f"{root}/checkpoint", ["user_id", "event_type"], "event_id")
    return got.select("user_id", "event_type", "event_id", "value")


from vespera import catalog_case, catalog_plugs, catalog_rules, catalog_state  # noqa: E402, F401, I001  they add their queries to QUERIES
