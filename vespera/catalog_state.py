"""Queries of files, keyed state, state over time, stored indexes and stateful streams, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vespera.catalog import ORACLES, query, t
from vespera.operators import lexical_index, vector_index
from vespera.plans import evidence as P
from vespera.plans import pages, replay
from vespera.sources import csvs, files, storage
from vespera.sources import evidence as S

# ---- files

FILE = "CASE WHEN s_suppkey % 7 = 0 THEN '.hid/' ELSE 'step_' || (s_suppkey % 3) || '/' END || CASE WHEN s_suppkey % 5 = 0 THEN '_' ELSE '' END || 'f' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_sysmon.csv' ELSE '.txt' END"
TEXT = "s_name || chr(10) || s_nationkey"


@query(f"SELECT path, kind, sha256(text) AS sha, length(text)::BIGINT AS length FROM (SELECT {FILE} AS path, {TEXT} AS text, CASE WHEN s_suppkey % 2 = 0 THEN 'sysmon_csv' ELSE 'generic_text' END AS kind FROM supplier WHERE s_suppkey % 7 > 0)")
def source_scan(spark, sf_dir):
    root = storage.scratch(spark, "tree")
    files.write_texts(t(spark, sf_dir, "supplier").select(F.expr(FILE).alias("path"), F.expr(TEXT).alias("text")), root)
    return S.scan(spark, root).select("path", "kind", "sha", "length")


@query(r"SELECT page_id::VARCHAR AS page_id, md5(regexp_replace(html, '^\s+|\s+$', '', 'g')) AS html FROM pages")
def csv_split_rows(spark, sf_dir):
    """Pages as CSV files of quoted fields with line ends and quotes, read in ranges of 64 KB."""
    root = storage.scratch(spark, "csv")
    t(spark, sf_dir, "pages").select("page_id", "html", "url").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(root)
    found = files.listing(spark, root).where("path like 'part-%'").withColumns({"kind": F.lit("generic_csv"), "seq": F.col("path")})
    rows = csvs.split_rows(found, root, 1 << 16)
    return rows.select(F.element_at("row", "page_id").alias("page_id"), F.md5(F.element_at("row", "html")).alias("html"))


# ---- keyed state

MENTION = {"seq": "lpad(event_id || '', 12, '0')", "type": "event_type", "value": "CASE WHEN event_id % 3 = 0 THEN 'USER' ELSE 'user' END || user_id", "source": "'s' || (event_id % 17)"}


@query("WITH m AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in MENTION.items()) + " FROM events) SELECT type, lower(value) AS key, arg_min(value, seq) AS value, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, min(seq) AS seq FROM m GROUP BY 1, 2")
def ingest_merge(spark, sf_dir):
    """Mentions that come in three batches by two writers, each merged into the buckets it touches."""
    root = storage.scratch(spark, "state")
    writers = [storage.Versions(spark, root) for _ in range(2)]
    _, key, facts, merge, back = P.KEYED["entities"]
    for b in range(3):
        rows = t(spark, sf_dir, "events").where(F.col("event_id") % 3 == b).select(*[F.expr(v).alias(k) for k, v in MENTION.items()])
        writer = writers[b % 2]
        since = writer.last()
        staged = writer.upsert("entities", facts(rows), key, merge, back, since)
        writers[1 - b % 2].commit({f"other{b}": [root]})  # another table meanwhile
        writer.commit(staged, since)
    return spark.read.parquet(*writers[0].folders("entities")).withColumn("sources", F.array_join("sources", ","))


# ---- state over time

STEP, RANK = "strftime(o_orderdate, '%Y-%m')", "6 - left(o_orderpriority, 1)::INT"


def _states(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("key"), F.col("o_orderpriority").alias("confidence"), F.date_format("o_orderdate", "yyyy-MM").alias("step"))
    return replay.intervals(o, ["key"], "confidence", 6 - F.substring("confidence", 1, 1).cast("int"))


@query(f"SELECT o_custkey % 300 AS key, arg_max(o_orderpriority, {RANK}) AS confidence FROM orders WHERE {STEP} <= '1996-03' GROUP BY 1")
def state_as_of(spark, sf_dir):
    return replay.as_of(_states(spark, sf_dir), F.lit("1996-03")).select("key", "confidence")


@query(f"""WITH s AS (SELECT DISTINCT {STEP} AS step FROM orders), k AS (SELECT o_custkey % 300 AS key, {STEP} AS step, {RANK} AS r, o_orderpriority AS p FROM orders), x AS (SELECT s.step, key, arg_max(p, r) AS confidence FROM s JOIN k ON k.step <= s.step GROUP BY 1, 2)
SELECT step, key, confidence, before FROM (SELECT *, lag(confidence) OVER (PARTITION BY key ORDER BY step) AS before FROM x) WHERE before IS DISTINCT FROM confidence""")
def replay_all_steps(spark, sf_dir):
    return replay.moves(_states(spark, sf_dir), ["key"], "confidence").select("step", "key", "confidence", "before")


@query("""WITH n AS (SELECT (row_number() OVER (ORDER BY stamp = 'unknown', stamp, event_id) - 1) // 250 AS part, event_id, '- ' || stamp || ' ' || event_type || ' (Source: u' || user_id || ')' AS line, row_number() OVER (ORDER BY stamp = 'unknown', stamp, event_id) AS r
 FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events)) SELECT 'timeline' AS page, part, count(*) AS lines, string_agg(line, chr(10) ORDER BY r) AS body FROM n GROUP BY part""")
def page_parts(spark, sf_dir):
    stamp = F.when(F.col("event_id") % 9 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    e = t(spark, sf_dir, "events").select(stamp.alias("ts"), F.col("event_type").alias("description"), F.concat(F.lit("u"), "user_id").alias("path"), F.lpad(F.col("event_id").cast("string"), 19, "0").alias("seq"))
    return pages.timeline_parts(e, 250)


# ---- stored indexes


@query(ORACLES["bm25_many"])
def bm25_indexed(spark, sf_dir):
    root = storage.scratch(spark, "lexical")
    lexical_index.build(t(spark, sf_dir, "documents"), root)
    return lexical_index.search(spark, root, t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")), 5)


@query(ORACLES["dense_cosine_topk"])
def dense_ann_topk(spark, sf_dir):
    root, v = storage.scratch(spark, "vectors"), t(spark, sf_dir, "embeddings")
    vector_index.build(v, root)
    asked = v.where("vec_id = 0").first()["embedding"]
    return vector_index.search(spark, root, asked, 11).where("id != 0").select(F.col("id").alias("vec_id"), "cosine")


# ---- streams


@query(ORACLES["stream_incremental_merge"])
def stream_stateful_merge(spark, sf_dir):
    from vespera.streaming.stateful import merge_stream

    root = storage.scratch(spark, "stateful")
    path = f"{sf_dir}/events.parquet"
    got = merge_stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema, f"{root}/out", f"{root}/checkpoint", ["user_id", "event_type"], "event_id")
    return got.select("user_id", "event_type", "event_id", "value")
