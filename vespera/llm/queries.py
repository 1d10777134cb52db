"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vespera.llm import centroids, decontaminate, mixing, near_dup, packing, pairwise_quality, pii, quality_rules, secret_scan, token_files, toxicity, url_rules, word_runs
from vespera.llm.common import table

TOKENIZER, PACK_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _of_kind(spans: str, kind):
    """How many of the spans are of one kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == F.lit(kind))).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    say = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = [_of_kind("spans", k).alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *n, F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, secret_scan.KINDS))
    say = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")
    n = [_of_kind("base", i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *n, F.sha2(say("base"), 256).alias("base_sha256"), say("spans").alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, clusters = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    say = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    each = clusters.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sum("inertia").over(Window.partitionBy()).alias("inertia"), say.alias("centroid_sha256"))
    # A row a cluster, of which there are at most CLUSTERS.
    return got.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by crc32 of the id, repeat a stretch of their words to the end, as op13's contract has it."""
    got = docs.selectExpr("doc_id", "text", "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) AS h")
    got = got.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[ \t-\r]+"), lambda x: x != "")))
    got = got.withColumn("n", F.expr("IF(w IS NULL, 0, size(w))")).withColumn("g", F.expr("h div 10"))
    got = got.withColumn("a", F.expr("IF(n > 0, CAST(g % n AS INT), 0)")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    repeated = "array_join(transform(sequence(0, n - 1), i -> w[IF(i < a, i, a + (i - a) % p)]), ' ')"
    return got.select("doc_id", F.expr(f"IF(n > 0, {repeated}, text)").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = word_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    none = "CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"
    best = F.expr(f"aggregate(runs, {none}, (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    said = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return said.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_pii, op2_near_dup, op3_toxicity, op4_url_rules, op5_token_files, op6_quality_rules, op7_secrets, op8_decontaminate, op9_quality, op10_mixing, op11_centroids, op12_packing, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in ops}


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""

OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages
), h AS (
  SELECT page_id, low, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), x AS (SELECT page_id, low, path, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h
), v AS (
  SELECT page_id, host, coalesce(path, '') AS path, low, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM x
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(low, '(^|[^a-z0-9])casino([^a-z0-9]|$)') OR regexp_matches(low, '^[^:/?#]*://([^/?#]*[.-])?adult([^a-z0-9]|$)')
    OR regexp_matches(low, '(^|[^a-z0-9])spam-farm([^a-z0-9]|$)') OR regexp_matches(low, '^[^:/?#]*://([^/?#]*[.-])?xxx([^a-z0-9]|$)')
    OR regexp_matches(low, '(^|[^a-z0-9])poker-online([^a-z0-9]|$)') OR regexp_matches(low, '(^|[^a-z0-9])viagra([^a-z0-9]|$)')
    OR regexp_matches(low, '/wp-login\.php([^a-z0-9]|$)') OR regexp_matches(low, '/cgi-bin/') THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i + 1:i + least(10, len(ws))], ' ') AS g
  FROM b, unnest(range(0, greatest(1, len(ws) - 9))) AS t(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT size FROM g
), o AS (
  SELECT doc_id, i AS start, size, array_to_string(ws[i + 1:i + size], ' ') AS g FROM d, sizes, unnest(range(0, greatest(0, len(ws) - size + 1))) AS t(i)
), m AS (SELECT o.doc_id, o.start, o.size, g.item_id FROM o JOIN g USING (g, size)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM m, unnest(range(start, start + size)) AS t(p) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
), gm AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i + 1:i + k] || ['*'] || ws[i + k + 2:i + 10], ' ') AS g FROM b, unnest(range(0, greatest(0, len(ws) - 9))) AS t(i), range(10) AS u(k)
), dm AS (
  SELECT doc_id, k, array_to_string(ws[i + 1:i + k] || ['*'] || ws[i + k + 2:i + 10], ' ') AS g FROM d, unnest(range(0, greatest(0, len(ws) - 9))) AS t(i), range(10) AS u(k)
), near AS (
  SELECT doc_id, count(DISTINCT item) AS n FROM (SELECT doc_id, item_id::VARCHAR AS item FROM m UNION ALL SELECT doc_id, item_id::VARCHAR FROM dm JOIN gm USING (k, g)) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def _op11_sql() -> str:
    """The rounds one after another: every vector against every centroid, and centroids as means of all their vectors."""
    ctes = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM v ORDER BY h, v LIMIT 16))""",
    ]
    for r in range(4):
        ctes.append(f"""a{r} AS (SELECT vec_id, v, min((d, k)) AS b FROM (
  SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY vec_id, v)""")
        if r < 3:
            ctes.append(f"""m{r} AS (SELECT k, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS c FROM (
  SELECT b[2] AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY 1, 2) GROUP BY k)""")
            ctes.append(f"c{r + 1} AS (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    return "WITH " + ", ".join(ctes) + """
SELECT vec_id, b[2]::INTEGER AS cluster, b[1] AS distance, sum(b[1]) OVER (PARTITION BY b[2])::BIGINT AS cluster_inertia, sum(b[1]) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON k = b[2]"""


#: Runs by brute force: equal windows of 16 words give distances, and stretches of such windows at one distance are runs.
OP13_SQL = r"""
WITH h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w0, list_reduce(
    list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: ((ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1)) >> (k % 8)::INTEGER) & 1)::BIGINT),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT) AS c FROM documents
), g AS (SELECT doc_id, w0, len(w0) AS n, 4294967295 - c AS h, (4294967295 - c) // 10 AS g FROM h
), a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g
), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), w AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) ELSE w0 END AS w FROM p
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS x FROM w, unnest(range(0, greatest(0, n - 15))) AS t(i)
), e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM win a JOIN win b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i
), s AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e) GROUP BY doc_id, q, isle
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= 24 AND length >= 3 * q GROUP BY doc_id, start, length
), t AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id
), best AS (
  SELECT doc_id, start, length, period FROM r x WHERE NOT EXISTS (
    SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
      OR y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period)))
), gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(start + period, start + length)) AS t(i)
), kept AS (
  SELECT w.doc_id, string_agg(w.w[i + 1], ' ' ORDER BY i) AS text FROM w, unnest(range(n)) AS t(i) WHERE w.doc_id IN (SELECT doc_id FROM r)
    AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.i = t.i) GROUP BY w.doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, best.length::BIGINT AS length, period::BIGINT AS period,
  (1000 * best.length // period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, array_to_string(w.w, ' '))) AS collapsed_sha256
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dup": OP2_SQL, "op4_url_rules": OP4_SQL, "op8_decontaminate": OP8_SQL, "op11_centroids": _op11_sql(), "op13_periodic_runs": OP13_SQL}
