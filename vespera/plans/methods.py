"""Five ways to answer the same questions, each one job for any number of them, and their scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vespera.operators import embed, graph, retrieval
from vespera.plans import answers as A
from vespera.sources import shapes as S
from vespera.sources import storage

METHODS = ("raw", "vector", "graph", "state", "hybrid")
#: Neighbours of a node that an answer lists (part of the answers' form).
NEIGHBOURS = 5
ITEM = "id string, category string, question string, expected_best_method string, must_include array<string>, must_not_include array<string>, required_sources array<string>, expect_refusal boolean, expect_separation boolean"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file, as an array or below items; flags that are not there are false, lists are empty, a text in place of a list is a list of one."""
    v, columns = F.col("v"), []
    for name, kind in (c.strip().split() for c in ITEM.split(",")):
        read = {"string": S.text_of, "boolean": S.flag_of}.get(kind, S.texts_of)
        columns.append(read(v, name).alias(name))
    return S.records(spark, path).select(*columns).where("id is not null")


def _listed(hits: DataFrame, source) -> DataFrame:
    """qid, answer: ranked snippets with their sources."""
    line = F.concat(F.lit("- "), F.substring("snippet", 1, 160), F.lit(" (Source: "), source, F.lit(")"))
    x = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return x.select("qid", F.concat(F.lit("Answer:\n"), F.array_join(F.transform("l", lambda y: y["line"]), "\n")).alias("answer"))


def _whole(questions: DataFrame, found: DataFrame, method: str, confidence: str = "Low") -> DataFrame:
    """Every question with its answer, or that evidence is insufficient."""
    x = questions.select("qid").join(found, "qid", "left")
    none = F.col("answer").isNull()
    return x.select("qid", F.lit(method).alias("method"), F.lit("fact").alias("classification"), F.when(none, "Low").otherwise(confidence).alias("confidence"), none.alias("insufficient"), F.coalesce("answer", F.lit("Evidence is insufficient.")).alias("answer"))


def raw(files: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    hits = retrieval.bm25_many(files, questions, k, "path")
    told = hits.join(retrieval.snippets(files, hits, questions, "path"), ["qid", "doc_id"])
    return _whole(questions, _listed(told, F.col("doc_id")), "raw")


def vector(files: DataFrame, questions: DataFrame, k: int = 5, embedder: embed.Embedder | None = None) -> DataFrame:
    """Of equal snippets of a file only the first counts, so k different ones come back. Without an embedder, features are hashed."""
    chunks = retrieval.distinct_chunks(files, "path")
    hits = embed.nearest(chunks, questions, k, embedder) if embedder else retrieval.hash_cosine_many(chunks, questions, k)
    told = hits.join(chunks, "doc_id").select("qid", "rank", F.col("doc_id.path").alias("path"), F.regexp_replace("text", "\n", " ").alias("snippet"))
    return _whole(questions, _listed(told, F.col("path")), "vector")


def relations(nodes: DataFrame, edges: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, block: the neighbours of the longest node label that each question names, with edge types and evidence."""
    labels = nodes.where("type != 'source'").select("id", "label", F.struct("seq", "id").alias("seq"))
    hit = storage.stored(graph.longest_match(questions, labels).withColumnRenamed("id", "node"), "hit")  # read twice
    # the lines of a node depend on it and the spelling of its label alone: they are made once, however many questions name it
    x = _around(hit.select("node", "label").distinct(), nodes, edges)
    line = F.concat(F.lit("- "), "label", F.lit(" "), F.translate("type", "_", " "), F.lit(" "), "name", F.lit(" (Source: "), "evidence", F.lit(")"))
    x = x.select("node", "label", (F.col("type") == "mentioned_in").alias("o"), (F.col("type") == "related_to").alias("p"), line.alias("line")).distinct()
    first = Window.partitionBy("node", "label").orderBy("o", "p", "line")
    x = x.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEIGHBOURS)
    block = x.groupBy("node", "label").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    block = block.select("node", "label", F.array_join(F.transform("l", lambda y: y["line"]), "\n").alias("block"))
    return hit.join(block, ["node", "label"]).select("qid", "block")


def _around(named: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """named (node and others), other, type, evidence, name: the edges of each named node, in both directions, and the label at their other end."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "type", "evidence").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "type", "evidence"))
    return named.join(both, "node").join(nodes.select(F.col("id").alias("other"), F.col("label").alias("name")), "other")


def surroundings(nodes: DataFrame, edges: DataFrame, interest: DataFrame) -> DataFrame:
    """qid, block: every node whose label the text of interest (qid, question) names, with its first neighbours and how many more there are."""
    hit = storage.stored(graph.matches(interest, nodes.select("id", F.col("type").alias("kind"), "label")).withColumnRenamed("id", "node"), "hit")  # read twice
    # what is told of a node is the same in every question that names it, so it is made once
    x = _around(hit.select("node", "kind", "label").distinct(), nodes, edges)
    line = F.concat(F.lit("    - "), F.translate("type", "_", " "), F.lit(" "), "name", F.lit(" (Source: "), "evidence", F.lit(")"))
    of_node = Window.partitionBy("node", "kind", "label")
    first = of_node.orderBy(F.col("type") == "mentioned_in", F.col("type") == "related_to", "type", "name", "other", "evidence")
    x = x.select("*", line.alias("line"), F.count("*").over(of_node).alias("n"), F.row_number().over(first).alias("rank")).where(F.col("rank") <= NEIGHBOURS)
    told = x.groupBy("node", "label", "kind", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    head = F.concat(F.lit("- "), "label", F.lit(" ("), "kind", F.lit("): "), F.col("n").cast("string"), F.lit(" relationship(s):\n"))
    more = F.when(F.col("n") > NEIGHBOURS, F.concat(F.lit("\n    - and "), (F.col("n") - NEIGHBOURS).cast("string"), F.lit(" more"))).otherwise("")
    told = told.select("label", "node", "kind", F.concat(head, F.array_join(F.transform("l", lambda y: y["line"]), "\n"), more).alias("text"))
    told = hit.join(told, ["node", "kind", "label"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("label", "node", "text"))).alias("l"))
    return told.select("qid", F.array_join(F.transform("l", lambda y: y["text"]), "\n").alias("block"))


def every(files: DataFrame, nodes: DataFrame, edges: DataFrame, state: A.Tables, questions: DataFrame, embedder: embed.Embedder | None = None) -> DataFrame:
    """qid, method, classification, confidence, insufficient, answer: all methods over all questions (qid, question)."""
    lexical = raw(files, questions)
    best = lexical.where("not insufficient").select("qid", F.regexp_replace("answer", "^Answer:\n", "").alias("snippet"))
    block = relations(nodes, edges, questions)
    compiled = A.with_fallback(A.answers(questions, state, files.select("path", "text")), best)
    columns = ["qid", "method", "classification", "confidence", "insufficient", "answer"]
    kept = compiled.withColumn("method", F.lit("state")).select(*columns)
    evidence = F.when(F.col("insufficient"), "").otherwise(F.col("answer"))
    interest = questions.select("qid", "question").join(compiled.select("qid", evidence.alias("evidence")), "qid", "left")
    around = surroundings(nodes, edges, interest.select("qid", F.concat_ws("\n", "question", "evidence").alias("question")))
    joined = compiled.join(around, "qid", "left").withColumn("method", F.lit("hybrid"))
    joined = joined.withColumn("answer", F.concat("answer", F.coalesce(F.concat(F.lit("\nRelationships:\n"), "block"), F.lit("")))).withColumn("insufficient", F.col("insufficient") & F.col("block").isNull()).select(*columns)
    related = _whole(questions, block.select("qid", F.concat(F.lit("Answer:\n"), "block").alias("answer")), "graph", "Medium")
    return lexical.unionByName(vector(files, questions, embedder=embedder)).unionByName(related).unionByName(kept).unionByName(joined)
