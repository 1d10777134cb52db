"""Lexical and vector retrieval."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vespera.functions import text as X
from vespera.sources import storage

K1, B = 1.5, 0.75
#: Documents whose vectors Python hands over at once.
VECTORS = 256
#: Terms that a scan is told to keep, and weights of terms in questions that are sent to every task, at most.
TOLD, WEIGHTS = 200_000, 500_000
#: Scores that a task holds at once, about.
SCORES = 1 << 18


def bm25(docs: DataFrame, question: str, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents by BM25: doc_id, score (6 decimals). One scan counts lengths and the question's terms only."""
    terms = X.query_terms(question)
    weight = {t: terms.count(t) for t in terms}
    d = docs.select(docs[id_col].alias("doc_id"), X.search_tokens(docs[text_col]).alias("t"))
    d = d.select("doc_id", F.greatest(F.size("t"), F.lit(1)).alias("dl"), F.filter("t", lambda t: t.isin(*weight or [""])).alias("hits"))
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = d.select("doc_id", "dl", F.explode("hits").alias("t")).groupBy("doc_id", "dl", "t").agg(F.count("*").alias("tf"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    w = F.create_map(*[x for t, n in weight.items() for x in (F.lit(t), F.lit(n))]) if weight else F.create_map()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = w[F.col("t")] * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(F.broadcast(df), "t").crossJoin(F.broadcast(stats)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def snippet(docs: DataFrame, question: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, snippet: each document's non-blank line with the most distinct terms, the earliest of equals."""
    terms = sorted(set(X.query_terms(question)))
    lines = docs.select(docs[id_col].alias("doc_id"), F.posexplode(F.split(docs[text_col], "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    hits = F.size(F.array_intersect(X.search_tokens(F.col("line")), F.array(*map(F.lit, terms)).cast("array<string>")))
    best = F.max_by(F.struct("line_no", "line"), F.struct(hits, -F.col("line_no"))).alias("best")
    return lines.groupBy("doc_id").agg(best).select("doc_id", "best.line_no", F.trim("best.line").alias("snippet"))


def hash_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, vector (array of dim, value, by dim; at most DIMENSIONS): signed, tf-weighted feature hashing of unit length.

    A document is one row, so its grams are counted where it is read and nothing is shuffled. Column functions can't count
    within a row in linear time; Python does, on Arrow batches. Documents without grams have no vector.
    """
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("value", T.DoubleType())])
    out = T.StructType([T.StructField("doc_id", d.schema[0].dataType), T.StructField("vector", T.ArrayType(kind))])
    stop, token = frozenset(X.SEARCH_STOPWORDS), re.compile(X.TOKEN)

    def run(batches):
        known: dict[str, tuple[int, float]] = {}

        def place(gram: str) -> tuple[int, float]:
            digest = hashlib.md5(gram.encode()).digest()
            known[gram] = digest[0], -1.0 if digest[4] % 2 else 1.0
            return known[gram]

        for whole in batches:
            for at in range(0, whole.num_rows, VECTORS):
                batch = whole.slice(at, VECTORS)
                keep, dims, values, ends = [], [], [], [0]
                for i, text in enumerate(batch.column(1)):
                    words = [w for w in map(str.lower, token.findall(text.as_py() or "")) if w not in stop]
                    counts = Counter(words)
                    counts.update(f"{a}_{b}" for a, b in zip(words, words[1:]))
                    v = np.zeros(X.DIMENSIONS)
                    for gram, n in counts.items():
                        dim, sign = known.get(gram) or place(gram)
                        v[dim] += sign * (1 + math.log(n))
                    norm = math.sqrt(float(v @ v))
                    if norm > 1e-9:
                        keep.append(i)
                        dims.append(np.flatnonzero(v))
                        values.append(v[dims[-1]] / norm)
                        ends.append(ends[-1] + len(dims[-1]))
                    if len(known) > 500_000:
                        known.clear()
                cells = pa.StructArray.from_arrays([pa.array(np.concatenate([*dims, []]).astype(np.int32)), pa.array(np.concatenate([*values, []]))], names=["dim", "value"])
                vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), vectors], names=["doc_id", "vector"])

    return d.mapInArrow(run, out)


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question; Spark drops the rest of a partition's rows before it shuffles them."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """doc_id, dl (search tokens, 1 at least), terms (array of t, tf, dl; of the given terms only) of every document.

    A document is one row, so its terms are counted where it is read and nothing is shuffled. A null text is an empty one.
    """
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = T.StructType([T.StructField("t", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
    out = T.StructType([T.StructField("doc_id", d.schema[0].dataType), T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(kind))])
    told = None if only is None else d.sparkSession.sparkContext.broadcast(frozenset(only))
    stop, token = frozenset(X.SEARCH_STOPWORDS), re.compile(X.TOKEN)

    def run(batches):
        keep = told and told.value
        for whole in batches:
            for at in range(0, whole.num_rows, VECTORS):
                batch = whole.slice(at, VECTORS)
                lengths, terms, counts, ends = [], [], [], [0]
                for text in batch.column(1):
                    found: dict[str, int] = {}
                    for word, n in Counter(token.findall(text.as_py() or "")).items():
                        low = word.lower()
                        found[low] = found.get(low, 0) + n
                    for word in stop.intersection(found):
                        del found[word]
                    lengths.append(max(1, sum(found.values())))
                    if keep is not None:
                        found = {t: found[t] for t in keep.intersection(found)}
                    terms += found.keys()
                    counts += found.values()
                    ends.append(len(terms))
                each = pa.array(np.repeat(np.array(lengths, np.int32), np.diff(ends)))
                cells = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()), each], names=["t", "tf", "dl"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), lists], names=["doc_id", "dl", "terms"])

    return d.mapInArrow(run, out)


def by_document(counted: DataFrame) -> DataFrame:
    """doc_id, terms of stored term_counts, one row an id. Rows that share an id and a length count as one document, as in SQL's grouping."""
    if counted.groupBy("doc_id").count().where("count > 1").isEmpty():
        return counted.select("doc_id", "terms")
    flat = counted.select("doc_id", F.inline("terms")).groupBy("doc_id", "t", "dl").agg(F.sum("tf").alias("tf"))
    return storage.stored(flat.groupBy("doc_id").agg(F.collect_list(F.struct("t", "tf", "dl")).alias("terms")), "terms")


def asked_terms(questions: DataFrame) -> DataFrame:
    """qid, t, weight: how often each question has each term."""
    return questions.select("qid", F.explode(X.search_tokens(F.col("question"))).alias("t")).groupBy("qid", "t").agg(F.count("*").alias("weight"))


def bm25_many(docs: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of each question. questions: qid, question.

    One scan for all questions: documents keep the terms that any question uses, then meet the questions by term.
    """
    q = asked_terms(questions)
    terms = [r["t"] for r in q.select("t").distinct().limit(TOLD + 1).collect()]
    counted = storage.stored(term_counts(docs, id_col, text_col, terms if len(terms) <= TOLD else None), "terms")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    docs = by_document(counted)
    df = docs.select(F.inline("terms")).groupBy("t").agg(F.count("*").alias("df"))
    return ranked(docs, q, df, stats, k)


def ranked(docs: DataFrame, q: DataFrame, df: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k best by BM25. docs: doc_id, terms (array of t, tf, dl); q: qid, t, weight; df: t, df; stats: one row of n, avgdl.

    The weights of up to WEIGHTS terms in questions are sent along. A task scores its documents for all questions and
    hands on those that are among the k best it has seen; pairs of questions and documents are not shuffled. More weights
    meet the documents by term.
    """
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = q.join(df, "t").crossJoin(F.broadcast(stats.select("n", "avgdl"))).withColumn("w", F.col("weight") * idf)  # one row of statistics
    told = known.select("qid", "t", "w", "avgdl").limit(WEIGHTS + 1).toArrow()
    if told.num_rows > WEIGHTS:
        part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return _best(docs.select("doc_id", F.inline("terms")).join(known, "t").groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score")), k)
    asked = told.column("qid").combine_chunks().dictionary_encode()
    words = told.column("t").combine_chunks().dictionary_encode()
    by = np.argsort(words.indices.to_numpy(), kind="stable")
    n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
    shared = docs.sparkSession.sparkContext.broadcast({
        "qids": asked.dictionary, "terms": words.dictionary, "q": asked.indices.to_numpy()[by].astype(np.int64), "w": told.column("w").to_numpy()[by], "n": n, "at": np.cumsum(n) - n,
        "avgdl": told.column("avgdl")[0].as_py() if told.num_rows else 1.0,
    })

    def score(batches):
        x = shared.value
        size = max(1, len(x["qids"]))
        step = max(1, SCORES // size)
        best = np.zeros((k, size))  # of each question, the k best scores so far
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                cells = batch.column(1).flatten()
                t, count, dl = (cells.field(i) for i in range(3))
                count, dl = count.to_numpy(zero_copy_only=False), dl.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
                term = pc.fill_null(pc.index_in(t, x["terms"]), -1).to_numpy(zero_copy_only=False)
                value = count * (K1 + 1) / (count + K1 * (1 - B + B * dl / x["avgdl"]))
                row, term, value = row[term >= 0], term[term >= 0], value[term >= 0]
                n = x["n"][term]
                first = np.cumsum(n) - n
                cell = np.repeat(x["at"][term] - first, n) + np.arange(n.sum())
                flat = np.bincount(np.repeat(row, n) * size + x["q"][cell], np.repeat(value, n) * x["w"][cell], batch.num_rows * size)
                s = np.floor(flat.reshape(batch.num_rows, size) * 1e6 + 0.5) / 1e6
                # rows are in order of doc_id, so the first of equal scores are the least ids
                s = np.concatenate((best, s))
                best = np.partition(s, len(s) - k, axis=0)[-k:]
                above, equal = s > best[0], s == best[0]
                keep = above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0)))
                r, c = np.nonzero((keep & (s > 0))[k:])
                yield pa.RecordBatch.from_arrays([x["qids"].take(pa.array(c)), batch.column(0).take(pa.array(r)), pa.array(s[r + k, c])], names=["qid", "doc_id", "score"])

    out = T.StructType([q.schema["qid"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return _best(docs.select("doc_id", "terms").sortWithinPartitions("doc_id").mapInArrow(score, out), k)


#: Questions whose vectors are sent to every task; more of them meet the documents by dimension.
ASKED_AT_ONCE = 1_000


def hash_cosine_many(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k documents nearest to each question by hashed vectors.

    A stated set of questions against all documents: up to ASKED_AT_ONCE are counted and sent along, one pass over documents.
    """
    asked = hash_vectors(questions.select(F.col("qid").alias("doc_id"), F.col("question").alias("text")))
    if questions.limit(ASKED_AT_ONCE + 1).count() <= ASKED_AT_ONCE:
        q = asked.select(F.col("doc_id").alias("qid"), F.map_from_entries("vector").alias("q"))
        dot = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at("q", x["dim"]), F.lit(0.0)))
        return _best(hash_vectors(docs).crossJoin(F.broadcast(q)).select("qid", "doc_id", F.round(dot, 6).alias("score")), k)
    flat = lambda df, key: df.select(F.col("doc_id").alias(key), F.inline("vector").alias("dim", "value"))
    q = flat(asked, "qid").withColumnRenamed("value", "other")
    dots = flat(hash_vectors(docs), "doc_id").join(q, "dim").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("value") * F.col("other")), 6).alias("score"))
    return _best(dots, k)


def snippets(docs: DataFrame, hits: DataFrame, questions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """qid, doc_id, snippet: the line of each hit's document that holds most distinct terms of its question, the earliest of equals."""
    asked = questions.select("qid", F.array_distinct(X.search_tokens(F.col("question"))).alias("terms"))
    found = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(hits.select("qid", "doc_id"), "doc_id").join(asked, "qid")
    line = found.select("qid", "doc_id", "terms", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    n = F.size(F.array_intersect(X.search_tokens(F.col("line")), "terms"))
    return line.groupBy("qid", "doc_id").agg(F.trim(F.max_by("line", F.struct(n, -F.col("line_no")))).alias("snippet"))


def hash_cosine(docs: DataFrame, question_doc: DataFrame, k: int) -> DataFrame:
    """The k documents nearest to one text by hashed vectors: doc_id, cosine."""
    # one row: the question's vector as a map from dimension to value
    q = hash_vectors(question_doc).select(F.map_from_entries("vector").alias("q")).limit(1)
    dot = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at("q", x["dim"]), F.lit(0.0)))
    s = hash_vectors(docs).crossJoin(F.broadcast(q)).select("doc_id", F.round(dot, 6).alias("cosine"))
    return s.where("cosine > 0").orderBy(F.desc("cosine"), "doc_id").limit(k)


def chunks(docs: DataFrame, size: int = 8, step: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_no, n_lines, chunk: windows of non-blank lines; the last one reaches the end."""
    lines = docs.select(docs[id_col].alias("doc_id"), F.filter(F.split(docs[text_col], "\n"), lambda x: F.trim(x) != "").alias("l")).where(F.size("l") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("l") - size) / step) * step).cast("int")
    at = lines.select("doc_id", "l", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_no", "s"))
    part = F.slice("l", F.col("s") + 1, F.lit(size))
    return at.select("doc_id", "chunk_no", F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("chunk"))


def distinct_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (struct of path and chunk_no), text: chunks, of equal ones of a document the first, so that a top-k holds k different ones."""
    each = chunks(docs, id_col=id_col, text_col=text_col).groupBy("doc_id", "chunk").agg(F.min("chunk_no").alias("chunk_no"))
    return each.select(F.struct(F.col("doc_id").alias("path"), "chunk_no").alias("doc_id"), F.col("chunk").alias("text"))


def dense_cosine(vectors: DataFrame, query_id: int, k: int) -> DataFrame:
    """The k nearest of vec_id, embedding to the vector query_id: vec_id, cosine (4 decimals)."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = v.where(F.col("vec_id") == query_id).select(F.col("e").alias("qe")).limit(1)
    c = F.round(dot(F.col("e"), F.col("qe")) / F.sqrt(dot(F.col("e"), F.col("e")) * dot(F.col("qe"), F.col("qe"))), 4)
    return v.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(q)).select("vec_id", c.alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)
