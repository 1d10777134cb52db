"""A stored lexical index: postings by term, in blocks, so that a question reads its own terms and nothing else."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.functions import text as X
from vespera.operators import retrieval
from vespera.sources import storage

#: Folders that the terms are dealt over; a question reads those of its terms, and of their files the row groups that may hold them.
BUCKETS = 64
#: Postings of a term that one task writes, about: a frequent term is dealt over several.
POSTINGS = 1_000_000
#: Documents whose postings Python inverts at once.
INVERTED = 4_096


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(docs: DataFrame) -> DataFrame:
    """t, n, least (id), doc_id, dl, tf (arrays, which take less than one of structs) of doc_id, terms: what INVERTED documents hold of a term is one row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(b):
        ids, cells = b.column(0), b.column(1).flatten()
        t = cells.field(0).dictionary_encode()
        code = t.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        at = np.flatnonzero(np.diff(code[by], prepend=-1))
        row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))[by]
        order = pa.array(by)
        ends = np.append(at, len(by)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (ids.take(pa.array(row)), cells.field(2).take(order), cells.field(1).take(order))]
        return pa.RecordBatch.from_arrays([t.dictionary.take(pa.array(code[by[at]])), pa.array(np.diff(ends).astype(np.int64)), ids.take(pa.array(row[at])), *lists], names=["t", "n", "least", "doc_id", "dl", "tf"])

    def invert(batches):
        for b in batches:
            for at in range(0, b.num_rows, INVERTED):
                yield one(b.slice(at, INVERTED))
            del b
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "terms").mapInArrow(invert, f"t string, n long, least {kind}, doc_id array<{kind}>, dl array<int>, tf array<long>")


def build(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the postings (t, n, doc_id, dl, tf as arrays), the terms (t, df) and one row of statistics (n, avgdl) below root.

    A null text is an empty one. Rows that share an id are documents of their own and add up in its score.
    """
    counted = storage.stored(retrieval.term_counts(docs, id_col, text_col), "terms")
    told = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(counted.schema["doc_id"].dataType.simpleString()).alias("id_type"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings"))
    told.write.mode("overwrite").parquet(f"{root}/statistics")
    spark = docs.sparkSession
    dealt = _blocks(retrieval.by_document(counted)).withColumn("bucket", _bucket("t"))
    # a range of (bucket, t, id): a term of any number of postings goes to as many tasks as it fills
    parts = max(1, spark.read.parquet(f"{root}/statistics").first()["postings"] // POSTINGS)
    dealt.repartitionByRange(parts, "bucket", "t", "least").sortWithinPartitions("bucket", "t").drop("least").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    terms = spark.read.schema("t string, n long, bucket int").parquet(f"{root}/postings").groupBy("bucket", "t").agg(F.sum("n").alias("df"))
    terms.repartitionByRange("bucket", "t").sortWithinPartitions("bucket", "t").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/terms")


def search(spark: SparkSession, root: str, questions: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of each question (qid, question) by BM25, as bm25_many gives them.

    Up to 1,000 terms are told to the scan, which then reads their buckets only; more of them meet the postings by a join.
    """
    q = retrieval.asked_terms(questions)
    terms = [r["t"] for r in q.select("t").distinct().limit(1_001).collect()]
    stats = spark.read.parquet(f"{root}/statistics")
    kind = stats.first()["id_type"]
    postings = spark.read.schema(f"t string, doc_id array<{kind}>, dl array<int>, tf array<long>, bucket int").parquet(f"{root}/postings")
    df = spark.read.schema("t string, df long, bucket int").parquet(f"{root}/terms")
    if len(terms) <= 1_000:
        buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket("t").alias("b")).distinct().collect()]
        asked = F.col("bucket").isin(*buckets or [-1]) & F.col("t").isin(*terms or [""])
        postings, df = postings.where(asked), df.where(asked)
    found = postings.join(q.select("t").distinct(), "t", "left_semi").select("t", F.inline(F.arrays_zip("doc_id", "dl", "tf")))
    docs = found.groupBy("doc_id").agg(F.collect_list(F.struct("t", "tf", "dl")).alias("terms"))
    return retrieval.ranked(docs, q, df.drop("bucket"), stats, k)
