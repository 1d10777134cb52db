"""Texts as dense vectors by an embedder that is given; the one here hashes features and needs no model."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.functions import text as X
from vespera.operators.retrieval import ASKED_AT_ONCE, _best

#: A function without arguments, called once a task, that gives a function of texts to a matrix with a row a text. A model is loaded in the first.
Embedder = Callable[[], Callable[[list[str]], np.ndarray]]
#: Texts that an embedder gets at once.
BATCH = 128
#: Grams whose places a task remembers, at most about.
KNOWN = 500_000


def hashed() -> Callable[[list[str]], np.ndarray]:
    """Words and pairs of neighbours, hashed to signed dimensions, weighted by their logarithmic count, of unit length."""
    stop, token = frozenset(X.SEARCH_STOPWORDS), re.compile(X.TOKEN)
    known: dict[str, tuple[int, float]] = {}

    def place(gram: str) -> tuple[int, float]:
        digest = hashlib.md5(gram.encode()).digest()
        known[gram] = at = digest[0] % X.DIMENSIONS, -1.0 if digest[4] % 2 else 1.0
        return at

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), X.DIMENSIONS))
        for row, text in zip(out, texts):
            words = [w for w in map(str.lower, token.findall(text)) if w not in stop]
            counts = Counter(words)
            counts.update(map("_".join, zip(words, words[1:])))
            if counts:
                at = [known.get(gram) or place(gram) for gram in counts]
                dims, signs = zip(*at)
                row += np.bincount(dims, np.array(signs) * [1 + math.log(n) for n in counts.values()], X.DIMENSIONS)
            if len(known) > KNOWN:
                known.clear()
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0.0)

    return embed


def embedded(docs: DataFrame, embedder: Embedder = hashed, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, embedding (array<double>) of every row; a null text is an empty one. Nothing is shuffled."""
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches):
        embed = embedder()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                m = np.asarray(embed(some.column(1).to_pylist()), np.float64)
                if m.ndim != 2 or len(m) != some.num_rows:
                    raise ValueError(f"the embedder gave {m.shape} for {some.num_rows} texts")
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), rows], names=["doc_id", "embedding"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, embedding array<double>")


def nearest(docs: DataFrame, questions: DataFrame, k: int, embedder: Embedder = hashed) -> DataFrame:
    """qid, doc_id, score (cosine, 6 decimals), rank: the k documents (doc_id, text) nearest to each question (qid, question).

    The stated questions go to the documents in blocks of about ASKED_AT_ONCE, so documents are embedded once a block.
    Texts without a direction are near to nothing; a question's score must be above 0.
    """
    asked = embedded(questions, embedder, "qid", "question").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("q"))
    blocks, vectors, out = -(-questions.count() // ASKED_AT_ONCE), embedded(docs, embedder), None
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    long = lambda a: F.sqrt(dot(F.col(a), F.col(a)))
    vectors, asked = vectors.withColumn("dl", long("embedding")).where("dl > 0"), asked.withColumn("ql", long("q")).where("ql > 0")
    for b in range(max(1, blocks)):
        some = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else asked
        cosine = F.round(dot(F.col("embedding"), F.col("q")) / (F.col("dl") * F.col("ql")), 6)
        got = vectors.crossJoin(F.broadcast(some)).select("qid", "doc_id", cosine.alias("score"))  # a block of counted questions
        out = got if out is None else out.unionByName(got)
    return _best(out, k)
