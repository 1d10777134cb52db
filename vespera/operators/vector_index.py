"""A stored vector index: inverted lists around centroids, with radii that make a search exact.

Vectors are scaled to length one, so that the nearest by distance is the nearest by cosine. The centroids are fitted on a
bounded sample, every vector is in the list of its nearest one, and a list's radius is its farthest member's distance. No
member of a list is nearer to a question than the centroid's distance less the radius, so lists beyond the k-th best
found so far need not be read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.sources import storage

#: Vectors that the centroids are fitted on, at most; the least by a hash of the id.
FIT_ROWS = 20_000
LISTS, ROUNDS, PROBES = 64, 8, 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of the vectors that have a direction: not null, finite, not zero. All must have one length."""
    v = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.coalesce(finite, F.lit(False)))


def build(vectors: DataFrame, root: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS) -> None:
    """Write the lists (list, id, v, far), a folder a list, and what a search needs of them: centroids, radii, sizes."""
    spark = vectors.sparkSession
    good = storage.stored(usable(vectors, id_col, vector_col), "vectors")  # read twice; an embedder is asked once
    # the hash that ends the sample is found by ids alone, so that no task meets more vectors than the sample's
    last = good.select(F.xxhash64("id").alias("h")).orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]
    sample = good.where(F.xxhash64("id") <= F.lit(last)).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks() if last is not None else []
    x = _unit(_matrix(sample)) if len(sample) else np.zeros((0, 1))
    rng = np.random.default_rng(1)
    c = x[np.sort(rng.permutation(len(x))[:lists])] if len(x) else x
    for _ in range(ROUNDS if len(c) else 0):
        of = np.argmax(x @ c.T, axis=1)
        c = _unit(np.array([x[of == k].sum(0) if (of == k).any() else c[k] for k in range(len(c))]))
    shared = spark.sparkContext.broadcast(c)  # LISTS vectors

    def place(batches):
        for b in batches:
            if b.num_rows:
                v = _unit(_matrix(b.column(1)))
                to = np.sqrt(np.maximum(0.0, 2 - 2 * v @ shared.value.T))
                near = to.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(to[np.arange(len(v)), near])], names=["id", "v", "list", "far"])

    kind = good.schema["id"].dataType.simpleString()
    # by list and a hash, so that a large list is written by several tasks
    placed = storage.stored(good.mapInArrow(place, f"id {kind}, v array<double>, list int, far double"), "placed")  # read for the ranges too
    placed.repartitionByRange("list", F.xxhash64("id")).write.mode("overwrite").partitionBy("list").parquet(f"{root}/lists")
    radii = {r["list"]: (r["far"], r["n"]) for r in spark.read.schema(f"id {kind}, v array<double>, far double, list int").parquet(f"{root}/lists").groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    storage.write_text(spark, f"{root}/centroids.json", json.dumps({"id": kind, "c": c.tolist(), "far": [radii.get(k, (0, 0))[0] for k in range(len(c))], "n": [radii.get(k, (0, 0))[1] for k in range(len(c))]}))


def search(spark: SparkSession, root: str, question: list[float], k: int, probes: int | None = None, digits: int = 4) -> DataFrame:
    """id, cosine (rounded to so many digits) of the k nearest vectors to one, itself included if it is there.

    probes: how many lists are read, the nearest first; None reads PROBES, and then each that may hold a nearer vector than
    the k-th, so that the result is exact.
    """
    told = json.loads(storage.read_text(spark, f"{root}/centroids.json"))
    c = np.array(told["c"], np.float64)
    rows = spark.read.schema(f"id {told['id']}, v array<double>, far double, list int").parquet(f"{root}/lists")
    if not len(c):
        return rows.select("id", F.lit(0.0).alias("cosine")).limit(0)
    q = _unit(np.array([question], np.float64))[0]
    to, far = np.sqrt(np.maximum(0.0, 2 - 2 * c @ q)), np.array(told["far"])
    order = [i for i in np.argsort(to, kind="stable").tolist() if told["n"][i]]
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = F.lit([float(x) for x in question])
    cosine = F.round(dot(F.col("v"), e) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(e, e)), digits)
    some = lambda ls: rows.where(F.col("list").isin(*ls)).select("id", cosine.alias("cosine"))
    best = lambda df: df.orderBy(F.desc("cosine"), "id").limit(k)
    first = order[: probes or PROBES]
    if probes is None and len(first) < len(order):
        found = [r["cosine"] for r in best(some(first)).collect()]  # k rows
        bound = np.sqrt(max(0.0, 2 - 2 * (found[-1] - 10.0**-digits))) if len(found) == k else 2.0  # as far as the k-th, with the rounding
        first = first + [i for i in order[len(first) :] if to[i] - far[i] <= bound + 1e-9]
    return best(some(first))


def recall(spark: SparkSession, root: str, questions: DataFrame, k: int, probes: int) -> float:
    """The share of the exact k nearest that so many probes find, over the given vectors (id, v); one search each."""
    hit = every = 0
    for r in questions.collect():  # a stated few
        want = {x["id"] for x in search(spark, root, r["v"], k).collect()}
        hit += len(want & {x["id"] for x in search(spark, root, r["v"], k, probes).collect()})
        every += len(want)
    return hit / max(1, every)

