"""Lloyd's clustering by differences: only what moved is compared, and only what changed hands is summed.

Assignments live in the shared folder, with the vectors, and one small table of sums stands for all of them. A round
compares a vector with the centroids that moved; with all of them only if its own moved. What changed hands leaves signed
integers: a vector is taken from the sum it left and added to the one it came to, so sums stay exact at any number of rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import drop_stored, fresh_task, stored

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
#: Integers are at most this large, so that a squared distance and its sums stay exact.
LARGEST = 1 << 27
#: Vectors that a task compares at once.
ROWS = 8192


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (array of long, floor(scale * x)) of the vectors with exactly `size` components, all finite.

    A component beyond LARGEST after scaling is an error: distances would not be exact.
    """
    x = F.col("x")
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    kept = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("x")).where((F.size(x) == size) & finite)
    whole = lambda c: F.when(F.abs(c * scale) <= LARGEST, F.floor(c * scale)).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")).cast("long"))
    return kept.select("id", F.transform(x, whole).alias("v"))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:id`, in that order; of rows that share an id, the least vector comes first, and so on."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = whole.select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact; a column a centroid."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        apart = v - c
        out[:, k] = np.einsum("ij,ij->i", apart, apart)
    return out


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """id, v, cluster, distance, was: the nearest centroid now and the one before.

    state has id and v, and from the second time on cluster and distance. Numbers of the moved centroids are in `moved`;
    what is nearer, or as near and of a smaller number, wins.
    """
    known = "cluster" in state.columns

    def each(batches):
        fresh_task()
        changed = np.zeros(len(centroids), bool)
        changed[moved] = True
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                part = whole.slice(lo, ROWS)
                v = _matrix(part.column(1))
                if known:
                    was = part.column(2).to_numpy().astype(np.int64)
                    cluster, distance = was.copy(), part.column(3).to_numpy().copy()
                    rest = np.flatnonzero(~changed[was])
                    if len(moved):
                        to = _distances(v[rest], centroids[moved])
                        best = to.argmin(axis=1)  # the first of several is the smallest number
                        near, number = to[np.arange(len(rest)), best], moved[best]
                        wins = (near < distance[rest]) | (near == distance[rest]) & (number < cluster[rest])
                        cluster[rest[wins]], distance[rest[wins]] = number[wins], near[wins]
                    anew = np.flatnonzero(changed[was])
                else:
                    was, anew = np.full(len(v), -1), np.arange(len(v))
                    cluster, distance = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
                if len(anew):
                    to = _distances(v[anew], centroids)
                    cluster[anew] = to.argmin(axis=1)
                    distance[anew] = to[np.arange(len(anew)), cluster[anew]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(was, pa.int32())], names=["id", "v", "cluster", "distance", "was"])

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(each, f"id {kind}, v array<bigint>, cluster int, distance bigint, was int")


def transfers(state: DataFrame, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed hands add to each cluster's count and sums: signed, summed in the cluster."""

    def each(batches):
        fresh_task()
        count, total = np.zeros(clusters, np.int64), None
        for batch in batches:
            v = _matrix(batch.column(0))
            total = np.zeros((clusters, v.shape[1]), np.int64) if total is None and len(v) else total
            for column, sign in ((1, 1), (2, -1)):
                owner = batch.column(column).to_numpy()
                for k in np.unique(owner[owner >= 0]).tolist():
                    mine = owner == k
                    count[k] += sign * int(mine.sum())
                    total[k] += sign * v[mine].sum(axis=0)
        used = [] if total is None else np.flatnonzero((count != 0) | total.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), pa.array([total[k].tolist() for k in used], pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = state.where(F.col("cluster") != F.col("was")).select("v", "cluster", "was").mapInArrow(each, "cluster int, n bigint, s array<bigint>")
    sums = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "s")).alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    rows = sums.collect()  # a row a cluster and component
    out = np.zeros((clusters, 1 + max((r["at"] for r in rows), default=0)), np.int64)
    for r in rows:
        out[r["cluster"], r["at"]] = r["x"]
    return out[:, 0], out[:, 1:]


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) of every kept vector, and the clusters: cluster, n, inertia, centroid; both stored.

    Each of the rounds assigns the vectors to the nearest centroid (squared distance, then number) and replaces every
    centroid that has vectors by their mean, rounded down; then they are assigned once more. It stops early, with the
    same result, once no centroid moves. A round writes its assignments to the shared folder, where the next one reads
    them, and removes those before; a lost executor repeats its own tasks only. `clusters` times `size` numbers reach the
    driver. Vectors that are null, of another length, or with a null or infinite component are left out. Null ids count
    as empty for the seed; repeated ids and repeated vectors each give a row. With fewer vectors than clusters there are
    as many clusters as vectors. Empty tables give empty ones.
    """
    whole = whole_vectors(vectors, size, scale, id_col, vector_col)
    centroids = first_centroids(whole, clusters, seed)
    spark, k = vectors.sparkSession, len(centroids)
    kind = whole.schema["id"].dataType.simpleString()
    if not k:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance bigint"), spark.createDataFrame([], "cluster int, n bigint, inertia bigint, centroid array<bigint>")
    state = stored(assign(whole, centroids, np.arange(k)), "assigned")
    counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for _ in range(rounds):
        n, s = transfers(state, k)
        counts += n
        sums += s if s.shape[1] else 0
        before = centroids
        centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], before)
        moved = np.flatnonzero((centroids != before).any(axis=1))
        if not len(moved):
            break
        last, state = state, stored(assign(state.select("id", "v", "cluster", "distance"), centroids, moved), "assigned")
        drop_stored(last)
    inertia = {r["cluster"]: (r["n"], r["d"]) for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d")).collect()}
    rows = [(i, *inertia.get(i, (0, 0)), c) for i, c in enumerate(centroids.tolist())]
    return state.select("id", "cluster", "distance"), spark.createDataFrame(rows, "cluster int, n bigint, inertia bigint, centroid array<bigint>")
