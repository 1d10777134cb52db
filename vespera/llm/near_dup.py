"""Near duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash (Ertl 2017): every shingle has a random permutation of the slots and takes rank j plus a fraction in the
slot its permutation has at j. All slots of a set being taken, later ranks cannot win: the rounds stop there.

Exact copies are first made one class. Documents that share a band go to the band's least member as candidate links;
confirmed links are grouped. In bands whose members are then still in different groups, every such pair whose
signatures agree enough is confirmed too, so no link depends on which member is the least.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vespera.llm.common import WORD, checked, fresh_task, slices, spread_join, stored
from vespera.llm.components import components

SHINGLE = 5
PERCENT = 80
SLOTS = 256
#: 42 bands of 6 slots: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 42, 6
#: A pair is confirmed on its texts unless its signatures agree in fewer slots than the percentage lets expect less so
#: many standard deviations: a link is passed over with probability 3e-6, as by the bands.
#: None confirms every pair that shares a band, whatever the signatures say.
DEVIATIONS: float | None = 4.5
#: Members of a band that one task compares with so many others.
BLOCK = 1024

_WORDS = re.compile(WORD)
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY = np.uint64(2**64 - 1)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").translate(_CAPITALS))


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    """The distinct runs of size words; the whole sequence if there are fewer, nothing without words."""
    w = words_of(text)
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)} if w else set()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_hashes(words: list[str], size: int, known: _Hashes) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    size = min(size, len(h))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out ^ h[k : k + n], k + 1)
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (uint64: rank in the high bits, fraction in the low) of sets of hashes; empty sets stay at the maximum."""
    best = np.full((len(sets), slots), _EMPTY, np.uint64)
    flat = best.reshape(-1)
    item = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm, low = None, np.uint64((1 << 48) - 1)
    for j in range(slots):
        if not len(item):
            break
        r = _mix(item, 2 * j + 1)
        k = j + (_mix(item, 2 * j + 2) >> np.uint64(32)).astype(np.int64) % (slots - j)
        if perm is None:
            slot = k
        else:
            at = np.arange(len(item))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(j) << np.uint64(48)) | (r & low))
        open_ = (best == _EMPTY).any(1)
        keep = open_[owner]
        if not keep.all() or perm is None:
            if perm is not None and keep.mean() > 0.7:
                continue  # moving the permutations costs more than the few rounds saved
            first = perm is None
            if first:
                k = k[keep]
            item, owner = item[keep], owner[keep]
            if first:
                perm = np.tile(np.arange(slots, dtype=np.uint16), (len(item), 1))
                perm[np.arange(len(item)), k] = 0
            else:
                perm = perm[keep]
    return best


def signatures(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, same (16 bytes, equal for equal word sequences), sig (SLOTS bytes; null for empty sets)."""
    got = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = T.StructType([T.StructField("doc_id", got.schema[0].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches):
        fresh_task()
        known = _Hashes()
        for batch in batches:
            lo = 0
            texts = batch.column(1)
            while lo < batch.num_rows:
                sets, same, total, hi = [], [], 0, lo
                while hi < batch.num_rows and total < 20_000 and hi - lo < 2_000:
                    w = words_of(texts[hi].as_py())
                    sets.append(shingle_hashes(w, size, known))
                    same.append(xxhash.xxh3_128_digest("\n".join(w).encode("utf-8", "surrogatepass")) if w else None)
                    total += len(sets[-1])
                    hi += 1
                sig = (super_minhash(sets) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array([s.tobytes() if len(x) else None for s, x in zip(sig, sets)], pa.binary())],
                    names=["doc_id", "n_shingles", "same", "sig"],
                )
                lo = hi

    return got.mapInArrow(run, out)


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets are similar enough. pairs must be stored.

    The texts of b stream past the set of a, BLOCK of them a task: a's text is sent once for so many others, and a set is
    built once a text. Of rows that share an id, any may confirm a pair.
    """
    large = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(checked(large), "a", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    others = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("i"), F.lit(1).alias("side"))
    heads = dealt.select("a", "blocks").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("i"), F.lit(0).alias("side"))
    wanted = others.unionByName(heads)
    texts = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).join(checked(wanted.select("i").distinct()), "i", "left_semi")
    rows = wanted.join(texts, "i").select("a", "block", "side", "i", "t").repartition("a", "block").sortWithinPartitions("a", "block", "side")

    def run(batches):
        fresh_task()
        at, own = None, []
        for batch in batches:
            for part in slices(batch):
                good = []
                for a, block, side, i, text in zip(*(c.to_pylist() for c in part.columns)):
                    if (a, block) != at:
                        at, own = (a, block), []
                    x = shingles(text, size)
                    if side == 0:
                        own.append(x)
                        continue
                    for y in own:
                        common = len(x & y)
                        if common and 100 * common >= percent * (len(x) + len(y) - common):
                            good.append((a, i))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in good], pa.int64()), pa.array([i for _, i in good], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def variance_factor(union: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """How much smaller than J (1 - J) / slots the estimate's variance is, for unions of so many elements (Ertl 2017, theorem 1)."""
    u = np.maximum(2.0, np.asarray(union, float))[:, None]
    m, k = float(slots), np.arange(1, slots)[None, :]
    term = (k / m) ** u * (((k + 1) / (m - 1)) ** u + ((k - 1) / (m - 1)) ** u - 2 * (k / (m - 1)) ** u)
    return np.clip(1 - term.sum(1) * (m - 1) / (u[:, 0] - 1), 0.0, 1.0)


def least_agreeing(percent: int, slots: int = SLOTS) -> np.ndarray:
    """By the sum of two sets' sizes (the last entry for all larger ones): slots in which a link's signatures agree at least."""
    j = percent / 100
    sums = np.arange(8192)
    if DEVIATIONS is None:
        return np.full(len(sums), -1, np.int64)
    deviation = np.sqrt(j * (1 - j) * slots * variance_factor(sums / (1 + j), slots))
    return np.floor(slots * j - DEVIATIONS * deviation - 1).astype(np.int64)


def _agreeing(least: np.ndarray, percent: int):
    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one block pair of one band: in different groups, signatures agree, sizes allow it, and this is the first band they share."""
        band, p, q = int(rows["band_no"].iloc[0]), int(rows["p"].iloc[0]), int(rows["q"].iloc[0])
        # A pair of blocks holds both; a block with itself holds each once.
        block = rows["block"].to_numpy()
        x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, SLOTS)
        ids, comp, size = rows["doc_id"].to_numpy(), rows["component"].to_numpy(), rows["n_shingles"].to_numpy()
        bands = np.ascontiguousarray(sig[:, : BANDS * ROWS]).reshape(len(sig), BANDS, ROWS)
        a, b = [], []
        for i in x:
            others = y[(comp[y] != comp[i]) & ((ids[y] > ids[i]) | (p != q)) & (100 * np.minimum(size[y], size[i]) >= percent * np.maximum(size[y], size[i]))]
            if len(others):
                equal = sig[others] == sig[i]
                near = equal.sum(1) >= least[np.minimum(size[others] + size[i], len(least) - 1)]
                others = others[near]
                earlier = (bands[others, :band] == bands[i, :band]).all(2).any(1) if band else np.zeros(len(others), bool)
                others = others[~earlier]
                a += np.minimum(ids[i], ids[others]).tolist()
                b += np.maximum(ids[i], ids[others]).tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return pairs


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id is its component's) for every row.

    Ids are integers. Null texts and texts without words have no shingles and no links. Rows that share an id are one
    node. A null id is linked with nothing, has no component, and is kept.
    """
    measured = stored(signatures(docs, size, id_col, text_col), "signatures")
    full = measured.where("same is not null and doc_id is not null")
    classes = stored(full.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "classes")
    copies = spread_join(full.select("doc_id", "same"), classes.where("n > 1").select("same", "rep", "n"), "same", measured.count()).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    members = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substr(F.col("sig"), k * ROWS + 1, F.lit(ROWS))))).alias("band_no", "band"))
    heads = members.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count("*").alias("n")).where("head != last").select("band", "head", "n")
    total = BANDS * classes.count()
    shared = stored(spread_join(members, heads, "band", total).select("band", "band_no", "head", "rep"), "bands")
    stars = stored(shared.where("head != rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = stored(confirm(stars, docs, size, percent, id_col, text_col), "confirmed")
    group = components(links)
    # bands whose members are still apart
    placed = shared.join(group, shared["rep"] == group["node"], "left").select("band", "band_no", "rep", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi and n > 2")
    open_ = spread_join(placed, split.select("band", "n", F.col("n").alias("members")), "band", total).withColumnRenamed("members", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_ = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("p"), F.greatest(F.col("block"), o).alias("q"))))
    dealt = open_.select("band", "band_no", "rep", "component", "block", each.alias("e")).select("band", "band_no", "e.p", "e.q", "block", F.col("rep").alias("doc_id"), "component")
    dealt = dealt.join(classes.select(F.col("rep").alias("doc_id"), "sig", "n_shingles"), "doc_id")
    more = dealt.groupBy("band", "p", "q").applyInPandas(_agreeing(least_agreeing(percent), percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    further = stored(confirm(stored(more, "agreeing"), docs, size, percent, id_col, text_col), "confirmed")
    every = links.unionByName(further).unionByName(copies.select("a", "b"))
    final = components(every)
    out = measured.join(final, measured["doc_id"] == final["node"], "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
