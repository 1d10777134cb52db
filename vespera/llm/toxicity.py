"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

For each class (toxic, ordinary) a character model of order ORDER inside words is counted on the labelled documents.
Its highest order belongs to the class, its backoff counts (distinct left neighbours) are shared by both, so a rare
expression falls back to the same distribution on both sides. A document's two log-likelihoods are compared by their
difference a word (length-normalised) and by its strongest words; a logistic calibration makes a score of it. An
expression of several words is seen through its words only (a model of word pairs was tried: its counts took more
than the disk that is allowed).

Counts cover all labelled documents and are aggregated in the cluster, and every gram that they hold counts. Models of up
to TABLE_ROWS grams are sent to the tasks, by a 64-bit hash of the gram; for larger ones, distinct words meet the grams,
and then the documents' words, in joins, with the same scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import checked, fold, fresh_task, map_rows, slices, spread_join, stored

ORDER = 6
DISCOUNT = 0.75
#: Grams of a model that is sent to the tasks, at most (12 bytes each, and as many for contexts: 96 MB).
TABLE_ROWS = 4_000_000
#: One in CALIBRATE_OF of the labelled documents is kept from the counts to calibrate the score, at most CALIBRATE_ROWS.
CALIBRATE_OF = 10
CALIBRATE_ROWS = 20_000
THRESHOLD = 0.3
BEGIN, END = "\x02", "\x03"
#: Distinct words that a Python task remembers at most; then it starts anew.
REMEMBERED = 300_000
#: Distinct words counted before a Python task passes them on.
COUNTED = 400_000
FEATURES = ("mean_word", "top_word", "top_words")
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _grams(word: str):
    w = BEGIN + word + END
    return [w[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(w))]


def _keys(grams: list[str]) -> np.ndarray:
    """The same numbers as Spark's xxhash64 of these strings."""
    return np.fromiter((xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams), np.uint64, len(grams)).view(np.int64)


def count(labelled: DataFrame) -> DataFrame:
    """gram, c0, c1: occurrences by class. labelled: text, label (0 or 1)."""

    def run(batches):
        fresh_task()
        words = (Counter(), Counter())

        def flush():
            out: dict[str, list[int]] = {}
            for label, seen in enumerate(words):
                for w, n in seen.items():
                    for g in _grams(w):
                        out.setdefault(g, [0, 0])[label] += n
                seen.clear()
            keys = list(out)
            for lo in range(0, len(keys), 50_000):
                part = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([out[g][y] for g in part], pa.int64()) for y in (0, 1))], names=["gram", "c0", "c1"])

        for batch in batches:
            for part in slices(batch):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words[y].update(words_of(t))
                if len(words[0]) + len(words[1]) > COUNTED:
                    yield from flush()
        yield from flush()

    parts = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "gram string, c0 long, c1 long")
    return stored(parts.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "grams")


@dataclass
class Table:
    """Values by key, sorted by key."""

    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether there is one) of each key."""
        if not len(self.key):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[at] == key
        return np.where(there, self.value[at], 0.0), there


def _table(entries: DataFrame) -> Table:
    """entries: key, value; at most TABLE_ROWS, counted before."""
    rows = entries.toArrow()
    key, value = rows.column("key").to_numpy(), rows.column("value").to_numpy()
    order = np.argsort(key, kind="stable")
    return Table(key[order], value[order])


@dataclass
class Model:
    """Log ratios of grams, those of their contexts' backoff weights, and the logistic calibration's weights.

    Either as tables that are sent along, or, where there are too many, as frames (gram or h, value).
    """

    grams: Table = field(default_factory=Table)
    contexts: Table = field(default_factory=Table)
    weights: tuple[float, ...] = (-2.0, *(0.0,) * len(FEATURES))
    frames: tuple[DataFrame, DataFrame] | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word's characters."""
        if not words:
            return np.zeros(0)
        each = [_grams(w) for w in words]
        flat = [g for gs in each for g in gs]
        r, there = self.grams.get(_keys(flat))
        new = np.flatnonzero(~there)
        r[new] = self.contexts.get(_keys([flat[i][:-1] for i in new.tolist()]))[0]
        return np.add.reduceat(r, np.concatenate(([0], np.cumsum([len(g) for g in each])[:-1])))


def _ratio(p, classes=("0", "1")):
    """Log ratio of interpolated Kneser-Ney probabilities whose shared lower order is the column p."""
    at = lambda c: F.when(F.col(f"n{c}") > 0, (F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"t{c}") * p) / F.col(f"n{c}")).otherwise(p)
    return F.log(at(classes[1]) / at(classes[0]))


def _context(counts: DataFrame, key: str) -> DataFrame:
    """By context: occurrences and distinct followers in each class, and the log ratio of the backoff weights."""
    own = counts.groupBy(key).agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.count_if(F.col("c0") > 0).alias("t0"), F.count_if(F.col("c1") > 0).alias("t1"))
    weight = lambda c: F.when(F.col(f"n{c}") > 0, DISCOUNT * F.col(f"t{c}") / F.col(f"n{c}")).otherwise(1.0)
    return own.withColumn("b", F.log(weight(1) / weight(0)))


def gram_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n, value) and (h, n, value) from character gram counts, all of them."""
    g = counts.select("gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("h"), F.expr("substring(gram, 2)").alias("s"), F.expr("right(gram, 1)").alias("c"), "c0", "c1")
    ctx = stored(_context(g, "h"), "contexts")
    suffix = g.groupBy("s").agg(F.count("*").alias("k")).select("s", F.expr("substring(s, 1, length(s) - 1)").alias("hs"), F.expr("right(s, 1)").alias("cs"), "k")
    lower = suffix.groupBy("hs").agg(F.sum("k").alias("kn"), F.count("*").alias("kt"))
    chars = g.groupBy("c").agg(F.count("*").alias("kc"))
    total = F.lit(float(max(1, counts.count())))
    shared = suffix.join(lower, "hs").join(checked(chars), suffix["cs"] == chars["c"]).select("s", ((F.greatest(F.col("k") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kt") * F.col("kc") / total) / F.col("kn")).alias("p"))
    r = g.join(ctx, "h").join(shared, "s").select("gram", (F.col("c0") + F.col("c1")).alias("n"), _ratio(F.col("p")).alias("value"))
    return r, ctx.select("h", (F.col("n0") + F.col("n1")).alias("n"), F.col("b").alias("value"))


def fit(counts: DataFrame, table_rows: int = TABLE_ROWS) -> Model:
    """The model of count()'s table, all of its grams."""
    (g, h), value = gram_ratios(counts), F.col("value").cast("float").alias("value")
    if counts.count() > table_rows:
        return Model(frames=(stored(g.select("gram", value), "ratios"), stored(h.select("h", value), "backoff")))
    return Model(_table(g.select(F.xxhash64("gram").alias("key"), value)), _table(h.select(F.xxhash64("h").alias("key"), value)))


class Memory:
    """Words seen before with their log ratios, and the features of documents."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ratio = np.zeros(0)

    def learn(self, words: list[str]) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.ratio = np.concatenate([self.ratio, self.model.words(words)])

    def features(self, texts: list) -> list[list[float]]:
        """FEATURES of each text: the difference of log-likelihood a word, the largest of a word, the mean of the three
        largest (not below 0). All 0 without words."""
        if len(self.at) > REMEMBERED:
            self.clear()
        each = [words_of(t) for t in texts]
        self.learn(list(set().union(*each).difference(self.at)))
        out = []
        for words in each:
            if not words:
                out.append([0.0] * len(FEATURES))
                continue
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            own = np.sort(self.ratio[np.unique(at)])[::-1]
            out.append([float(self.ratio[at].mean()), float(own[0]), float(np.maximum(0.0, own[:3]).sum() / 3)])
        return out


def _scored(docs: DataFrame, model: Model, extra: str) -> DataFrame:
    """docs: doc_id, text, extra. Gives doc_id, extra, and FEATURES."""
    got = docs.select("doc_id", extra, "text")
    kind = dict(got.dtypes)
    if model.frames:
        return _joined(got, *model.frames, extra)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        memory = Memory(shared.value)

        def f(ids, extras, texts):
            return ids, extras, *([*c] for c in zip(*memory.features(texts)))

        return f

    return map_rows(got, make, f"doc_id {kind['doc_id']}, {extra} {kind[extra]}, " + ", ".join(f"{f} double" for f in FEATURES))


def _joined(docs: DataFrame, ratios: DataFrame, backoff: DataFrame, extra: str) -> DataFrame:
    """_scored with a model of any size: distinct words meet its grams, and documents their words, frequent ones dealt over tasks."""
    kind = dict(docs.dtypes)

    def bags(batches):
        fresh_task()
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                found = [Counter(words_of(t)) for t in part.column(2).to_pylist()]
                rows = pa.array(range(n, n + len(found)), pa.int64())
                n += len(found)
                yield pa.RecordBatch.from_arrays([rows, *part.columns[:2], pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["row", "doc_id", extra, "words", "counts"])

    bag = stored(docs.mapInArrow(bags, f"row long, doc_id {kind['doc_id']}, {extra} {kind[extra]}, words array<string>, counts array<long>"), "bags")
    each = bag.select("row", F.inline(F.arrays_zip("words", "counts")).alias("word", "k"))
    known = each.groupBy("word").agg(F.count("*").alias("n"))
    whole = F.concat(F.lit(BEGIN), "word", F.lit(END))
    cut = lambda k: F.substr(whole, F.greatest(F.lit(1), k - ORDER + 1), F.least(k, F.lit(ORDER)))
    grams = known.select("word", "n", F.explode(F.transform(F.sequence(F.lit(2), F.length(whole)), cut)).alias("gram"))
    seen = grams.join(ratios, "gram", "left")
    left = seen.where("value is null").drop("value").withColumn("h", F.expr("substring(gram, 1, length(gram) - 1)")).join(backoff, "h", "left")
    sums = seen.where("value is not null").select("word", "n", "value").unionByName(left.select("word", "n", F.coalesce("value", F.lit(0.0)).cast("float").alias("value")))
    words = stored(sums.groupBy("word").agg(F.max("n").alias("n"), F.sum(F.col("value").cast("double")).alias("ratio")), "words")
    met = spread_join(each, words, "word", each.count())
    top = F.slice(F.sort_array(F.collect_list("ratio"), asc=False), 1, 3)  # distinct words of one document
    of = met.groupBy("row").agg((F.sum(F.col("k") * F.col("ratio")) / F.sum("k")).alias("mean_word"), F.max("ratio").alias("top_word"), top.alias("top"))
    of = of.withColumn("top_words", F.aggregate("top", F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x)) / 3)
    return bag.select("row", "doc_id", extra).join(of, "row", "left").select("doc_id", extra, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (bias first) by Newton's method; a class that is missing leaves the other's prior."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, table_rows: int = TABLE_ROWS) -> Model:
    """docs: doc_id, text. labels: doc_id, label; only documents with a label 0 or 1 count, all of them.

    Of several labels of one id the largest counts. Rows that share an id are all counted.
    """
    y = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    y = y.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATE_OF)))
    texts = docs.select("doc_id", "text")
    model = fit(count(texts.join(checked(y.where("part > 0")), "doc_id")), table_rows)
    held = y.where("part = 0").orderBy(F.xxhash64("doc_id")).limit(CALIBRATE_ROWS)
    rows = _scored(texts.join(checked(held), "doc_id"), model, "label").drop("doc_id").toPandas()
    if len(rows):
        model.weights = tuple(logistic(rows[[*FEATURES]].to_numpy(float), rows["label"].to_numpy(float)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row. Null and empty texts score what the bias gives."""
    got = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.lit(0).alias("zero"))
    z = F.lit(float(model.weights[0]))
    for w, f in zip(model.weights[1:], FEATURES):
        z = z + F.lit(float(w)) * F.col(f)
    return _scored(got, model, "zero").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: int = 4, out: int = 2, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted. labels: doc_id, toxic. Rows with crc32(id) mod of = out never train.

    Without labels the score is one constant below the threshold. Null ids are never held out. Repeated rows are each scored.
    """
    y = labels.select("doc_id", F.col("toxic").alias("label")).where(fold(F.col("doc_id"), of) != out)
    model = train(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), y, table_rows)
    held = F.coalesce(fold(F.col("doc_id"), of) == out, F.lit(False))
    return score(docs, model, id_col, text_col).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
