"""Quality by Bradley-Terry ranking: scores learned from preferences between documents.

A preference says that one document of a pair is better; the model is a linear score of text features fitted by
logistic loss on feature differences. A score quantile of the training documents becomes the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vespera.llm.common import WORD, checked, fold, fresh_task, map_rows, slices

#: Labelled documents that the fit reads at most, the least by a hash of the id.
FIT_ROWS = 40_000
#: Preferences drawn for each document of the rarer label.
PAIRS = 20
RIDGE = 1.0
SEED = 11
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "sentence_ends", "commas", "newlines", "repeated_lines",
    "distinct_words", "top_word", "same_as_last", "repeated_trigrams", "short_words", "long_words", "mixed_words", "empty", "other_marks",
)
_WORDS = re.compile(WORD)
_UPPER, _DIGIT, _SYMBOL, _MIXED = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[#*$%&<>@^~_=\\]"), re.compile(r"[^\W\d_][^\w\s'-][^\W\d_]")
_MARKS = re.compile(r"[^\w\s]")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; shares are of characters, words or lines. A text without words has `empty` only."""
    t = text or ""
    words = _WORDS.findall(t)
    n, chars = len(words), max(1, len(t))
    if not n:
        return [0.0] * 18 + [1.0, 0.0]
    counts = Counter(words)
    lines = [x for x in t.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    same = sum(map(str.__eq__, words, words[1:]))
    grams = len(set(zip(words, words[1:], words[2:])))
    share = lambda r: len(r.findall(t)) / chars
    symbols = share(_SYMBOL)
    return [
        np.log1p(n), min(20.0, lengths.mean()), share(_UPPER), share(_DIGIT), symbols, t.count("!") / n, t.count("|") / n, min(1.0, t.count(".") / n),
        min(1.0, t.count(",") / n), min(1.0, t.count("\n") / n), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / n, counts.most_common(1)[0][1] / n, same / n,
        1 - grams / max(1, n - 2) if n > 2 else 0.0, float((lengths <= 2).mean()), float((lengths > 15).mean()), len(_MIXED.findall(t)) / n, 0.0, share(_MARKS) - symbols,
    ]


@dataclass
class Ranker:
    """score = sigmoid(scale * (w . (x - mean) / std - cut) + logit(THRESHOLD)): the cut scores THRESHOLD."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Weights w that maximise the likelihood of w . better > w . worse, pair by pair."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d.T @ p) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED, quantile: float | None = None) -> Ranker:
    """x: features by document, y: 0 or 1. With one label only, every score is above the threshold alike.

    quantile: the share of the training documents that scores below the threshold; None takes the share, up to twice
    that of label 0, that separates the labels with the fewest errors (the least such share).
    """
    width = len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = np.clip((x - mean) / std, -8, 8)
    rng = np.random.default_rng(seed)
    n = PAIRS * min(len(good), len(bad))
    pick = lambda a: np.concatenate([rng.permutation(a) for _ in range(-(-n // len(a)))])[:n]
    w = bradley_terry(z[pick(good)], z[pick(bad)])
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    wrong = len(bad) + np.cumsum(np.where(y[order] == 1, 1, -1))
    top = max(1, min(len(raw) - 1, 2 * len(bad)))
    k = int(np.argmin(wrong[:top])) + 1 if quantile is None else max(1, min(len(raw), round(quantile * len(raw))))
    cut = (raw[order[k - 1]] + raw[order[min(k, len(raw) - 1)]]) / 2
    spread = np.subtract(*np.quantile(raw, [0.75, 0.25]))
    return Ranker(mean, std, w, float(cut), float(1 / max(0.25, spread / 2)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quantile: float | None = None) -> Ranker:
    """labels: doc_id, label. At most FIT_ROWS labelled documents, by hash of the id, make the preferences."""
    y = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    got = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    n = y.count()
    if n > FIT_ROWS:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= int(1_050_000 * FIT_ROWS / n)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)

    def make():
        def f(ids, label, texts):
            return ids, label, [features(t) for t in texts]

        return f

    found = got.join(checked(y, FIT_ROWS), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    rows = map_rows(found, make, f"doc_id {dict(found.dtypes)['doc_id']}, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(int), quantile=quantile)


def score(docs: DataFrame, ranker: Ranker, keep: list[str] = ["doc_id"], text_col: str = "text", name: str = "vespera_score") -> DataFrame:  # noqa: B006
    """The columns keep of docs as they are, whatever their types and names, and a last column, the score; a null text is an empty one."""
    at = keep.index(text_col) if text_col in keep else len(keep)
    got = docs.select(*[F.col(f"`{c}`") for c in [*keep, *[text_col][: at == len(keep)]]])
    got = got.toDF(*[f"c{i}" for i in range(len(got.columns))])
    schema = T.StructType([*got.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())])

    def run(batches):
        fresh_task()
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t) for t in part.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(ranker.score(x), pa.float64())], names=schema.names)

    return got.mapInArrow(run, schema).toDF(*keep, name)


def quality(docs: DataFrame, labels: DataFrame, of: int = 5, out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted. labels: doc_id, quality. Rows with crc32(id) mod of = out never train.

    Null and empty texts get the score of the `empty` feature. Without labels every document passes. Rows that repeat are
    each scored, and alike; a null id is scored and never held out. Of several labels of one id the largest counts. Texts
    are read whole, one at a time if they are long.
    """
    y = labels.select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id"), of) != out)
    held = F.coalesce(fold(F.col("doc_id"), of) == out, F.lit(False))
    s = F.col("vespera_score")
    return score(docs, train(docs, y)).select("doc_id", held.alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
