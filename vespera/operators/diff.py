"""Differences of page texts."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sides(old: DataFrame, new: DataFrame, key: str = "page", text: str = "body") -> DataFrame:
    """key, old, new of the texts that differ; one that only one side has is null on the other."""
    both = old.select(F.col(key), F.col(text).alias("old")).join(new.select(F.col(key), F.col(text).alias("new")), key, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def line_counts(old: DataFrame, new: DataFrame, key: str = "page", text: str = "body") -> DataFrame:
    """key, line, removed, added: lines that one side has more often than the other; no order, one aggregation."""
    side = lambda df, x, y: df.select(key, F.explode(F.split(text, "\n")).alias("line"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    return side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(key, "line").agg(F.sum("x").alias("removed"), F.sum("y").alias("added")).where("removed != added")


def unified(old: DataFrame, new: DataFrame, key: str = "page", text: str = "body", context: int = 3) -> DataFrame:
    """key, diff: a unified diff with context lines for each text that differs.

    A longest-matching-blocks diff is beyond column functions: Python reads only the pairs that differ, one at a time.
    """
    kind = dict(new.dtypes)[key]

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                lines = difflib.unified_diff((a or "").split("\n") if a is not None else [], (b or "").split("\n") if b is not None else [], f"{k} (old)", f"{k} (new)", lineterm="", n=context)
                keys.append(k)
                out.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(out, pa.string())], names=[key, "diff"])

    return sides(old, new, key, text).mapInArrow(run, f"{key} {kind}, diff string")
