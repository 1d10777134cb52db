"""Long texts from ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.operators.merge import numbered

#: Lines of a page that one task joins; longer pages are joined part by part.
PART = 10_000


def joined(rows: DataFrame, order: list, line) -> DataFrame:
    """One row: n, text, the lines in order. Lines are sorted by range and joined in parts, so that no task sorts all."""
    keys = [f"o{i}" for i in range(len(order))]
    x = numbered(rows.select(*[o.alias(k) for o, k in zip(order, keys)], line.alias("line")), [*keys, "line"])
    parts = x.groupBy(F.floor((F.col("n") - 1) / PART).alias("part")).agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda y: y["line"]), "\n").alias("text"))
    return parts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda y: y["text"]), "\n").alias("text"))
