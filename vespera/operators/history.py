"""How keyed tables of a case change from one state to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_rows(prior: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """The rows of now whose key prior does not hold."""
    return now.join(prior.select(*key), key, "left_anti")


def changed(prior: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, old, new of the keys on both sides whose value differs; null differs from everything but null."""
    both = now.select(*key, F.col(value).alias("new")).join(prior.select(*key, F.col(value).alias("old")), key)
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*key, "old", "new")


def trajectory(steps: DataFrame, key: list[str], step: str, value: str) -> DataFrame:
    """steps with before: the value at the key's step before, null at its first. One row a key and step, the first by value."""
    one = steps.groupBy(*key, step).agg(F.min(F.struct(value, *[c for c in steps.columns if c not in (*key, step, value)])).alias("r")).select(*key, step, "r.*")
    return one.withColumn("before", F.lag(value).over(Window.partitionBy(*key).orderBy(step)))


def with_step(history: DataFrame, now: DataFrame) -> DataFrame:
    """history and now's rows (title, step and others) for steps that a title does not have yet."""
    old = history.select(F.lower("title").alias("key"), "step")
    fresh = now.withColumn("key", F.lower("title")).join(old, ["key", "step"], "left_anti").drop("key")
    return history.unionByName(fresh.select(*history.columns))


def steps_of(claims: DataFrame, step: str, assessment) -> DataFrame:
    """A history row a claim: title, claim_id, step, confidence (lower-cased), assessment, supporting_count, contradicting_count."""
    return claims.select("title", "claim_id", F.lit(step).alias("step"), F.lower("confidence").alias("confidence"), assessment.alias("assessment"), F.size("supporting").alias("supporting_count"), F.size("contradicting").alias("contradicting_count"))
