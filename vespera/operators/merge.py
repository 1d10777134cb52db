"""Keyed merges of extracted facts. Order is a column (seq), never the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vespera.sources import storage

RANKS = {"Low": 1, "Medium": 2, "High": 3, "Confirmed": 4}


def rank(confidence):
    return F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])[confidence]


def first_wins(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key, by hash aggregation."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r"))
    return got.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_entities(mentions: DataFrame) -> DataFrame:
    """mentions: type, value, source, seq. One row a type and lower-cased value: first spelling, sorted sources (an array)."""
    return mentions.groupBy("type", F.lower("value").alias("key")).agg(
        F.min_by("value", "seq").alias("value"), F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("source").alias("n_sources"), F.min("seq").alias("seq")
    )


def mentions_of(entities: DataFrame) -> DataFrame:
    """Rows of merge_entities as mentions: merged again, alone or with later ones, they give what all mentions give."""
    return entities.select("seq", "type", "value", "key", F.explode("sources").alias("source"))


def merge_iocs(iocs: DataFrame) -> DataFrame:
    """iocs: artifact, type, first_seen, source, confidence, reason, seq. Highest confidence, first known sighting, first source and reason."""
    known = F.min_by(F.when(F.col("first_seen") != "unknown", F.col("first_seen")), F.when(F.col("first_seen") != "unknown", F.col("seq")))
    return iocs.groupBy("type", F.lower("artifact").alias("key")).agg(
        F.min_by("artifact", "seq").alias("artifact"), F.coalesce(known, F.lit("unknown")).alias("first_seen"), F.min_by("source", "seq").alias("source"),
        F.max_by("confidence", rank(F.col("confidence"))).alias("confidence"), F.min_by("reason", "seq").alias("reason"), F.min("seq").alias("seq"),
    )


def merge_hypotheses(parts: DataFrame) -> DataFrame:
    """parts: title, confidence, inference, fact, seq. Highest confidence, first inference that is not empty, facts (an array) in order of first mention."""
    facts = parts.where("fact is not null").groupBy(F.lower("title").alias("key"), "fact").agg(F.min("seq").alias("s"))
    facts = facts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "fact"))), lambda x: x["fact"]).alias("facts"))
    head = parts.groupBy(F.lower("title").alias("key")).agg(
        F.min_by("title", "seq").alias("title"), F.max_by("confidence", rank(F.col("confidence"))).alias("confidence"),
        F.coalesce(F.min_by(F.when(F.col("inference") != "", F.col("inference")), F.when(F.col("inference") != "", F.col("seq"))), F.lit("")).alias("inference"),
    )
    return head.join(facts, "key", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))


def numbered(rows: DataFrame, order: list[str], start=0, name: str = "n") -> DataFrame:
    """rows with consecutive numbers in a global order, without sorting all rows in one task.

    Rows are dealt by range and sorted within partitions; a partition's offset is the number of rows before it. What
    is brought together is one count a partition. The dealt rows are written: dealt again, with other columns or merged
    small partitions, they would lie elsewhere than they were counted.
    """
    parts = storage.stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_k"))
    before = counts.select("_p", (F.sum("_k").over(Window.orderBy("_p")) - F.col("_k")).alias("_b"))
    inner = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return inner.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_b") + start).drop("_p", "_r", "_b")


def stable_ids(prior: DataFrame, rows: DataFrame, prefix: str) -> DataFrame:
    """prior: key, num. rows: key, seq. Known keys keep their number; new ones go on from the largest in order of seq."""
    keys = rows.groupBy("key").agg(F.min("seq").alias("seq"))
    new = numbered(keys.join(prior, "key", "left_anti"), ["seq", "key"], name="i")
    top = prior.agg(F.coalesce(F.max("num"), F.lit(0)).alias("top"))
    every = prior.select("key", "num").unionByName(new.crossJoin(F.broadcast(top)).select("key", (F.col("top") + F.col("i")).alias("num")))
    return every.select("key", F.format_string(prefix + "_%04d", F.col("num")).alias("id"))


def changed_sources(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """now: path, sha. manifest: path, sha, status. path and state: new, changed, failed or unchanged."""
    m = manifest.select("path", F.col("sha").alias("old"), "status")
    state = F.when(F.col("status").isNull(), "new").when(~F.col("sha").eqNullSafe(F.col("old")), "changed").when(F.col("status") != "processed", "failed").otherwise("unchanged")
    return now.join(m, "path", "left").select("path", state.alias("state"))
