"""Review gate: risky changes wait in a queue; only pending ones can be decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.operators import lint
from vespera.operators.merge import numbered


def queue(old: DataFrame, new: DataFrame, taken: DataFrame, **rules) -> DataFrame:
    """review_id, page, status, phrases, proposed, prior for pages that newly hold a risky phrase.

    old, new: page, body. taken: num of reviews so far; new ones take the numbers from 1 that are free, in order of pages.
    """
    risky = lint.newly_risky(old, new, **rules).groupBy("page").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"))
    items = risky.join(new.select("page", F.col("body").alias("proposed")), "page").join(old.select("page", F.col("body").alias("prior")), "page", "left")
    n = numbered(items, ["page"])
    # the free numbers: of the first (taken + new) ones, those that are not taken
    bound = taken.agg(F.count("*").alias("k")).crossJoin(items.agg(F.count("*").alias("m")))
    free = bound.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") + F.col("m"))).alias("num")).join(taken.select("num"), "num", "left_anti")
    n = n.join(numbered(free, ["num"]), "n")
    return n.select(F.format_string("rev_%04d", F.col("num")).alias("review_id"), "page", F.lit("pending").alias("status"), "phrases", "proposed", "prior")


def held_back(new: DataFrame, queued: DataFrame) -> DataFrame:
    """The pages as they may be published: queued ones keep their prior body, or none if they are new."""
    p = queued.where("status != 'approved'").select("page", "prior", F.lit(True).alias("held"))
    return new.join(p, "page", "left").select("page", F.when(F.col("held"), F.col("prior")).otherwise(F.col("body")).alias("body")).where("body is not null")


def decide(queued: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: review_id, verdict (approved or rejected). Pending items take it; decided ones stay as they are."""
    d = decisions.where(F.col("verdict").isin("approved", "rejected")).groupBy("review_id").agg(F.min("verdict").alias("verdict"))
    status = F.when((F.col("status") == "pending") & F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.col("status"))
    return queued.join(d, "review_id", "left").withColumn("status", status).drop("verdict")
