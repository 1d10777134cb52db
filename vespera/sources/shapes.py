"""JSON whose shape is not known before it is read, as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def members(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, name, type, value: a row a top-level member of each JSON object in a column of text.

    value is the text of a string and the JSON of anything else; a JSON null is a null value of type VOID. Texts that are
    null, not JSON, or not an object have no members.
    """
    parsed = rows.select(F.col(key).alias("_id"), F.try_parse_json(column).alias("_v"))
    objects = parsed.where(F.schema_of_variant("_v").startswith("OBJECT"))
    each = objects.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind = F.schema_of_variant("value")
    text = F.when(kind == "STRING", F.try_variant_get("value", "$", "string")).when(kind == "VOID", F.lit(None).cast("string")).otherwise(F.to_json("value"))
    return each.select(F.col("_id").alias(key), F.col("key").alias("name"), F.regexp_extract(kind, "^[A-Z]+", 0).alias("type"), text.alias("value"))


def shape(rows: DataFrame, column: str) -> DataFrame:
    """shape: the one type that holds all JSON values of a column of text; n: how many there are; n_broken: texts that are not JSON."""
    parsed = rows.select(F.col(column).alias("_t"), F.try_parse_json(column).alias("_v"))
    broken = F.count_if(F.col("_v").isNull() & F.col("_t").isNotNull())
    return parsed.agg(F.schema_of_variant_agg("_v").alias("shape"), F.count("_v").alias("n"), broken.alias("n_broken"))


def records(spark: SparkSession, path: str, inside: str = "items") -> DataFrame:
    """v (VARIANT): the records of a JSON file: those of an array, those of the array below a member named inside, or the file's one object."""
    raw = spark.read.option("singleVariantColumn", "v").option("multiLine", True).json(path)
    below = F.try_variant_get("v", f"$.{inside}", "array<variant>")
    own = F.try_variant_get("v", "$", "array<variant>")
    return raw.select(F.explode(F.coalesce(below, own, F.array("v"))).alias("v"))


def text_of(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def texts_of(v: Column, name: str) -> Column:
    """The texts of a member that is an array, or one text; empty if it is not there or anything else."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array_compact(F.array(text_of(v, name))))


def flag_of(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "boolean"), F.lit(False))
