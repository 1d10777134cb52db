"""Incremental merge of events from a file stream: the streaming counterpart of the batch merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.sources import storage


def _state(spark: SparkSession, out: str, schema, before: int | None = None) -> tuple[DataFrame, str | None]:
    """The merged state that the last whole batch (below a number) left; empty before the first."""
    whole = [n for n in storage.names(spark, out) if n.startswith("state-") and storage.exists(spark, f"{out}/{n}/_SUCCESS")]
    last = max((n for n in whole if before is None or int(n[6:]) < before), default=None)
    return (spark.read.schema(schema).parquet(f"{out}/{last}"), last) if last else (spark.createDataFrame([], schema), None)


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return got.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*rows.columns)


def merge_stream(spark: SparkSession, path: str, schema, out: str, checkpoint: str, key: list[str], order: str) -> DataFrame:
    """Merge every file below path that earlier calls have not read; gives the first event of each key by order.

    Only the state, a row a key, and the new events are grouped in a micro-batch. Its result is a folder of its own, by the
    number of the batch: one that is repeated after a failure starts from the same state and replaces what it had written.
    Late files can't break first-wins.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        prior, last = _state(session, out, schema, number)
        first_of_each(prior.unionByName(batch), key, order).write.mode("overwrite").parquet(f"{out}/state-{number:010d}")
        for n in storage.names(session, out):
            if n.startswith("state-") and last and n < last:
                storage.remove(session, f"{out}/{n}")

    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _state(spark, out, schema)[0]


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of time, with a bound on lateness so that state is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
