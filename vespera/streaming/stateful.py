"""First-wins merge of a stream with state kept by key: a micro-batch writes what it changes, not the whole state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changed(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, order and the rest of the columns of the first row of each key that a micro-batch brought or replaced by an earlier one.

    The state of a key is its first row so far, with the time of the micro-batch that brought it. Tasks keep the first row
    of each key before rows are shuffled; of rows of one order, one of the earliest micro-batch
    stays, and a row without an order is the last.
    """
    rest = [c for c in stream.columns if c not in key]
    now = F.current_timestamp()  # one time a micro-batch, the same if it is repeated
    first = F.min_by(F.struct(*rest, F.col("_at")), F.struct(F.col(order).isNull(), order, "_at")).alias("_first")
    merged = stream.withColumn("_at", now).groupBy(*key).agg(first).where(F.col("_first._at") == now)
    return merged.select(*key, *[F.col("_first")[c].alias(c) for c in rest])


def merge_stream(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, key: list[str], order: str) -> DataFrame:
    """Merge every file below path that earlier calls have not read; gives the first row of each key.

    The state is in Spark's store (RocksDB) below the checkpoint; each micro-batch adds a folder with the rows it changed. A
    batch that is repeated after a failure writes its folder anew. The last change of a key is its state.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:010d}")

    stream = changed(spark.readStream.schema(schema).parquet(path), key, order)
    spark.conf.set(name, ROCKS)
    try:
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return current(spark, out, schema, key, order)


def current(spark: SparkSession, out: str, schema: T.StructType, key: list[str], order: str) -> DataFrame:
    """The merged rows: of each key the change with the least order."""
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    rest = [c for c in schema.names if c not in key]
    best = log.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*schema.names)
