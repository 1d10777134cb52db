"""What the training-data operators share: batching over Arrow, the shared folder, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the contracts: everything but ASCII blanks.
WORD = r"[^ \t-\r]+"
#: Rows, and bytes of strings, that a Python task holds as Python objects at once; a longer text makes a slice of its own.
SLICE, SLICE_BYTES = 256, 1 << 21
#: A side of at most so many narrow rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a task joins, about.
SPREAD = 1024


#: What a Python worker keeps between tasks of one kind, by kind.
CACHES: dict[str, object] = {}


def fresh_task(kind: str = "") -> None:
    """At the start of a Python task: forget what tasks of other kinds kept, and give freed memory back."""
    for k in [k for k in CACHES if k != kind]:
        del CACHES[k]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, removed when the session's JVM ends.

    Only where that setting is absent (tests, a laptop) a local folder is set up.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if there.isDefined():
            root = there.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='vespera-')}"
            spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/vespera/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df written to the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of stored() as soon as nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        at = jvm.org.apache.hadoop.fs.Path(name).getParent()
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, rows: int = SLICE, size: int = SLICE_BYTES):
    """The batch in slices of at most so many rows and bytes of strings, one row at least."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    total, lo = np.cumsum(total), 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + size, side="right"))
        hi = min(max(lo + 1, hi), lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """make() gives, once a task, a function from columns (lists) to columns; it sees slices of bounded rows and bytes."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        fresh_task()
        f = make()
        for batch in batches:
            for part in slices(batch):
                out = f(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, struct)


def checked(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it has at most limit rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def spread_join(big: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """big and small joined on key, no task holding much more than SPREAD rows of one key of big.

    small has one row a key and a column n, the rows that big has of it (dropped here); total: rows of big. Keys with many
    rows are dealt over several tasks, to each of which small's row is sent. There are at most total / SPREAD such keys, and
    SPREAD grows where that would be more than BROADCAST_ROWS, so that their broadcast is bounded.
    """
    per = max(SPREAD, total // BROADCAST_ROWS + 1)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / per)).cast("int")
    large = small.where(F.col("n") > per).select(key, parts.alias("_parts"))
    own = F.xxhash64(*[c for c in big.columns if c != key]) if len(big.columns) > 1 else F.monotonically_increasing_id()
    dealt = big.join(F.broadcast(large), key, "left").withColumn("_part", F.pmod(own, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    each = small.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(each, [key, "_part"]).drop("_part")


def fold(doc_id, of: int):
    """crc32 of the id as text, modulo of; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of
