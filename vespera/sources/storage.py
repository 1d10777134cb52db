"""Folders on any file system that Spark reads: shared scratch space, listings, and tables in versions."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a keyed table is dealt over by a hash of its key.
BUCKETS = 32
_BUCKET = "vespera_bucket"


class Conflict(RuntimeError):
    """Another writer has replaced a table that this one has replaced too."""


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a local one only where the master is local and none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/vespera/{what}-{uuid.uuid4().hex}"
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: a cut of the lineage that outlives executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names(spark: SparkSession, path: str, folders: bool = True) -> list[str]:
    """Names of the visible folders (or files) below path, sorted; none if it is not there."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() == folders and not x.getPath().getName().startswith("."))


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file: beside its name first, then moved there, so that readers never see a half."""
    at, fs = _at(spark, path)
    beside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"could not move a file to {path}")


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write one small file if none has this name; False if one has. Of several writers at once one wins, and no reader sees a half."""
    at, fs = _at(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, beside, text)
    old, _ = _at(spark, beside)
    try:
        if fs.getUri().getScheme() == "file":  # a rename there replaces; a link does not
            os.link(old.toUri().getPath(), at.toUri().getPath())
            fs.delete(old, False)
        else:
            jvm = spark._jvm
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(old), fs.makeQualified(at), none)
        return True
    except (FileExistsError, Py4JJavaError):
        fs.delete(old, False)
        if fs.exists(at):
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


class Versions:
    """Tables below a folder. A version names the folders of each table; it is there as soon as its one file is.

    A table that a version does not write is that of the version before. Whoever reads sees one whole version, also
    while the next is written or if its writer dies.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names(self.spark, f"{self.root}/versions", False) if n.endswith(".json") and n[:-5].isdigit())

    def tables(self, number: int | None = None) -> dict[str, list[str]]:
        """Folders by table of a version, the last by default; none before the first."""
        known = self.numbers()
        if not known:
            return {}
        return json.loads(read_text(self.spark, f"{self.root}/versions/{known[-1] if number is None else number:08d}.json"))

    def last(self) -> int:
        """The number of the last version, 0 before the first."""
        return max(self.numbers(), default=0)

    def stage(self, name: str, df: DataFrame) -> list[str]:
        """Write a table that no version has yet; gives its folders."""
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return [path]

    def commit(self, staged: dict[str, list[str]], since: int | None = None, added: dict[str, list[str]] | None = None) -> int:
        """Make the staged tables, and those of the last version that are not among them, the next version; gives its number.

        added: folders that join those of a table. What other writers have committed meanwhile stays: if another has the
        number first, the tables are put upon its version. since: the version that the staged tables were made from; if
        one of them was replaced after it, Conflict is raised and nothing is committed.
        """
        while True:
            last = self.last()
            tables = self.tables(last) if last else {}
            if since is not None and last != since:
                base = self.tables(since) if since else {}
                if clash := sorted(n for n in staged if tables.get(n) != base.get(n)):
                    raise Conflict(f"tables of version {since} that version {last} has replaced: {', '.join(clash)}")
            more = {n: [*tables.get(n, []), *folders] for n, folders in (added or {}).items()}
            if put_new(self.spark, f"{self.root}/versions/{last + 1:08d}.json", json.dumps({**tables, **more, **staged}, sort_keys=True)):
                return last + 1

    def folders(self, name: str, number: int | None = None) -> list[str]:
        """The folders of a table, plain or keyed; none if it was never written."""
        tables = self.tables(number) if number != 0 else {}
        return tables.get(name) or [f for n in sorted(tables) if n.startswith(f"{name}/") for f in tables[n]]

    def upsert(self, name: str, rows: DataFrame, key: list[str], merge: Callable[[DataFrame], DataFrame], back: Callable[[DataFrame], DataFrame] = lambda state: state, number: int | None = None, buckets: int = BUCKETS) -> dict[str, list[str]]:
        """Merge rows into a keyed table; gives the folders of the buckets that they touch, to be committed.

        The table is kept in folders by a hash of the key. Only those that rows of a touched bucket fall into are read and
        written anew; the others keep their files. merge: rows of any number of facts to one row a key. back: such rows as
        facts again, which merge must take for all the facts they came from.
        """
        place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        kept = stored(rows.withColumn(_BUCKET, place), name)
        touched = sorted(r[0] for r in kept.select(_BUCKET).distinct().collect())  # a row a bucket
        if not touched:
            return {}
        tables = self.tables(number) if number != 0 else {}
        there = [f for b in touched for f in tables.get(f"{name}/{b:04d}", [])]
        facts = kept.drop(_BUCKET)
        if there:
            facts = back(self.spark.read.parquet(*there)).unionByName(facts)
        path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        merge(facts).withColumn(_BUCKET, place).repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(path)
        return {f"{name}/{b:04d}": [f"{path}/{_BUCKET}={b}"] for b in touched}
