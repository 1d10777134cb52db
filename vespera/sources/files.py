"""Files below a folder, listed and read by the cluster: the driver sees neither their names nor their bytes."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.sources import storage

#: Entries after which a task leaves the folders it has not looked into to the next round.
ENTRIES = 2_000
#: Bytes of contents that a task hands on at once, and that a partition of files has, about.
BATCH, PARTITION = 1 << 23, 1 << 26
FOUND = "at string, folder boolean, length long, modificationTime timestamp"


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the place in it; ValueError if executors can't open it by themselves."""
    if root.startswith("file:") or "://" not in root:
        return pafs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/").rstrip("/")
    try:
        fs, at = pafs.FileSystem.from_uri(root)
    except (pa.ArrowException, OSError) as e:
        raise ValueError(f"no file system for {root}") from e
    return fs, at.rstrip("/")


def reachable(root: str) -> bool:
    try:
        filesystem(root)
    except ValueError:
        return False
    return True


def listing(spark: SparkSession, root: str) -> DataFrame:
    """at, path (below root), length, modificationTime of every file; those with a part that begins with a dot are left out.

    Folders are looked into by tasks, in rounds: a task goes down until it has met ENTRIES entries and leaves the rest to
    the next round, so a large tree is spread over the cluster and a small one takes one round. A missing root has no files.
    """
    _, base = filesystem(root)

    def walk(batches):
        fs, _ = filesystem(root)
        for b in batches:
            for top in b.column(0).to_pylist():
                waiting, met = [top], 0
                while waiting and (met == 0 or met < ENTRIES):
                    here = fs.get_file_info(pafs.FileSelector(waiting.pop(), allow_not_found=True))
                    here = [i for i in here if not i.base_name.startswith(".")]
                    met += max(1, len(here))
                    waiting += [i.path for i in here if i.type == pafs.FileType.Directory]
                    files = [i for i in here if i.type == pafs.FileType.File]
                    times = [i.mtime if i.mtime is not None else datetime.fromtimestamp(0, timezone.utc) for i in files]
                    yield _found([i.path for i in files], False, [i.size for i in files], times)
                yield _found(waiting, True, [0] * len(waiting), [None] * len(waiting))

    found, folders = None, spark.createDataFrame([(base,)], "at string")
    while True:
        level = storage.stored(folders.mapInArrow(walk, FOUND), "listing")
        files = level.where("not folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        n = level.where("folder").count()
        if not n:
            break
        folders = level.where("folder").select("at").repartition(min(n, 1_000))
    return found.select("at", F.substring("at", len(base) + 2, 1 << 30).alias("path"), "length", "modificationTime")


def _found(paths: list, folder: bool, sizes: list, times: list) -> pa.RecordBatch:
    cols = [pa.array(paths, pa.string()), pa.array([folder] * len(paths), pa.bool_()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC"))]
    return pa.RecordBatch.from_arrays(cols, names=["at", "folder", "length", "modificationTime"])


def contents(files: DataFrame, root: str, whole) -> DataFrame:
    """files (at, path, length, modificationTime) with sha (hexadecimal) and content, null where `whole` (a condition) is false.

    Files are dealt by bytes; a file is read by one task, in pieces where its content is not wanted.
    """
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    parts = max(1, min(total["n"], max(total["b"] // PARTITION, total["n"] // 10_000, files.sparkSession.sparkContext.defaultParallelism)))
    kind = "at string, path string, length long, modificationTime timestamp, sha string, content binary"

    def read(batches):
        fs, _ = filesystem(root)
        for b in batches:
            shas, datas, first, held = [], [], 0, 0
            for i, (at, keep) in enumerate(zip(b.column(0).to_pylist(), b.column(4).to_pylist())):
                digest, pieces = hashlib.sha256(), []
                with fs.open_input_stream(at) as f:
                    while piece := f.read(1 << 22):
                        digest.update(piece)
                        if keep:
                            pieces.append(piece)
                data = b"".join(pieces) if keep else None
                shas.append(digest.hexdigest())
                datas.append(data)
                held += len(data or b"")
                if held >= BATCH or i == b.num_rows - 1:
                    part = b.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(shas, pa.string()), pa.array(datas, pa.binary())], names=[*b.schema.names[:4], "sha", "content"])
                    shas, datas, first, held = [], [], i + 1, 0

    dealt = files.select("at", "path", "length", "modificationTime", whole.alias("whole")).repartition(parts)
    return dealt.mapInArrow(read, kind)


def write_texts(texts: DataFrame, root: str) -> None:
    """Write one file a row of path (below root), text, by the tasks that hold the rows; a file that is there is replaced.

    Names are unique by path, and a repeated task writes the same bytes again.
    """

    def put(batches):
        fs, base = filesystem(root)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = f"{base}/{path}"
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    texts.select("path", "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row
