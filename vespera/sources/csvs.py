"""CSV files of any size: byte ranges are summarised, then parsed apart.

Whether a byte range begins inside quotes depends on all before it. What a range does to that state is one of four
functions, so the ranges' summaries are put together by a window of one small row a range; then every range knows its
state, finds the records that begin in it, and parses them. No task reads much more than a range and its last record.
"""

from __future__ import annotations

import csv
import io
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vespera.sources import storage
from vespera.sources.files import filesystem

#: Bytes of a range, and of the ranges that a task gets where there are more of them than cores, about.
RANGE, TASK = 1 << 26, 1 << 26
#: Ranges whose row counts are sent to every task, at most.
SENT = 200_000
ROW = "map<string,string>"
_MAP = pa.map_(pa.string(), pa.string())
_STOPS = re.compile(rb'"+|\r\n?|\n')
_GAPS = re.compile(rb"[\n\r, ]")
_QUOTE, _FIELD_STARTS = 34, (44, 10, 13)


def records(text: str, header: list[str] | None = None) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """(header, rows as pairs of header and stripped value) of CSV text.

    Fields may be of any length. Records end at a line feed, a carriage return or both, outside quotes; blank ones are
    left out. Text after a closing quote belongs to the field; a quote inside a field that did not begin with one is text.
    Columns without a name are dropped.
    """
    csv.field_size_limit(sys.maxsize)
    reader = csv.DictReader(io.StringIO(text, newline=""), fieldnames=header)
    names = list(reader.fieldnames or [])
    return names, [[(h.strip(), (x or "").strip()) for h, x in row.items() if h and h.strip()] for row in reader]


def effect(data: np.ndarray, before: int | None) -> tuple[bool, bool]:
    """Whether quotes are open after these bytes if they were closed, and if they were open, before them.

    before: the byte ahead, None at the start of the file. Only odd runs of quotes matter: one where a field begins
    turns the state round; any other closes.
    """
    at = np.flatnonzero(data == _QUOTE)
    if not len(at):
        return False, True
    new = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    first, size = at[new], np.diff(np.concatenate((new, [len(at)])))
    ahead = np.where(first > 0, data[first - 1], _FIELD_STARTS[0] if before is None else before)
    odd = size % 2 == 1
    turns = odd & np.isin(ahead, _FIELD_STARTS)
    closes = np.flatnonzero(odd & ~turns)
    if len(closes):
        after = bool(turns[closes[-1] :].sum() % 2)
        return after, after
    turned = bool(turns.sum() % 2)
    return turned, not turned


def _edge(file, size: int, at: int) -> int:
    """at, moved on past quotes that are there, so that no run of quotes is cut."""
    while 0 < at < size:
        data = file.read_at(min(1 << 12, size - at), at)
        rest = len(data) - len(data.lstrip(b'"'))
        at += rest
        if rest < len(data):
            break
    return min(at, size)


def _record_start(file, size: int, at: int, quoted: bool) -> int:
    """The first place from at on where a record begins; quoted: whether quotes are open there."""
    if at == 0 or at >= size:
        return min(at, size)
    before, step = file.read_at(1, at - 1), 1 << 13
    while True:
        data, state = file.read_at(min(step, size - at), at), quoted
        whole = at + len(data) >= size
        if not state and before in (b"\n", b"\r"):
            return at + (before == b"\r" and data[:1] == b"\n")
        for m in _STOPS.finditer(data):
            if m.end() == len(data) and not whole:
                break  # it may go on
            if data[m.start()] != _QUOTE:
                if not state:
                    return at + m.end()
            elif (m.end() - m.start()) % 2:
                ahead = data[m.start() - 1] if m.start() else before[0]
                state = not state and ahead in _FIELD_STARTS
        if whole:
            return size
        step *= 4


def _first_record(file, size: int) -> bytes:
    """The bytes of the file's first record."""
    step = 1 << 16
    while True:
        data, state = file.read_at(min(step, size), 0), False
        for m in _STOPS.finditer(data):
            if m.end() == len(data) and len(data) < size:
                break
            if data[m.start()] != _QUOTE:
                if not state:
                    return data[: m.end()]
            elif (m.end() - m.start()) % 2:
                state = not state and (m.start() == 0 or data[m.start() - 1] in _FIELD_STARTS)
        if len(data) == size:
            return data
        step *= 4


def _word_end(file, size: int, at: int) -> int:
    """The first place from at on that follows a line end, a comma or a blank."""
    while 0 < at < size:
        data = file.read_at(1 << 13, at - 1)
        if m := _GAPS.search(data):
            return at - 1 + m.end()
        at += len(data)
    return min(at, size)


def split_text(files: DataFrame, root: str, size: int = RANGE) -> DataFrame:
    """path, seq, content: the bytes of files in pieces of about size, cut where no word is. files: path, seq, at (its place), length (bytes)."""
    ranges = files.where("length > 0").select("path", "seq", "at", "length", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size).cast("int") - 1)).alias("k"))
    parts = max(files.sparkSession.sparkContext.defaultParallelism, ranges.count())

    def read(batches):
        fs, _ = filesystem(root)
        for b in batches:
            for path, seq, at, length, k in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(at) as f:
                    lo, hi = _word_end(f, length, k * size), _word_end(f, length, (k + 1) * size)
                    if hi > lo:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seq]), pa.array([f.read_at(hi - lo, lo)], pa.binary())], names=["path", "seq", "content"])

    return ranges.repartition(parts, "at", "k").mapInArrow(read, "path string, seq string, content binary")


def split_rows(files: DataFrame, root: str, size: int = RANGE) -> DataFrame:
    """path, kind, seq, row_no, row of every row of CSV files. files: path, kind, seq, at (its place), length (bytes).

    row_no counts from 0 within a file. An empty file has no rows; a file of a header alone neither. Bytes that are not
    UTF-8 become replacement characters.
    """
    spark = files.sparkSession
    ranges = files.where("length > 0").select("path", "kind", "seq", "at", "length", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size).cast("int") - 1)).alias("k"))
    n, total = ranges.agg(F.count("*"), F.coalesce(F.sum(F.least(F.lit(size), F.col("length") - F.col("k") * F.lit(size))), F.lit(0))).first()
    # neighbours go to one task, so that a file is opened and its header is read once a task and not once a range
    parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, total // TASK, n // 10_000)))
    dealt = lambda df: df.repartitionByRange(parts, "at", "k").sortWithinPartitions("at", "k")

    def summarise(batches):
        fs, _ = filesystem(root)
        for b in batches:
            out = []
            for at, length, k in zip(*(b.column(i).to_pylist() for i in (3, 4, 5))):
                with fs.open_input_file(at) as f:
                    lo, hi = _edge(f, length, k * size), _edge(f, length, (k + 1) * size)
                    out.append((lo, hi, *effect(np.frombuffer(f.read_at(hi - lo, lo), np.uint8), f.read_at(1, lo - 1)[0] if lo else None)))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lo", "hi", "closed", "open"])

    schema = "path string, kind string, seq string, at string, length long, k int"
    told = storage.stored(dealt(ranges).mapInArrow(summarise, schema + ", lo long, hi long, closed boolean, open boolean"), "ranges")  # a row a range, read for the dealing too
    # closed, open: the state after the range by the state before it. Equal: a constant; else the state stays or turns.
    by = Window.partitionBy("path").orderBy("k")
    turn = (F.col("closed") & ~F.col("open")).cast("int")
    counted = told.withColumn("turns", F.sum(turn).over(by))
    fixed = F.last(F.when(F.col("closed") == F.col("open"), F.struct(F.col("closed").cast("int").alias("state"), "turns")), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    states = counted.withColumn("fixed", fixed).withColumn("quoted", (F.coalesce("fixed.state", F.lit(0)) + F.col("turns") - turn - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1)
    after = F.when(F.col("quoted"), F.col("open")).otherwise(F.col("closed"))
    known = states.select("path", "kind", "seq", "at", "length", "k", "lo", "hi", "quoted", after.alias("left"))

    def parse(batches):
        fs, _ = filesystem(root)
        opened = first = header = None
        for b in batches:
            for path, kind, seq, at, length, k, lo, hi, quoted, left in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(at) as f:
                    if at != opened:
                        opened, first = at, _first_record(f, length)
                        header, _ = records(first.decode("utf-8", "replace"))
                    a, z = max(len(first), _record_start(f, length, lo, quoted)), _record_start(f, length, hi, left)
                    rows = records(f.read_at(z - a, a).decode("utf-8", "replace"), header)[1] if z > a else []
                for i in range(0, len(rows), 4096):
                    some = rows[i : i + 4096]
                    same = [pa.array([x] * len(some), t) for x, t in ((path, pa.string()), (kind, pa.string()), (seq, pa.string()), (k, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(i, i + len(some)), pa.int64()), pa.array(some, _MAP)], names=["path", "kind", "seq", "k", "i", "row"])

    rows = storage.stored(dealt(known).mapInArrow(parse, f"path string, kind string, seq string, k int, i long, row {ROW}"), "csv")
    counts = rows.groupBy("path", "k").agg(F.count("*").alias("n"))
    before = counts.select("path", "k", (F.sum("n").over(by) - F.col("n")).alias("before"))  # a row a range
    if n <= SENT:
        before = F.broadcast(before)
    return rows.join(before, ["path", "k"]).select("path", "kind", "seq", (F.col("before") + F.col("i")).alias("row_no"), "row")
