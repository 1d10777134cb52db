"""Evidence files of a case as DataFrames: scan, kinds, and the rows of each format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vespera.functions.text import source_kind
from vespera.sources import csvs, files as listed

#: CSV files of more bytes are read in ranges, by many tasks.
SPLIT_BYTES = 1 << 26
CSV_KINDS = ("sysmon_csv", "network_csv", "generic_csv")
LINES = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def text_of(content):
    """Bytes as text: UTF-8, with the replacement character where they are not."""
    return F.make_valid_utf8(content.cast("string"))


def scan(spark: SparkSession, root: str, step: str | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """path (below root), kind, sha, text, seq and others of every file; hidden files and folders are left out.

    step reads one sub-folder alone. A folder that does not exist raises Spark's PATH_NOT_FOUND. seq orders paths by their
    parts. Bytes that are not UTF-8 become replacement characters. Executors list and read the files; the text of CSV files
    of more than `split` bytes is null, and csv_rows reads them in ranges. On a file system that only Spark opens, Spark
    lists and reads; its listing leaves out names that begin with an underscore.
    """
    root = root.rstrip("/")
    at = root + (f"/{step.strip('/')}" if step else "")
    if listed.reachable(root):
        fs, place = listed.filesystem(at)
        if fs.get_file_info(place).type == listed.pafs.FileType.NotFound:
            spark.read.format("binaryFile").load(at)  # Spark's error
        found = listed.listing(spark, at).withColumn("path", F.concat(F.lit(f"{step.strip('/')}/" if step else ""), "path"))
        large = source_kind(F.col("path")).isin(*CSV_KINDS) & (F.col("length") > split)
        read = listed.contents(found, root, ~large)
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
        base = root.split(":", 1)[-1].lstrip("/")
        path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", ""), "^" + "".join(f"\\{c}" if not c.isalnum() else c for c in base) + "/?", "")
        read = read.select(F.col("path").alias("at"), path.alias("path"), "length", "modificationTime", F.sha2("content", 256).alias("sha"), "content").where(~F.col("path").rlike(r"(^|/)\."))
    return read.select("path", source_kind(F.col("path")).alias("kind"), "sha", text_of(F.col("content")).alias("text"), "modificationTime", F.array_join(F.split("path", "/"), "\x01").alias("seq"), "at", "length", F.lit(root).alias("root"))


def with_rows(files: DataFrame) -> DataFrame:
    """files with rows (maps of header to stripped value) of the CSV kinds whose text is there; csvs.records tells how.

    Python reads each file once here; what is made from the result stays in the JVM, so write it before using it often.
    """
    kind = "array<map<string,string>>"
    if "rows" in files.columns:
        return files

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):  # a file at a time: rows take many times the bytes of their text here
                t = pa.Table.from_batches([b.slice(i, 1)])
                found = csvs.records(t["text"][0].as_py() or "")[1] if t["kind"][0].as_py() in CSV_KINDS else []
                yield from t.append_column("rows", pa.array([found], pa.list_(pa.map_(pa.string(), pa.string())))).to_batches()

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + f", rows {kind}")


#: What str.strip takes for white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDS = "\r\n|\r|\n"


def _header():
    """The header names of a CSV text without quotes, stripped."""
    first = F.regexp_extract("text", r"\A[^\r\n]*", 0)
    return F.transform(F.split(first, ","), lambda h: F.btrim(h, F.lit(BLANKS)))


def _plain():
    """Whether columns split the text as csvs.records does: there are no quotes, and the header is not blank and names nothing twice.

    Fields beyond 131,072 characters are not special; a text that is null or empty has no rows.
    """
    h = F.filter(_header(), lambda x: x != "")
    return F.coalesce(~F.contains("text", F.lit('"')) & F.col("text").rlike(r"\A[^\r\n]") & (F.size(h) == F.size(F.array_distinct(h))), F.lit(False))


def _split_plain(files: DataFrame, keep: list[str]) -> DataFrame:
    """keep, row_no, row of CSV texts for which _plain holds."""
    x = files.select(*keep, _header().alias("_h"), F.split("text", _ENDS).alias("_l"))
    x = x.select(*keep, F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))).alias("_h"), F.posexplode(F.filter(F.slice("_l", 2, F.greatest(F.lit(0), F.size("_l") - 1)), lambda l: l != "")).alias("row_no", "_line"))
    x = x.select(*keep, "row_no", F.filter("_h", lambda c: c["h"] != "").alias("_h"), F.split("_line", ",").alias("_f"))
    value = lambda c: F.btrim(F.coalesce(F.get("_f", c["i"]), F.lit("")), F.lit(BLANKS))
    row = F.map_from_arrays(F.transform("_h", lambda c: c["h"]), F.transform("_h", value))
    return x.select(*keep, "row_no", F.explode(F.array(row)).alias("row"))  # so that filters do not make the map again for each use of it


#: Rows of a CSV text that Python hands over at once.
HANDED = 4096


def _split_quoted(files: DataFrame, keep: list[str]) -> DataFrame:
    """keep, row_no, row of CSV texts by csvs.records, a file at a time, so that Python holds the rows of one."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                rows = csvs.records(b.column(b.num_columns - 1)[i].as_py() or "")[1]
                for at in range(0, len(rows), HANDED):
                    some = rows[at : at + HANDED]
                    same = [b.column(c).take(pa.array([i] * len(some), pa.int64())) for c in range(b.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.map_(pa.string(), pa.string()))], names=[*keep, "row_no", "row"])

    kinds = dict(files.dtypes)
    return files.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", row_no int, row map<string,string>")


def csv_rows(files: DataFrame) -> DataFrame:
    """path, kind, seq, row_no, row (a map of header to stripped value; csvs.records tells how) of every CSV row.

    Texts of tables are split by columns where they hold no quotes, others by Python, as those of files are, which are
    then read once. Files whose text was not read, being large, are read in ranges. Rows of with_rows are taken as they are.
    """
    keep = ["path", "kind", "seq"]
    wanted = files.where(F.col("kind").isin(*CSV_KINDS))
    if "rows" in files.columns:
        got = wanted.select(*keep, F.posexplode("rows").alias("row_no", "row"))
    elif "at" in files.columns:
        got = _split_quoted(wanted.where("text is not null"), keep)
    else:
        got = _split_plain(wanted.where(_plain()), keep).unionByName(_split_quoted(wanted.where(F.col("text").isNotNull() & ~_plain()), keep))
    if "at" not in files.columns:
        return got
    for root, large in _large(files):
        got = got.unionByName(csvs.split_rows(large, root))
    return got


def _large(files: DataFrame) -> list[tuple[str, DataFrame]]:
    """(root, files below it) of CSV files whose text was not read."""
    large = files.where(F.col("kind").isin(*CSV_KINDS) & F.expr("text is null and length > 0")).select("path", "kind", "seq", "at", "length", "root")
    return [(r["root"], large.where(F.col("root") == r["root"])) for r in large.select("root").distinct().collect()]  # one root a scan


def texts(files: DataFrame) -> DataFrame:
    """path, seq, text of every file. Large files, whose text was not read, come in pieces that end at a line end, a comma or a blank."""
    got = files.where("text is not null").select("path", "seq", "text")
    for root, large in _large(files) if "at" in files.columns else []:
        got = got.unionByName(csvs.split_text(large, root).select("path", "seq", text_of(F.col("content")).alias("text")))
    return got


def lines(files: DataFrame) -> DataFrame:
    """path, kind, seq, line_no (from 1, blank lines counted), line (trimmed)."""
    return files.select("path", "kind", "seq", F.posexplode(F.split("text", LINES)).alias("i", "line")).select("path", "kind", "seq", (F.col("i") + 1).alias("line_no"), F.trim("line").alias("line"))


def registry_values(files: DataFrame) -> DataFrame:
    """path, seq, line_no, key, name, value of registry exports; a section's key is carried down to its values."""
    x = lines(files.where("kind = 'registry_reg'"))
    key = F.when(x["line"].rlike(r"^\[.+\]$"), F.regexp_extract("line", r"^\[(.+)\]$", 1))
    down = F.last(key, ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no"))
    entry = r'^"([^"]+)"=(.*)$'
    raw = F.regexp_replace(F.regexp_extract("line", entry, 2), '^"(.*)"$', "$1")
    value = F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return x.withColumn("key", down).where(F.col("line").rlike(entry) & F.col("key").isNotNull()).select("path", "seq", "line_no", "key", F.regexp_extract("line", entry, 1).alias("name"), value.alias("value"))
