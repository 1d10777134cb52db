"""Facts by an extractor that is given: any function of texts, such as one that asks a model.

The function stands behind a table function that says itself what it returns and how its rows are dealt. It gets texts in
batches; a batch that fails is asked again, then its texts one by one. A text's answer is kept under its hash, so equal
texts, and texts of earlier runs, are not asked again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from vespera.functions import names as N
from vespera.operators.merge import RANKS
from vespera.plans import evidence
from vespera.sources import storage

FACTS = "array<struct<type:string,value:string,confidence:string>>"
ANSWERS = f"sha string, facts {FACTS}, problem string"
#: A function of texts gives, for each of them, dicts with type, value and, if it likes, confidence.
Ask = Callable[[list[str]], list[list[dict]]]
#: Texts of a request, its characters (a longer text goes alone), texts of a task, and folders of answers before they become one.
BATCH, CHARACTERS, TASK, FOLDERS = 32, 200_000, 2_000, 50
#: Hashes of texts to be asked that are sent to every task, at most.
SENT = 200_000


def table_function(ask: Ask, tries: int = 3, wait: float = 1.0, batch: int = BATCH):
    """A table function of rows (part, sha, text): sha, facts, and the problem of a text that failed so many times."""

    made = T.StructType.fromDDL(ANSWERS)

    class Answers:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            lacking = {"part", "sha", "text"} - set(rows.dataType.names)
            if lacking:
                raise ValueError(f"the rows lack {', '.join(sorted(lacking))}")
            return AnalyzeResult(made, partitionBy=[PartitioningColumn("part")])

        def __init__(self):
            self.held, self.size = [], 0

        def eval(self, row):
            text = row["text"] or ""
            if self.held and self.size + len(text) > CHARACTERS:
                yield from self.flush()
            self.held.append((row["sha"], text))
            self.size += len(text)
            if len(self.held) == batch:
                yield from self.flush()

        def terminate(self):
            if self.held:
                yield from self.flush()

        def flush(self):
            held, self.held, self.size = self.held, [], 0
            yield from self.answers(held)

        def answers(self, held):
            problem = ""
            for n in range(tries):
                try:
                    said = ask([t for _, t in held])
                    if len(said) != len(held):
                        raise ValueError(f"{len(said)} answers to {len(held)} texts")
                    told = [(sha, [(f.get("type"), f.get("value"), f.get("confidence")) for f in fs], None) for (sha, _), fs in zip(held, said)]
                except Exception as e:  # whatever a model's client raises
                    problem = f"{type(e).__name__}: {e}"
                    if n + 1 < tries:
                        time.sleep(wait * 2**n)
                    continue
                yield from told
                return
            if len(held) == 1:
                yield held[0][0], None, problem
                return
            for one in held:
                yield from self.answers([one])

    return F.udtf(Answers)


def _kept(versions: storage.Versions) -> DataFrame:
    """sha, facts of all texts ever answered; of two answers to one text that of the lesser run."""
    spark, at = versions.spark, versions.folders("answers")
    if not at:
        return spark.createDataFrame([], f"sha string, facts {FACTS}, run string")
    return spark.read.schema(f"sha string, facts {FACTS}, run string").parquet(*at).groupBy("sha").agg(F.min_by("facts", "run").alias("facts"), F.min("run").alias("run"))


def answered(files: DataFrame, ask: Ask, memo: str, **how) -> tuple[DataFrame, DataFrame]:
    """(sha, facts of the texts of files; sha, problem of those that failed). files: sha, text, where equal shas have equal texts; without a sha there is no answer.

    Only texts without an answer below memo are asked, each once however many files hold it. Answers are committed as one
    version, beside those of other writers; failed texts are not kept, so a later run asks them again.
    """
    spark = files.sparkSession
    versions = storage.Versions(spark, memo)
    lacking = storage.stored(files.select("sha").where("sha is not null").distinct().join(_kept(versions).select("sha"), "sha", "left_anti"), "lacking")
    n = lacking.count()
    failed = spark.createDataFrame([], "sha string, problem string")
    if n:
        # one row a text leaves each task that reads copies of it; texts that are known are not sent at all if few are new
        texts = files.select("sha", "text")
        if n <= SENT:
            new = texts.join(F.broadcast(lacking), "sha", "left_semi").dropDuplicates(["sha"])
        else:
            new = texts.dropDuplicates(["sha"]).join(lacking, "sha", "left_semi")
        parts = -(-n // TASK)
        spark.udtf.register("vespera_extract", table_function(ask, **how))
        dealt = new.withColumn("part", F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("int"))
        said = storage.stored(spark.sql("SELECT * FROM vespera_extract(TABLE({rows}))", rows=dealt), "answers")
        failed = said.where("problem is not null").select("sha", "problem")
        good = said.where("problem is null").select("sha", "facts").withColumn("run", F.lit(uuid.uuid4().hex))
        versions.commit({}, added={"answers": versions.stage("answers", good)})
        if len(versions.folders("answers")) > FOLDERS:
            since = versions.last()
            try:
                versions.commit({"answers": versions.stage("answers", _kept(versions))}, since)
            except storage.Conflict:  # another writer added some; the next run makes them one
                pass
    return _kept(versions).select("sha", "facts").join(files.select("sha").distinct(), "sha", "left_semi"), failed


def facts(files: DataFrame, ask: Ask, memo: str, **how) -> DataFrame:
    """path, n (from 0, in the extractor's order), type, value, confidence, note of every fact of every file (path, sha, text).

    Types are those of the vocabulary, any other is kept in the note; a confidence that is not known is Low. Facts without
    a value are left out. Files that share a text have the same facts; files whose text failed have none.
    """
    got, _ = answered(files, ask, memo, **how)
    each = files.select("path", "sha").join(got, "sha").select("path", F.posexplode("facts").alias("n", "f"))
    each = each.withColumns({"value": F.regexp_replace("f.value", r"^\s+|\s+$", ""), "t": N.known_type(F.col("f.type"))}).where("value != ''")
    sure = F.when(F.col("f.confidence").isin(*RANKS), F.col("f.confidence")).otherwise("Low")
    return each.select("path", "n", F.col("t.type").alias("type"), "value", sure.alias("confidence"), F.col("t.note").alias("note"))


def extracting(ask: Ask, memo: str, **how) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """What Case takes as extract: the facts by rules, and as further mentions those of an extractor."""

    def run(files: DataFrame) -> dict[str, DataFrame]:
        raw = evidence.extract(files)
        more = facts(files, ask, memo, **how)
        like = raw["mentions"]
        # after the mentions by rules of the same file
        seq = F.concat("path", F.lit("\x04"), F.lpad(F.col("n").cast("string"), 19, "0"))
        more = more.select(seq.alias("seq"), "type", "value", F.col("path").alias("source"))
        return {**raw, "mentions": like.unionByName(more.select(*[c if c in more.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns]))}

    return run
