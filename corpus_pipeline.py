"""A training corpus from documents: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and judges all that its predecessor kept; all but the last give rows with the
columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vespera.llm import decontaminate, mixing, near_dup, pairwise_quality, token_files
from vespera.llm.common import checked, fold, stored, table
from vespera.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking scores at or above the threshold, with every row and column they had.

    Null and empty texts get one score, that of the `empty` feature. Repeated rows get equal scores, so all stay or all go;
    a null id is judged like any other. Without labels every row stays. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id"), 5) != 0)
    scored = pairwise_quality.score(docs, pairwise_quality.train(docs, labels), keep=docs.columns)
    plain = scored.toDF(*[f"c{i}" for i in range(len(docs.columns))], "score")  # by place: names may meet
    return plain.where(F.col("score") >= pairwise_quality.THRESHOLD).drop("score").toDF(*docs.columns)


def row_key():
    """What rows are judged by: the id, which may be null or shared, and a hash of the text."""
    return F.struct("doc_id", F.xxhash64("text").alias("hash"))


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, and all columns in one, `row`, so that a stage's own columns meet none of theirs."""
    return docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def comparable(docs: DataFrame):
    """The values of a row in a form that has an order: maps and variants as JSON."""
    plain = lambda t: not any(x in t for x in ("map<", "variant"))
    return F.struct(*[F.col(f"row.`{c}`") if plain(t) else F.to_json(F.struct(F.col(f"row.`{c}`"))) for c, t in docs.dtypes])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, once. Ids are integers.

    The first text of an id is judged by that id; rows without an id and further texts of an id by numbers beyond all ids.
    Of rows of one id and text, and of ties, the least by all columns stays (maps by their JSON). Rows without words are
    linked with nothing: one stays for an id, all where there is no id.
    """
    keyed = apart(docs).withColumn("key", row_key())
    ids = keyed.select("key").distinct().select("key.*")
    first = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("first"), F.max("hash").alias("last"))
    further = ids.join(first.where("first != last"), "doc_id").where("hash != first").select("doc_id", "hash").unionByName(ids.where("doc_id is null"))
    beyond = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0)).alias("m")).first()["m"] + 1
    numbers = stored(further.select(F.struct("doc_id", "hash").alias("key"), (F.lit(beyond) + F.monotonically_increasing_id()).alias("number")), "numbers")
    numbered = keyed.join(checked(numbers), "key", "left").withColumn("id", F.coalesce("number", F.col("doc_id").cast("long"))).drop("number", "key")
    kept = near_dup.near_duplicates(numbered.select("id", "text"), id_col="id").where("kept").select(F.col("doc_id").alias("id"), "n_shingles").distinct()
    chosen = numbered.join(kept, "id")
    alone = (F.col("doc_id").isNull()) & (F.col("n_shingles") == 0)  # no id and no words: nothing says that two are one
    once = chosen.where(~alone).groupBy("id").agg(F.min_by("row", comparable(docs)).alias("row")).select("row.*")
    return once.unionByName(chosen.where(alone).select("row.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Each id and text is judged apart, so a contaminated row takes only its own repeats along, whether its id is null or
    shared. Null and empty texts stay; without benchmark items every row stays.
    """
    keyed = apart(docs).withColumn("key", row_key())
    found = decontaminate.decontaminate(keyed.select("key", "text"), table(spark, sf_dir, "benchmark"), id_col="key").where("contaminated").select(F.col("doc_id").alias("key"))
    return keyed.join(found, "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows of one id, text and source are interchangeable; if the mix takes them unequally, they are ranked. Rows without
    words add nothing to any target and are not taken. A null source is a source of its own.
    """
    keyed = apart(docs).withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash"), "source"))
    taken = mixing.mix(keyed.select("key", "text", "source"), id_col="key").groupBy(F.col("doc_id").alias("key")).agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").alias("all"), F.count("*").alias("n"))
    both = keyed.join(taken.where("most > 0"), "key")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(comparable(docs))))
    # copies of one size differ by one at most
    unequal = both.where("least != most").withColumn("copies", F.col("least") + (rank <= F.col("all") - F.col("least") * F.col("n")).cast("long"))
    both = both.where("least = most").withColumn("copies", F.col("most")).unionByName(unequal).where("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, and what they hold of each document: a row a copy, null ids first.

    A null or empty text is its end id alone; an empty table makes files without documents.
    """
    return token_files.token_files(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: Training, hashing and dynamic programming are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower().replace("/", "-"))
    return docs
