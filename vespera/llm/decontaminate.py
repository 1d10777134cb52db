"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index stores the postings (row, term, position) of every document for the terms that test items use, in the
order of the scan, as segments in the shared folder. A phrase is looked up from its rarest terms: their lists,
shifted by the terms' offsets, are intersected first; what is left is confirmed on all terms of the phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vespera.llm.common import checked, stored

#: Words are runs of digits, a-z and everything beyond ASCII, after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Lists that are intersected before the confirmation.
RAREST = 3
#: Share of a window's words that stand in their places in a near match: of ten words, one may differ.
NEAR = 0.9
#: Pseudo term after the last word of every document; its position is the number of words.
END = "\x01"


def words(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


@dataclass
class Index:
    """postings: row, doc_id, term, pos; term 0 is END. terms: word, term, n (occurrences in all documents)."""

    postings: DataFrame
    terms: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of every row of docs (whole texts) for the words of vocabulary (column word, distinct)."""
    spark = docs.sparkSession
    own = vocabulary.select("word").where(F.col("word").isNotNull() & (F.col("word") != END)).distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    own = stored(own.unionByName(spark.range(1).select(F.lit(END).alias("word"), F.lit(0).cast("long").alias("term"))), "vocabulary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), F.concat(words(docs[text_col]), F.array(F.lit(END))).alias("w"))
    postings = rows.select("row", "doc_id", F.posexplode("w").alias("pos", "word")).join(checked(own), "word").select("row", "doc_id", "term", "pos")
    postings = stored(postings, "postings")
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    return Index(postings, stored(own.join(counts, "term").select("word", "term", "n"), "terms"))


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases: phrase, words), (uses: phrase, item_id): every run of size words of an item; a shorter item is one run."""
    w = items.select(items[id_col].alias("item_id"), words(items[text_col]).alias("w")).where(F.size("w") > 0)
    runs = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size)), lambda s: F.slice(F.col("w"), s + 1, F.lit(size)))).alias("words"))
    uses = stored(runs.select("item_id", "words", F.concat_ws(" ", "words").alias("text")), "windows")
    phrases = stored(uses.groupBy("text").agg(F.first("words").alias("words")).select(F.monotonically_increasing_id().alias("phrase"), "text", "words"), "phrases")
    return phrases.select("phrase", "words"), phrases.join(uses.select("text", "item_id").distinct(), "text").select("phrase", "item_id")


def _terms_of(index: Index, phrases: DataFrame, near: float = 1.0) -> DataFrame:
    """phrase, len, need, known, off, term, n for the words that some document has, of phrases of which at least `need` words are such."""
    t = phrases.select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("off", "word")).join(index.terms, "word")
    need = F.greatest(F.lit(1), F.ceil(F.first("len") * F.lit(near))).cast("int")
    whole = t.groupBy("phrase").agg(F.count("*").alias("known"), need.alias("need")).where("known >= need")
    return stored(t.join(whole, "phrase").select("phrase", "len", "need", "known", "off", "term", "n"), "phrase_terms")


def find_phrases(index: Index, phrases: DataFrame, rarest: int = RAREST, near: float = 1.0) -> DataFrame:
    """row, phrase, start, len, n of every place where n >= near * len words of a phrase stand where they should; exact where n = len.

    With near below 1, one of the rarest words may be missing or changed: a phrase with a single changed word is always
    found, one with several unless two of its three rarest words are among them.
    """
    terms = _terms_of(index, phrases, near)
    by_rarity = Window.partitionBy("phrase").orderBy("n", "off")
    rare = terms.withColumn("r", F.row_number().over(by_rarity)).where(F.col("r") <= rarest)
    k = F.least("known", F.lit(rarest))
    least = k if near >= 1 else F.when((k >= 3) & (F.col("need") < F.col("len")), k - 1).otherwise(k)
    rare = stored(rare.select("term", "phrase", "off", least.alias("k")), "rare")
    lists = index.postings.select("row", "term", "pos").join(checked(rare), "term").select("row", "phrase", (F.col("pos") - F.col("off")).alias("start"), "k").where("start >= 0")
    left = stored(lists.groupBy("row", "phrase", "start").agg(F.count("*").alias("n"), F.first("k").alias("k")).where("n >= k").select("row", "phrase", "start"), "candidates")
    some = checked(left.select("row").distinct())
    wanted = left.join(terms.select("phrase", "len", "need", "off", "term"), "phrase").select("row", "phrase", "start", "len", "need", "term", (F.col("start") + F.col("off")).alias("pos"))
    there = index.postings.where("term > 0").select("row", "term", "pos").join(some, "row", "left_semi")
    met = wanted.join(there, ["row", "term", "pos"]).groupBy("row", "phrase", "start").agg(F.count("*").alias("n"), F.first("len").alias("len"), F.first("need").alias("need"))
    met = met.where("n >= need")
    if near < 1:  # a phrase that would go on beyond the end of its document is none
        met = met.join(index.postings.where("term = 0").select("row", F.col("pos").alias("words")), "row").where(F.col("start") + F.col("len") <= F.col("words"))
    return met.select("row", "phrase", "start", "len", "n")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", near: float = NEAR) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, n_near for every row of docs.

    A word is hit if any exact occurrence of a window covers it. n_near counts the items of which a window occurs with at
    least the share near of its words in their places, the exact ones included; it decides nothing. Null texts and texts
    without words have no hits; items without words make no window; with no items nothing is hit. Rows that share an id
    are judged apart.
    """
    phrases, uses = windows(items, size, item_id_col, item_text_col)
    index = build_index(docs, phrases.select(F.explode("words").alias("word")), id_col, text_col)
    found = stored(find_phrases(index, phrases, near=near), "matches")
    exact = found.where("n = len")
    hit = exact.select("row", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    whole = found.groupBy("row", "phrase").agg(F.bool_or(F.col("n") == F.col("len")).alias("exact"))
    its = whole.join(checked(uses), "phrase").groupBy("row", F.col("item_id").cast("string").alias("item")).agg(F.bool_or("exact").alias("exact"))
    its = its.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count("*").alias("n_near"))
    all_rows = index.postings.where("term = 0").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    n_hit, items_ = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    out = all_rows.join(hit, "row", "left").join(its, "row", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
