"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with language references (the summed
histograms of each language's documents) by Jensen-Shannon distance; the nearer of those of its own language
and of all languages counts. Documents of too few words are not judged by distance.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from vespera.llm.common import WORD, checked, map_rows, stored

#: Documents of fewer words are not judged by distance.
MIN_WORDS = 30
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45
WINDOW = 5
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "other_letter", "digit", "space", "newline", "period_comma", "exclaim", "quote_bracket", "symbol", "other")
#: Common words of the four languages whose histograms are kept; all others count as one.
COMMON = tuple(
    dict.fromkeys(
        "the of and to in is that it for was on are as with be at by this have from or an not but they you he she his her which a we i "
        "le la les de des du et un une est que qui dans pour pas sur au par plus ce il elle en avec son se ou "
        "der die das und ist nicht ein eine zu den von mit sich des auf für im dem auch als es an werden aus er hat dass sie nach bei um "
        "el los las y que del un una por con no su para como más pero sus al lo es".split()
    )
)

#: A language's reference has so many words at least; documents of the others are held against that of all languages.
MIN_REFERENCE = 2_000
#: Languages whose references are sent along at once (1.6 KB each); more of them are joined by shuffle.
LANGUAGES_SENT = 20_000

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile("[" + re.escape(SYMBOLS) + "]")
_COMMON = {v: i for i, w in enumerate(COMMON) for x in (w, w.capitalize(), w.upper()) for v in (x, x + ",", x + ".")}
#: Code points that are classed at once.
_CHUNK = 1 << 16
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, chars array<int>, word_ids array<int>, word_counts array<int>"


def _class_of(c: str) -> int:
    if c in SYMBOLS:
        return 9
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    kind = unicodedata.category(c)
    if kind == "Ll":
        return 0
    if kind == "Lu":
        return 1
    if kind[0] in "LM":
        return 2
    if kind[0] == "N":
        return 3
    return 6 if c in ".,;:" else 7 if c in "!?" else 8 if kind in ("Ps", "Pe", "Pi", "Pf") or c in "\"'" else 10


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    return np.fromiter((_class_of(chr(i)) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


def class_counts(text: str) -> list[int]:
    """Characters by class, in chunks of bounded size."""
    codes, out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), np.zeros(len(CLASSES), np.int64)
    for lo in range(0, len(codes), _CHUNK):
        out += np.bincount(_classes()[codes[lo : lo + _CHUNK]], minlength=len(CLASSES))
    return out.tolist()


def repeat_words(words: list[str]) -> int:
    """Words inside windows of WINDOW words that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    base = len(known)
    if base**WINDOW < 1 << 62:
        key = ids[:n].copy()
        for k in range(1, WINDOW):
            key = key * base + ids[k : k + n]
    else:
        key = ids[:n]
        for k in range(1, WINDOW):
            key = np.unique(key * base + ids[k : k + n], return_inverse=True)[1].reshape(-1)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse.reshape(-1)] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, lang and FIELDS: the base counts and both histograms of every whole text (null: empty)."""
    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    got = docs.select(docs[id_col].alias("doc_id"), lang.alias("lang"), docs[text_col].alias("text"))

    def make():
        def f(ids, langs, texts):
            base, length, chars, at, n = [], [], [], [], []
            for t in texts:
                t = t or ""
                words = _WORDS.findall(t)
                base.append(base_counts(t, words))
                length.append(len(t))
                chars.append(class_counts(t))
                found = Counter(_COMMON.get(w, len(COMMON)) for w in words)
                at.append(list(found))
                n.append(list(found.values()))
            return ids, langs, *([*c] for c in zip(*base)), length, chars, at, n

        return f

    return map_rows(got, make, f"doc_id {got.schema[0].dataType.simpleString()}, lang string, {FIELDS}")


def references(measured: DataFrame) -> tuple[DataFrame, Row | None]:
    """(lang, ref_chars, ref_words of every language, the same over all languages; None if no document passes).

    Shares of character classes and of common words, summed over documents of MIN_WORDS words that pass the base rules.
    Languages are the values of the column, whichever these are; null, and those below MIN_REFERENCE words, have none.
    """
    words = F.map_from_arrays("word_ids", "word_counts")
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(len(COMMON) + 1)]
    by = stored(measured.where((F.col("n_words") >= MIN_WORDS) & ~base_failed()).groupBy("lang").agg(*sums), "references")
    c, w = [f"c{i}" for i in range(len(CLASSES))], [f"w{i}" for i in range(len(COMMON) + 1)]
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    lists = lambda df: df.withColumns({"c": F.array(*c), "w": F.array(*w)})
    share = lambda xs: F.transform(xs, lambda x: x / total(F.col(xs)))
    made = lambda df: df.withColumns({"ref_chars": share("c"), "ref_words": share("w")})
    every = made(lists(by.agg(*[F.sum(x).alias(x) for x in c + w])).where(F.col("c0").isNotNull())).first()
    own = lists(by).where(F.col("lang").isNotNull() & (total(F.col("w")) >= MIN_REFERENCE))
    return made(own).select("lang", "ref_chars", "ref_words"), every


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distance(at, counts, total, ref):
    """Jensen-Shannon distance (root of the divergence in bits) of a sparse histogram with a sum of total from a reference of sum 1.

    Entries that only the reference has add their share to twice the divergence, so what is not listed needs no visit.
    """
    def term(i, c):
        p, r = c / total, F.element_at(ref, i + 1)
        m = (p + r) / 2
        return F.when(c > 0, p * F.log2(p / m) + F.when(r > 0, r * F.log2(r / m)).otherwise(0.0) - r).otherwise(0.0)

    twice = F.aggregate(F.zip_with(at, counts, term), F.lit(1.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Every document's counts, distances to the nearer reference (null below MIN_WORDS), base_failed, kept.

    Null and empty texts have no words, so they fail the base. A document is held against the reference of its language
    and that of all languages; one without a language, or of one with too little text for a reference, against the latter. With no document long enough there is no reference, and
    only the base rules judge. Ids may be null and rows may repeat: each row is judged.
    """
    measured = stored(measure(docs, id_col, text_col, lang_col), "histograms")
    known, every = references(measured)
    x, near = measured, F.lit(None).cast("struct<both:double,chars:double,words:double>")
    if every:
        x = measured.join(checked(known, LANGUAGES_SENT), "lang", "left")
        refs = [(F.col("ref_chars"), F.col("ref_words")), (F.lit(every["ref_chars"]), F.lit(every["ref_words"]))]
        each = [(distance(F.lit(list(range(len(CLASSES)))), F.col("chars"), F.col("n_chars"), c), distance(F.col("word_ids"), F.col("word_counts"), F.col("n_words"), w)) for c, w in refs]
        both = [F.when(ref.isNotNull(), F.struct((c + w).alias("both"), c.alias("chars"), w.alias("words"))) for (ref, _), (c, w) in zip(refs, each)]
        near = F.when(F.col("n_words") >= MIN_WORDS, F.array_min(F.array(*both)))  # null is no reference
    x = x.withColumn("near", near)
    good = F.coalesce((F.col("near.chars") <= MAX_CHAR_DISTANCE) & (F.col("near.words") <= MAX_WORD_DISTANCE), F.lit(True))
    return x.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & good).alias("kept"),
        F.col("near.chars").alias("char_distance"), F.col("near.words").alias("word_distance"),
    )
