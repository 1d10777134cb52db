"""Pages of a case: markdown bodies made by ordered aggregation, one row a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.operators import diff, merge
from vespera.plans.evidence import State
from vespera.plans.report import PAGE
from vespera.plans.text import joined

#: Pages that a case must have; all but the report are rendered with each merge.
NAMES = ("contradictions", "entities", PAGE, "hypotheses", "index", "iocs", "open_questions", "timeline")

#: Lines of a part of a page that is too long for one.
PART_LINES = 1_000


def _page(name: str, rows: DataFrame, order: list, line) -> DataFrame:
    """A page: its front matter, and one line a row in order; a page without rows says so."""
    x = joined(rows, order, line)
    head = F.concat(F.lit(f"---\npage: {name}\nlines: "), F.col("n").cast("string"), F.lit(f"\n---\n# {name}\n\n"))
    return x.select(F.lit(name).alias("page"), F.concat(head, F.when(F.col("n") == 0, "_none_").otherwise(F.col("text"))).alias("body"))


def _bullet(*parts):
    return F.concat(F.lit("- "), *parts)


def timeline(events: DataFrame) -> DataFrame:
    """page, body of events (ts, description, path, seq): by time as text, unknown times last."""
    return _page("timeline", events, [F.col("ts") == "unknown", F.col("ts"), F.col("seq")], _bullet("ts", F.lit(" "), "description", F.lit(" (Source: "), "path", F.lit(")")))


def parts(name: str, rows: DataFrame, order: list, line, size: int = PART_LINES) -> DataFrame:
    """page, part (from 0), lines, body: a page of any length in parts of `size` lines, in order; none without rows.

    Lines are numbered by ranges, so no task holds more than its range or one part. Lines of equal order keep theirs by text.
    """
    keys = [f"k{i}" for i in range(len(order))]
    told = rows.select(*[o.alias(k) for o, k in zip(order, keys)], line.alias("line"))
    at = merge.numbered(told, [*keys, "line"]).withColumn("part", F.floor((F.col("n") - 1) / size).cast("long"))
    whole = at.groupBy("part").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))  # size rows at most
    return whole.select(F.lit(name).alias("page"), "part", "lines", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("body"))


def timeline_parts(events: DataFrame, size: int = PART_LINES) -> DataFrame:
    """The timeline in parts."""
    return parts("timeline", events, [F.col("ts") == "unknown", F.col("ts"), F.col("seq")], _bullet("ts", F.lit(" "), "description", F.lit(" (Source: "), "path", F.lit(")")), size)


def render(state: State, claims: DataFrame, questions: DataFrame) -> DataFrame:
    """page, body. questions: text. The timeline puts unknown times last; all else is in the order of its key."""
    e, n, i, c = state.events, state.entities, state.iocs, state.contradictions
    every = [
        timeline(e),
        _page("entities", n, [F.col("type"), F.col("key")], _bullet("type", F.lit(": "), "value", F.lit(" ("), F.array_join("sources", ", "), F.lit(")"))),
        _page("iocs", i, [F.lower("artifact")], _bullet("artifact", F.lit(" ["), "confidence", F.lit("] "), "reason")),
        _page("hypotheses", claims, [F.lower("title")], _bullet("title", F.lit(" ["), "confidence", F.lit("] "), "inference", F.array_join(F.transform("facts", lambda f: F.concat(F.lit("\n  "), f)), ""))),
        _page("contradictions", c, [F.lower("title")], _bullet("title", F.lit(": Claim A: "), "claim_a", F.lit(" Claim B: "), "claim_b")),
        _page("open_questions", questions, [F.col("text")], _bullet("text")),
        _page("index", claims.sparkSession.createDataFrame([(x,) for x in NAMES if x != "index"], "n string"), [F.col("n")], _bullet(F.lit("[["), "n", F.lit("]]"))),
    ]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """page, sign (+ or -), line, n: lines that one side has more often than the other."""
    d = diff.line_counts(old, new).withColumn("n", F.col("added") - F.col("removed"))
    return d.select("page", F.when(F.col("n") > 0, "+").otherwise("-").alias("sign"), "line", F.abs("n").alias("n"))
