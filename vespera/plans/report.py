"""The report of a case: one page whose sections are made by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.operators.merge import rank
from vespera.plans.text import joined

PAGE = "final_report"
STUB = "# Final report\n\n_No report has been made._"


def section(title: str, rows: DataFrame, order: list, line) -> DataFrame:
    """body: a heading and a line a row in order, or that there is none."""
    x = joined(rows, order, line)
    return x.select(F.concat(F.lit(f"## {title}\n\n"), F.when(F.col("n") == 0, "- _none_").otherwise(F.col("text"))).alias("body"))


def render(events: DataFrame, entities: DataFrame, iocs: DataFrame, claims: DataFrame, contradictions: DataFrame, steps: DataFrame, files: DataFrame) -> DataFrame:
    """page, body. Facts, inferences and hypotheses stay apart; the summary names the strongest hypothesis, the first of equals."""
    bullet = lambda *parts: F.concat(F.lit("- "), *parts)
    listed = lambda c: F.when(F.size(c) == 0, "- _none_").otherwise(F.array_join(F.transform(c, lambda s: F.concat(F.lit("- "), s)), "\n"))
    top = claims.agg(F.count("*").alias("n"), F.max_by(F.struct("title", "confidence"), F.struct(rank(F.col("confidence")), -F.substring("claim_id", 7, 20).cast("int"))).alias("top"))
    strongest = F.concat(F.lit("The strongest hypothesis is: "), F.col("top.title"), F.lit(" (confidence: "), F.col("top.confidence"), F.lit("). It is not a fact."))
    summary = top.select(F.concat(F.lit("## Summary\n\n"), F.when(F.col("n") == 0, "No hypothesis is on record.").otherwise(strongest)).alias("body"))
    told = F.concat(
        F.lit("### "), "title", F.lit(" (confidence: "), "confidence", F.lit(")\n\nFacts\n"), listed(F.col("facts")), F.lit("\n\nInference\n"), F.coalesce(F.nullif("inference", F.lit("")), F.lit("_none_")),
        F.lit("\n\nSupporting\n"), listed(F.transform("supporting", lambda s: F.concat(F.lit("(Source: "), s, F.lit(")")))), F.lit("\n\nContradicting\n"), listed(F.transform("contradicting", lambda s: F.concat(F.lit("(Source: "), s, F.lit(")")))), F.lit("\n"),
    )
    parts = [
        summary,
        section("Timeline", events, [F.col("ts") == "unknown", F.col("ts"), F.col("seq")], bullet("ts", F.lit(": "), "description", F.lit(" (Source: "), "path", F.lit(")"))),
        section("Key artifacts", entities.where("type = 'file'"), [F.col("value")], bullet("value")),
        section("Indicators", iocs, [F.col("artifact")], bullet("artifact", F.lit(" ("), "type", F.lit(", confidence: "), "confidence", F.lit("): "), "reason", F.lit(" (Source: "), "source", F.lit(")"))),
        section("Hypotheses", claims, [F.col("title")], told),
        section("Contradictions", contradictions, [F.col("title")], bullet("title", F.lit(": Claim A: "), "claim_a", F.lit(" Claim B: "), "claim_b")),
        section("Next steps", steps, [F.col("claim_id"), F.col("pos")], bullet("text", F.lit(" (from "), "claim_id", F.lit(")"))),
        section("Sources", files, [F.col("path")], bullet("path")),
    ]
    every = parts[0].withColumn("i", F.lit(0))
    for i, x in enumerate(parts[1:], 1):
        every = every.unionByName(x.withColumn("i", F.lit(i)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n\n")
    return every.agg(body.alias("b")).select(F.lit(PAGE).alias("page"), F.concat(F.lit("# Final report\n\n"), "b").alias("body"))
