"""Deterministic scoring of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_refusal(answer: Column) -> Column:
    a = F.lower(answer)
    return a.contains("not confirmed") | F.ltrim(a).startswith("answer:\nno") | a.contains("\nno.") | a.contains("\nno ")


def checks(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """id, method, kind, term, passed: one row a check.

    answers: id, method, answer and, where they have them, insufficient and classification. cases: id, must_include,
    must_not_include (arrays), expect_refusal and, where they have them, required_sources (array, met by base name) and
    expect_separation (of facts and hypotheses).
    """
    x = answers.join(F.broadcast(cases) if cases.isLocal() else cases, "id").withColumn("low", F.lower("answer"))

    def terms(column: str, kind: str, holds: bool) -> DataFrame:
        term = F.explode(column).alias("term")
        if kind == "required_source":
            term = F.explode(F.transform(column, lambda s: F.regexp_replace(s, "^.*/", ""))).alias("term")
        hit = F.contains("low", F.lower("term"))
        return x.select("id", "method", F.lit(kind).alias("kind"), "low", term).select("id", "method", "kind", "term", (hit if holds else ~hit).alias("passed"))

    def flag(column: str, kind: str, passed: Column) -> DataFrame:
        return x.where(column).select("id", "method", F.lit(kind).alias("kind"), F.lit("").alias("term"), passed.alias("passed"))

    refused = is_refusal(F.col("answer"))
    if "insufficient" in x.columns:
        refused = F.coalesce("insufficient", F.lit(False)) | refused
    out = terms("must_include", "must_include", True).unionByName(terms("must_not_include", "must_not_include", False)).unionByName(flag("expect_refusal", "refusal", refused))
    if "required_sources" in x.columns:
        out = out.unionByName(terms("required_sources", "required_source", True))
    if "expect_separation" in x.columns:
        apart = F.contains("low", F.lit("fact")) & F.contains("low", F.lit("hypothesis"))
        if "classification" in x.columns:
            apart = (F.coalesce("classification", F.lit("")) == "hypothesis") | apart
        out = out.unionByName(flag("expect_separation", "separation", apart))
    return out


def results(checked: DataFrame) -> DataFrame:
    return checked.groupBy("id", "method").agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_failures"))


def summary(result: DataFrame) -> DataFrame:
    """A row a method: total, passed, failed, failures."""
    return result.groupBy("method").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.sum("n_failures").alias("failures"))


def ratio(hits: Column, of: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.count_if(hits & of), F.count_if(of)), F.lit(0.0)), 6)


# The question categories of the measures.
RELATIONSHIP = ("relationship_retrieval", "multi_hop_relation")
NARRATIVE = ("current_investigation_assessment", "hypothesis_evolution", "final_report_accuracy")
CONTRADICTION = ("contradiction_detection",)


def scorecard(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """A row a method: passed, failed, failures by kind, and the ratios over the questions that each is about.

    answers and cases as for checks; cases also hold category and expected_best_method. A question without checks passes.
    """
    failed = checks(answers, cases).where(~F.col("passed")).groupBy("id", "method").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "must_not_include").alias("unsupported"), F.count_if(F.col("kind") == "required_source").alias("missing")
    )
    about = cases.select("id", "category", F.coalesce("expect_refusal", F.lit(False)).alias("refuse"), "expected_best_method")
    x = answers.select("id", "method", "answer").join(about, "id").join(failed, ["id", "method"], "left").fillna(0, ["n", "unsupported", "missing"])
    ok, kind = F.col("n") == 0, lambda *names: F.coalesce(F.col("category").isin(*names), F.lit(False))
    return x.groupBy("method").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.sum("unsupported").alias("unsupported_failures"), F.sum("missing").alias("missing_source_failures"),
        ratio(is_refusal(F.col("answer")), F.col("refuse")).alias("refusal_accuracy"), F.count_if(kind(*CONTRADICTION) & ~ok).alias("contradiction_misses"),
        ratio(ok, kind(*RELATIONSHIP)).alias("relationship_coverage"), ratio(ok, kind(*NARRATIVE)).alias("narrative_state_quality"), F.count_if(ok & (F.col("expected_best_method") == F.col("method"))).alias("expected_best_wins"),
    )


def card_text(rows: list[dict]) -> str:
    """A scorecard as a Markdown table, a column a method."""
    methods = [r["method"] for r in rows]
    lines = ["| measure | " + " | ".join(methods) + " |", "|---|" + "---|" * len(methods)]
    for name in [k for k in (rows[0] if rows else {}) if k != "method"]:
        lines.append(f"| {name.replace('_', ' ')} | " + " | ".join(f"{r[name]:.2f}" if isinstance(r[name], float) else str(r[name]) for r in rows) + " |")
    return "\n".join(lines) + "\n"
