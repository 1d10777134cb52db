"""What an agent may do with the cases of a workspace: thirteen tools as plain functions, by name in TOOLS.

Names of cases and pages are checked before anything is read, results are plain values, and lists have a stated length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vespera.api import Case, cases
from vespera.functions.names import safe_case, safe_page
from vespera.operators import lint
from vespera.plans import evidence, pages

#: Rows of a list that a tool gives at most; the total is told beside it.
LISTED = 200
#: Fixed value: characters of a report that a summary gives.
SUMMARY = 300


@dataclass
class Workspace:
    spark: SparkSession
    evidence: str
    states: str

    def case(self, name: str) -> Case:
        name = safe_case(name)
        return Case(self.spark, f"{self.evidence.rstrip('/')}/{name}", f"{self.states.rstrip('/')}/{name}")


def _listed(df, order: list) -> dict:
    """total, items: the first rows by order."""
    return {"total": df.count(), "items": [r.asDict(True) for r in df.orderBy(*order).limit(LISTED).collect()]}


def list_cases(w: Workspace) -> list[dict]:
    return cases(w.spark, w.evidence, w.states)


def case_summary(w: Workspace, case: str) -> dict:
    """How much the state holds, and its strongest hypotheses."""
    c = w.case(case)
    counts = {n: c.read(n).count() for n in ("manifest", "events", "entities", "iocs", "claims", "contradictions")}
    top = c.read("claims").orderBy(F.desc(evidence.merge.rank(F.col("confidence"))), "claim_id").limit(3)
    return {"case": case, **counts, "top": [r.asDict(True) for r in top.select("claim_id", "title", "confidence").collect()]}


def list_pages(w: Workspace, case: str) -> list[str]:
    return sorted(r["page"] for r in w.case(case).pages().select("page").where(F.col("page").isin(*pages.NAMES)).collect())


def read_page(w: Workspace, case: str, page: str) -> str:
    name = safe_page(page).removesuffix(".md")
    got = w.case(case).pages().where(F.col("page") == name).first()
    if got is None:
        raise ValueError(f"no page {page!r}")
    return got["body"]


def ingest(w: Workspace, case: str, step: str | None = None, dry_run: bool = False) -> dict:
    c = w.case(case)
    return _listed(c.ingest(safe_page(step) if step else None, dry_run=dry_run), ["page" if dry_run else "path"])


def query(w: Workspace, case: str, question: str) -> dict:
    return w.case(case).answer(question)


def lint_case(w: Workspace, case: str) -> dict:
    found = w.case(case).lint()
    return {"summary": lint.summary(found).first().asDict(), **_listed(found, ["rule", "page", "detail"])}


def report(w: Workspace, case: str) -> dict:
    body = w.case(case).report().first()["body"]
    return {"page": "final_report", "summary": body[:SUMMARY], "length": len(body)}


def compare_all(w: Workspace, case: str, question: str) -> list[dict]:
    q = w.spark.createDataFrame([(1, question)], "qid long, question string")
    return [r.asDict(True) for r in w.case(case).methods(q).drop("qid").orderBy("method").collect()]


def hypothesis_history(w: Workspace, case: str) -> dict:
    return _listed(w.case(case).read("history"), ["claim_id", "step"])


def contradictions(w: Workspace, case: str) -> dict:
    c = w.case(case)
    against = evidence.contradicted(c.read("claims")).select("claim_id", "title", "contradicting")
    return {"contradictions": _listed(c.read("contradictions").select("title", "claim_a", "claim_b"), ["title"]), "claims": _listed(against, ["claim_id"])}


def open_questions(w: Workspace, case: str) -> dict:
    return _listed(w.case(case).open_questions(), ["text"])


def graph_query(w: Workspace, case: str, question: str) -> dict:
    return _listed(w.case(case).graph_query(question), ["neighbour", "type"])


#: Name: function, what it is for.
TOOLS: dict[str, tuple[Callable, str]] = {
    "list_cases": (list_cases, "Cases with evidence or a compiled state"), "get_case_summary": (case_summary, "Counts and strongest hypotheses of a case"),
    "list_pages": (list_pages, "Names of a case's pages"), "read_page": (read_page, "One page"), "ingest_case_sources": (ingest, "Compile new evidence, or tell what would change"),
    "query_case": (query, "Answer a question from the compiled state"), "lint_case": (lint_case, "Findings of all rules"), "generate_report": (report, "Make the report"),
    "compare_all_methods": (compare_all, "Answer a question in five ways"), "get_hypothesis_history": (hypothesis_history, "How hypotheses moved from step to step"),
    "get_contradictions": (contradictions, "Contradictions and the claims that they concern"), "get_open_questions": (open_questions, "What sources and claims leave open"),
    "graph_query": (graph_query, "Neighbours of what a question names"),
}


def call(w: Workspace, name: str, **arguments) -> dict:
    """{"ok": True, "result": ...}, or {"ok": False, "error": ...} for an unknown tool or a name that is refused."""
    if name not in TOOLS:
        return {"ok": False, "error": f"no tool {name!r}"}
    try:
        return {"ok": True, "result": TOOLS[name][0](w, **arguments)}
    except (ValueError, TypeError) as e:
        return {"ok": False, "error": str(e)}
