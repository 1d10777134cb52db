"""python -m vespera.cli CASE_DIR STATE_DIR VERB [ARGUMENT ...]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.api import Case
from vespera.operators import graph
from vespera.plans import evidence


def run(case: Case, verb: str, args: list[str], dry_run: bool = False, hold: bool = False, force: bool = False) -> tuple[int, list]:
    """Exit code and printable rows of one verb."""
    rows = lambda df: [r.asDict(True) for r in df.toLocalIterator()]
    text = " ".join(args)
    asked = lambda: case.spark.createDataFrame([(1, text)], "qid long, question string")
    five = lambda *only: rows(case.methods(asked()).where(F.col("method").isin(*only) if only else F.lit(True)).drop("qid").orderBy("method"))
    if verb == "ingest":
        return 0, rows(case.ingest(args[0] if args else None, dry_run, hold, force))
    if verb == "lint":
        found = rows(case.lint())
        return int(any(f["severity"] in ("Critical", "High") for f in found)), found
    if verb == "snapshot":
        case.snapshot(args[0])
        return 0, []
    if verb == "eval":
        got = rows(case.evaluate(args[0]))
        return int(not all(r["passed"] for r in got)), got
    if verb == "review" and args and args[0] in ("approve", "reject"):
        done = case.decide(args[1], {"approve": "approved", "reject": "rejected"}[args[0]])
        return int(not done), []
    tables = {
        "compare": lambda: five("raw", "state"), "compare-all": five, "benchmark": lambda: case.scorecard(args[0], ["raw", "state"]),
        "benchmark-methods": lambda: case.scorecard(args[0], None, dict(x.split("=", 1) for x in args[1:])), "export-pages": lambda: case.export_pages(args[0]), "export-timeline": lambda: [case.export_timeline(args[0])], "review": lambda: case.reviews(*args[1:2]),
        "pages": lambda: case.pages().orderBy("page"), "snapshots": case.snapshots, "open-questions": lambda: case.open_questions().orderBy("text"), "contradicted": lambda: evidence.contradicted(case.read("claims")).orderBy("claim_id"),
        "rag-query": lambda: case.rag(text), "vector-query": lambda: case.vector(text), "graph-query": lambda: case.graph_query(text), "graph-build": lambda: graph.summary(case.read("nodes"), case.read("edges")).orderBy(F.desc("section"), "line"),
        "graph-export": lambda: case.export_graph().orderBy("n"), "evolve": lambda: case.evolve(*args[:1]), "diff-snapshots": lambda: case.diff(*args), "report": lambda: case.report(hold), "query": lambda: [case.query(text)],
        "traces": case.traces, "history": lambda: case.read("history").orderBy("claim_id", "step"),
    }
    got = tables[verb]()
    return 0, rows(got) if isinstance(got, DataFrame) else got


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="vespera", description=__doc__)
    p.add_argument("case")
    p.add_argument("state")
    p.add_argument("verb")
    p.add_argument("args", nargs="*")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--review", action="store_true", help="hold risky pages for review")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("vespera").getOrCreate()
    code, out = run(Case(spark, a.case, a.state), a.verb, a.args, a.dry_run, a.review, a.force)
    for x in out:
        print(json.dumps(x, ensure_ascii=False, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
