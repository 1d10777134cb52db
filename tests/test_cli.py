from test_evidence import FILES

from vespera.api import Case, cases
from vespera.cli import run


def test_verbs(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / "case" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "case" / name).write_text(text)
    case = Case(spark, str(tmp_path / "case"), str(tmp_path / "state"))
    planned = {d["page"]: d["diff"] for d in run(case, "ingest", [], dry_run=True)[1]}
    assert "+- 2026-01-02 03:04:05 cmd.exe spawned tool.exe" in planned["timeline"] and not (tmp_path / "state" / "versions").exists()
    assert run(case, "ingest", ["step_1"])[1] == [{"path": "step_1/sysmon.csv", "state": "new"}]
    assert run(case, "snapshot", ["one"]) == (0, [])
    code, found = run(case, "lint", [])
    assert code == 1 and sum(f["rule"] == "H2" for f in found) == 5
    assert len(run(case, "ingest", [])[1]) == 5 and run(case, "ingest", [])[1] == []
    run(case, "snapshot", ["two"])
    code, found = run(case, "lint", [])
    assert code == 0 and all(f["rule"] not in ("H1", "H2", "C1") for f in found)
    assert {d["page"] for d in run(case, "diff-snapshots", ["one", "two"])[1]} >= {"timeline", "iocs"}
    got = {m["method"]: m["answer"] for m in run(case, "compare-all", ["is tool.exe a beacon in the network?"])[1]}
    assert "network event(s)" in got["state"] and "cmd.exe" in got["graph"] and "tool.exe" in got["raw"] and len(got) == 5
    assert any(n["neighbour"] == "process:cmd.exe" for n in run(case, "graph-query", ["tool.exe"])[1])
    assert run(case, "query", ["was whoami signed?"])[1][0]["fell_back"]
    assert [p["page"] for p in run(case, "report", [])[1]] == ["final_report"] and len(run(case, "pages", [])[1]) == 8 and run(case, "graph-export", [])[1] and run(case, "graph-build", [])[1]


def test_questions_report_review_and_export(spark, tmp_path):
    import json

    for name, text in FILES.items():
        (tmp_path / "c" / "case" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / "case" / name).write_text(text)
    case = Case(spark, str(tmp_path / "c" / "case"), str(tmp_path / "s" / "case"))
    run(case, "ingest", [])
    assert cases(spark, str(tmp_path / "c"), str(tmp_path / "s")) == [{"case": "case", "has_evidence": True, "has_state": True}]
    items = [
        {"id": "q1", "category": "contradiction_detection", "question": "Is this confirmed malware?", "must_include": ["not confirmed"], "must_not_include": ["definitely"], "required_sources": ["x/defender_scan.txt"], "expect_refusal": True, "expect_separation": True, "expected_best_method": "best"},
        {"id": "q2", "category": "relationship_retrieval", "question": "Which source mentions tool.exe?", "must_include": ["sysmon.csv"], "expected_best_method": "graph"},
        {"id": "q3", "category": "final_report_accuracy", "question": "what next step should we look at", "must_include": ["baseline"]},
    ]
    for name, whole in (("bare.json", items), ("wrapped.json", {"items": items})):
        (tmp_path / name).write_text(json.dumps(whole))
    code, got = run(case, "eval", [str(tmp_path / "wrapped.json")])
    assert code == 0 and [r["passed"] for r in got] == [True] * 3
    score = {r["method"]: r for r in run(case, "benchmark-methods", [str(tmp_path / "bare.json"), "best=state"])[1]}
    assert sorted(score) == ["graph", "hybrid", "raw", "state", "vector"]
    assert score["state"]["passed"] == 3 and score["state"]["expected_best_wins"] == 1 and score["state"]["refusal_accuracy"] == 1.0
    assert score["graph"]["contradiction_misses"] == 1 and score["graph"]["relationship_coverage"] == 1.0 and score["raw"]["total"] == 3
    run(case, "report", [])
    out = run(case, "export-pages", [str(tmp_path / "notes")])[1]
    assert "graph.md" in out and len(out) == 10 and "(from claim_0001)" in (tmp_path / "notes" / "final_report.md").read_text()
    (tmp_path / "c" / "case" / "step_3" / "powershell_console.txt").write_text("echo data was stolen\n")
    run(case, "ingest", [], hold=True)
    (waiting,) = run(case, "review", ["list", "pending"])[1]
    assert (tmp_path / "s" / "case" / "scorecards" / "bare.md").read_text().startswith("| measure | graph | hybrid | raw | state | vector |")
    assert waiting["page"] == "timeline" and waiting["phrases"] == ["data was stolen"]
    assert "data was stolen" not in case.pages().where("page = 'timeline'").first()["body"]
    assert run(case, "review", ["approve", waiting["review_id"]])[0] == 0 and run(case, "review", ["reject", waiting["review_id"]])[0] == 1
    assert "data was stolen" in case.pages().where("page = 'timeline'").first()["body"]
    assert run(case, "lint", [])[0] in (0, 1) and case.log("ingest", "step string").count() == 2
