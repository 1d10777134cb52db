import json

import pytest
from pyspark.sql import functions as F
from test_evidence import FILES

from vespera import tools
from vespera.functions import names as N
from vespera.operators import trace


def test_replay_indexes_and_tools(spark, tmp_path):
    for name in ("step_1/sysmon.csv", "step_2/run_keys.reg"):
        (tmp_path / "c" / "case" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / "case" / name).write_text(FILES[name])
    (tmp_path / "q.json").write_text(json.dumps({"items": [{"id": "q", "category": "lookup", "question": "does it persist", "must_include": ["logon"]}]}))
    w = tools.Workspace(spark, str(tmp_path / "c"), str(tmp_path / "s"))
    case = w.case("case")
    steps = case.evolve(str(tmp_path / "q.json"))
    assert [s["step"] for s in steps] == ["step_1", "step_2"] and [s["files"] for s in steps] == [1, 1] and [s["passed"] for s in steps] == [0, 1]
    assert steps[0]["new_hypotheses"] == ["Execution chain from a script host"] and steps[1]["new_hypotheses"] == ["Autostart persistence of an unfamiliar program"]
    assert case.snapshots() == ["after_step_1", "after_step_2"] and "## step_2" in (tmp_path / "s" / "case" / "replay.md").read_text()
    assert {(r["claim_id"], r["step"]) for r in case.read("history").collect()} == {("claim_0001", "step_1"), ("claim_0001", "step_2"), ("claim_0002", "step_2")}
    ids = {r["key"]: r["event_id"] for r in case.read("event_index").collect()}
    assert sorted(ids.values()) == ["evt_0001", "evt_0002"] and case.at_snapshot("after_step_1", "event_index").first()["event_id"] == "evt_0001"
    first = {r["key"]: r["entity_id"] for r in case.at_snapshot("after_step_1", "entity_index").collect()}
    now = {r["key"]: r for r in case.read("entity_index").collect()}
    assert all(now[k]["entity_id"] == v for k, v in first.items()) and now["file:tool.exe"]["related_pages"] == ["entities", "hypotheses", "iocs"]
    assert [s["step"] for s in case.traces().first()["steps"]][:2] == ["scan", "extract"]
    # a source that is gone keeps its facts; only changed files are read
    (tmp_path / "c" / "case" / "step_1" / "sysmon.csv").unlink()
    (tmp_path / "c" / "case" / "step_2" / "notes.md").write_text("- It may be malware\n")
    assert [tuple(r) for r in case.ingest().collect()] == [("step_2/notes.md", "new")]
    assert case.read("events").count() == 3 and case.read("manifest").count() == 3 and case.read("claims").count() == 2
    # tools
    assert len(tools.TOOLS) == 13 and tools.call(w, "list_cases")["result"] == [{"case": "case", "has_evidence": True, "has_state": True}]
    assert tools.call(w, "get_case_summary", case="case")["result"]["events"] == 3
    assert "spawned" in tools.call(w, "read_page", case="case", page="timeline.md")["result"] and len(tools.call(w, "list_pages", case="case")["result"]) == 8
    for bad in ({"case": "../x", "page": "timeline"}, {"case": "case", "page": "../../etc/passwd"}, {"case": "case", "page": "nope"}):
        assert not tools.call(w, "read_page", **bad)["ok"]
    assert not tools.call(w, "no_tool")["ok"] and not tools.call(w, "query_case", case="case", wrong=1)["ok"]
    assert tools.call(w, "get_hypothesis_history", case="case")["result"]["total"] == 3 and tools.call(w, "get_open_questions", case="case")["result"]["total"] > 3
    assert tools.call(w, "graph_query", case="case", question="what of tool.exe")["result"]["total"] > 1
    assert tools.call(w, "get_contradictions", case="case")["result"]["contradictions"]["total"] == 1


def test_safe_names():
    assert N.safe_case("case_1") == "case_1" and N.safe_page("a/b.md") == "a/b.md" and N.safe_page("a\\b") == "a/b"
    for bad in ("", ".x", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            N.safe_case(bad)
    for bad in ("", "/etc", "\\x", "a/../b", ".fw/x", "a/.git", "C:/x", "a//b"):
        with pytest.raises(ValueError):
            N.safe_page(bad)


def test_traces_tell_of_errors_and_skips(spark, tmp_path):
    with pytest.raises(RuntimeError), trace.Trace(spark, str(tmp_path / "t"), "cmd") as t:
        with t.step("one"):
            pass
        with t.step("two") as note:
            note.update(status="skipped", detail="nothing to do")
        with t.step("three"):
            raise RuntimeError("broken\nmore")
    row = spark.read.schema(trace.SCHEMA).json(str(tmp_path / "t")).first()
    assert row["trace_id"].startswith("cmd_2") and [(s["step"], s["status"], s["detail"]) for s in row["steps"]] == [("one", "ok", None), ("two", "skipped", "nothing to do"), ("three", "error", "RuntimeError: broken")]
    assert trace.trace_id("a") != trace.trace_id("a")


def test_stream_keeps_a_row_a_key_over_calls(spark, tmp_path):
    from vespera.streaming import incremental

    schema = "k string, seq long, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merge = lambda: {r["k"]: (r["seq"], r["v"]) for r in incremental.merge_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "seq").collect()}
    write([("a", 5, "x"), ("b", 1, "y")])
    assert merge() == {"a": (5, "x"), "b": (1, "y")}
    write([("a", 2, "late"), ("c", 9, "z"), ("b", 4, "no")])
    assert merge() == {"a": (2, "late"), "b": (1, "y"), "c": (9, "z")} == merge()
    assert spark.range(1).select(F.lit(1)).count() == 1
