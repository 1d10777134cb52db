import pytest
from pyspark.errors import AnalysisException

from vespera.plans import evidence as P
from vespera.sources import evidence as S

FILES = {
    "step_1/sysmon.csv": 'timestamp,event_id,parent_image,image,user,command_line\n2026-01-02 03:04:05,1,C:\\W\\cmd.exe,C:\\T\\tool.exe,PC\\ann,"C:\\T\\tool.exe" --x\n',
    "step_2/network_log.csv": "timestamp,local_address,local_port,remote_address,remote_port,protocol,process,bytes_sent,bytes_received\n2026-01-02 04:00:00,10.0.0.2,50000,203.0.113.9,443,TCP,tool.exe,10,20\n",
    "step_2/run_keys.reg": 'Windows Registry Editor Version 5.00\n\n[HKCU\\Software\\Run]\n"Tool"="\\"C:\\\\T\\\\tool.exe\\" /q"\n',
    "step_3/powershell_history.txt": "whoami\n\nexit\n",
    "step_3/defender_scan.txt": "Completed : 2026-01-03 00:00:00\nThreats Found : 0\n",
    "step_3/notes.md": "- It may be malware\n  more\n- second\n",
    ".hidden/x.txt": "no",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("case")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    parsed = str(tmp_path_factory.mktemp("parsed") / "files")
    S.with_rows(S.scan(spark, str(root))).write.parquet(parsed)  # read and parsed once
    return spark.read.parquet(parsed), str(root)


def test_scan(spark, files):
    kinds = {r["path"]: r["kind"] for r in files[0].collect()}
    assert kinds["step_1/sysmon.csv"] == "sysmon_csv" and kinds["step_3/notes.md"] == "investigator_notes" and len(kinds) == 6
    assert {r["path"] for r in S.scan(spark, files[1], "step_1").collect()} == {"step_1/sysmon.csv"}
    with pytest.raises(AnalysisException):
        S.scan(spark, files[1] + "/none")


def test_events(files):
    got = [r["description"] for r in P.events(files[0]).orderBy("seq").collect()]
    assert got == [
        "cmd.exe spawned tool.exe (C:\\T\\tool.exe --x)", "tool.exe connected to 203.0.113.9:443 (TCP, sent 10 bytes)",
        "Registry value 'Tool' set under HKCU\\Software\\Run = \"C:\\T\\tool.exe\" /q", "Windows Defender full scan completed; 0 threats found.",
        "Investigator note: It may be malware", "Investigator note: second", "PowerShell command #1: whoami", "PowerShell command #3: exit",
    ]


def test_state_and_graph(files):
    s = P.compile_state(files[0])
    assert {(r["type"], r["key"], r["confidence"]) for r in s.iocs.collect()} == {("file", "tool.exe", "Medium"), ("ip", "203.0.113.9", "Low")}
    assert s.iocs.where("key = 'tool.exe'").first()["first_seen"] == "2026-01-02 03:04:05"
    assert s.contradictions.count() == 2
    nodes, edges = P.graph(P.entities(files[0]), P.events(files[0]))
    assert {(r["source"], r["target"]) for r in edges.where("type = 'spawned'").collect()} == {("process:cmd.exe", "file:tool.exe")}
    assert nodes.where("type = 'source'").count() == 3


def test_claims_answers_and_replay(spark, files, tmp_path):
    from vespera.plans import answers as A
    from vespera.plans import replay

    s = P.compile_state(files[0])
    claims = P.claims(P.iocs(files[0]), s.contradictions)
    got = {r["title"]: r for r in claims.collect()}
    assert len(got) == 3 and sorted(r["claim_id"] for r in got.values()) == ["claim_0001", "claim_0002", "claim_0003"]
    assert got["Autostart persistence of an unfamiliar program"]["supporting"] == ["step_2/run_keys.reg"]
    assert P.claim_edges(claims).where("type = 'supports'").count() == 3
    tables = {"claims": claims, "iocs": s.iocs, "contradictions": s.contradictions, "events": s.events, "entities": s.entities, "files": files[0].select("path")}
    for k, df in tables.items():  # answers read a written state
        df.write.parquet(f"{tmp_path}/{k}")
    state = A.Tables(**{k: spark.read.parquet(f"{tmp_path}/{k}") for k in tables})
    asked = spark.createDataFrame([(1, "Is this confirmed malware?"), (2, "any beacon?"), (3, "does it persist"), (4, "is it signed?")], "qid long, question string")
    out = {r["qid"]: r for r in A.answers(asked, state).collect()}
    assert out[1]["answer"].startswith("Answer:\nNo. Malware is not confirmed") and not out[1]["insufficient"]
    assert "203.0.113.9" in out[2]["answer"] and out[3]["confidence"] == "Medium" and out[4]["insufficient"]
    lexical = spark.createDataFrame([(4, "some line")], "qid long, snippet string")
    assert {r["qid"]: r["fell_back"] for r in A.with_fallback(A.answers(asked, state), lexical).collect()} == {1: False, 2: False, 3: False, 4: True}
    total = {(r["step"], r["kind"]): r["n_total"] for r in replay.growth(files[0]).collect()}
    assert total["step_1", "event"] == 1 and total["step_2", "event"] == 3 and total["step_3", "event"] == 8 and total["step_3", "hypothesis"] == 3


def test_scan_survives_bytes_and_underscores(spark, tmp_path):
    (tmp_path / "_inbox").mkdir()
    (tmp_path / "_notes.txt").write_bytes(b"caf\xe9 \xff ok")
    (tmp_path / "_inbox" / "x.txt").write_text("below")
    (tmp_path / "plain.md").write_text("ünï")
    (tmp_path / ".hidden").write_text("no")
    got = {r["path"]: r["text"] for r in S.scan(spark, str(tmp_path)).collect()}
    assert got == {"_notes.txt": "caf\ufffd \ufffd ok", "_inbox/x.txt": "below", "plain.md": "ünï"}


def test_review_queue(spark):
    from vespera.operators import review

    old = spark.createDataFrame([("a", "fine"), ("b", "confirmed malware")], "page string, body string")
    new = spark.createDataFrame([("a", "Confirmed malware!"), ("b", "confirmed malware"), ("c", "data was stolen")], "page string, body string")
    q = review.queue(old, new, spark.createDataFrame([(4,)], "num long"))
    assert [(r["review_id"], r["page"], r["prior"]) for r in q.orderBy("page").collect()] == [("rev_0001", "a", "fine"), ("rev_0002", "c", None)]  # the least free numbers
    assert {r["page"]: r["body"] for r in review.held_back(new, q).collect()} == {"a": "fine", "b": "confirmed malware"}
    d = review.decide(q, spark.createDataFrame([("rev_0001", "approved")], "review_id string, verdict string"))
    again = review.decide(d, spark.createDataFrame([("rev_0001", "rejected"), ("rev_0002", "rejected")], "review_id string, verdict string"))
    assert {r["review_id"]: r["status"] for r in again.collect()} == {"rev_0001": "approved", "rev_0002": "rejected"}
