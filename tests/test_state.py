"""Versions, keyed tables and answers: writers at once, buckets that stay, counts beyond lists."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from test_evidence import FILES

from vespera.api import Case
from vespera.operators import merge
from vespera.plans import answers as A
from vespera.plans import evidence as P
from vespera.sources import storage


def test_writers_at_once_lose_nothing(spark, tmp_path):
    v = storage.Versions(spark, str(tmp_path))
    first = v.commit({"a": ["1"]})
    other = storage.Versions(spark, str(tmp_path))
    # both have seen version 1; the second to commit puts its tables upon the first one's
    assert v.commit({"b": ["2"]}, first) == 2 and other.commit({"c": ["3"]}, first) == 3
    assert v.tables() == {"a": ["1"], "b": ["2"], "c": ["3"]}
    with pytest.raises(storage.Conflict):
        other.commit({"b": ["4"]}, first)
    assert v.last() == 3 and v.commit({}, 3, {"c": ["5"]}) == 4 and v.tables()["c"] == ["3", "5"]
    threads = [threading.Thread(target=lambda i=i: storage.Versions(spark, str(tmp_path)).commit({f"t{i}": [str(i)]}, added={"log": [str(i)]})) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert v.last() == 12 and sorted(v.tables()["log"]) == [str(i) for i in range(8)] and all(v.tables()[f"t{i}"] == [str(i)] for i in range(8))
    assert not storage.put_new(spark, f"{tmp_path}/versions/00000001.json", "x") and v.tables(1) == {"a": ["1"]}
    assert not [n for n in storage.names(spark, f"{tmp_path}/versions", False) if n.endswith(".tmp")]


def test_an_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    rng, v = random.Random(1), storage.Versions(spark, str(tmp_path))
    _, key, facts, merge_, back = P.KEYED["entities"]
    rows = [(f"{b:02d}{i:04d}", rng.choice(["file", "ip"]), rng.choice(["A", "a"]) + str(rng.randint(0, 300)), f"s{rng.randint(0, 9)}") for b in range(3) for i in range(400)]
    df = lambda some: spark.createDataFrame(some, "seq string, type string, value string, source string")
    for b in range(3):
        v.commit(v.upsert("entities", facts(df([r for r in rows if r[0].startswith(f"{b:02d}")])), key, merge_, back))
    got = spark.read.parquet(*v.folders("entities"))
    want = merge.merge_entities(df(rows))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    before = v.tables()
    v.commit(v.upsert("entities", facts(df([("99", "ip", "new", "s")])), key, merge_, back))
    assert sum(before.get(k) != f for k, f in v.tables().items()) == 1
    assert v.upsert("entities", facts(df([])), key, merge_, back) == {}


def test_an_ingest_while_another_commits_is_done_again(spark, tmp_path):
    for name in ("step_1/sysmon.csv", "step_2/run_keys.reg"):
        (tmp_path / "case" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "case" / name).write_text(FILES[name])
    a, b = (Case(spark, str(tmp_path / "case"), str(tmp_path / "state"), traced=False) for _ in range(2))
    commit = a.versions.commit

    def late(*args):
        a.versions.commit = commit
        b.ingest("step_2")
        return commit(*args)

    a.versions.commit = late
    assert [r["path"] for r in a.ingest("step_1").collect()] == ["step_1/sysmon.csv"]
    assert {r["path"] for r in a.read("manifest").collect()} == {"step_1/sysmon.csv", "step_2/run_keys.reg"}
    assert {r["path"] for r in a.read("events").collect()} == {"step_1/sysmon.csv", "step_2/run_keys.reg"} and a.read("claims").count() == 2
    n = a.export_timeline(str(tmp_path / "told"), size=1)
    assert n == a.read("events").count() and len((tmp_path / "told").glob("part-*.md").__iter__().__next__().read_text().splitlines()) == 1
    assert sorted(p.name for p in (tmp_path / "told").glob("part-*.md")) == [f"part-{i:08d}.md" for i in range(n)]
    assert [r["text"] for r in a.open_questions().orderBy("text").collect()] == [r["text"] for r in P.open_questions(a.read("manifest"), a.read("claims")).orderBy("text").collect()]
    # the log tells when an ingest began, and pages are stamped after that: none is stale, however long the writing took
    assert a.log("ingest", "step string").count() == 2 and a.stale_pages().count() == 0
    began = a.log("ingest", "step string").agg(F.max("at")).first()[0]
    assert all(r[0] for r in a.read("pages").select(F.to_timestamp("at") >= F.date_trunc("second", F.lit(began))).collect())


def test_one_odd_csv_does_not_stop_an_ingest(spark, tmp_path):
    (tmp_path / "case").mkdir()
    head = "timestamp,event_id,parent_image,image,user,command_line"
    (tmp_path / "case" / "sysmon.csv").write_text(f"{head}\n2026-01-02 03:04:05,1,a.exe,b.exe,u,{'x' * 140_000}\n", newline="")
    (tmp_path / "case" / "old_sysmon.csv").write_text(f"{head}\r2026-01-02 03:04:05,1,c.exe,d.exe,u,go\r2026-01-02 03:04:05,1,e.exe,f.exe,u\rx,1\r", newline="")
    case = Case(spark, str(tmp_path / "case"), str(tmp_path / "state"), traced=False)
    assert case.ingest().count() == 2
    got = {r["description"][:20] for r in case.read("events").collect()}
    assert "c.exe spawned d.exe " in got and "a.exe spawned b.exe " in got


def test_answers_count_what_they_do_not_list(spark, tmp_path):
    claims = spark.createDataFrame([(f"claim_{n}", f"Persistence {n}", c, "i", ["f (Source: a)"], ["a"], ["b"]) for n, c in (("0001", "Low"), ("10000", "High"), ("9999", "High"), ("0002", "Medium"))], "claim_id string, title string, confidence string, inference string, facts array<string>, supporting array<string>, contradicting array<string>")
    con = spark.range(300).select(F.format_string("t%04d", "id").alias("title"), F.lit("a").alias("claim_a"), F.format_string("no (Source: %04d)", "id").alias("claim_b"))
    none = lambda s: spark.createDataFrame([], s)
    state = A.Tables(claims, none("artifact string, type string, confidence string, reason string, seq string"), con, none("ts string, description string, path string, seq string"), none("value string, seq string, type string, key string, sources array<string>"), none("path string"))
    asked = spark.createDataFrame([(1, "which evidence contradicts the claim"), (2, "is this confirmed malware?")], "qid long, question string")
    got = {r["qid"]: r for r in A.answers(asked, state).collect()}
    assert got[1]["body"] == "300 contradiction(s) are on record."
    assert len(got[2]["caveats"]) == 201 and got[2]["caveats"][-1] == "and 100 more"
    assert got[2]["evidence"] == ["Hypothesis: Persistence 9999 (High)", "Hypothesis: Persistence 10000 (High)"]
