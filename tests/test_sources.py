"""Listing, reading and CSV records, against the standard library and files of odd shapes."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.sources import csvs, files
from vespera.sources import evidence as S


def test_records_of_odd_texts():
    long = "x" * 140_000
    assert csvs.records(f"a,b\n1,{long}\n")[1] == [[("a", "1"), ("b", long)]]
    assert csvs.records("a,b\r1,2\r3,4")[1] == [[("a", "1"), ("b", "2")], [("a", "3"), ("b", "4")]]
    assert csvs.records("a,b\n1,2\r3,4\r\n5,6\n")[1] == [[("a", "1"), ("b", "2")], [("a", "3"), ("b", "4")], [("a", "5"), ("b", "6")]]
    assert csvs.records('a,b, ,\n"x"y,"p\rq""r",drop,drop,more\n\n1\n')[1] == [[("a", "xy"), ("b", 'p\rq"r')], [("a", "1"), ("b", "")]]
    assert csvs.records("")[1] == [] and csvs.records("a,b\n")[1] == []


def odd_csv(rng, n=60):
    bits = ["a", "b c", ",", ",", "\n", "\r\n", "\r", '"', '"', '""', '"x,\ny"', "é", ",\"", "\",", "日本"]
    return "h1,h2,h3\n" + "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_ranges_know_their_state_and_records():
    rng = random.Random(1)
    for _ in range(3000):
        data = odd_csv(rng).encode()
        f, size = Bytes(data), rng.randint(1, 40)
        edges = [csvs._edge(f, len(data), k * size) for k in range(-(-len(data) // size) + 1)]
        state, first, got = False, csvs._first_record(f, len(data)), []
        header = csvs.records(first.decode())[0]
        for lo, hi in zip(edges, edges[1:]):
            closed, open_ = csvs.effect(np.frombuffer(data[lo:hi], np.uint8), data[lo - 1] if lo else None)
            after = open_ if state else closed
            a, z = max(len(first), csvs._record_start(f, len(data), lo, state)), csvs._record_start(f, len(data), hi, after)
            got += csvs.records(data[a:z].decode(), header)[1] if z > a else []
            state = after
        assert got == csvs.records(data.decode())[1]


def test_split_rows_of_files(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"d/{i}_netflow.csv": odd_csv(rng, 400) for i in range(12)} | {"empty.csv": "", "head.csv": "a,b\n", "long.csv": "a,b\n1," + "y" * 200_000 + "\n2,3"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    whole = S.csv_rows(S.scan(spark, str(tmp_path)))
    parts = S.csv_rows(S.scan(spark, str(tmp_path), split=0))
    rows = lambda df: sorted((r["path"], r["row_no"], sorted(r["row"].items())) for r in df.collect())
    assert rows(parts) == rows(whole) == sorted((n, i, sorted(dict(r).items())) for n, t in texts.items() for i, r in enumerate(csvs.records(t)[1]))
    found = files.listing(spark, str(tmp_path)).withColumn("kind", F.lit("k")).withColumn("seq", F.lit("s"))
    assert rows(csvs.split_rows(found, str(tmp_path), size=4999)) == rows(whole)


def test_plain_files_equal_the_standard_reader():
    rng = random.Random(3)
    for _ in range(300):
        out = io.StringIO(newline="")
        w = csv.writer(out)
        want = [[rng.choice(["", "a", 'q"q', "x,y", "l\nm", "l\r\nm", " s "]) for _ in range(3)] for _ in range(rng.randint(1, 20))]
        w.writerows([["a", "b", "c"], *want])
        assert csvs.records(out.getvalue())[1] == [list(zip("abc", map(str.strip, r))) for r in want]


@pytest.mark.parametrize("entries", [1, 7, 2000])
def test_listing_in_rounds(spark, tmp_path, monkeypatch, entries):
    monkeypatch.setattr(files, "ENTRIES", entries)
    names = {f"{a}/{b}/{c}.txt" for a in ("_x", "b c", "d") for b in ("e", "_f", "é") for c in range(4)} | {"top.md", "_under", "deep/1/2/3/4/5/z"}
    for n in [*names, ".hid/x", "d/.h", "d/e/.k/y"]:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    got = files.listing(spark, f"file://{tmp_path}").collect()
    assert sorted(r["path"] for r in got) == sorted(names) and all(r["length"] == len(r["path"].encode()) for r in got)
    assert {r["path"]: r["text"] for r in S.scan(spark, str(tmp_path)).collect()} == {n: n for n in names}
    assert files.listing(spark, f"{tmp_path}/none").count() == 0


def test_underscored_files_have_no_limit_and_nothing_is_kept_by_the_driver(spark, tmp_path):
    (tmp_path / "_large.txt").write_bytes(b"0123456789" * 2_000_000)
    assert S.scan(spark, str(tmp_path)).selectExpr("length(text) as n").first()["n"] == 20_000_000


def test_ranges_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    texts = {f"{i}.csv": "a,b\n" + "".join(f'{i},"x\n{j}"\n' for j in range(3000)) for i in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    found = files.listing(spark, str(tmp_path)).withColumn("kind", F.lit("k")).withColumn("seq", F.lit("s"))
    for sent in (200_000, 0):
        monkeypatch.setattr(csvs, "SENT", sent)
        got = csvs.split_rows(found, str(tmp_path), size=700)
        assert sorted((r["path"], r["row_no"], r["row"]["a"], r["row"]["b"]) for r in got.collect()) == sorted((f"{i}.csv", j, str(i), f"x\n{j}") for i in range(3) for j in range(3000))
        assert len([x for x in got.inputFiles() if x.endswith(".parquet")]) <= spark.sparkContext.defaultParallelism  # a file a task


def test_entities_of_large_files_are_found_in_their_texts(spark, tmp_path):
    from vespera.plans import evidence as P

    text = "timestamp,remote_address,note,process\n" + "".join(f"t,198.51.{i % 250}.7,see 203.0.{i % 200}.9 host{i}.example.org CORP\\u{i} tool{i}.exe é,agent{i % 3}.exe\n" for i in range(400))
    (tmp_path / "big_netflow.csv").write_text(text + '"agent1.exe, x",,over the header,a,b,192.0.2.77')
    (tmp_path / "small.txt").write_text("10.9.8.7")
    found = lambda split: sorted({(r["type"], r["value"], r["source"]) for r in P.entities(S.scan(spark, str(tmp_path), split=split)).collect()})
    want = found(1 << 26)
    assert ("domain", "host7.example.org", "big_netflow.csv") in want and ("ip", "192.0.2.77", "big_netflow.csv") in want and len(want) > 1400
    assert found(0) == want
    listed = spark.createDataFrame([("big_netflow.csv", "s", str(tmp_path / "big_netflow.csv"), (tmp_path / "big_netflow.csv").stat().st_size)], "path string, seq string, at string, length long")
    pieces = csvs.split_text(listed, str(tmp_path), size=997).collect()
    whole = (tmp_path / "big_netflow.csv").read_bytes()
    assert len(pieces) > 20 and sum(len(r["content"]) for r in pieces) == len(whole) and all(bytes(r["content"])[-1:] in b"\n\r, " or whole.endswith(bytes(r["content"])) for r in pieces)


def test_case_entities_are_those_of_all_files(spark):
    from vespera.catalog import QUERIES

    got = {(r["type"], r["key"]): r["first_source"] for r in QUERIES["case_entities"](spark, "/root/testdata/sf0.001").collect()}
    assert got["file", "cust1.exe"].endswith("_keys.reg") and ("user", "hkcu\\software") in got
    assert any(k == "registry_key" for k, _ in got) and any(s.startswith("docs/") for s in got.values())
