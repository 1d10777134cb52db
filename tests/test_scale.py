"""Results that must not depend on how rows are dealt, and plans whose work must not outgrow their input."""

from pyspark.sql import functions as F

from vespera.catalog import MARKERS, PHRASES, QUERIES
from vespera.operators import merge


def test_numbers_are_whole_whatever_is_read_of_the_rows(spark):
    rows = spark.range(0, 60_000, 1, 8).select((F.col("id") * 7919 % 60_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    for k, v in small.items():
        spark.conf.set(k, v)  # rows with texts and rows without them are merged into different partitions
    try:
        got = merge.numbered(rows, ["k"])
        assert got.where("n = k + 1 and length(text) = 128").count() == 60_000
    finally:
        for k in small:
            spark.conf.unset(k)


def test_newly_risky_takes_the_word_away_in_any_case(spark, tmp_path):
    assert "token" in PHRASES and "public" in MARKERS
    rows = [(1, "A Token here"), (2, "a token"), (3, "TOKEN\nidtokeniot"), (4, "nothing"), (5, "a public token"), (6, "pubtokenlic idiot")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["newly_risky"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, "token"), (2, "token"), (3, "token"), (6, "token")]


def test_csv_texts_of_tables_give_the_rows_that_python_reads(spark):
    from vespera.sources import csvs
    from vespera.sources import evidence as S

    texts = [
        "a,b,c\n1,2,3\r\n\r\n4,5\r6,7,8,9\n", "a,,b\n1,2,3", " a , b \n\xa0x , y\t\n ,\n", "a,a\n1,2\n", "\na,b\n1,2\n", "a, a\n1,2", "a,b\n\"x,\ny\",2\nz\"q,1\n", "a,b", "", "a,b\n\n\n", ",\n1,2\n", "é,日本\n\U0001f600,ü\x85\n",
        "a,b\n1,2\x0b3\n\x0c, 4\n", "a\n" + "\n".join(map(str, range(10_000))) + "\n",
    ]
    files = spark.createDataFrame([(f"{i}.csv", "generic_csv", f"{i}", t) for i, t in enumerate(texts)] + [("n.csv", "generic_csv", "n", None)], "path string, kind string, seq string, text string")
    got = sorted((r["path"], r["row_no"], sorted(r["row"].items())) for r in S.csv_rows(files).collect())
    assert got == sorted((f"{i}.csv", k, sorted(dict(r).items())) for i, t in enumerate(texts) for k, r in enumerate(csvs.records(t)[1]))
    stored = sorted((r["path"], r["row_no"], sorted(r["row"].items())) for r in S.csv_rows(S.with_rows(files)).collect())
    assert stored == got


def test_composed_files_are_read_without_python(spark):
    from vespera.plans import evidence as P
    from vespera.sources import evidence as S

    files = spark.createDataFrame([("a_sysmon.csv", "sysmon_csv", "a", "image\nx.exe\n")], "path string, kind string, seq string, text string")
    assert "Python" not in S._split_plain(files.where(S._plain()), ["path"])._jdf.queryExecution().toString()
    assert [tuple(r)[1:] for r in P.entities(files).collect()] == [("process", "x.exe", "a_sysmon.csv")]


def test_few_and_many_labels_match_alike(spark, monkeypatch):
    from vespera.operators import graph

    texts = [(1, "The Token\nof \U0001f600x"), (2, "lily"), (3, ""), (4, None), (5, "y" * 9000 + "token" + "\U0001f600x")]
    questions = spark.createDataFrame(texts, "qid long, question string")
    labels = spark.createDataFrame([("token", 1), ("TOKEN", 2), ("li", 3), ("y", 4), ("", 5), ("\U0001f600x", 6), ("n\no", 7), ("e\nof \U0001f600", 8), ("token", 1)], "label string, k int")
    want = sorted({(q, l, k) for q, t in texts for l, k in labels.collect() if l and t and l.lower() in t.lower()})
    for few in (256, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert sorted(map(tuple, graph.matches(questions, labels).collect())) == want


def test_what_is_told_of_a_node_is_made_once(spark, monkeypatch):
    from vespera.plans import methods

    seen = []
    around = methods._around
    monkeypatch.setattr(methods, "_around", lambda named, *rest: seen.append(named) or around(named, *rest))
    nodes = spark.createDataFrame([("n1", "host", "Alpha", "1"), ("n2", "file", "Beta", "2"), ("n3", "file", "alpha", "3")], "id string, type string, label string, seq string")
    edges = spark.createDataFrame([("n1", "n2", "sells_to", "x.txt")], "source string, target string, type string, evidence string")
    asked = spark.createDataFrame([(i, "of alpha") for i in range(50)], "qid long, question string")
    got = methods.surroundings(nodes, edges, asked).collect()
    assert len(got) == 50 and {r["block"] for r in got} == {"- Alpha (host): 1 relationship(s):\n    - sells to Beta (Source: x.txt)"}
    assert {r["block"] for r in methods.relations(nodes, edges, asked).collect()} == {"- Alpha sells to Beta (Source: x.txt)"}
    assert [x.count() for x in seen] == [2, 1]


def test_hash_vectors_are_handed_over_in_parts(spark, monkeypatch):
    import pyarrow as pa

    from vespera.operators import retrieval

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    texts = [f"word{i} and more" if i % 3 else "" for i in range(1000)]
    got = list(retrieval.hash_vectors(docs)([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])]))
    assert max(b.num_rows for b in got) <= retrieval.VECTORS
    assert [i for b in got for i in b.column(0).to_pylist()] == [i for i in range(1000) if i % 3]


def test_related_nodes_are_those_of_brute_force_by_every_way(spark, monkeypatch):
    from itertools import combinations

    from vespera.operators import graph

    rows = sorted({(f"n{i * i % 47}é", f"s{i % 29}") for i in range(400)} | {(f"one{i}", f"s{i % 7}") for i in range(20)} | {(f"n{i}é", f"s{j}") for i in range(12) for j in range(29) if (i + j) % 3})
    want = {}
    for s in {s for _, s in rows}:
        for a, b in combinations(sorted(n for n, x in rows if x == s), 2):
            want.setdefault((a, b), []).append(s)
    want = sorted((a, b, min(s), len(s)) for (a, b), s in want.items())
    mentions = spark.createDataFrame(rows + rows[:30], "node string, source string")
    used, counted = [], graph._counted
    monkeypatch.setattr(graph, "_counted", lambda *a: used.append(a[1:]) or counted(*a))
    for common, cells, size, block in ((8, 1024, 500_000, 2048), (3, 5, 40, 6), (10**6, 5, 40, 6)):
        for k, v in {"COMMON": common, "CELLS": cells, "ROWS": size, "BLOCK": block}.items():
            monkeypatch.setattr(graph, k, v)
        assert sorted(map(tuple, graph.related(mentions).select("a", "b", "evidence", "n_shared").collect())) == want
    assert len(used) == 2


def test_unmentioned_keys_are_looked_for_in_distinct_words(spark, monkeypatch):
    from vespera.operators import graph, lint

    texts = ["The tool-a runs\nfast  here", "the tool-b\truns", None, "", "x\ry Big\u00a0thing", "\U0001f600z one two"] * 9
    pages = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "page string, body string")
    keys = ["TOOL", "l-a r", "fast  h", "fast h", "b\tr", "x\ry", "runs\nfast", " ", "   ", "g\u00a0t", "\U0001f600", "one two", "two one", "o t", "e t", "", None, "absent", "e"]
    values = spark.createDataFrame([(k,) for k in keys], "value string")
    lines = {x.lower() for t in texts if t is not None for x in t.split("\n")}
    want = sorted(k for k in keys if k and not any(k.lower() in x for x in lines))
    seen, matches = [], graph.matches
    monkeypatch.setattr(graph, "matches", lambda q, x: seen.append(q) or matches(q, x))
    for few in (256, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert sorted(r["value"] for r in lint.unmentioned(values, pages, "value").collect()) == want
    assert sorted(r["question"] for r in seen[0].collect()) == sorted({w for x in lines for w in x.replace("\t", " ").replace("\r", " ").split(" ")})


def test_filters_on_facts_of_csv_rows_make_a_row_once(spark):
    from vespera.plans import evidence as P

    files = spark.createDataFrame([("a_sysmon.csv", "sysmon_csv", "a", "event_id,parent_image,image\n1,C:\\cmd.exe,x.exe\n3,cmd.exe,y.exe\n")], "path string, kind string, seq string, text string")
    told = P.events(files).where("relation is not null").select("actor", "targets")
    assert told._jdf.queryExecution().optimizedPlan().toString().count("map_from_arrays") == 1
    assert [tuple(r) for r in told.collect()] == [("cmd.exe", ["x.exe"])]


def test_pairs_of_common_nodes_are_counted_and_not_joined(spark, monkeypatch):
    from vespera.operators import graph

    met = graph._met
    seen = []
    monkeypatch.setattr(graph, "_met", lambda m, which: seen.append(met(m, which)) or seen[-1])
    rows = [(f"n{i}", f"s{j:03d}") for i in range(60) for j in range(120) if (i * 7 + j) % 5] + [("rare", "s003"), ("rare", "s004"), ("once", "s110")]
    got = {(r["a"], r["b"]): (r["evidence"], r["n_shared"]) for r in graph.related(spark.createDataFrame(rows, "node string, source string")).collect()}
    by = {}
    for n, s in rows:
        by.setdefault(n, set()).add(s)
    assert got == {(a, b): (min(by[a] & by[b]), len(by[a] & by[b])) for a in by for b in by if a < b and by[a] & by[b]}
    assert len(got) > 1770 and sorted(x.where("least(x, y) like 'n%' and greatest(x, y) like 'n%'").count() for x in seen) == [0, 0]
