from pyspark.sql import functions as F

from vespera.functions import text as X
from vespera.operators import evaluate, graph, lint, merge, retrieval


def test_chunks_reach_the_end(spark):
    for n in (0, 1, 7, 8, 9, 14, 15, 20, 21, 40):
        text = "\n".join(f"l{i}" for i in range(n))
        got = retrieval.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_no").collect()
        starts, at = [], 0
        while n and (not starts or starts[-1] + 8 < n):
            starts.append(at)
            at += 6
        assert [r["chunk"].split("\n")[0] for r in got] == [f"l{s}" for s in starts]
        assert not n or got[-1]["chunk"].endswith(f"l{n - 1}")


def test_numbers_are_consecutive_over_partitions(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k"))
    got = merge.numbered(rows, ["k"]).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


def test_ids_do_not_change_and_grow_past_four_digits(spark):
    prior = spark.createDataFrame([("a", 9999)], "key string, num long")
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", 1), ("b", 9)], "key string, seq long")
    assert {r["key"]: r["id"] for r in merge.stable_ids(prior, rows, "evt").collect()} == {"a": "evt_9999", "c": "evt_10000", "b": "evt_10001"}


def test_routes(spark):
    asked = ["overall assessment", "What contradicts the claim?", "is this malware", "data theft?", "is it signed", "which file mentions x", "run key", "beacon", "what next", ""]
    want = ["compromise", "contradiction", "malware", "exfiltration", "signature", "sources", "persistence", "network", "next_steps", "generic"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").select("i", X.route(F.col("q")).alias("r"))
    assert [r["r"] for r in df.orderBy("i").collect()] == want


def test_related_and_longest_match(spark):
    m = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("a", "s2"), ("b", "s2"), ("c", "s2"), ("c", "s2")], "node string, source string")
    got = {(r["a"], r["b"]): (r["evidence"], r["n_shared"]) for r in graph.related(m).collect()}
    assert got == {("a", "b"): ("s1", 2), ("a", "c"): ("s2", 1), ("b", "c"): ("s2", 1)}
    q = spark.createDataFrame([(1, "is new york big"), (2, "nothing")], "qid int, question string")
    labels = spark.createDataFrame([("York", 1), ("New York", 2)], "label string, seq int")
    assert [(r["qid"], r["label"]) for r in graph.longest_match(q, labels).collect()] == [(1, "New York")]


def test_labels_match_by_containment_however_long(spark):
    path = "C:\\Users\\j.doe\\AppData\\Local\\Temp\\Quarterly Report\\viewer.exe"
    q = spark.createDataFrame([(1, f"which file mentions {path}?"), (2, f"which file mentions {path}2?"), (3, "C:\\Users\\j.doe\\AppData\\Local\\Temp\\Quarterly")], "qid int, question string")
    labels = spark.createDataFrame([("viewer.exe", 1), (path, 2), ("AppData", 3)], "label string, seq int")
    assert {r["qid"]: r["label"] for r in graph.longest_match(q, labels).collect()} == {1: path, 2: path, 3: "AppData"}
    assert {(r["qid"], r["label"]) for r in graph.matches(q, labels).collect()} == {(i, x) for i in (1, 2) for x in (path, "viewer.exe", "AppData")} | {(3, "AppData")}
    parts = spark.createDataFrame([("tool", 2), ("rest", 1), ("", 0), ("x", 3), ("TOOL", 1)], "label string, seq int")
    asked = spark.createDataFrame([(1, "restTOOLx"), (2, ""), (3, "x"), (4, None)], "qid int, question string")
    assert {(r["qid"], r["label"]) for r in graph.matches(asked, parts).collect()} == {(1, "tool"), (1, "rest"), (1, "x"), (1, "TOOL"), (3, "x")}
    assert {r["qid"]: r["label"] for r in graph.longest_match(asked, parts).collect()} == {1: "TOOL", 3: "x"}  # the first of equals, by seq and label


def test_matches_in_segments_and_blocks_of_labels(spark, monkeypatch):
    import random

    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcAB .") for _ in range(rng.randint(0, 300)))) for i in range(40)]
    labels = [("".join(rng.choice("abc .") for _ in range(rng.randint(0, 6))),) for _ in range(60)] + [(texts[3][1][5:90],)]
    q, x = spark.createDataFrame(texts, "qid int, question string"), spark.createDataFrame(labels, "label string").distinct()
    want = {(i, v) for i, t in texts for (v,) in labels if v and v.lower() in t.lower()}
    assert {tuple(r) for r in graph.matches(q, x).collect()} == want
    monkeypatch.setattr(graph, "SEGMENT", 16)
    monkeypatch.setattr(graph, "LABELS", 9)
    got = [tuple(r) for r in graph.matches(q, x).collect()]
    assert set(got) == want and len(got) == len(want)
    assert graph.matches(q, x.limit(0)).count() == 0 and graph.matches(q.limit(0), x).count() == 0


def test_large_sources_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    m = spark.createDataFrame([(f"n{i}", "hot") for i in range(40)] + [(f"n{i}", "b") for i in range(5)], "node string, source string")
    got = {(r["a"], r["b"]): (r["evidence"], r["n_shared"]) for r in graph.related(m).collect()}
    names = sorted(f"n{i}" for i in range(40))
    few = {f"n{i}" for i in range(5)}
    assert got == {(a, b): ("b", 2) if {a, b} <= few else ("hot", 1) for k, a in enumerate(names) for b in names[k + 1 :]}


def test_hybrid_block_names_every_node(spark):
    from vespera.plans import methods

    nodes = spark.createDataFrame([("f:a", "file", "a.exe", "1"), ("i:1", "ip", "203.0.113.9", "2"), *[(f"s{i}", "source", f"log{i}.txt", "3") for i in range(7)]], "id string, type string, label string, seq string")
    edges = spark.createDataFrame([*[("f:a", f"s{i}", "mentioned_in", f"log{i}.txt") for i in range(7)], ("f:a", "i:1", "connected_to", "net.csv")], "source string, target string, type string, evidence string")
    q = spark.createDataFrame([(1, "did a.exe reach it?\nAnswer: 203.0.113.9 was reached"), (2, "nothing")], "qid int, question string")
    got = {r["qid"]: r["block"] for r in methods.surroundings(nodes, edges, q).collect()}
    assert list(got) == [1] and got[1].startswith("- 203.0.113.9 (ip): 1 relationship(s):\n    - connected to a.exe (Source: net.csv)\n- a.exe (file): 8 relationship(s):\n    - connected to 203.0.113.9 (Source: net.csv)\n")
    assert got[1].count("mentioned in") == 4 and got[1].endswith("    - and 3 more")


def test_risky_lines_skip_attributed_ones(spark):
    p = spark.createDataFrame([("x", "Confirmed malware here\nAnalyst: confirmed malware\nok")], "page string, body string")
    assert [(r["line_no"], r["phrase"]) for r in lint.risky_lines(p).collect()] == [(0, "confirmed malware")]


def test_checks_without_terms_pass_nothing_in(spark):
    a = spark.createDataFrame([("q", "m", "Answer:\nNo. Not shown")], "id string, method string, answer string")
    c = spark.createDataFrame([("q", ["shown"], ["yes"], True)], "id string, must_include array<string>, must_not_include array<string>, expect_refusal boolean")
    assert evaluate.results(evaluate.checks(a, c)).collect()[0].asDict() == {"id": "q", "method": "m", "passed": True, "n_failures": 0}


def test_rules_over_pages(spark):
    pages = spark.createDataFrame(
        [("index", "[[a]] [[b#part|B]] [[gone.md]]"), ("a", "Alpha Tool.exe (Source: s1.txt) (Source: s2.txt)\nconfirmed malware, definitely malicious"), ("b", "claim_0001 claim_0009\nAnalyst: confirmed malware"), ("lost", "")], "page string, body string"
    )
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(lint.broken_links(pages)) == [("index", "gone")] and rows(lint.orphans(pages)) == [("lost",)]
    assert rows(lint.broken_citations(pages, spark.createDataFrame([("s1.txt",)], "path string"))) == [("a", "s2.txt")]
    assert rows(lint.unknown_ids(pages, spark.createDataFrame([("claim_0001",)], "id string"))) == [("b", "claim_0009")]
    assert rows(lint.asserted_lines(pages, lint.CONFIRMATION_PHRASES)) == [("a", 1, "confirmed malware")]
    values = spark.createDataFrame([("TOOL.EXE",), ("ol",), ("other",), ("alphax",), (None,), ("",)], "value string")
    assert rows(lint.unmentioned(values, pages, "value")) == [("alphax",), ("other",)]
    facts = spark.createDataFrame([("t", "seen (Source: x)"), ("t", "guess"), ("t", "")], "title string, fact string")
    assert rows(lint.uncited_facts(facts)) == [("t", "guess")]
    claims = spark.createDataFrame([("Beacon found",), ("Other thing",)], "title string")
    assert rows(lint.unrelated(claims, spark.createDataFrame([("x", "a beacon")], "title string, claim_a string"))) == [("Other thing",)]
    f = lint.with_meta(lint.finding(claims, "C1", "Critical", "p"))
    assert [r["rule"] for r in f.collect()].count("C5") == 1 and lint.with_meta(f.where("rule = 'none'")).count() == 0


def test_many_questions_give_what_one_gives(spark):
    docs = spark.createDataFrame([(1, "red fox jumps\nfox"), (2, "red hen"), (3, ""), (4, "blue fox fox red")], "doc_id long, text string")
    asked = ["fox fox red", "hen", "nothing here"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    many = {(r["qid"], r["doc_id"]): r["score"] for r in retrieval.bm25_many(docs, q, 2).collect()}
    assert many == {(i, r["doc_id"]): r["score"] for i, x in enumerate(asked) for r in retrieval.bm25(docs, x, 2).collect()}
    near = {(r["qid"], r["doc_id"]): r["score"] for r in retrieval.hash_cosine_many(docs, q, 2).collect()}
    one = {(i, r["doc_id"]): r["cosine"] for i, x in enumerate(asked) for r in retrieval.hash_cosine(docs, spark.createDataFrame([(0, x)], "doc_id long, text string"), 2).collect()}
    assert near == one
    assert {r["doc_id"]: r["snippet"] for r in retrieval.snippets(docs, retrieval.bm25_many(docs, q, 2).where("qid = 0"), q).collect()}[1] == "red fox jumps"
