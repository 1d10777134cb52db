"""Given extractors and embedders, JSON of unknown shape, neighbours without pairs: odd rows, failures, brute force."""

import hashlib
import json
import random
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from vespera.api import Case
from vespera.functions import text as X
from vespera.operators import embed, graph, retrieval
from vespera.plans import methods
from vespera.sources import extractor, shapes, storage


def _files(spark, texts):
    rows = [(p, None if t is None else hashlib.sha256(t.encode()).hexdigest(), t) for p, t in texts]
    return spark.createDataFrame(rows, "path string, sha string, text string")


def _asked(folder):
    return sorted(t for f in folder.iterdir() for t in json.loads(f.read_text()))


def _model(folder):
    """Notes every text it answers; refuses a batch that holds a bad one."""

    def ask(texts):
        import uuid

        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        (folder / uuid.uuid4().hex).write_text(json.dumps(texts))
        return [[{"type": "Registry Key", "value": f" {t} ", "confidence": "High"}, {"type": "gadget", "value": t, "confidence": "sure"}, {"type": "ip", "value": " "}, {"type": None, "value": None}] for t in texts]

    return ask


def test_texts_are_asked_once_in_batches_and_failures_are_told(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"
    seen.mkdir()
    memo, ask = str(tmp_path / "memo"), _model(seen)
    files = _files(spark, [("a", "one"), ("b", "two"), ("copy", "one"), ("c", "bad text"), ("e", "")])
    got = sorted(map(tuple, extractor.facts(files, ask, memo, wait=0.0).collect()))
    note = "unknown type kept as other: gadget"
    assert got == sorted([(p, 0, "registry_key", t, "High", None) for p, t in (("a", "one"), ("b", "two"), ("copy", "one"))] + [(p, 1, "other", t, "Low", note) for p, t in (("a", "one"), ("b", "two"), ("copy", "one"))])
    assert _asked(seen) == ["", "one", "two"]
    # what was answered is not asked again, what failed is
    more = files.unionByName(_files(spark, [("d", "three")]))
    kept, failed = extractor.answered(more, ask, memo, wait=0.0)
    assert _asked(seen) == ["", "one", "three", "two"] and kept.count() == 4
    assert [(r["sha"], r["problem"]) for r in failed.collect()] == [(hashlib.sha256(b"bad text").hexdigest(), "RuntimeError: refused")]
    # of two answers to one text one counts, and the folders of answers can be made one
    v = storage.Versions(spark, memo)
    v.commit({}, added={"answers": v.folders("answers")[:1]})
    assert extractor.answered(files, ask, memo, wait=0.0)[0].count() == 3
    assert extractor.facts(files.limit(0), ask, memo).count() == 0
    monkeypatch.setattr(extractor, "SENT", 1)
    assert sorted(map(tuple, extractor.facts(files.unionByName(_files(spark, [("n", None)])), ask, f"{memo}2", wait=0.0).collect())) == got


def test_a_batch_is_asked_again_and_long_texts_go_alone(spark):
    calls = []

    def ask(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return [[] for _ in texts]

    made = extractor.table_function(ask, tries=3, wait=0.0, batch=4).func()
    out = [x for i in range(5) for x in made.eval({"sha": str(i), "text": "x" * (extractor.CHARACTERS if i == 2 else 1)})] + list(made.terminate())
    assert [x[0] for x in out] == list("01234") and all(x[2] is None for x in out)
    assert calls == [2, 2, 2, 1, 2]
    wrong = extractor.table_function(lambda texts: [], tries=2, wait=0.0).func()
    list(wrong.eval({"sha": "s", "text": None}))
    assert list(wrong.terminate()) == [("s", None, "ValueError: 0 answers to 1 texts")]


def test_members_of_json_that_is_null_broken_or_no_object(spark):
    rows = [(1, '{"a": 1, "b": "x, y", "c": null, "d": [1, {"e": 2}], "f": 1.5, "g": false, "h": {}}'), (2, None), (3, "{"), (4, "[1]"), (5, "7"), (6, "{}"), (7, '{"a": ""}'), (7, '{"a": ""}')]
    df = spark.createDataFrame(rows, "key int, value string").select("key", F.col("value").alias("pos"))
    got = sorted(map(tuple, shapes.members(df, "key", "pos").collect()))
    assert got == sorted([(1, "a", "BIGINT", "1"), (1, "b", "STRING", "x, y"), (1, "c", "VOID", None), (1, "d", "ARRAY", '[1,{"e":2}]'), (1, "f", "DECIMAL", "1.5"), (1, "g", "BOOLEAN", "false"), (1, "h", "OBJECT", "{}"), (7, "a", "STRING", ""), (7, "a", "STRING", "")])
    told = shapes.shape(df.where("key in (2, 3, 6, 7)"), "pos").first()
    assert tuple(told) == ("OBJECT<a: STRING>", 3, 1)
    assert shapes.members(df.limit(0), "key", "pos").count() == 0 and shapes.shape(df.limit(0), "pos").first()["n"] == 0


def test_question_files_of_several_shapes(spark, tmp_path):
    item = {"id": "q", "question": "why?", "must_include": ["a", "b"], "expect_refusal": True, "extra": {"x": 1}}
    bare = [item, {"id": 7, "question": "one text", "must_include": "only"}, {"question": "no id"}]
    for name, data in (("bare", bare), ("wrapped", {"items": bare, "title": "t"}), ("single", item)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
        got = {r["id"]: r for r in methods.load_questions(spark, str(tmp_path / f"{name}.json")).collect()}
        assert set(got) == ({"q"} if name == "single" else {"q", "7"})
        assert got["q"]["must_include"] == ["a", "b"] and got["q"]["expect_refusal"] and not got["q"]["expect_separation"] and got["q"]["required_sources"] == []
        assert name == "single" or got["7"]["must_include"] == ["only"]
    (tmp_path / "none.json").write_text("[]")
    assert methods.load_questions(spark, str(tmp_path / "none.json")).count() == 0


def test_a_given_embedder_takes_the_place_of_hashing(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(60)] + [(100, None), (101, ""), (102, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "word1 word2 word3"), (2, "word4 word5"), (3, ""), (4, None)], "qid long, question string")
    key = lambda df: sorted((r["qid"], r["rank"], r["score"]) for r in df.collect())
    want = key(retrieval.hash_cosine_many(docs, asked, 5))
    assert key(embed.nearest(docs, asked, 5)) == want and want
    monkeypatch.setattr(embed, "ASKED_AT_ONCE", 2)  # several blocks
    assert key(embed.nearest(docs, asked, 5)) == want

    def letters():
        return lambda texts: np.array([[t.count(c) for c in "abc"] for t in texts], float)

    few = spark.createDataFrame([(1, "aab"), (2, "ccc"), (3, "aabaab")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "aab")], "qid long, question string")
    assert [(r["doc_id"], r["score"]) for r in embed.nearest(few, q, 5, letters).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0)]
    evidence = tmp_path / "evidence"
    evidence.mkdir()
    (evidence / "n.txt").write_text("abba\n")
    (evidence / "m.txt").write_text("ccc\n")
    seen = tmp_path / "seen"
    seen.mkdir()
    case = Case(spark, str(evidence), str(tmp_path / "state"), extractor.extracting(_model(seen), str(tmp_path / "memo")), embedder=letters)
    case.ingest()
    assert {(r["type"], r["value"]) for r in case.read("entities").collect()} >= {("registry_key", "abba"), ("registry_key", "ccc"), ("other", "ccc")}
    said = methods.vector(case.files(), spark.createDataFrame([("q", "ab")], "qid string, question string"), embedder=case.embedder).first()
    assert "abba" in said["answer"] and "ccc" not in said["answer"]


def test_neighbours_equal_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(25)) for _ in range(200)] + [(n, 99) for n in range(300)] + [(5, None), (None, 3), (1, 99)]
    m = spark.createDataFrame(rows, "node int, source int")
    pairs = {(a, b) for a, s in rows for b, t in rows if s == t and s is not None and a != b and None not in (a, b)}
    nodes = spark.createDataFrame([(1,), (1,), (7,), (250,), (9999,)], "node int")
    want = sorted(p for p in pairs if p[0] in (1, 7, 250))
    assert sorted(map(tuple, graph.neighbours_of(m, nodes).collect())) == want
    monkeypatch.setattr(graph, "SENT", 3)
    assert sorted(map(tuple, graph.neighbours_of(m, nodes).collect())) == want
    assert graph.neighbours_of(m, nodes.limit(0)).count() == 0


def test_an_index_asks_the_embedder_once_for_each_text(spark, tmp_path):
    from vespera.operators import vector_index

    asked = tmp_path / "asked"
    asked.mkdir()

    def counting():
        model = embed.hashed()

        def f(texts):
            (asked / uuid.uuid4().hex).write_text(str(len(texts)))
            return model(texts)

        return f

    docs = spark.createDataFrame([(i, f"word{i % 7} and other{i} text" if i % 5 else None) for i in range(300)], "doc_id long, text string")
    vector_index.build(embed.embedded(docs, counting), str(tmp_path / "index"), "doc_id")
    assert sum(int(p.read_text()) for p in asked.iterdir()) == 300


def test_hashed_vectors_are_those_of_the_digests(monkeypatch):
    texts = ["The Alpha alpha beta alpha beta", "", "the of", "x.y-z_ Kelvin ü", " ".join(f"w{i % 50}" for i in range(400))]

    def plain(text):
        words = [w.lower() for w in re.findall(r"[a-zA-Z][a-zA-Z0-9_.\-]*", text)]
        words = [w for w in words if w not in X.SEARCH_STOPWORDS]
        grams, row = words + [f"{a}_{b}" for a, b in zip(words, words[1:])], np.zeros(256)
        for g in sorted(set(grams)):
            d = hashlib.md5(g.encode()).digest()
            row[d[0]] += (-1 if d[4] % 2 else 1) * (1 + np.log(grams.count(g)))
        return row / (np.linalg.norm(row) or 1)

    for known in (500_000, 1):
        monkeypatch.setattr(embed, "KNOWN", known)
        assert np.allclose(embed.hashed()(texts), [plain(t) for t in texts])
