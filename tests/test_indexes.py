"""Stored indexes, state over time and the stateful stream: against whole scans, odd rows, restarts."""

import random

import numpy as np
from pyspark.sql import functions as F

from vespera.operators import lexical_index, retrieval, vector_index
from vespera.plans import replay
from vespera.streaming import stateful


def test_the_lexical_index_gives_what_a_scan_gives(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["the", "Alpha"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(100, None), (101, ""), (102, "w1 " * 500), (103, "w1 " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexical_index.build(docs, str(tmp_path))
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "nothing here"), (3, ""), (4, "alpha w3"), (5, None)], "qid long, question string")
    key = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    got = lexical_index.search(spark, str(tmp_path), asked, 5)
    assert key(got) == key(retrieval.bm25_many(docs, asked, 5)) and got.count() == 10
    # only the buckets of the question's terms are read
    plan = lexical_index.search(spark, str(tmp_path), asked.where("qid = 4"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.partition("PartitionFilters: [")[2]
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1200)))], "qid long, question string")
    assert key(lexical_index.search(spark, str(tmp_path), many, 5)) == key(retrieval.bm25_many(docs, many, 5))
    lexical_index.build(docs.limit(0), f"{tmp_path}/none")
    assert lexical_index.search(spark, f"{tmp_path}/none", asked, 5).count() == 0


def test_the_vector_index_is_exact_and_its_probes_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (20, 16))
    x = (centers[rng.integers(0, 20, 1500)] + rng.normal(0, 0.4, (1500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    vector_index.build(df, str(tmp_path), lists=24)
    good = {i: np.array(v, np.float64) for i, v in rows if v is not None and np.isfinite(v).all() and any(v)}
    for q in (0, 3, 77):
        c = {i: round(float(v @ good[q] / np.sqrt((v @ v) * (good[q] @ good[q]))), 4) for i, v in good.items()}
        want = sorted(c.items(), key=lambda p: (-p[1], p[0]))[:12]
        got = [(r["id"], r["cosine"]) for r in vector_index.search(spark, str(tmp_path), x[q].tolist(), 12).collect()]
        assert [p[0] for p in got] == [p[0] for p in want] and np.allclose([p[1] for p in got], [p[1] for p in want], atol=2e-4)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 150)], "id long, v array<double>")
    share = vector_index.recall(spark, str(tmp_path), asked, 10, 6)
    print("recall of 6 of 24 lists:", share)
    assert share >= 0.9
    vector_index.build(df.limit(0), f"{tmp_path}/none")
    assert vector_index.search(spark, f"{tmp_path}/none", [1.0] * 16, 3).count() == 0


def test_state_at_every_step(spark):
    rng = random.Random(3)
    rank = {"Low": 1, "Medium": 2, "High": 3}
    rows = [(f"k{rng.randint(0, 15)}", rng.choice(list(rank)), f"step_{rng.randint(1, 6)}") for _ in range(60)]
    states = replay.intervals(spark.createDataFrame(rows, "key string, confidence string, step string"), ["key"], "confidence", F.expr("CASE confidence WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"))
    best = lambda step: {k: max((c for a, c, s in rows if a == k and s <= step), key=rank.get) for k in {a for a, _, s in rows if s <= step}}
    moved, before = {(r["step"], r["key"]): (r["before"], r["confidence"]) for r in replay.moves(states, ["key"], "confidence").collect()}, {}
    for step in (f"step_{i}" for i in range(0, 8)):
        now = best(step)
        assert {r["key"]: r["confidence"] for r in replay.as_of(states, F.lit(step)).collect()} == now
        assert {k: v for (s, k), v in moved.items() if s == step} == {k: (before.get(k), c) for k, c in now.items() if before.get(k) != c}
        before = now


def test_the_stateful_stream_goes_on_after_a_stop_and_writes_what_changed(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, seq long, v string").schema
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merge = lambda: {r["k"]: (r["seq"], r["v"]) for r in stateful.merge_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "seq").collect()}
    write([(f"k{i}", 100, "x") for i in range(50)] + [("a", 5, None), ("b", 1, "y"), ("b", 0, "first")])
    assert merge()["a"] == (5, None) and merge()["b"] == (0, "first")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    write([("a", 2, "late"), ("c", 9, "z"), ("b", 4, "no"), ("k1", 101, "no")])
    got = merge()
    assert got["a"] == (2, "late") and got["b"] == (0, "first") and got["c"] == (9, "z") and len(got) == 53
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    last = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))[-1]
    assert spark.read.parquet(f"{tmp_path}/out/{last}").count() == 2  # a and c, not the 53 rows of the state


def test_documents_are_scored_in_place_and_equal_ones_by_their_ids(spark, tmp_path, monkeypatch):
    import math
    import re
    from collections import Counter

    from vespera.functions import text as X

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["the", "Alpha", "Kelvin", "x.y-z_"]
    rows = [(f"d{i:04d}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(f"c{rng.randint(0, 10**6):07d}", "w1 w2 alpha alpha") for _ in range(150)] + [("null", None), ("d0001", "w1 w3"), ("d0001", "w1 w5"), ("same", "w7 w8"), ("same", "w7 w7")]
    rng.shuffle(rows)
    asked = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(40)] + [(40, "w1 alpha"), (41, "gone"), (42, None)]
    tokens = lambda s: [w.lower() for w in re.findall(X.TOKEN, s or "") if w.lower() not in X.SEARCH_STOPWORDS]

    def brute(rows, k):
        size = [max(1, len(tokens(s))) for _, s in rows]
        mean, tf = sum(size) / len(size), Counter()
        for (d, s), dl in zip(rows, size):
            tf.update((t, d, dl) for t in tokens(s))
        df = Counter(t for t, _, _ in tf)
        out = []
        for q, s in asked:
            score, weight = Counter(), Counter(tokens(s))
            for (t, d, dl), n in tf.items():
                if t in weight:
                    score[d] += weight[t] * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / mean))
            out += [(q, i + 1, d, round(x, 6)) for i, (d, x) in enumerate(sorted(score.items(), key=lambda p: (-round(p[1], 6), p[0]))[:k])]
        return out

    q = spark.createDataFrame(asked, "qid long, question string")
    key = lambda df: sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    for i, some in enumerate((rows, [r for r in dict(rows).items()])):
        docs = spark.createDataFrame(some, "doc_id string, text string").repartition(3)
        lexical_index.build(docs, f"{tmp_path}/{i}")
        for name, value in (("SCORES", 1 << 18), ("SCORES", 90), ("TOLD", 5), ("WEIGHTS", 5)):
            with monkeypatch.context() as m:
                m.setattr(retrieval, name, value)
                got = retrieval.bm25_many(docs, q, 7)
                assert key(got) == brute(some, 7) and key(lexical_index.search(spark, f"{tmp_path}/{i}", q, 7)) == brute(some, 7)
                if name == "SCORES":
                    assert "hashpartitioning(qid#" in (plan := got._jdf.queryExecution().toString()) and "doc_id" not in "".join(x.partition("hashpartitioning(")[2] for x in plan.split("\n"))


def test_the_stateful_stream_keeps_first_rows_without_python(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long, seq long, v string").schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert "Pandas" not in stateful.changed(stream, ["k", "n"], "seq")._jdf.queryExecution().logical().toString()
    rng, want, batches = random.Random(4), {}, 3
    for b in range(batches):
        rows = [(rng.choice(["a", "b", None]), rng.randint(0, 20), rng.randint(0, 200) * 10 + b, f"v{b}.{i}") for i in range(150)]
        rows = [*{(k, n, s): (k, n, s, v) for k, n, s, v in rows}.values()] + [("null", 0, None if b == 0 else 9 - b, f"x{b}"), ("tie", 0, 5, f"t{b}"), ("late", b, None, None)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        before = dict(want)
        for k, n, s, v in rows:
            if (k, n) not in want or (s is not None and (want[k, n][0] is None or s < want[k, n][0])):
                want[k, n] = s, v
        got = stateful.merge_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["k", "n"], "seq").collect()
        told = {k: (x, v if x is not None else None) for k, (x, v) in want.items()}  # as in SQL, no order, no value
        assert {(r["k"], r["n"]): (r["seq"], r["v"]) for r in got} == told and len(got) == len(told)
        last = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))[-1]
        assert spark.read.parquet(f"{tmp_path}/out/{last}").count() == sum(before.get(k) != x for k, x in want.items())
