import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F

from vespera.llm import near_dup, queries


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns, name
        out = corpus_pipeline.stored(out, "t")
        assert out.join(docs, docs.columns, "left_anti").count() == 0
        if name.startswith("MinHash"):
            left = {r["doc_id"]: near_dup.shingles(r["text"], 5) for r in out.collect()}
            every = [(i, s) for i, s in left.items() if s]
            assert len(left) == out.count()
            assert not any(100 * len(a & b) >= 80 * len(a | b) for k, (_, a) in enumerate(every) for _, b in every[:k])
        if name.startswith("benchmark"):
            assert at.count() > out.count()
        at = out
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.agg(F.sum("n_tokens")).first()[0] > 0 and last.count() == at.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "t")
        assert docs.count() == 0


def test_stages_judge_rows_of_null_and_shared_ids_apart(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    words = [" ".join(f"{x}{i}" for i in range(k)) for x, k in (("a", 30), ("b", 40), ("c", 50), ("d", 60))]
    rows = [(i, t, "en", "s", len(t)) for i, t in ((None, words[0]), (None, words[1]), (None, item), (7, words[2]), (7, words[3]), (7, item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted((r["doc_id"] is None, r["text"]) for r in df.collect())
    clean = corpus_pipeline.drop_benchmark(spark, docs, SF)
    assert texts(clean) == sorted((i is None, t) for i, t, *_ in rows if t != item)
    copy = spark.createDataFrame([(3, words[0], "en", "s", 1), (7, words[2], "en", "s", len(words[2])), (None, words[1], "fr", "s", 1), (None, "", "en", "s", 0), (None, "", "en", "s", 0)], docs.schema)
    once = corpus_pipeline.keep_one_of_each(spark, docs.where(F.col("text") != item).unionByName(copy), SF)
    assert texts(once) == sorted([(False, words[0]), (True, words[1]), (False, words[2]), (False, words[3]), (True, ""), (True, "")])
    many = spark.createDataFrame([(None if i % 2 else 5, f"{'w ' * (i % 9 + 1)}", "en", f"s{i % 3}", i) for i in range(300)], docs.schema).repartition(3)
    goal = {r["source"]: r["target"] for r in corpus_pipeline.mixing.mix(many).select("source", "target").distinct().collect()}
    mixed = corpus_pipeline.mix_sources(spark, many, SF)
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert got.keys() == goal.keys() and all(abs(got[s] - goal[s]) <= 1 for s in goal)
    assert mixed.groupBy("n_chars").count().agg(F.max("count")).first()[0] <= 2


def test_stages_on_odd_rows(spark):
    long, words = "word " * 30_000, " ".join(f"w{i}" for i in range(40))
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, "one"), (4, long), (5, words), (5, words), (6, words), (7, "tie a b c d e f g h i j"), (8, "tie a b c d e f g h i j"), (9, " ".join(f"v{i}" for i in range(50)))]
    docs = spark.createDataFrame([(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", len(t or ""), 0.5, 7) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score double, size int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns and out.join(docs, [docs[c].eqNullSafe(out[c]) for c in docs.columns], "left_anti").count() == 0, name
        if name.startswith("quality"):
            kept = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert all(kept.count(x) in (0, rows.count(x)) for x in set(rows))  # equal rows share their fate
        if name.startswith("MinHash"):
            assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "4", "5", "7", "9", "None", "None"]
        if name.startswith("benchmark"):
            assert out.count() == len(rows)
    last = corpus_pipeline.token_output(spark, docs, SF).collect()
    assert len(last) == len(rows) and sorted(r["n_tokens"] for r in last)[:4] == [1, 1, 1, 1]


def test_stages_keep_columns_of_any_kind_and_name(spark):
    """Maps have no order, and a user may have the names that a stage has inside."""
    words = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = [(1, words[0]), (1, words[0]), (2, words[0]), (3, words[1]), (None, words[2]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 5, {"k": k}, "mine", 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, meta map<string,int>, vespera_key string, n int")
    more = docs.withColumns({c: F.lit("mine") for c in ("vespera_score", "score", "key", "row", "id", "copies", "hash", "vespera_text", "a.b")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, more, SF), "t")
        assert out.columns == more.columns and dict(out.dtypes) == dict(more.dtypes), name
        got = out.collect()
        assert got and all(r["vespera_key"] == r["key"] == r["vespera_score"] == r["a.b"] == "mine" and r["meta"]["k"] < 6 for r in got), name
        if name.startswith("MinHash"):
            assert sorted((r["doc_id"] or 0, r["meta"]["k"]) for r in got) == [(0, 4), (0, 5), (1, 0), (3, 3)]
    assert corpus_pipeline.token_output(spark, more, SF).count() == 6


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == names[:-1] and names[-1] == "pipeline"
    assert set(queries.oracle_sql()) < set(names)
