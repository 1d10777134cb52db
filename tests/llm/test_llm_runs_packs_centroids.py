"""Clustering, packing and periodic runs: brute force beside, odd rows, round trips."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vespera.llm import centroids, packing, queries, word_runs

SCHEMA = "doc_id long, text string, lang string, length long, period long, start long, ids string, `group` int, place double, runs string, sequence long, v int"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x", 4, 0.5, "r", 6, 7) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def words(t):
    return re.findall(r"[^ \t-\r]+", t or "")


def odd_texts():
    rng = random.Random(4)
    some = [" ".join(rng.choice("the of and to tree river stone light 12 x-y don't".split()) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    line = "one two three four five six seven\n"
    odd = [None, "", " \n\t ", "a", "x" * 30_000, "word " * 9_000, line * 50, "q " + line * 3 + "q", "日本 " * 40, "a  b \n c \x1c d \x85 e " * 10, "<|endoftext|> a <|endoftext|>b  \n\n c", some[0], some[0]]
    return odd + some


def brute_runs(w, least=24, exponent=3):
    out = set()
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            size = i - s + p
            if size >= max(least, exponent * p) and not any(w[s : s + size - q] == w[s + q : s + size] for q in range(1, p)):
                out.add((s, size, p))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 110), rng.choice([1, 2, 3, 5])
        w = [rng.randint(0, k - 1) for _ in range(n)]
        if n > 3 and rng.random() < 0.7:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least, exponent in ((24, 3), (4, 2), (9, 4)):
            want = brute_runs(w, least, exponent)
            assert word_runs.runs_of(np.array(w, np.int64), least, exponent) == want
            window = -(-least * (exponent - 1) // exponent)
            assert not want or 0 in word_runs.suspects(np.array(w), np.zeros(n, np.int64), window)


def test_runs_survive_a_hash_that_always_collides(monkeypatch):
    """With the sums of all words zero every hash agrees; the words themselves decide."""
    monkeypatch.setattr(word_runs, "sums", lambda codes: np.zeros(len(codes) + 1, np.uint64))
    rng = random.Random(2)
    for _ in range(150):
        w = [rng.randint(0, 1) for _ in range(rng.randint(0, 90))]
        w += w[-7:] * 6
        assert word_runs.runs_of(np.array(w, np.int64)) == brute_runs(w)


@pytest.mark.parametrize("kind", ["one", "seven", "morse", "fibonacci"])
def test_runs_of_long_periodic_texts_take_seconds(kind):
    fib = ["a", "ab"]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    w = {"one": [0] * 200_000, "seven": [i % 7 for i in range(200_000)], "morse": [i.bit_count() & 1 for i in range(1 << 17)], "fibonacci": [ord(c) for c in fib[-1]]}[kind]
    got = word_runs.runs_of(np.array(w, np.int64))
    assert got == {"one": [(0, 200_000, 1)], "seven": [(0, 200_000, 7)], "morse": []}.get(kind, got)
    assert kind != "fibonacci" or len(got) > 5000


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choice([" ", "\n", "a", "b", "é", "日", "\t\r", "\x85", "\x1c", "xyz"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        got, n = word_runs.words_of(pa.array(["first", *texts], pa.string()).slice(1))
        assert [x.decode() for x in got.to_pylist()] == [w for t in texts for w in words(t)]
        assert n.tolist() == [len(words(t)) for t in texts]


def test_find_runs_on_odd_rows(spark):
    texts = odd_texts()
    ids = [None, 5, 5, *range(10, 7 + len(texts))]
    got = word_runs.find_runs(frame(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    want = defaultdict(list)
    for i, t in zip(ids, texts):
        w = words(t)
        runs = brute_runs(w) if len(w) < 2000 else [(0, len(w), 1)]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want[i].append((len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert word_runs.find_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        word_runs.find_runs(frame(spark, []), min_exponent=1)


def test_planted_runs_are_as_the_contract_says(spark):
    rng = random.Random(6)
    texts = [" ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(0, 80))) + " \n" for _ in range(120)] + [None, "", " one"]
    ids = [*range(1000, 1000 + len(texts))]
    got = {r["doc_id"]: r["text"] for r in queries.with_planted_runs(frame(spark, [*texts, "no id"], [*ids, None])).collect()}
    planted = 0
    for i, t in zip(ids, texts):
        w, h = words(t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
            planted += 1
        assert words(got[i]) == w
    assert planted > 5 and got[None] == "no id"


def test_bins_are_first_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.choice([rng.randint(1, 50), rng.randint(1, 10), 50, 25]) for _ in range(rng.randint(0, 60))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
            if b is None:
                b = len(room)
                room.append(50)
                want.append([])
            room[b] -= sizes[i]
            want[b].append(i)
        assert packing.fit(sizes, 50) == want


def test_filled_bins_hold_every_id_once_with_little_padding():
    rng = random.Random(7)
    for case in range(300):
        sizes = [rng.randint(1, 2047) if case % 3 else rng.choice([1, 5, 1500, 1400, 2047]) for _ in range(rng.randint(0, 80))]
        bins = packing.fill(sizes, packing.fit(sizes))
        seen = defaultdict(list)
        for b in bins:
            total = sum(n for _, _, n in b)
            assert 0 < total <= 2048 and all(n > 0 for _, _, n in b)
            assert total > 2048 - packing.LEAST_CUT or total & (total - 1) == 0
            for i, at, n in b:
                seen[i].append((at, n))
        for i, n in enumerate(sizes):
            at = 0
            for lo, k in sorted(seen[i]):
                assert lo == at
                at += k
            assert at == n


def test_ids_are_the_librarys(tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.PACK_TOKENIZER)
    coder, memory = Tokenizer.from_file(path), packing.ByteMemory(path, "<u2")
    assert memory.apart
    rng = random.Random(8)
    bits = [" ", " ", "\n", "\t", "  ", "\x1c", "\x85", " ", " ", "​", "﻿", "᠎", "a", "don't", "'s", "12", "é", "日本", "😀", "<|endoftext|>", "<|endo", "--", "_x", "\x00", "Ab", "́"]
    for _ in range(300):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        ids, n = memory.encode(pa.array(["skip me", *texts], pa.string()).slice(1))
        want = [coder.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_pack_keeps_every_id_and_sequences_are_gapless(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.PACK_TOKENIZER)
    coder, texts = Tokenizer.from_file(path), odd_texts()
    texts += ["long words of a longer text, " * 3000]
    ids = [None, 5, 5, *range(10, 7 + len(texts))]
    pieces = packing.pack(frame(spark, texts, ids).repartition(3), path, group=8)
    rows = pieces.collect()
    want = defaultdict(list)
    for i, t in zip(ids, texts):
        want[i].append([*coder.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.frombuffer(r["ids"], "<u2")
        assert r["length"] == len(own) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own.tolist()))
        by_doc[r["doc_id"]].append((r["doc_tokens"], r["start"], own.tolist()))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in want.items():
        if len(own) == 1:
            got = sorted(by_doc[i])
            assert [x for p in got for x in p[2]] == own[0] and {p[0] for p in got} == {len(own[0])}
            assert [p[1] for p in got] == [sum(len(q[2]) for q in got[:k]) for k in range(len(got))]
        else:
            assert sorted(x for p in by_doc[i] for x in p[2]) == sorted(x for o in own for x in o)
    for pieces_ in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces_):
            assert offset == at
            at += n
        assert at <= 2048 and (at > 2040 or at & (at - 1) == 0)
    put = packing.sequences(pieces).collect()
    assert len(put) == len(by_sequence) and all(len(r["ids"]) == 2 * r["n_tokens"] for r in put)
    assert packing.pack(frame(spark, []), path).count() == 0


def brute_lloyd(rows, k, rounds, size):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, of) if o == n]
            if mine:
                cs[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i is not None, i or 0), near(v)[1], near(v)[0]) for i, v in kept), cs


@pytest.mark.parametrize("rounds", [0, 1, 3, 6])
def test_clusters_equal_lloyds(spark, rounds):
    rng = random.Random(rounds)
    rows = [(i, [rng.choice([-1.5, -0.01, 0.0, 0.26, 1.0, rng.uniform(-2, 2)]) for _ in range(4)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 260)] + [(7, [1.0, 1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0, 9.0]), (None, [-9.0, 0.0, 0.0, 0.0]), (300, None), (301, []), (302, [1.0]), (303, [1.0, None, 1.0, 1.0]), (304, [1.0, float("nan"), 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0, 1.0]), (306, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "c", 5) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, distance long").repartition(5)
    got, clusters = centroids.cluster_vectors(df, clusters=6, rounds=rounds, size=4)
    want, cs = brute_lloyd(rows, 6, rounds, 4)
    assert sorted(((r["id"] is not None, r["id"] or 0), r["cluster"], r["distance"]) for r in got.collect()) == want
    told = clusters.orderBy("cluster").collect()
    assert [r["centroid"] for r in told] == cs and sum(r["inertia"] for r in told) == sum(d for *_, d in want) and sum(r["n"] for r in told) == len(want)


def test_few_and_no_vectors_and_too_large_ones(spark):
    schema = "vec_id long, embedding array<double>"
    got, clusters = centroids.cluster_vectors(spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0])], schema), size=2)
    assert got.count() == 2 and clusters.count() == 2
    got, clusters = centroids.cluster_vectors(spark.createDataFrame([(1, [0.0])], schema), size=2)
    assert got.count() == 0 and clusters.count() == 0
    with pytest.raises(Exception, match="a component beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], schema), size=2)


@pytest.mark.parametrize("name", ["op11_centroids", "op13_periodic_runs"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table().to_pylist()
    got = queries.queries()[name](spark, SF).toArrow().to_pylist()
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, got)) == sorted(map(key, want)) and got
