"""Near-duplicates, components and exact top-k search against brute force."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from broadsheet.llm import minhash, topk
from broadsheet.llm.common import binary_rows
from broadsheet.llm.components import components

components_module = sys.modules[components.__module__]


def bag(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(x, y):
    a, b = bag(x), bag(y)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(docs, least=0.8):
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bag(docs[i]) and bag(docs[j]) and similarity(docs[i], docs[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(seed, groups=6, size=12):
    rng = random.Random(seed)
    docs = {}
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 5000)}"
            docs[rng.randint(0, 10**6)] = " ".join(copy)
    return docs


@pytest.mark.parametrize("small", [16, 1])
def test_classes_of_an_id_with_two_texts(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, one), (1, two), (2, [*one, "x"]), (3, [*two, "y"]), (4, [*one, "z"]), (5, [*two, "v"])]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(1, ""), (9, "")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}


@pytest.mark.parametrize("seed,small,block", [(0, 16, 256), (1, 1, 4)])
def test_classes(spark, monkeypatch, seed, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_copies(seed) | {-1: "", -2: None, -3: "one two", -4: "one  TWO", -5: "a " * 3000, -6: "a " * 2990, -7: " \n"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(frame).collect()} == classes(docs)


def test_leader_is_not_needed(spark):
    # a chain: neighbours are similar, the ends aren't; the least id is at one end
    words = [f"w{i}" for i in range(400)]
    docs = {i: " ".join(words[i * 15 : i * 15 + 200]) for i in range(8)}
    assert similarity(docs[0], docs[1]) >= 0.8 > similarity(docs[0], docs[2])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_near_duplicate_cases(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 2), (9, "a b c d e f", 3), (7, "other words stand here now", 4), (7, "and again some others then", 5), (3, "and again some others then", 6), (None, "a b c d e f", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in minhash.near_duplicates(frame).collect())
    assert got == [(-1, -1), (3, 3), (5, 5), (5, 5), (7, 3), (7, 3), (9, 5)]
    assert sorted(r.node for r in minhash.keep_first(frame).collect()) == [1, 2, 6, 7] and minhash.keep_first(frame).columns == frame.columns
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_signature_is_unbiased():
    rng = np.random.default_rng(4)
    e = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = minhash.bag_minhash(np.concatenate([e, e]), np.concatenate([a, b]), np.array([60, 60]), 8192)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 8192)
    assert np.isinf(minhash.bag_minhash(e[:0], a[:0], np.array([0]))).all()


def test_overlaps():
    texts = list(near_copies(3, 2, 5).values()) + ["", "x x x x x x x x"]
    e, w, n = minhash.bags(*minhash.shingles(*binary_rows(pa.array([t.encode() for t in texts], pa.binary()))))
    got = minhash.overlaps(e, w, n)
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert i == j or got[i, j] == sum((bag(x) & bag(y)).values())


def test_components_end_without_a_round_where_one_task_holds_the_edges(spark, monkeypatch):
    rounds, own = [], components_module._star
    monkeypatch.setattr(components_module, "_star", lambda edges, large: rounds.append(large) or own(edges, large))
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i % 7, 2000 + i) for i in range(50)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(8)
    wanted = {i: 0 for i in range(1, 301)} | {2000 + i: 1000 + i % 7 for i in range(50)}
    assert {r.node: r.root for r in components(frame).collect()} == wanted and not rounds
    monkeypatch.setattr(components_module, "AT_ONCE", 100)
    rows = components(frame).collect()
    assert {r.node: r.root for r in rows} == wanted and len(rows) == len(wanted) and rounds


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(500, i) for i in range(501, 520)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(vectors, k):
    q = {i: v for i, v in vectors if i is not None and i % 20 == 0}
    out = {}
    for i, v in q.items():
        scores = sorted((-int(np.dot(np.floor(64 * np.array(v)), np.floor(64 * np.array(x)))), j) for j, x in vectors if j != i)
        out |= {(i, r): (j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("n,block,sample,batch", [(300, 4096, 2048, 2048), (300, 5, 30, 17), (15, 4096, 2048, 2048), (120, 1, 30, 50)])
def test_top_k(spark, monkeypatch, n, block, sample, batch):
    for name, value in (("BLOCK", block), ("SAMPLE", sample), ("BATCH", batch), ("AT_ONCE", 2 if block == 1 else 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 16))
    vectors = [(i, [float(np.float32(v)) for v in centres[i % 5] + rng.normal(size=16) * 0.1]) for i in range(n)]
    vectors[n // 2] = (n // 2, vectors[0][1])  # ties
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame, frame.vec_id % 20 == 0).collect()}
    assert got == brute_top(vectors, 20)


def test_levels_prune_and_keep(spark):
    # queries whose neighbours differ in every level from the rest
    rng = np.random.default_rng(8)
    x = np.floor(64 * rng.normal(size=(3000, 32)) * np.where(np.arange(3000) % 50 == 0, 3, 0.1)[:, None])
    ids = np.arange(3000)
    q = x[::100]
    score = q @ x.T
    score[np.arange(len(q)), ids[::100]] = -np.inf
    floor = np.partition(score, -5, axis=1)[:, -5]
    batch = pa.RecordBatch.from_pydict({"vec_id": ids, "embedding": pa.array((x / 64).tolist(), pa.list_(pa.float64()))})
    got = pa.Table.from_batches(list(topk.search(ids[::100], q, floor, 5)(iter([batch])))).to_pylist()
    wanted = {(int(i), int(j)) for n, i in enumerate(ids[::100]) for j in sorted(range(3000), key=lambda j: (-score[n, j], j))[:5]}
    assert {(r["query_id"], r["vec_id"]) for r in got} == wanted


def test_top_k_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 1.0], "b"), (1, [1.0], "c"), (2, None, "d"), (3, [1.0, nan], "e"), (4, [inf, 1.0], "f"), (5, [1.0, None], "g"), (None, [1.0, 1.0], "h"), (6, [1e7, 1e9], "i"), (7, [], "j")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, frame.vec_id % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 64 * 64 * 10**7 + 64 * 64 * 10**9), (0, 2, 1, 64 * 64), (0, 3, 7, 0)]
    assert topk.top_k(frame.limit(0), frame.vec_id == 0).count() == 0


def test_scores_beyond_64_bits_raise():
    q = np.array([[2.0**40, 0.0]])
    batch = pa.RecordBatch.from_pydict({"vec_id": [7], "embedding": pa.array([[2.0**34, 1.0]], pa.list_(pa.float64()))})
    with pytest.raises(OverflowError):
        list(topk.search(np.array([0]), q, np.array([-np.inf]), 5)(iter([batch])))
