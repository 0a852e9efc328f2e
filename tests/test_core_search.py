"""Searches against plain restatements: many blocks of questions, ties, repeated ids, ids that are texts."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quillon.operators import search


@pytest.fixture(scope="module")
def made():
    r = random.Random(6)
    vocab = ["the", "of", "éta", "x_1", "٣٤", "Straße"] + [f"w{i}" for i in range(40)]
    nodes = [(f"n{i:03}", " ".join(r.choices(vocab, k=r.randint(0, 30)))) for i in range(120)] + [("n900", None), ("n901", ""), ("n902", "unique"), ("n903", "unique")]
    asked = [(i, " ".join(r.choices(vocab, k=r.randint(1, 6)))) for i in range(23)] + [(100, "unique!"), (101, "absent"), (102, None)]
    return nodes, asked


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def best(scores, k):
    out = []
    for q, of in scores.items():
        out += [(q, n, pytest.approx(-s, abs=2e-6), i) for i, (s, n) in enumerate(sorted((-s, n) for n, s in of.items())[:k])]
    return sorted(out, key=lambda x: (x[0], x[3]))


def rows(df):
    return sorted(((r["query_id"], r["node_id"], r["score"], r["rank"]) for r in df.collect()), key=lambda x: (x[0], x[3]))


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("block", [4096, 5])
def test_text_search(spark, made, monkeypatch, block, stored):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SCORES", 1 << (22 if block > 5 else 5))
    nodes, asked = made
    n, a = spark.createDataFrame(nodes, "node_id string, content string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    index = search.postings(n) if stored else None
    bags = {i: Counter(words(t)) for i, t in nodes}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(nodes)
    scores = {}
    for q, text in asked:
        of = {}
        for i, b in bags.items():
            s = sum(math.log(1 + (len(nodes) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in set(words(text)) if w in b)
            if round(s, 6) > 0:
                of[i] = round(s, 6)
        scores[q] = of
    assert rows(search.bm25(a, n, 7, index=index)) == best(scores, 7)
    for every in (False, True):
        matched = {q: {i: float(len(set(words(t)) & b.keys())) for i, b in bags.items() if set(words(t)) & b.keys() and (not every or not set(words(t)) - b.keys())} for q, t in asked}
        assert rows(search.term_match(a, n, every, 7, index=index)) == best(matched, 7)


@pytest.mark.parametrize("block", [4096, 3])
def test_vector_search(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SCORES", 1 << (22 if block > 3 else 4))
    r = random.Random(1)
    nodes = [(i, [float(r.randint(-2, 2)) for _ in range(6)]) for i in range(90)] + [(200, None), (201, [0.0] * 6)]
    asked = [(i, v) for i, v in nodes[:10]] + [(3, nodes[3][1]), (300, [0.0] * 6)]
    cos = lambda x, y: 0.0 if not any(x) or not any(y) else sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    n, a = spark.createDataFrame(nodes, "node_id long, vector array<double>").repartition(4), spark.createDataFrame(asked, "query_id long, vector array<double>").where("query_id <> 3")
    of = {q: {i: round(cos(x, v), 9) for i, v in nodes if v} for q, x in asked if q != 3}
    assert rows(search.vector_top_k(a, n, 5)) == best(of, 5)
    same = {q: {i: float(sum((s > 0) == (t > 0) for s, t in zip(x, v))) for i, v in nodes if v} for q, x in asked if q != 3}
    near = {q: {i: of[q][i] for _, i in sorted((-s, i) for i, s in m.items())[:20]} for q, m in same.items()}
    assert rows(search.quantised_top_k(a, n, 5)) == best(near, 5)
    assert search.vector_top_k(a.limit(0), n, 5).count() == 0 and search.vector_top_k(a, n.limit(0), 5).count() == 0


def test_texts_are_taken_apart_in_pieces(spark, monkeypatch):
    """What a task holds does not grow with its batches; postings and counts are the same by any piece."""
    monkeypatch.setattr(search, "TEXT", 40)
    lowered = pa.array(["a b a", "", "word " * 30, "b c"] * 5 + [None])
    batch = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array([x.as_py() or "" for x in lowered])], names=["node_id", "lowered"])
    pieces = list(search._pieces(iter([batch, batch.slice(0, 0), batch.slice(3, 6)]), 4))
    assert all(p.num_rows == 1 or (p.num_rows <= 4 and sum(len(x.as_py()) for x in p.column("lowered")) <= 40) for p in pieces)
    assert [i for p in pieces for i in p.column("node_id").to_pylist()] == [*range(21), *range(3, 9)]
    whole = search._counted(batch)
    parts = [r for p in map(search._counted, search._pieces(iter([batch]))) for r in p.to_pylist()]
    plain = lambda r: (r["node_id"], r["length"], sorted(zip(r["terms"], r["counts"])))
    assert list(map(plain, parts)) == list(map(plain, whole.to_pylist()))
    counted = search._pieces(iter([whole]), 5)
    assert [p.num_rows for p in counted] == [5, 5, 5, 5, 1]
