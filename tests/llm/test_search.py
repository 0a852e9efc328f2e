"""Exact search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from quillon.llm import op4_search

TERM = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, mean = len(docs), max(sum(sum(b.values()) for _, b in bags), 1) / max(len(docs), 1)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in queries:
        scored = []
        for i, b in bags:
            length = sum(b.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in set(terms(text)) if w in b)
            if round(s, 6) > 0:
                scored.append((-round(s, 6), i))
        out += [(q, r, i, pytest.approx(-s, abs=2e-6)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("limits", [(5000, 128, 1 << 20), (20, 3, 50)])
def test_search(spark, monkeypatch, limits):
    monkeypatch.setattr(op4_search, "SHARD", limits[0])
    monkeypatch.setattr(op4_search, "TOGETHER", limits[1])
    monkeypatch.setattr(op4_search, "BLOCK", 8)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["Straße", "x_1", "THE", "the"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(r.choices(vocab, weights, k=r.randint(0, 40)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, docs[3][1]), (153, docs[3][1]), (154, "unique-token here")]
    queries = [(i, t) for i, t in docs if i % 10 == 0] + [(1000, "absent"), (1001, None), (1002, "unique token")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted(tuple(x) for x in op4_search.search(q, op4_search.index(d), 5, pass_terms=limits[2]).collect())
    assert got == sorted(brute(docs, queries, 5), key=lambda x: x[:2])


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert op4_search.search(q, op4_search.index(none), 5).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert op4_search.search(q.where("query_id < 0"), op4_search.index(some), 5).count() == 0


def test_search_prunes(spark):
    """Blocks whose bound is below the k-th best are not scored, and what is found is what all blocks would give."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op4_search.index(docs).collect()
    arrays = [{k: np.frombuffer(bytes(r[k]), t) for k, t in op4_search._ARRAYS.items()} for r in rows]
    scored = there = 0
    for shard in arrays:
        n = len(shard["ids"])
        idf = np.log(1 + (n - np.diff(shard["starts"]) + 0.5) / (np.diff(shard["starts"]) + 0.5))
        s = op4_search._Shard(shard, float(shard["lengths"].mean()), np.arange(len(idf)), idf)
        term = np.repeat(np.arange(len(idf)), np.diff(shard["starts"]))
        queries = [term[shard["docs"] == d] for d in range(0, n, 17)]
        got = s.search(queries, [[] for _ in queries], 10)
        for q, hits in zip(queries, got):
            keep = np.isin(term, q)
            every = np.bincount(shard["docs"][keep], s.scores[keep], n)
            assert [i for _, i in hits] == [i for _, i in s.best(every, 10, 0.0)]
        scored, there = scored + s.scored, there + s.there
    assert 0 < scored < 0.8 * there


def test_counts_add_up_level_by_level(spark, monkeypatch):
    """However few tasks a group adds up, the document counts and so the scores are the same."""
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    queries = docs.where("doc_id % 10 = 0").selectExpr("doc_id as query_id", "text")
    indexed = op4_search.index(docs)
    want = sorted(map(tuple, op4_search.search(queries, indexed, 5).collect()))
    monkeypatch.setattr(op4_search, "FAN", 2)
    assert sorted(map(tuple, op4_search.search(queries, indexed, 5).collect())) == want and want


def test_only_what_counts_over_all_shards_is_kept(spark, monkeypatch):
    """Tasks keep no document that cannot be among a query's k best of all shards; what they keep has all of these."""
    monkeypatch.setattr(op4_search, "SHARD", 25)
    monkeypatch.setattr(op4_search, "AHEAD", 2, raising=False)
    kept = []

    def written(df, label, real=op4_search.written):
        out = real(df, label)
        if label == "hits":
            kept.append(out.count())
        return out

    monkeypatch.setattr(op4_search, "written", written)
    r = random.Random(7)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(1, 60)))) for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    queries = docs[::100]
    got = sorted(map(tuple, op4_search.search(spark.createDataFrame(queries, "query_id long, text string"), op4_search.index(d), 5).collect()))
    assert got == sorted(brute(docs, queries, 5), key=lambda x: x[:2])
    assert kept[0] < 16 * len(queries) * 5 / 2


def test_scores_in_single_precision_lose_nothing(spark):
    """Documents whose scores differ in the last places, or not at all, are ranked as by brute force."""
    r = random.Random(9)
    words = [f"v{i}" for i in range(40)]
    docs = [(i, " ".join(r.sample(words, 30) + ["and"] * (i % 7))) for i in range(600)]
    docs += [(1000 + i, docs[i][1]) for i in range(0, 600, 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    queries = docs[::50]
    got = sorted(map(tuple, op4_search.search(spark.createDataFrame(queries, "query_id long, text string"), op4_search.index(d), 10).collect()))
    assert got == sorted(brute(docs, queries, 10), key=lambda x: x[:2])
