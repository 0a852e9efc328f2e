"""Loops with scripted judges, lifecycle and comparison operators, fixed by hand."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import metrics
from quillon.operators import graph, loops, store
from quillon.operators.models import Scripted


@pytest.fixture(scope="module")
def contents(spark):
    return spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "node_id long, content string")


def by_word(contents):
    def retrieve(queries):
        hits = queries.join(contents, F.contains("text", F.col("content"))).select("query_id", "node_id", F.lit(1.0).alias("score"))
        return hits.withColumn("rank", (F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("query_id").orderBy("node_id")) - 1))

    return retrieve


def test_iterative(spark, contents):
    queries = spark.createDataFrame([(1, "alpha?"), (2, "alpha then beta"), (3, "none")], "query_id long, text string")
    critic = loops.model_critic(Scripted([(r"Question: alpha\?\n\[1\] alpha\n\n\[2\] gamma", '{"sufficient": true, "missing": []}'), (r"Question: alpha\?", '{"sufficient": false, "missing": ["gamma"]}'), ("none", "no JSON")], '{"sufficient": false, "missing": []}'))
    hits, stops = loops.iterative(queries, by_word(contents), contents, critic)
    assert {r["query_id"]: (r["rounds"], r["reason"]) for r in stops.collect()} == {1: (2, "sufficient"), 2: (2, "no-new-evidence"), 3: (1, "unobserved")}
    assert sorted((r["query_id"], r["node_id"], r["rank"]) for r in hits.collect()) == [(1, 1, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1)]
    out = loops.refined(queries.where("query_id = 1"), by_word(contents), contents, Scripted([], "drafted"), critic)
    assert [(r["answer"], r["rounds"]) for r in out.collect()] == [("drafted", 2)]


def test_graded_and_corrective(spark, contents):
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    grader = lambda hits: loops.graded(hits, contents, queries, Scripted([("Passage: beta", "0.9")], "0.1"))
    assert [(r["node_id"], r["rank"]) for r in grader(by_word(contents)(queries)).collect()] == [(2, 0)]
    both = loops.corrective(queries, by_word(contents), by_word(contents), grader)
    assert sorted((r["arm"], r["node_id"]) for r in both.collect()) == [("other", 1), ("other", 2), ("primary", 2)]
    with pytest.raises(ValueError):
        loops.multi_retriever(queries, [("one", by_word(contents))])
    assert loops.multi_retriever(queries, [("one", by_word(contents)), ("two", by_word(contents))]).count() == 4


def test_transforms(spark, contents):
    queries = spark.createDataFrame([(1, "it?"), (2, "alpha?")], "query_id long, text string")
    history = spark.createDataFrame([(1, "about alpha"), (2, "")], "query_id long, history string")
    out = {r["query_id"]: r["text"] for r in loops.rewritten(queries, history, Scripted([], "alpha, it?")).collect()}
    assert out == {1: "alpha, it?", 2: "alpha?"}
    assert loops.step_back(queries, Scripted([("it", "what in general?")])).count() == 3
    s = loops.scored_queries(queries, Scripted([("it", '{"depth": 0.5, "width": 7}')]), ["depth", "width"]).orderBy("query_id").collect()
    assert (s[0]["depth"], s[0]["width"], s[1]["depth"]) == (0.5, None, None)
    hits = spark.createDataFrame([(1, 1, 0.5, 0), (1, 2, 0.9, 1)], "query_id long, node_id long, score double, rank int")
    assert [(r["content"], r["score"]) for r in loops.summarised(hits, contents, queries, Scripted([], "sum"), 2).collect()] == [("sum", 0.9)]
    answers = spark.createDataFrame([(1, "so"), (2, "not so")], "query_id long, answer string")
    passages = spark.createDataFrame([(1, 1, "x")], "query_id long, label int, content string")
    assert {r["query_id"]: r["stance"] for r in loops.contradicted(answers, passages, Scripted([("Answer: so", "Yes.")], "?")).collect()} == {1: "contradicted", 2: "undetermined"}


def test_comparisons(spark):
    diffs = spark.createDataFrame([("a", 0.5), ("b", 0.01), ("c", 0.2)], "metric string, mean double")
    spreads = spark.createDataFrame([("a", 0.0, 0.1), ("b", 0.0, 0.1), ("d", 0.0, 0.1)], "metric string, low double, high double")
    assert {r["metric"]: r["judgement"] for r in metrics.judge_differences(diffs, spreads).collect()} == {"a": "outside", "b": "within", "c": "unjudgeable", "d": "unjudgeable"}
    q = spark.createDataFrame([("q1", ["x", "y"]), ("q2", ["x"])], "question_id string, documents array<string>")
    d = spark.createDataFrame([("x", "open"), ("y", "closed")], "document string, tier string")
    assert [r["question_id"] for r in metrics.in_tiers(q, d, ["open"]).collect()] == ["q2"]
    labels = spark.createDataFrame([("b/c.txt",), ("c.txt",), ("z",)], "label string")
    paths = spark.createDataFrame([("/a/b/c.txt",), ("/d/c.txt",), ("/d/xc.txt",)], "document string")
    assert {r["label"]: (r["document"], r["matches"]) for r in metrics.resolve_labels(labels, paths).collect()} == {"b/c.txt": ("/a/b/c.txt", 1), "c.txt": (None, 2), "z": (None, 0)}
    hits = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 20, 2)], "query_id long, node_id long, rank int")
    docs = spark.createDataFrame([(10, "d1"), (11, "d1"), (20, "d2")], "node_id long, document string")
    assert [(r["node_id"], r["rank"]) for r in metrics.first_by_document(hits, docs, 5).orderBy("rank").collect()] == [("d1", 0), ("d2", 1)]
    low, high = metrics.pooled_interval([1.0, 0.0, 2.0], [2, 1, 3])
    assert 0 <= low <= high <= 1
    assert metrics.storage_projection(1000, 10, 64, "binary") == 80_000
    assert metrics.implies({"n": (2, 5)}, {"n": (0, 10)}) and not metrics.implies({}, {"n": (0, 10)})
    assert metrics.set_digest(q) == metrics.set_digest(q.orderBy(F.desc("question_id")).select("documents", "question_id"))
    v = spark.createDataFrame([(1, "tp"), (1, "fp"), (1, "fn")], "question_id int, verdict string")
    sim = spark.createDataFrame([(1, 0.8)], "question_id int, similarity double")
    assert metrics.answer_correctness(v, sim).first()["score"] == pytest.approx(0.75 * 0.5 + 0.25 * 0.8)
    r = spark.createDataFrame([("the cat sat", "a cat sat down")], "a string, b string").select(metrics.key_term_precision(F.col("a"), F.col("b"), ["the"]).alias("k"), metrics.overlap_at(F.col("a"), F.col("b"), 0.5).alias("o")).first()
    assert (r["k"], r["o"]) == (1.0, 1.0)
    calls = spark.createDataFrame([("ask", "m", 1000, 500), ("ask", "m", 1000, 500)], "role string, model string, prompt long, completion long")
    assert metrics.usage(calls, spark.createDataFrame([("m", 1.0, 2.0)], "model string, price_in double, price_out double")).first()["cost"] == pytest.approx(0.004)


def test_lifecycle(spark):
    stored = spark.createDataFrame([("o", "old", ["a", "b"]), ("k", "keep", ["c"])], "id string, content string, sources array<string>")
    new = spark.createDataFrame([("n", "new", ["a", "b", "c"])], stored.schema)
    assert sorted(r["id"] for r in store.supersede(stored, "o", new).collect()) == ["k", "n"]
    assert sorted(r["id"] for r in store.supersede(store.supersede(stored, "o", new), "o", new).collect()) == ["k", "n"]
    with pytest.raises(Exception, match="fewer sources"):
        store.supersede(stored, "o", spark.createDataFrame([("n", "new", ["a"])], stored.schema)).collect()
    made = spark.createDataFrame([("n", "a", "a"), ("m", "b", "b")], "node_id string, production string, source string")
    left, report = store.reconcile(made, spark.createDataFrame([("a", "deleting"), ("b", "active")], "id string, status string"))
    assert report.first().asDict() == {"examined": 1, "removed": 1, "narrowed": 0}
    g = spark.createDataFrame([], "id string, layer string, status string, published_at timestamp")
    g = store.open_generation(store.open_generation(g, "g1", "tree"), "g2", "tree")
    g = store.set_generation(g, "g1", "published")
    assert [r["id"] for r in store.newest_published(g).collect()] == ["g1"]
    assert [r["id"] for r in store.hidden_generations(g).collect()] == ["g2"]


def test_graph_upkeep(spark):
    pairs = spark.createDataFrame([("a", "b", 0.7), ("a", "c", 0.7), ("a", "d", 0.9)], "a string, b string, score double")
    resolved = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "name string, entity string")
    assert [(r["a"], r["b"]) for r in graph.adjudication_band(pairs, resolved, 0.6, 0.83).collect()] == [("a", "c")]
    out = graph.orphans(spark.createDataFrame([("e1",), ("e2",)], "entity string"), spark.createDataFrame([("x", "e1"), ("y", "e2")], "alias string, entity string"), spark.createDataFrame([("x", 1)], "alias string, node_id int"))
    assert [r["entity"] for r in out.collect()] == ["e2"]
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "node_id int, name string")
    assert [(r["both"], r["either"]) for r in graph.ceiling(found, spark.createDataFrame([("a", "b")], "a string, b string")).collect()] == [(1, 3)]


def test_nearest_rank_of_a_large_group(spark):
    """A group over many tasks, ties, nulls and groups without a value."""
    import math
    import random

    r = random.Random(4)
    rows = [("big", float(r.randint(0, 50))) for _ in range(5000)] + [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0), (None, None)] + [("few", float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "kind string, value double").repartition(7)
    for q in (0.5, 0.95, 1.0):
        want = {}
        for kind in ("big", "one", "none", None, "few"):
            v = sorted(x for k, x in rows if k == kind and x is not None)
            at = math.ceil(q * len(v))
            want[kind] = (len(v), v[at - 1] if at < len(v) else None)
        assert {x["kind"]: (x["n"], x["value"]) for x in metrics.nearest_rank(df, q, "kind").collect()} == want
    assert metrics.nearest_rank(df.drop("kind"), 0.5).collect()[0]["n"] == 5043


def test_relevant_nodes_are_counted_not_listed(spark):
    """Scores from counts are those from lists, and the query forms no pair of a question and a relevant node."""
    hits = spark.createDataFrame([(q, n, r) for q in (1, 2) for r, n in enumerate((3, 5, 8, 4))], "query_id long, node_id long, rank int")
    relevant = spark.createDataFrame([(1, n) for n in (5, 4, 90, 91)] + [(2, 99), (3, 7)], "query_id long, node_id long")
    many = relevant.groupBy("query_id").count().withColumnRenamed("count", "n")
    good = hits.join(relevant, ["query_id", "node_id"], "left_semi").select("query_id", "rank")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(metrics.counted_scores(good, many, 3)) == rows(metrics.ranking_scores(hits, relevant, 3)) and many.count() == 3


def test_resamples_are_drawn_in_parts(monkeypatch):
    """Only the stream is held whole, and the bounds are the same by any part."""
    import tracemalloc

    data = [float(i % 7) - 2.5 for i in range(1500)]
    tracemalloc.start()
    whole = metrics.bootstrap_interval(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pooled = metrics.pooled_interval(data[:50], [i % 3 for i in range(50)])
    monkeypatch.setattr(metrics, "DRAWS", 100)
    assert metrics.bootstrap_interval(data) == whole and metrics.pooled_interval(data[:50], [i % 3 for i in range(50)]) == pooled
    assert peak < 4 * 2000 * 1500 * 5


def test_a_long_stream_is_not_held(monkeypatch):
    """A stream beyond what is held goes by way of a file: the same bytes and bounds, a small part in memory."""
    import hashlib
    import tracemalloc

    data = [float(i % 7) - 2.5 for i in range(1500)]
    whole = metrics.bootstrap_interval(data)
    assert b"".join(metrics._stream(b"seed", 10_001, 4096)) == hashlib.shake_256(b"seed").digest(10_001)
    monkeypatch.setattr(metrics, "HELD", 1000)
    monkeypatch.setattr(metrics, "DRAWS", 10_000)
    tracemalloc.start()
    by_file = metrics.bootstrap_interval(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert by_file == whole and peak < 2000 * 1500 * 5 / 4
    assert b"".join(metrics._stream(b"seed", 3_000_001, 4096)) == hashlib.shake_256(b"seed").digest(3_000_001)
    monkeypatch.setattr(metrics.ctypes.util, "find_library", lambda name: "no such library")
    assert metrics.bootstrap_interval(data) == whole
