"""Boolean trees, filters of questions and cover density against plain restatements."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import boolean, filtered, filters, positional, search


def texts(r, n=120):
    vocab = ["red", "green", "blue", "grau", "é", "one", "two", "and", "or"]
    return [None, "", "  ", *[" ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 8, 40]))) for _ in range(n)]]


def brute_covers(words, terms):
    """Every least stretch, by looking at all of them."""
    n = len(words)
    whole = [(a, b) for a in range(n) for b in range(a, n) if terms <= set(words[a : b + 1])]
    return [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("normalization", [0, 1, 2, 4, 8, 16, 32, 63])
def test_cover_rank(spark, every, normalization):
    r = random.Random(3)
    said = texts(r)
    asked = ["red blue", "red", "one two grau", "nowhere red", "", "Red RED é"]
    nodes = spark.createDataFrame(list(enumerate(said)), "node_id long, content string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    want = {}
    for q, a in enumerate(asked):
        terms = set(re.findall(r"\w+", a.lower()))
        for n, t in enumerate(said):
            words = re.findall(r"\w+", (t or "").lower())
            if not terms or not (terms <= set(words) if every else terms & set(words)):
                continue
            stretches = brute_covers(words, terms) if every else [(i, i) for i, w in enumerate(words) if w in terms]
            v = sum(0.1 / (1 + sum(w not in terms for w in words[x : y + 1])) for x, y in stretches)
            gaps = [1 / ((c + d - a - b) / 2) for (a, b), (c, d) in zip(stretches, stretches[1:])]
            for bit, by in ((1, math.log(len(words) + 1)), (2, len(words)), (4, len(stretches) / sum(gaps) if gaps else 1), (8, len(set(words))), (16, math.log2(len(set(words)) + 1))):
                v = v / by if normalization & bit else v
            want[q, n] = v / (v + 1) if normalization & 32 else v
    got = {(x["query_id"], x["node_id"]): x["score"] for x in positional.cover_rank(queries, nodes, 1000, every=every, normalization=normalization).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if normalization == 63:
        index = positional.positions(nodes)
        assert {(x["query_id"], x["node_id"]): x["score"] for x in positional.cover_rank(queries, nodes, 1000, every=every, normalization=63, index=index).collect()} == got


def test_boolean(spark):
    """Nested trees, phrases, precedence; what cannot be answered says so."""
    r = random.Random(5)
    said = texts(r)
    has = [set(re.findall(r"\w+", (t or "").lower())) for t in said]
    trees = {
        "red": lambda w: "red" in w,
        "red and blue or green": lambda w: {"red", "blue"} <= w or "green" in w,
        "red or blue and green": lambda w: "red" in w or {"blue", "green"} <= w,
        "red and not (blue and not green)": lambda w: "red" in w and not ("blue" in w and "green" not in w),
        "(red or blue) and (one or (two and not grau))": lambda w: bool(w & {"red", "blue"}) and ("one" in w or ("two" in w and "grau" not in w)),
        '"red and" and "or"': lambda w: {"red", "and", "or"} <= w,
        "RED AND NOT nowhere": lambda w: "red" in w,
        "red and nowhere": lambda w: False,
        "nowhere or nothing": lambda w: False,
        "red and not red": lambda w: False,
    }
    wrong = ["not red", "red or not blue", "not (red and blue) and not green", "red and", "(red", "red blue", "((((red))))", "", None, "red and not (not blue)"]
    asked = [*trees, *wrong]
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string").repartition(3)
    nodes = spark.createDataFrame(list(enumerate(said)), "node_id long, content string")
    hits, told = boolean.boolean_retrieval(questions, nodes)
    got = {(x["query_id"], x["node_id"]) for x in hits.collect()}
    assert got == {(q, n) for q, (_, holds) in enumerate(trees.items()) for n, w in enumerate(has) if holds(w)}
    outcome = {x["query_id"]: (x["outcome"], x["note"]) for x in told.collect()}
    assert len(outcome) == len(asked)
    for q, a in enumerate(asked):
        want = "failed" if a in wrong else "hits" if any(x == q for x, _ in got) else "no hits" if a == "nowhere or nothing" else "empty conjunction"
        assert outcome[q][0] == want and (outcome[q][1] is None) == (want in ("hits", "no hits")), (a, outcome[q])
    first = [x for x in hits.collect() if asked[x["query_id"]] == "red and blue or green"]
    count = lambda n, w: re.findall(r"\w+", said[n].lower()).count(w)
    assert all(x["score"] == max(count(x["node_id"], "green"), count(x["node_id"], "red") if {"red", "blue"} <= has[x["node_id"]] else 0) for x in first)
    with pytest.raises(Exception, match="no node holds red and nowhere"):
        boolean.boolean_retrieval(questions, nodes, on_empty="fail")[1].collect()
    none, told = boolean.boolean_retrieval(questions.limit(0), nodes)
    assert none.count() == 0 and told.count() == 0
    assert boolean.boolean_retrieval(questions, nodes.limit(0))[0].count() == 0


FILTERS = [
    None,
    {"op": "eq", "field": "kind", "value": "a"},
    {"op": "eq", "field": "kind", "value": "b"},
    {"op": "ne", "field": "kind", "value": "a"},
    {"op": "in", "field": "size", "value": [1, 3]},
    {"op": "in", "field": "size", "value": [2]},
    {"op": "lt", "field": "size", "value": 3},
    {"op": "gte", "field": "size", "value": 4},
    {"op": "exists", "field": "kind"},
    {"op": "contains", "field": "tags", "value": "x"},
    {"op": "in", "field": "sources", "value": ["s1", "s2"]},
    {"op": "not", "clauses": [{"op": "eq", "field": "kind", "value": "a"}]},
    {"op": "and", "clauses": [{"op": "gt", "field": "size", "value": 1}, {"op": "or", "clauses": [{"op": "eq", "field": "kind", "value": "a"}, {"op": "not", "clauses": [{"op": "lte", "field": "size", "value": 4}]}]}]},
    {"op": "eq", "field": "kind", "value": "none has this"},
]


def filtered_nodes(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], r.choice(["a", "b", None]), r.choice([1, 2, 3, 4, 5, None]), r.choice([["x"], ["y", "x"], [], None]), r.choice([["s1"], ["s2", "s3"], []])) for i in range(150)]
    rows += [(150, None, "a", 1, ["x"], ["s1"]), (151, [0.0] * 4, "a", 1, None, None)]
    return spark.createDataFrame(rows, "node_id long, vector array<double>, kind string, size long, tags array<string>, sources array<string>").repartition(3)


def test_each_question_has_its_filter(spark):
    """Hits are those of a search of its own with the filter as a predicate."""
    nodes = filtered_nodes(spark)
    r = random.Random(7)
    asked = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)], json.dumps(f) if f else None) for i, f in enumerate(FILTERS * 2)], "query_id long, vector array<double>, filter string")
    for where in (None, {"op": "lt", "field": "size", "value": 5}):
        got = {(x["query_id"], x["rank"]): (x["node_id"], x["score"]) for x in filtered.vector_top_k_each(asked, nodes, 7, where=where).collect()}
        for i, f in enumerate(FILTERS * 2):
            held = nodes if f is None else filters.matching(nodes, f)
            held = held if where is None else filters.matching(held, where)
            want = {(i, x["rank"]): (x["node_id"], x["score"]) for x in search.vector_top_k(asked.where(F.col("query_id") == i), held, 7).collect()}
            assert {k: v for k, v in got.items() if k[0] == i} == want, f
    assert filtered.vector_top_k_each(asked.limit(0), nodes).count() == 0


def test_scans_are_by_shape_and_pushed(spark):
    shapes = {filtered.shape_of(f)[0] for f in FILTERS}
    assert len(shapes) == 11
    wide = filtered.widened(filtered.shape_of(FILTERS[12])[0], [[1, "a", 4], [0, "b", 9]])
    assert wide == {"op": "gt", "field": "size", "value": 0}
    assert filtered.widened(("and", ("eq", "kind"), ("lt", "size")), [["a", 3], ["b", 9]]) == {"op": "and", "clauses": [{"op": "in", "field": "kind", "value": ["a", "b"]}, {"op": "lt", "field": "size", "value": 9}]}
    asked = spark.createDataFrame([(1, [1.0] * 4, '{"op": "lt", "field": "kind", "value": "a"}')], "query_id long, vector array<double>, filter string")
    with pytest.raises(ValueError):
        filtered.vector_top_k_each(asked, filtered_nodes(spark))


def test_a_negated_comparison_of_a_missing_text_holds(spark):
    nodes = spark.createDataFrame([("a", "x"), (None, "y")], "content string, id string")
    assert [r["id"] for r in filters.matching(nodes, {"op": "not", "clauses": [{"op": "eq", "field": "content", "value": "a"}]}).collect()] == ["y"]
