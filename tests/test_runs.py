"""Choice of invocations and evidence against plain restatements."""

import random
from collections import defaultdict
from statistics import mean

import pytest
from pyspark.sql import functions as F

from quillon.operators import runs

RECORD = "experiment string, digest string, invocation string, arm string, repetition int, started long, metric string, question_id long, value double"


def made():
    r = random.Random(2)
    rows = []
    for inv, left_out in (("i1", None), ("i2", ("b", 1)), ("i3", None)):
        for arm, repeats in (("a", 3), ("b", 2), ("c", 1)):
            for rep in range(repeats + 1):
                if (arm, rep) == left_out:
                    continue
                rows += [("one", "d", inv, arm, rep, int(inv[1]) * 100 + k, "m", q, r.choice([None, 0.0, 0.5, 1.0])) for q in range(6) for k in range(r.randint(1, 3))]
    rows += [("two", "d", "i1", "a", 0, 5, "m", 1, 1.0), ("one", "other", "i9", "a", 0, 999, "m", 1, 1.0)]
    return rows + rows[:4]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(made(), RECORD).repartition(3)


@pytest.fixture(scope="module")
def grid(spark):
    rows = [("one", "d", "a", 3, True), ("one", "d", "b", 2, False), ("one", "d", "c", 1, False), ("two", "d", "a", 2, True), ("three", "d", "a", 1, True)]
    return spark.createDataFrame(rows, "experiment string, digest string, arm string, repeats int, baseline boolean")


def outcome(choice):
    return {r["experiment"]: (r["outcome"], r["invocation"], r["complete"]) for r in choice.collect()}


def test_choice(spark, records, grid):
    found = runs.completeness(records, grid)
    assert {(r["experiment"], r["invocation"]): r["missing"] for r in found.collect()} == {("one", "i1"): [], ("one", "i2"): ["b#1"], ("one", "i3"): [], ("two", "i1"): ["a#1"]}
    rest = {"two": ("incomplete", None, 0), "three": ("incomplete", None, 0)}
    assert outcome(runs.chosen(found, grid)) == {"one": ("ambiguous", None, 2)} | rest
    assert outcome(runs.chosen(found, grid, "latest")) == {"one": ("chosen", "i3", 2)} | rest
    name = lambda x: spark.createDataFrame([("one", x)], "experiment string, invocation string")
    assert outcome(runs.chosen(found, grid, named=name("i1")))["one"] == ("chosen", "i1", 1)
    assert outcome(runs.chosen(found, grid, "latest", name("i2")))["one"] == ("incomplete", None, 0)
    early = runs.completeness(runs.as_of(records, F.lit(299)), grid)
    assert outcome(runs.chosen(early, grid)) == {"one": ("chosen", "i1", 1)} | rest
    with pytest.raises(ValueError):
        runs.chosen(found, grid, "any")


def test_evidence(spark, records, grid):
    stood = {}
    for e, d, inv, arm, rep, started, _, q, v in made():
        key = (e, d, inv, arm, rep, q)
        stood[key] = max(stood.get(key, ((-1, False, 0.0), None)), ((started, v is not None, v or 0.0), v), key=lambda x: x[0])
    said = defaultdict(dict)
    for (e, d, inv, arm, rep, q), (_, v) in stood.items():
        if (e, d, inv) == ("one", "d", "i3") and v is not None and rep < {"a": 3, "b": 2, "c": 1}[arm]:
            said[arm][rep, q] = v
    means = [mean(v for (rep, _), v in said["a"].items() if rep == k) for k in sorted({rep for rep, _ in said["a"]})]
    low, high = min(means), max(means)
    seen = runs.as_of(records)
    got = {r["arm"]: r for r in runs.evidence(seen, runs.chosen(runs.completeness(seen, grid), grid, "latest"), grid).collect()}
    assert got.keys() == {"b", "c"}
    for arm, r in got.items():
        pairs = [v - said["a"][k] for k, v in said[arm].items() if k in said["a"]]
        assert r["n"] == len(pairs) and r["delta"] == pytest.approx(mean(pairs), abs=1e-8) and r["arm_mean"] == pytest.approx(mean(said[arm].values()), abs=1e-8)
        assert (r["low"], r["high"], r["baseline_mean"]) == pytest.approx((low, high, mean(said["a"].values())), abs=1e-8)
        assert r["verdict"] == ("beyond spread" if abs(mean(pairs)) > high - low else "within spread")
    none = runs.evidence(seen, runs.chosen(runs.completeness(seen, grid), grid), grid)
    assert none.count() == 0
