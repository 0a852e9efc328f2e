"""Deletions that are killed between any two steps, and what the next run makes of them."""

import pytest

from quillon.operators.deletion import Tables

KEYS = {"nodes": "source", "vectors": "source", "blobs": "owner"}
STEPS = ["tombstones", "blobs", "blobs written", "nodes", "nodes written", "vectors", "vectors written", "finished"]


class Killed(Exception):
    pass


def filled(spark, root, step=lambda name: None):
    t = Tables(spark, root, KEYS, step)
    rows = spark.range(20).selectExpr("id", "id % 5 as source", "id % 5 as owner")
    t.write("nodes", rows.select("id", "source"))
    t.write("vectors", rows.select("id", "source"))
    t.write("blobs", rows.select("owner").distinct())
    return t


def left(t, read):
    return {n: sorted(map(tuple, read(n).collect())) for n in KEYS}


@pytest.mark.parametrize("at", STEPS)
def test_killed_and_resumed(spark, tmp_path, at):
    def step(name):
        if name == at:
            raise Killed

    whole = filled(spark, f"{tmp_path}/whole")
    ids = spark.createDataFrame([(1,), (3,), (3,), (99,), (None,)], "id long")
    assert {r["table"]: r["rows"] for r in whole.estimate(ids).collect()} == {"nodes": 8, "vectors": 8, "blobs": 2}
    whole.delete(ids)
    want = left(whole, whole.read)
    assert [r[1] for r in want["nodes"]] == [r[1] for r in sorted((i, i % 5) for i in range(20)) if r[1] not in (1, 3)]
    t = filled(spark, f"{tmp_path}/killed", step)
    with pytest.raises(Killed):
        t.delete(ids)
    again = Tables(spark, f"{tmp_path}/killed", KEYS)
    if at == "tombstones":
        assert again.reconcile() == [] and left(again, again.visible)["nodes"] != want["nodes"]
        again.delete(ids)
    else:
        assert left(again, again.visible) == want
        assert len(again.reconcile()) == 1
    assert left(again, again.read) == left(again, again.visible) == want and again.reconcile() == []


def test_two_deletions_of_which_one_was_killed(spark, tmp_path):
    """A later deletion does not bring back what an unfinished one took; both end up done."""
    calls = []

    def step(name):
        calls.append(name)
        if len(calls) == 4:
            raise Killed

    t = filled(spark, str(tmp_path), step)
    with pytest.raises(Killed):
        t.delete(spark.createDataFrame([(1,)], "id long"))
    again = Tables(spark, str(tmp_path), KEYS)
    again.delete(spark.createDataFrame([(2,)], "id long"))
    assert {r["owner"] for r in again.visible("nodes").withColumnRenamed("source", "owner").collect()} == {0, 3, 4}
    again.reconcile()
    assert {r["source"] for r in again.read("nodes").collect()} == {r["source"] for r in again.read("vectors").collect()} == {0, 3, 4}
    with pytest.raises(ValueError):
        Tables(spark, str(tmp_path), {"other": "id"}).read("other")
