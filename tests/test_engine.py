"""The engine's path from documents to cited answers."""

import pytest

from quillon.engine import Engine
from quillon.operators.models import Scripted


def test_index_ask_delete(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", str(tmp_path / "pointer"), size=40, overlap=5)
    docs = spark.createDataFrame([(1, "The quick brown fox jumps."), (2, "The quick brown fox jumps."), (3, "Lazy dogs sleep all day long.")], "doc_id long, text string")
    e.index(docs)
    assert {r["source"]: r["chunks"] for r in e.coverage().collect()} == {"1": 1, "2": 1, "3": 1}
    asked = spark.createDataFrame([(1, "quick fox"), (2, "sleep")], "query_id long, text string")
    hits = {(r["query_id"], r["rank"]): r["node_id"] for r in e.retrieve(asked).collect()}
    held = {r["id"]: r["content"] for r in e.targets.read(spark).collect()}
    assert len(held) == 2 and len(hits) == 4
    out = {r["query_id"]: r for r in e.ask(asked, Scripted([], "So it is [1].")).collect()}
    assert len(out[1]["citations"]) == 1 and out[1]["citations"][0] in held
    only = e.retrieve(asked, where={"op": "contains", "field": "lineage.sources", "value": "3"})
    assert {held[r["node_id"]] for r in only.collect()} == {"Lazy dogs sleep all day long."}
    e.delete(spark.createDataFrame([("1",), ("3",)], "source string"))
    assert [(r["content"], r["sources"]) for r in e.targets.read(spark).collect()] == [("The quick brown fox jumps.", ["2"])]
    e.index(spark.createDataFrame([(4, "Another text.")], "doc_id long, text string"))
    assert e.targets.read(spark).count() == 2
    e.targets.rollback()
    assert e.targets.read(spark).count() == 1
    with pytest.raises(ValueError):
        Engine(spark, f"file://{tmp_path}/none", str(tmp_path / "no")).targets.read(spark)
