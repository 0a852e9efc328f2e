"""Every registered core query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 7) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    q = duck.sql(registry.ORACLES[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    """Queries without SQL give rows of a stable schema, but for two whose input is not in the tables' texts."""
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) > 0
    assert (df.count() > 0) == (name not in ("query_anchors", "acronyms"))


def test_names_of_four_words_stay_whole(spark, tmp_path):
    """Plans without SQL hold names of three and four words as one."""
    said = [(1, 0, "user", "we met North Sea Oil Company there"), (1, 1, "user", "and North Sea Oil too, said NSOC"), (2, 0, "user", "see North Sea Oil Company")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    names = {r["name"] for r in registry.QUERIES["resolve_names"](spark, str(tmp_path)).collect()}
    assert names == {"North Sea Oil Company", "North Sea Oil", "NSOC"}
    assert [(r["short"], r["long"]) for r in registry.QUERIES["acronyms"](spark, str(tmp_path)).collect()] == [("NSOC", "North Sea Oil Company")]
    walked = {(r["query_id"], r["node_id"]): r["score"] for r in registry.QUERIES["graph_walk"](spark, str(tmp_path)).collect()}
    assert walked == {(1, 1000): 1.0, (1, 1001): 1.0, (1, 2000): 1.0, (2, 1000): 1.0, (2, 2000): 1.0, (2, 1001): 1.0}
