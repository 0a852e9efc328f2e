"""The vector index: exact distances, recall, filters that few pass, rows read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import index, search


def clustered(spark, n=4000, width=16, centres=30):
    r = np.random.Generator(np.random.PCG64(4))
    middle = r.normal(size=(centres, width))
    rows = []
    for i in range(n):
        v = middle[i % centres] + 0.25 * r.normal(size=width)
        rows.append((i, v.tolist(), i % 7, i % 500 == 3))
    rows += [(n, None, 0, True), (n + 1, [0.0] * width, 0, False)]
    return spark.createDataFrame(rows, "node_id long, vector array<double>, label long, rare boolean").repartition(4)


@pytest.fixture(scope="module")
def nodes(spark):
    return clustered(spark)


@pytest.fixture(scope="module")
def held(nodes):
    return index.build(nodes)


@pytest.fixture(scope="module")
def asked(nodes):
    return nodes.where("node_id % 100 = 0 and vector is not null").select(F.col("node_id").alias("query_id"), "vector")


def rows(hits):
    return {(r["query_id"], r["node_id"]): r["score"] for r in hits.collect()}


def test_recall_and_exact_distances(nodes, held, asked):
    want = rows(search.vector_top_k(asked, nodes, 20))
    hits, report = index.probed_top_k(held, asked, 20, least=8)
    got = rows(hits)
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[x] - want[x]) < 1e-8 for x in got.keys() & want.keys())
    assert sum(held.sizes) == 4001 and report[0]["questions"] == 40


def test_few_cells_are_read_for_one_question(held, asked):
    one = asked.orderBy("query_id").limit(1)
    _, report = index.probed_top_k(held, one, 20, least=8)
    assert sum(r["rows"] for r in report) < 0.4 * sum(held.sizes)
    _, report = index.probed_top_k(held, one, 20, exact=True)
    assert sum(r["rows"] for r in report) < 0.6 * sum(held.sizes)


@pytest.mark.parametrize("where,k", [(None, 20), ("label = 3", 10), ("rare", 5), ("rare and label = 6", 20), ("false", 3)])
def test_exact(nodes, held, asked, where, k):
    """With `exact` the answer is the full scan's, whatever the filter leaves."""
    want = rows(search.vector_top_k(asked, nodes, k, where=None if where is None else F.expr(where)))
    assert rows(index.probed_top_k(held, asked, k, where=where, exact=True)[0]) == want


def test_filter_that_few_pass_costs_rounds_not_hits(nodes, held, asked):
    hits, report = index.probed_top_k(held, asked, 5, where="rare", first=1)
    assert len(report) > 2 and hits.groupBy("query_id").count().where("count = 5").count() == 40


def test_all_in_one_cell_and_none(spark, nodes, asked):
    same = spark.range(300).selectExpr("id as node_id", "array(1d, 2d) as vector")
    one = same.where("node_id = 7").select(F.col("node_id").alias("query_id"), "vector")
    hits, _ = index.probed_top_k(index.build(same), one, 3, exact=True)
    assert sorted(r["node_id"] for r in hits.collect()) == [0, 1, 2]
    none = index.build(nodes.limit(0))
    assert index.probed_top_k(none, asked, 3)[0].count() == 0
    with pytest.raises(Exception, match="width"):
        index.build(same.union(spark.sql("select 900L, array(1d)")), cells=2)
