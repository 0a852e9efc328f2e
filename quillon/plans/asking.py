"""Plans of questions that bring more than words: an index, a filter, places, a Boolean tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.identity import cosine, tokens
from quillon.operators import boolean, filtered, index, positional
from quillon.plans import sql
from quillon.plans.retrieval import _asked, _questions, _texts, _vectors, _whole


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of even label to every hundredth embedding, by the index, probed until the answer is exact."""
    nodes = _vectors(spark, sf_dir)
    return _whole(index.probed_top_k(index.build(nodes), _asked(nodes), 10, where="label % 2 = 0", exact=True)[0])


def vector_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What half of the index gives for every hundredth embedding: how many hits, and whether each has its exact cosine."""
    nodes = _vectors(spark, sf_dir)
    held = index.build(nodes)
    hits, _ = index.probed_top_k(held, _asked(nodes), 20, least=max(1, len(held.centres) // 2))
    full = hits.join(nodes.select("node_id", "vector"), "node_id").join(_asked(nodes).withColumnRenamed("vector", "asked"), "query_id")
    right = F.abs(F.col("score") - cosine(F.col("vector"), F.col("asked"))) < 1e-8
    return full.groupBy("query_id").agg(F.count("*").alias("hits"), F.every(right).alias("exact"))


def vector_filtered_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth embedding asks with a filter of its own, of four shapes."""
    nodes = _vectors(spark, sf_dir)
    turn = F.col("query_id") / 100
    n = turn.cast("long")
    eq = F.format_string('{"op": "eq", "field": "label", "value": %d}', n % 10)
    both = F.format_string('{"op": "and", "clauses": [{"op": "gte", "field": "label", "value": %d}, {"op": "not", "clauses": [{"op": "in", "field": "label", "value": [6, %d]}]}]}', n % 5, n % 10)
    less = F.format_string('{"op": "lt", "field": "label", "value": %d}', n % 10 + 1)
    asked = _asked(nodes).withColumn("filter", F.when(n % 4 == 0, eq).when(n % 4 == 1, both).when(n % 4 == 2, less))
    return _whole(filtered.vector_top_k_each(asked, nodes, 10))


def cover_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover density of the documents that hold every term of a passage, under all normalisations."""
    return _whole(positional.cover_rank(_questions(spark, sf_dir), _texts(spark, sf_dir), 20, normalization=63))


def cover_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover density of the documents that hold any term of a passage, divided by length and distances."""
    return _whole(positional.cover_rank(_questions(spark, sf_dir), _texts(spark, sf_dir), 20, every=False, normalization=7))


def _boolean(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each passage asks with four of its terms, in trees of five kinds."""
    asked = _questions(spark, sf_dir).withColumn("t", F.array_sort(F.array_distinct(tokens(F.col("text")))))
    n = F.size("t")
    a, b, c, d = (F.concat(F.lit('"'), F.element_at("t", i.cast("int")), F.lit('"')) for i in (F.lit(1), n, F.floor(n / 2) + 1, F.floor(n / 3) + 1))
    kind = F.col("query_id") % 5
    text = (
        F.when(kind == 0, F.concat(a, F.lit(" and "), b))
        .when(kind == 1, F.concat(a, F.lit(" and ("), b, F.lit(" or "), c, F.lit(") and not "), d))
        .when(kind == 2, F.concat(F.lit("("), a, F.lit(" or "), b, F.lit(") and not ("), c, F.lit(" and "), d, F.lit(")")))
        .when(kind == 3, F.concat(a, F.lit(" or "), b, F.lit(" and "), c))
        .otherwise(F.concat(a, F.lit(" and not "), a))
    )
    return boolean.boolean_retrieval(asked.select("query_id", text.alias("text")), _texts(spark, sf_dir))


def boolean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(_boolean(spark, sf_dir)[0])


def boolean_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boolean(spark, sf_dir)[1]


_T = "(q.vec_id // 100)"
_EACH = f"CASE {_T} % 4 WHEN 0 THEN e.label = {_T} % 10 WHEN 1 THEN e.label >= {_T} % 5 AND e.label NOT IN (6, {_T} % 10) WHEN 2 THEN e.label < {_T} % 10 + 1 ELSE true END"
_PLACES = f"""
questions AS (SELECT item_id AS query_id, text FROM benchmark),
l AS (SELECT doc_id AS node_id, regexp_extract_all(lower(text), '{sql.TOKEN}') AS w FROM documents),
t AS (SELECT node_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM l),
size AS (SELECT node_id, len(w) AS length, len(list_distinct(w)) AS uniq FROM l),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{sql.TOKEN}')) AS term FROM questions),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY ALL),
o AS (SELECT query_id, node_id, term, place FROM t JOIN q USING (term))"""
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM r) WHERE rank < 20"
_BOOL = f"""
q AS (SELECT item_id AS query_id, list_sort(list_distinct(regexp_extract_all(lower(text), '{sql.TOKEN}'))) AS t FROM benchmark),
k AS (SELECT query_id, query_id % 5 AS kind, t[1] AS a, t[len(t)] AS b, t[len(t) // 2 + 1] AS c, t[len(t) // 3 + 1] AS d FROM q),
w AS (SELECT doc_id AS node_id, unnest(regexp_extract_all(lower(text), '{sql.TOKEN}')) AS term FROM documents),
f AS (SELECT node_id, term, count(*) AS n FROM w GROUP BY ALL),
m AS (
    SELECT query_id, kind, node_id, coalesce(sum(n) FILTER (term = a), 0) AS a, coalesce(sum(n) FILTER (term = b), 0) AS b, coalesce(sum(n) FILTER (term = c), 0) AS c, coalesce(sum(n) FILTER (term = d), 0) AS d
    FROM k JOIN f ON f.term IN (a, b, c, d) GROUP BY ALL
), s AS (
    SELECT query_id, node_id, (CASE kind WHEN 2 THEN greatest(a, b) WHEN 3 THEN greatest(a, CASE WHEN b > 0 AND c > 0 THEN b ELSE 0 END) ELSE a END)::DOUBLE AS score FROM m
    WHERE CASE kind WHEN 0 THEN a > 0 AND b > 0 WHEN 1 THEN a > 0 AND (b > 0 OR c > 0) AND d = 0 WHEN 2 THEN (a > 0 OR b > 0) AND NOT (c > 0 AND d > 0) WHEN 3 THEN a > 0 OR b > 0 AND c > 0 ELSE false END
)"""

PLANS = {
    "vector_index": (vector_index, f"WITH {sql.vectors('e.label % 2 = 0', 10, 'even')} SELECT query_id, node_id, score, rank::INT AS rank FROM even"),
    "vector_probed": (vector_probed, "SELECT vec_id AS query_id, 20::BIGINT AS hits, true AS exact FROM embeddings WHERE vec_id % 100 = 0"),
    "vector_filtered_each": (vector_filtered_each, f"WITH {sql.vectors(_EACH, 10)} SELECT query_id, node_id, score, rank::INT AS rank FROM near"),
    "cover_every": (cover_every, f"""
        WITH {_PLACES}, h AS (SELECT query_id, node_id FROM o JOIN need USING (query_id) GROUP BY query_id, node_id, need HAVING count(DISTINCT term) = need),
        p AS (SELECT o.* FROM o JOIN h USING (query_id, node_id)),
        ends AS (SELECT x.query_id, x.node_id, x.place AS e, y.term, max(y.place) AS last FROM p x JOIN p y ON x.query_id = y.query_id AND x.node_id = y.node_id AND y.place <= x.place GROUP BY ALL),
        m AS (SELECT query_id, node_id, e, min(last) AS b FROM ends JOIN need USING (query_id) GROUP BY query_id, node_id, e, need HAVING count(*) = need),
        c AS (SELECT * FROM (SELECT *, lag(b) OVER (PARTITION BY query_id, node_id ORDER BY e) AS before FROM m) WHERE before IS NULL OR b > before),
        n AS (SELECT c.query_id, c.node_id, c.b, c.e, count(*) AS n FROM c JOIN p ON p.query_id = c.query_id AND p.node_id = c.node_id AND p.place BETWEEN c.b AND c.e GROUP BY ALL),
        g AS (SELECT *, (b + e) / 2 - lag((b + e) / 2) OVER (PARTITION BY query_id, node_id ORDER BY e) AS gap FROM n),
        x AS (SELECT query_id, node_id, sum(0.1::DOUBLE / (1 + (e - b) - (n - 1))) AS total, count(*) AS k, coalesce(sum(1 / gap) FILTER (gap > 0), 0) AS apart FROM g GROUP BY ALL),
        y AS (SELECT query_id, node_id, total / ln(length + 1) / length * CASE WHEN apart > 0 THEN apart / k ELSE 1 END / uniq / log2(uniq + 1) AS v FROM x JOIN size USING (node_id)),
        r AS (SELECT query_id, node_id, round(v / (v + 1), 12) AS score FROM y)
        SELECT query_id, node_id, score, rank::INT AS rank FROM {_RANKED}"""),
    "cover_any": (cover_any, f"""
        WITH {_PLACES}, g AS (SELECT *, place - lag(place) OVER (PARTITION BY query_id, node_id ORDER BY place) AS gap FROM o),
        x AS (SELECT query_id, node_id, 0.1::DOUBLE * count(*) AS total, count(*) AS k, coalesce(sum(1.0::DOUBLE / gap), 0) AS apart FROM g GROUP BY ALL),
        r AS (SELECT query_id, node_id, round(total / ln(length + 1) / length * CASE WHEN apart > 0 THEN apart / k ELSE 1 END, 12) AS score FROM x JOIN size USING (node_id))
        SELECT query_id, node_id, score, rank::INT AS rank FROM {_RANKED}"""),
    "boolean_documents": (boolean_documents, f"""
        WITH {_BOOL} SELECT query_id, node_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1)::INT AS rank FROM s"""),
    "boolean_outcomes": (boolean_outcomes, f"""
        WITH {_BOOL}, r AS (SELECT k.*, query_id IN (SELECT query_id FROM s) AS found FROM k)
        SELECT query_id, CASE WHEN found THEN 'hits' WHEN kind = 3 THEN 'no hits' ELSE 'empty conjunction' END AS outcome,
            CASE WHEN NOT found AND kind <> 3 THEN 'no node holds ' || CASE kind WHEN 0 THEN a || ' and ' || b WHEN 1 THEN a || ' and (...) and not ' || d WHEN 2 THEN '(...) and not (...)' ELSE a || ' and not ' || a END END AS note FROM r"""),
}
