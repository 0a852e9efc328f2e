"""Plans from questions to passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.operators import nodes as ops
from quillon.operators import rank, route, search
from quillon.plans import sql
from quillon.session import spread, table, written


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), "label")


def _asked(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_id") % 100 == 0).select(F.col("node_id").alias("query_id"), "vector")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("content")))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ops.fixed_size(ops.roots(spread(table(spark, sf_dir, "documents"))))
    chunks = cut.select((F.col("sources")[0].cast("long") * 100_000 + F.col("ordinal")).alias("node_id"), F.col("sources")[0].alias("parent"), "ordinal", "content")
    return written(chunks, "chunks")


def _whole(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "node_id", "score", F.col("rank").cast("int").alias("rank"))


def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _vectors(spark, sf_dir)
    return _whole(search.vector_top_k(_asked(nodes), nodes, 20))


def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _vectors(spark, sf_dir)
    return _whole(search.vector_top_k(_asked(nodes), nodes, 10, where=F.col("label") % 2 == 0))


def vector_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _vectors(spark, sf_dir)
    return _whole(search.quantised_top_k(_asked(nodes), nodes, 10))


def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(search.bm25(_questions(spark, sf_dir), _texts(spark, sf_dir), 20))


def match_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(search.term_match(_questions(spark, sf_dir), _texts(spark, sf_dir), every=True))


def match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(search.term_match(_questions(spark, sf_dir), _texts(spark, sf_dir)))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _vectors(spark, sf_dir)
    asked = _asked(nodes)
    return rank.arms(("all", search.vector_top_k(asked, nodes, 20)), ("even", search.vector_top_k(asked, nodes, 10, where=F.col("label") % 2 == 0)))


def fuse_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.reciprocal_rank(_arms(spark, sf_dir), weights={"even": 0.5}).select("query_id", "node_id", "score", F.col("rank").cast("int").alias("rank"), "arm")


def fuse_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(rank.normalized_scores(_arms(spark, sf_dir), weights={"all": 2.0}))


def fuse_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(rank.boolean_combine(_arms(spark, sf_dir), ("and", 0, ("not", 1))))


def fuse_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _vectors(spark, sf_dir)
    return _whole(rank.single_list(rank.arms(("all", search.vector_top_k(_asked(nodes), nodes, 20)))))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and text arms fused; a document's vector and a passage's are the embeddings of their number."""
    nodes = _vectors(spark, sf_dir)
    asked = nodes.join(_questions(spark, sf_dir).select(F.col("query_id").alias("node_id")), "node_id").select(F.col("node_id").alias("query_id"), "vector")
    text = search.bm25(_questions(spark, sf_dir), _texts(spark, sf_dir), 20)
    return _whole(rank.reciprocal_rank(rank.arms(("vector", search.vector_top_k(asked, nodes, 20)), ("text", text)), top_k=20))


def rerank_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(_questions(spark, sf_dir), _texts(spark, sf_dir), 20).join(_texts(spark, sf_dir), "node_id")
    return _whole(rank.shingle_resemblance(hits, size=3))


def rerank_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _vectors(spark, sf_dir)
    asked = _asked(nodes)
    hits = search.vector_top_k(asked, nodes, 20).join(nodes.select("node_id", "vector"), "node_id").join(asked.select("query_id", F.col("vector").alias("asked")), "query_id")
    return _whole(rank.mmr(hits, top_n=10))


def rerank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk hits stand for their documents."""
    hits = search.bm25(_questions(spark, sf_dir), _chunks(spark, sf_dir).select("node_id", "content"), 20)
    told = hits.select("query_id", F.col("node_id").cast("string").alias("node_id"), F.array((F.col("node_id") / 100_000).cast("long").cast("string")).alias("parents"), F.lit("chunk").alias("representation"), "score", "rank")
    return _whole(rank.collapse(told)).withColumn("node_id", F.col("node_id").cast("long"))


def rerank_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return _whole(rank.adjacent(search.bm25(_questions(spark, sf_dir), chunks.select("node_id", "content"), 5), chunks))


def rerank_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, questions = _texts(spark, sf_dir), _questions(spark, sf_dir)
    hits = search.bm25(questions, texts, 20).join(texts, "node_id")
    anchors = questions.select("query_id", F.array(F.lit("of the"), F.lit("token")).alias("anchors"))
    return rank.promote_anchors(hits, anchors).select("query_id", "node_id", "score", F.col("rank").cast("int").alias("rank"), "held")


def repack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select("node_id", "content")
    hits = search.bm25(_questions(spark, sf_dir), chunks, 10).join(chunks, "node_id")
    return rank.repack(hits, budget=400, method="sides")


def whole_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in the order of source and id, while the corpus is within the bound on words."""
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))).first()[0]
    if (size or 0) > 1_000_000_000:
        raise ValueError("the corpus is larger than the bound")
    return docs.orderBy(F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last()).select("source", "doc_id", F.lit(1.0).alias("score"))


def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency rank, divided by the logarithm of the length and scaled below 1."""
    return _whole(search.text_rank(_questions(spark, sf_dir), _texts(spark, sf_dir), 10, normalization=33))


def fusion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = rank.evidence(_arms(spark, sf_dir))
    return said.select("query_id", "node_id", F.array_join(F.transform("evidence", lambda e: F.concat(e["arm"], F.lit(":"), e["rank"].cast("string"))), ",").alias("evidence"))


def always_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.always(_questions(spark, sf_dir), "hybrid")


def no_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([], "query_id long, node_id long, score double, rank int")


def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return route.profile(asked).drop("identifiers", "quoted")


def query_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = turns.select("conv_id", "turn", F.explode(route.anchors(F.col("text"))).alias("a"))
    return found.select("conv_id", "turn", "a.at", "a.text", "a.kind")


def document_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of whole documents: numbers, addresses, keys and what they quote."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(route.anchors(F.col("text"))).alias("a"))
    return found.select("doc_id", "a.at", "a.text", "a.kind")


def threshold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("short", [("word_count", "<", 20)]), ("temporal", [("cue_temporal", "=", 1.0), ("word_count", ">=", 20)]), ("long", [("word_count", ">", 60)])]
    return route.ladder(query_profile(spark, sf_dir), rules, "usual").select("query_id", "route")


def nearest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's nearest label, a label standing by its first vector."""
    nodes = _vectors(spark, sf_dir)
    routes = nodes.groupBy("label").agg(F.min_by("vector", "node_id").alias("vector")).select(F.col("label").cast("string").alias("route"), "vector")
    return route.nearest_description(nodes.select(F.col("node_id").alias("query_id"), "vector"), routes)


def evidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = query_profile(spark, sf_dir)
    rules = [("all", F.col("word_count") < 10, 100), ("graph", F.col("word_count") < 30, None), ("vector", F.col("word_count") >= 10, 1)]
    return route.evidence(features, rules, ("all", "vector"), F.col("word_count"), 500, "none").select("query_id", "route", F.array_join("reasons", "; ").alias("reasons"))


def hedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("role", route.hedged(F.col("text")).alias("sufficiency")).agg(F.count("*").alias("turns"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a follow-up question is rewritten with: its last four turns."""
    last = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    turns = table(spark, sf_dir, "conversations").withColumn("before", F.array_join(F.collect_list("text").over(last), "\n"))
    return turns.where("role = 'user'").select("conv_id", "turn", F.md5("before").alias("history"))


_Q = "questions AS (SELECT item_id AS query_id, text FROM benchmark), texts AS (SELECT doc_id AS node_id, text AS content FROM documents)"
_C = f"{sql.CHUNKS}, questions AS (SELECT item_id AS query_id, text FROM benchmark), nodes AS (SELECT doc_id * 100000 + ordinal AS node_id, doc_id, ordinal, content FROM chunks)"
_EVEN = sql.vectors("e.label % 2 = 0", 10, "even")
_ARMS = f"{sql.vectors()}, {_EVEN}, arms AS (SELECT query_id, 0 AS list_idx, 'all' AS arm, node_id, score, rank FROM near UNION ALL SELECT query_id, 1, 'even', node_id, score, rank FROM even)"
_ORDERED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, node_id) - 1"
_WORD = r"[^\p{L}\p{N}_]"
_CUES = ", ".join(rf"regexp_matches(lower(text), '(^|{_WORD})({'|'.join(p)})({_WORD}|$)') AS cue_{c.replace('-', '_')}" for c, p in route.CUES["en"].items())
_PROFILE = f"profile AS (SELECT conv_id * 1000 + turn AS query_id, len(regexp_extract_all(text, '{sql.TOKEN}'))::INT AS word_count, {_CUES} FROM conversations WHERE role = 'user')"
_HEDGE = " OR ".join("contains(lower(text), '" + h.replace("'", "''") + "')" for h in route.HEDGES["en"])
_MATCH = f"""
WITH {_Q}, q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{sql.TOKEN}')) AS term FROM questions),
t AS (SELECT DISTINCT node_id, unnest(regexp_extract_all(lower(content), '{sql.TOKEN}')) AS term FROM texts),
n AS (SELECT query_id, count(*) AS need FROM q GROUP BY ALL),
s AS (SELECT query_id, node_id, count(*)::DOUBLE AS score FROM t JOIN q USING (term) GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM s JOIN n USING (query_id) WHERE @)
SELECT query_id, node_id, score, rank::INT AS rank FROM r WHERE rank < 20"""
_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"

PLANS = {
    "vector_top_k": (vector_top_k, f"WITH {sql.vectors()} SELECT query_id, node_id, score, rank::INT AS rank FROM near"),
    "vector_filtered": (vector_filtered, f"WITH {_EVEN} SELECT query_id, node_id, score, rank::INT AS rank FROM even"),
    "vector_quantised": (vector_quantised, f"""
        WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id,
                list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: ((p[1] > 0) = (p[2] > 0))::INT)) AS same,
                round({_COS.format(a='e.embedding', b='q.embedding')}, 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, node_id) AS k FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM c WHERE k <= 40)
        SELECT query_id, node_id, score, rank::INT AS rank FROM r WHERE rank < 10"""),
    "bm25_documents": (bm25_documents, f"WITH {_Q}, {sql.bm25('questions', 'texts', 20)} SELECT query_id, node_id, score, rank::INT AS rank FROM hits"),
    "match_any": (match_any, _MATCH.replace("@", "true")),
    "match_every": (match_every, _MATCH.replace("@", "score = need")),
    "fuse_reciprocal": (fuse_reciprocal, f"""
        WITH {_ARMS}, f AS (SELECT query_id, node_id, round(sum(CASE arm WHEN 'even' THEN 0.5 ELSE 1.0 END::DOUBLE / (60 + rank + 1)), 9) AS score, min((list_idx, rank)) AS seen, arg_min(arm, (rank, list_idx)) AS arm FROM arms GROUP BY ALL)
        SELECT query_id, node_id, score, ({_ORDERED})::INT AS rank, arm FROM f"""),
    "fuse_normalized": (fuse_normalized, f"""
        WITH {_ARMS}, b AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM arms WINDOW w AS (PARTITION BY query_id, list_idx)),
        f AS (SELECT query_id, node_id, round(sum(CASE arm WHEN 'all' THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END), 9) AS score, min((list_idx, rank)) AS seen FROM b GROUP BY ALL)
        SELECT query_id, node_id, score, ({_ORDERED})::INT AS rank FROM f"""),
    "fuse_boolean": (fuse_boolean, f"""
        WITH {_ARMS} SELECT query_id, node_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1)::INT AS rank
        FROM near n WHERE NOT EXISTS (SELECT 1 FROM even e WHERE e.query_id = n.query_id AND e.node_id = n.node_id)"""),
    "fuse_single": (fuse_single, f"WITH {sql.vectors()} SELECT query_id, node_id, score, rank::INT AS rank FROM near"),
    "hybrid": (hybrid, f"""
        WITH {_Q}, {sql.bm25('questions', 'texts', 20)}, {sql.vectors(name='v').replace('q.vec_id % 100 = 0', 'q.vec_id IN (SELECT item_id FROM benchmark)')},
        arms AS (SELECT query_id, 0 AS list_idx, node_id, rank FROM v UNION ALL SELECT query_id, 1, node_id, rank FROM hits),
        f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score, min((list_idx, rank)) AS seen FROM arms GROUP BY ALL),
        r AS (SELECT query_id, node_id, score, {_ORDERED} AS rank FROM f) SELECT query_id, node_id, score, rank::INT AS rank FROM r WHERE rank < 20"""),
    "rerank_shingles": (rerank_shingles, None),
    "rerank_mmr": (rerank_mmr, None),
    "rerank_collapse": (rerank_collapse, f"""
        WITH {_C}, {sql.bm25('questions', 'nodes', 20)}, g AS (SELECT query_id, node_id // 100000 AS node_id, max(score) AS score, min(rank) AS seen FROM hits GROUP BY ALL)
        SELECT query_id, node_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1)::INT AS rank FROM g"""),
    "rerank_adjacent": (rerank_adjacent, f"""
        WITH {_C}, {sql.bm25('questions', 'nodes', 5)},
        b AS (SELECT h.query_id, n.node_id, h.score, h.rank AS hit, n.ordinal FROM hits h JOIN nodes m ON m.node_id = h.node_id JOIN nodes n ON n.doc_id = m.doc_id AND abs(n.ordinal - m.ordinal) <= 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY hit, ordinal) AS k FROM b)
        SELECT query_id, node_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY hit, ordinal) - 1)::INT AS rank FROM o WHERE k = 1"""),
    "rerank_anchors": (rerank_anchors, f"""
        WITH {_Q}, {sql.bm25('questions', 'texts', 20)},
        p AS (SELECT h.*, ' ' || array_to_string(regexp_extract_all(regexp_replace(regexp_replace(lower(t.content), '([\\p{{L}}\\p{{N}}_])-([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}_])-([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '{sql.TOKEN}'), ' ') || ' ' AS plain FROM hits h JOIN texts t USING (node_id)),
        c AS (SELECT *, contains(plain, ' of the ')::INT + contains(plain, ' token ')::INT AS held FROM p)
        SELECT query_id, node_id, score + 3 * held AS score, (row_number() OVER (PARTITION BY query_id ORDER BY held DESC, rank) - 1)::INT AS rank, held FROM c"""),
    "repack_budget": (repack_budget, f"""
        WITH {_C}, {sql.bm25('questions', 'nodes', 10)},
        p AS (SELECT h.*, sum(len(regexp_extract_all(n.content, '\\S+')) + 1) OVER (PARTITION BY h.query_id ORDER BY h.rank) AS spent FROM hits h JOIN nodes n USING (node_id)),
        k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM p WHERE spent <= 400)
        SELECT query_id, node_id, score, rank::INT AS rank, (CASE WHEN rank % 2 = 0 THEN rank // 2 + 1 ELSE n - (rank - 1) // 2 END)::INT AS label FROM k"""),
    "whole_corpus": (whole_corpus, "SELECT source, doc_id, 1.0::DOUBLE AS score FROM documents"),
    "rank_documents": (rank_documents, f"""
        WITH {_Q}, t AS (SELECT node_id, unnest(regexp_extract_all(lower(content), '{sql.TOKEN}')) AS term FROM texts),
        tf AS (SELECT node_id, term, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT node_id, sum(n) AS length FROM tf GROUP BY ALL),
        h AS (SELECT n, (SELECT sum(1.0::DOUBLE / (i * i)) FROM range(1, n + 1) r(i)) AS h FROM (SELECT DISTINCT n FROM tf)),
        q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{sql.TOKEN}')) AS term FROM questions),
        s AS (SELECT query_id, tf.node_id, sum(0.1::DOUBLE * h / 1.64493406685::DOUBLE) / any_value(size) / log2(any_value(length) + 1) AS x
            FROM q JOIN tf USING (term) JOIN h USING (n) JOIN l ON l.node_id = tf.node_id JOIN (SELECT query_id, count(*) AS size FROM q GROUP BY ALL) USING (query_id) GROUP BY ALL),
        r AS (SELECT query_id, node_id, round(x / (x + 1), 9) AS score FROM s)
        SELECT query_id, node_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM r) WHERE rank < 10"""),
    "fusion_evidence": (fusion_evidence, f"WITH {_ARMS} SELECT query_id, node_id, string_agg(arm || ':' || rank, ',' ORDER BY list_idx) AS evidence FROM arms GROUP BY ALL"),
    "always_route": (always_route, "SELECT item_id AS query_id, 'hybrid' AS route FROM benchmark"),
    "no_retrieval": (no_retrieval, "SELECT 0::BIGINT AS query_id, 0::BIGINT AS node_id, 0.0::DOUBLE AS score, 0::INT AS rank WHERE false"),
    "query_profile": (query_profile, f"WITH {_PROFILE} SELECT * FROM profile"),
    "query_anchors": (query_anchors, None),
    "document_anchors": (document_anchors, None),
    "threshold_ladder": (threshold_ladder, f"WITH {_PROFILE} SELECT query_id, CASE WHEN word_count < 20 THEN 'short' WHEN cue_temporal AND word_count >= 20 THEN 'temporal' WHEN word_count > 60 THEN 'long' ELSE 'usual' END AS route FROM profile"),
    "nearest_route": (nearest_route, f"""
        WITH r AS (SELECT label::VARCHAR AS route, arg_min(embedding, vec_id) AS told FROM embeddings GROUP BY label),
        s AS (SELECT vec_id AS query_id, route, round({_COS.format(a='embedding', b='told')}, 9) AS score FROM embeddings, r)
        SELECT query_id, route, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, route) AS k FROM s) WHERE k = 1"""),
    "evidence_policy": (evidence_policy, f"""
        WITH {_PROFILE}, c AS (SELECT query_id, word_count AS w, CASE WHEN w >= 10 THEN 'all: does not hold' WHEN w * 100 > 500 THEN 'all: over the ceiling' END AS a,
            CASE WHEN w >= 30 THEN 'graph: does not hold' ELSE 'graph: not offered' END AS g, CASE WHEN w < 10 THEN 'vector: does not hold' WHEN w > 500 THEN 'vector: over the ceiling' END AS v FROM profile)
        SELECT query_id, CASE WHEN a IS NULL THEN 'all' WHEN v IS NULL THEN 'vector' ELSE 'none' END AS route, concat_ws('; ', a, g, v) AS reasons FROM c"""),
    "hedges": (hedges, f"SELECT role, CASE WHEN text IS NULL THEN 'unobserved' WHEN {_HEDGE} THEN 'insufficient' ELSE 'sufficient' END AS sufficiency, count(*) AS turns FROM conversations GROUP BY ALL"),
    "history": (history, """
        WITH h AS (SELECT conv_id, turn, role, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before FROM conversations)
        SELECT conv_id, turn, md5(coalesce(array_to_string(before, chr(10)), '')) AS history FROM h WHERE role = 'user'"""),
}
