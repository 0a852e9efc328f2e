"""Plans over the node store: writes, deletions, changes, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.identity import root_id
from quillon.operators import filters, store
from quillon.plans import sql
from quillon.session import table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(root_id(F.col("text")).alias("id"), F.col("text").alias("content"), F.array("source").alias("sources"), "doc_id")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents are stored, then all are written: equal texts are one node with all its sources."""
    nodes = _nodes(spark, sf_dir)
    stored = nodes.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return store.upsert(stored, nodes).select("id", F.array_join("sources", ",").alias("sources"), F.length("content").alias("size"))


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = store.productions(_nodes(spark, sf_dir))
    gone = spark.createDataFrame([("src0",), ("src1",)], "source string")
    return store.delete_sources(made, gone).select("node_id", F.array_join("sources", ",").alias("sources"), "deleted")


def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a catalogue that knows the labelled ones, some by another hash, pipeline or status."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    inventory = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"))
    known = docs.join(labels, "doc_id").select(
        (F.col("doc_id") + F.when(F.col("toxic") == 1, 100_000_000).otherwise(0)).alias("id"),
        F.when(F.col("lang") == "de", "old").otherwise(F.md5("text")).alias("content_hash"),
        F.when(F.col("lang") == "fr", "p0").otherwise("p1").alias("pipeline"),
        F.when(F.col("source") == "src5", "failed").when(F.col("source") == "src6", "indexing").otherwise("active").alias("status"),
    )
    return store.changes(inventory, known, "p1")


def status_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = source_changes(spark, sf_dir)
    return store.coverage(made.select(F.col("change").alias("status")))


def published_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    made = events.select(F.col("event_type").alias("layer"), F.col("event_id").alias("id"), F.when(F.col("value") > 10, "published").otherwise("building").alias("status"), F.struct("ts", "event_id").alias("published_at"))
    return store.newest_published(made)


def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("generations", F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang", "source")))
    return docs.where(filters.visible(F.col("generations"), ["de", "fr", "src1", "src2"])).select("doc_id")


def vector_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(store.one_width(F.col("embedding")).alias("width"), F.count("*").alias("n"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source: some pending, some of unknown size."""
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("source") == "src6", "indexing").otherwise("active")
    return docs.select(F.col("doc_id").alias("id"), status.alias("status"), F.lit(1).alias("leaves"), F.length("text").alias("tokens"), F.lit("characters").alias("tokenizer"), "lang")


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by language: each one, and what has none, a corpus of its own."""
    return store.corpus_profile(_catalogue(spark, sf_dir), 1_000_000, "lang")


def released_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents that vanished or were reparsed let go: nodes by text, sources by id."""
    docs = table(spark, sf_dir, "documents")
    made = store.productions(docs.select(root_id(F.col("text")).alias("id"), F.array(F.col("doc_id").cast("string")).alias("sources")))
    catalogue = docs.select(F.col("doc_id").alias("id"), F.lit("active").alias("status"))
    touched, _ = store.release(made, catalogue, source_changes(spark, sf_dir))
    return touched.select("node_id", F.array_join("sources", ",").alias("sources"), "deleted")


def reclaimed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes of the generation of their language; the newest published one of each layer stays."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang").alias("generations"), F.array("source").alias("sources"))
    kept = store.carry_forward(docs, "fr", "fr2", spark.createDataFrame([("src1",)], "source string"))
    made = spark.createDataFrame([("de", "a", "published", 1), ("en", "a", "published", 2), ("es", "b", "building", 3), ("fr2", "c", "published", 4)], "id string, layer string, status string, published_at int")
    return store.reclaim(kept, made).select("id", F.array_join("generations", ",").alias("generations"))


_N = f"n AS (SELECT doc_id, {sql.node_id('text', [], '0')} AS id, text, source FROM documents)"
_CHANGES = """
known AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 100000000 ELSE 0 END AS id, CASE WHEN lang = 'de' THEN 'old' ELSE md5(text) END AS content_hash,
    CASE WHEN lang = 'fr' THEN 'p0' ELSE 'p1' END AS pipeline, CASE source WHEN 'src5' THEN 'failed' WHEN 'src6' THEN 'indexing' ELSE 'active' END AS status FROM documents JOIN labels USING (doc_id)),
changes AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'vanished' WHEN b.status = 'failed' THEN 'failed' WHEN b.status = 'indexing' THEN 'incomplete'
    WHEN a.content_hash <> b.content_hash THEN 'content_changed' WHEN b.pipeline <> 'p1' THEN 'pipeline_changed' ELSE 'unchanged' END AS change
    FROM (SELECT doc_id AS id, md5(text) AS content_hash FROM documents) a FULL OUTER JOIN known b ON a.id = b.id)"""

PLANS = {
    "store_upsert": (upsert, f"WITH {_N} SELECT id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(length(text))::INT AS size FROM n GROUP BY id"),
    "store_delete": (delete_cascade, f"""
        WITH {_N}, t AS (SELECT id AS node_id, bool_or(source IN ('src0', 'src1')) AS hit, list_sort(list(DISTINCT source) FILTER (source NOT IN ('src0', 'src1'))) AS kept FROM n GROUP BY 1)
        SELECT node_id, coalesce(array_to_string(kept, ','), '') AS sources, coalesce(len(kept), 0) = 0 AS deleted FROM t WHERE hit"""),
    "source_changes": (source_changes, f"WITH {_CHANGES} SELECT id, change FROM changes"),
    "status_coverage": (status_coverage, f"WITH {_CHANGES} SELECT change AS status, count(*) AS sources FROM changes GROUP BY change"),
    "published_generations": (published_generations, "SELECT event_type AS layer, arg_max(event_id, (ts, event_id)) AS id FROM events WHERE value > 10 GROUP BY event_type"),
    "visible_nodes": (visible_nodes, "SELECT doc_id FROM documents WHERE lang = 'en' OR lang NOT IN ('de', 'fr') OR source NOT IN ('src1', 'src2')"),
    "corpus_profile": (corpus_profile, """
        WITH c AS (SELECT lang, count_if(source <> 'src6') AS documents, count_if(source = 'src6') AS sources_pending, sum(length(text)) FILTER (source <> 'src6') AS size FROM documents GROUP BY lang)
        SELECT lang, documents, CASE WHEN documents > 0 THEN documents END AS leaves, size::BIGINT AS leaf_tokens, sources_pending, 0::BIGINT AS sources_failed, documents > 0 AND sources_pending = 0 AS base_complete, size <= 1000000 AS fits_context FROM c"""),
    "released_sources": (released_sources, f"""
        WITH {_N}, {_CHANGES}, gone AS (SELECT id FROM changes WHERE change IN ('vanished', 'content_changed', 'pipeline_changed')),
        t AS (SELECT n.id AS node_id, count(g.id) AS hit, list_sort(list(doc_id::VARCHAR) FILTER (g.id IS NULL)) AS kept FROM n LEFT JOIN gone g ON g.id = n.doc_id GROUP BY 1)
        SELECT node_id, coalesce(array_to_string(kept, ','), '') AS sources, kept IS NULL OR len(kept) = 0 AS deleted FROM t WHERE hit > 0"""),
    "reclaimed_nodes": (reclaimed_nodes, """
        SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN 'fr,fr2' ELSE lang END AS generations FROM documents WHERE lang = 'en' OR (lang = 'fr' AND source <> 'src1')"""),
    "vector_width": (vector_width, "SELECT max(len(embedding))::INT AS width, count(*) AS n FROM embeddings"),
}
