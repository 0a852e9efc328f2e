"""Plans over texts: cleaning, chunking, embedding, keywords, rendering, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.identity import hash_embedding, root_id
from quillon.operators import clean, filters
from quillon.operators import nodes as ops
from quillon.plans import sql
from quillon.session import spread, table


def _cleaner(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = clean.CLEANERS[name](F.col("text"))
        return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(text).alias("digest"))

    return query


def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on text fields: there, not a value, one of several."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("media_type"), F.col("source").alias("id"))
    tree = {"op": "and", "clauses": [
        {"op": "exists", "field": "content"}, {"op": "ne", "field": "content", "value": ""},
        {"op": "or", "clauses": [
            {"op": "in", "field": "media_type", "value": ["de", "es"]}, {"op": "not", "clauses": [{"op": "exists", "field": "media_type"}]},
            {"op": "eq", "field": "id", "value": "src2"},
        ]},
    ]}
    return filters.matching(docs, tree).select("doc_id")


def root_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", root_id(F.col("text")).alias("node_id"))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.fixed_size(ops.roots(spread(table(spark, sf_dir, "documents"))))
    return out.select(F.col("sources")[0].cast("long").alias("doc_id"), F.col("ordinal"), F.col("start"), F.col("id").alias("node_id"), F.length("content").alias("size"))


def cleaned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, then chunk: two stages fused into one scan."""
    cleaned = clean.clean(clean.clean(ops.roots(spread(table(spark, sf_dir, "documents"))), "hyphenation"), "whitespace")
    out = ops.fixed_size(cleaned, size=300, overlap=30)
    return out.groupBy(F.col("sources")[0].cast("long").alias("doc_id")).agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"), F.min("id").alias("first_id"))


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(hash_embedding(F.col("text"), 16)).alias("i", "x"))
    return vectors.select("doc_id", "i", F.round("x", 12).alias("x"))


def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(ops.keywords(F.col("text")), " ").alias("terms"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a table whose rows become nodes."""
    nation = table(spark, sf_dir, "nation")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    tables = nation.groupBy("n_regionkey").agg(rows.alias("rows")).select(F.col("n_regionkey").cast("string").alias("id"), F.array(F.lit("key"), F.lit("na|me")).alias("headers"), "rows")
    return ops.table_rows(tables).select(F.col("parent").cast("long").alias("region"), "ordinal", "content", F.col("id").alias("node_id"))


def render_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.concat("role", F.lit(": "), "text").alias("content"))
    return ops.render(turns, "conv_id").select("conv_id", F.md5("text").alias("digest"))


def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"op": "and", "clauses": [
        {"op": "in", "field": "ext.lang", "value": ["de", "fr"]}, {"op": "gt", "field": "ext.n_chars", "value": 500},
        {"op": "or", "clauses": [{"op": "ne", "field": "ext.source", "value": "src0"}, {"op": "lte", "field": "ext.n_chars", "value": 900}]},
        {"op": "not", "clauses": [{"op": "eq", "field": "ext.source", "value": "src3"}]},
    ]}
    return filters.matching(table(spark, sf_dir, "documents"), tree).select("doc_id", "lang", "source")


def filter_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "documents").groupBy(root_id(F.col("text")).alias("id")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    tree = {"op": "and", "clauses": [{"op": "in", "field": "lineage.sources", "value": ["src1", "src2", "src3"]}, {"op": "not", "clauses": [{"op": "contains", "field": "lineage.sources", "value": "src0"}]}]}
    return filters.matching(nodes, tree).select("id", F.array_join("sources", ",").alias("sources"))


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of given ids: the ids of the labelled documents, by a semi-join."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.length("text").alias("size"))


def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("characters"), F.count_if(F.col("text") == "").alias("empty"))


_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_HY = r"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)-[ \t]*\n[ \t]*([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"

PLANS = {
    "root_nodes": (root_nodes, f"SELECT doc_id, {sql.node_id('text', [], '0')} AS node_id FROM documents"),
    "clean_whitespace": (_cleaner("whitespace"), f"SELECT doc_id, md5({_WS.format(x='text')}) AS digest FROM documents"),
    "clean_hyphenation": (_cleaner("hyphenation"), f"SELECT doc_id, md5({_HY.format(x='text')}) AS digest FROM documents"),
    "clean_artifacts": (_cleaner("artifact-remove"), r"""
        SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(text, '(?im)^\s*Page\s+\d+\s*$', '', 'g'), chr(10)),
            lambda l: length(regexp_replace(l, '^\s+|\s+$', '', 'g')) = 0
                OR length(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '[\p{L}\p{N}\s]', '', 'g')) / length(regexp_replace(l, '^\s+|\s+$', '', 'g')) <= 0.5), chr(10))) AS digest
        FROM documents"""),
    "clean_tables": (_cleaner("table-linearize"), r"""
        SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)),
            lambda l: CASE WHEN length(regexp_replace(l, '^\s+|\s+$', '', 'g')) >= 12 AND contains(l, '   ')
                THEN array_to_string(list_filter(list_transform(string_split_regex(l, ' {3,}'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> ''), chr(10))
                ELSE l END), chr(10))) AS digest
        FROM documents"""),
    "clean_unicode": (_cleaner("unicode-normalize"), None),
    "clean_polish": (_cleaner("polish-dictionary-spacing"), None),
    "chunk_fixed": (chunk_fixed, f"WITH {sql.CHUNKS} SELECT doc_id, ordinal, start::INT AS start, {sql.node_id('content', ['parent'], 'ordinal')} AS node_id, length(content)::INT AS size FROM chunks"),
    "cleaned_chunks": (cleaned_chunks, f"""
        WITH r AS (SELECT doc_id, {sql.node_id('text', [], '0')} AS id, text FROM documents),
        h AS (SELECT doc_id, id, {_HY.format(x='text')} AS text FROM r),
        h2 AS (SELECT doc_id, {sql.node_id('text', ['id'], '0')} AS id, text FROM h),
        w AS (SELECT doc_id, id, {_WS.format(x='text')} AS text FROM h2),
        w2 AS (SELECT doc_id, {sql.node_id('text', ['id'], '0')} AS id, text FROM w),
        cut AS (SELECT doc_id, id, text, unnest(generate_series(0, length(text) - 1, 270)) AS start FROM w2 WHERE length(text) > 0),
        c AS (SELECT doc_id, id, (start // 270)::INT AS ordinal, substr(text, start + 1, 300) AS content FROM cut)
        SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS characters, min({sql.node_id('content', ['id'], 'ordinal')}) AS first_id FROM c GROUP BY doc_id"""),
    "embed_hash": (embed_hash, r"""
        SELECT doc_id, i::INT AS i, round(('0x' || substr(sha256(encode(text) || from_hex(printf('%08x', i))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 * 2 - 1, 12) AS x
        FROM documents, range(16) r(i)"""),
    "keyword_terms": (keyword_terms, f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*') AS words FROM documents),
        e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        c AS (SELECT doc_id, word, count(*) AS n, min(i) AS i FROM e WHERE length(word) >= 3 AND word NOT IN ({", ".join(f"'{w}'" for w in ops.STOPWORDS)}) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM c)
        SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY k), '') AS terms FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k <= 5 GROUP BY d.doc_id"""),
    "table_rows": (table_rows, f"""
        WITH r AS (SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS ordinal, 'key: ' || n_nationkey || ' | na\\|me: ' || n_name AS content FROM nation)
        SELECT region::BIGINT AS region, ordinal, content, {sql.node_id('content', ['region::VARCHAR'], 'ordinal')} AS node_id FROM r"""),
    "render_conversations": (render_conversations, "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id"),
    "filter_tree": (filter_tree, "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND n_chars > 500 AND (source IS DISTINCT FROM 'src0' OR n_chars <= 900) AND NOT coalesce(source = 'src3', false)"),
    "filter_text": (filter_text, "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text IS DISTINCT FROM '' AND (lang IN ('de', 'es') OR lang IS NULL OR source = 'src2')"),
    "filter_lineage": (filter_lineage, f"""
        WITH n AS (SELECT {sql.node_id('text', [], '0')} AS id, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY 1)
        SELECT id, array_to_string(sources, ',') AS sources FROM n WHERE list_has_any(sources, ['src1', 'src2', 'src3']) AND NOT list_contains(sources, 'src0')"""),
    "node_lookup": (node_lookup, "SELECT doc_id, length(text)::INT AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "source_statistics": (source_statistics, "SELECT source, count(*) AS nodes, sum(length(text))::BIGINT AS characters, count_if(text = '')::BIGINT AS empty FROM documents GROUP BY source"),
}
