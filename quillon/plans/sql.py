"""Pieces of SQL that several plans share."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{N}_]+"


def part(x: str) -> str:
    return f"(from_hex(printf('%016x', octet_length(encode({x})))) || encode({x}))"


def node_id(content: str, parents: list[str], ordinal: str) -> str:
    """The content address of a text node as a hexadecimal digest."""
    parts = [part("'text'"), part(content), *map(part, parents), part(f"({ordinal})::VARCHAR")]
    return f"sha256({' || '.join(parts)})"


#: Chunks of 512 code points, 50 shared.
CHUNKS = f"""
roots AS (SELECT doc_id, text, {node_id('text', [], '0')} AS id FROM documents),
cut AS (
    SELECT doc_id, id AS parent, text, unnest(generate_series(0, length(text) - 1, 462)) AS start
    FROM roots WHERE length(text) > 0
),
chunks AS (
    SELECT doc_id, parent, start, (start // 462)::INT AS ordinal, substr(text, start + 1, 512) AS content FROM cut
)"""


def bm25(queries: str, nodes: str, k: int, name: str = "hits") -> str:
    """CTEs that end in `name` (query_id, node_id, score, rank) over tables (query_id, text) and (node_id, content)."""
    p = name
    return f"""
{p}_t AS (SELECT node_id, unnest(regexp_extract_all(lower(content), '{TOKEN}')) AS term FROM {nodes}),
{p}_tf AS (SELECT node_id, term, count(*) AS tf FROM {p}_t GROUP BY ALL),
{p}_len AS (SELECT node_id, sum(tf) AS length FROM {p}_tf GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY ALL),
{p}_g AS (SELECT (SELECT count(*) FROM {nodes}) AS n, (SELECT sum(tf) FROM {p}_tf) / (SELECT count(*) FROM {nodes}) AS mean),
{p}_q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM {queries}),
{p}_s AS (
    SELECT q.query_id, tf.node_id,
        round(sum(ln(1 + (g.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * len.length / g.mean))), 6) AS score
    FROM {p}_q q JOIN {p}_tf tf USING (term) JOIN {p}_df df USING (term) JOIN {p}_len len ON len.node_id = tf.node_id CROSS JOIN {p}_g g
    GROUP BY ALL
),
{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM {p}_s WHERE score > 0) WHERE rank < {k})"""


def vectors(where: str = "true", k: int = 20, name: str = "near") -> str:
    """A CTE (query_id, node_id, score, rank) of the nearest embeddings to every hundredth one."""
    return f"""
{name}_s AS (
    SELECT q.vec_id AS query_id, e.vec_id AS node_id,
        round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9) AS score
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND {where}
),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS rank FROM {name}_s) WHERE rank < {k})"""
