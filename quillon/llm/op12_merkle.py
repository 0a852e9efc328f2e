"""Merkle manifest of a dataset: a digest tree over all rows, and for each row the siblings that prove it.

Rows take their places in their tree by a range sort. Places are cut into aligned blocks of 2**HEIGHT nodes; each block
is walked in postorder, which gives the block's digest and leaves with every node the siblings met while unwinding. The
block digests are the nodes of the next walk, until each tree is one node. Groups hold a block, whatever the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import table, written

#: Levels that a walk of a block climbs: 4096 nodes a block.
HEIGHT = 12
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One row in so many, by crc32 of the id, is tampered with in the registered query.
TAMPERED = 7


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests: they enter as lowercase hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf(values: list[Column]) -> Column:
    """A row's digest (binary): each value with its length in bytes before it, `-` where it is null."""
    told = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256))


def postorder(digests: list[bytes], height: int) -> tuple[bytes, list[list[bytes]]]:
    """(digest of a block, the siblings of each node from below) for a block that is climbed `height` levels.

    A subtree's digest is known once its parts have been walked; unwinding, it is appended to the siblings of every
    node in the part beside it. A part that has no neighbour is hashed alone.
    """
    siblings: list[list[bytes]] = [[] for _ in digests]

    def walk(low: int, level: int) -> bytes:
        if level == 0:
            return digests[low]
        middle, high = low + (1 << level - 1), min(low + (1 << level), len(digests))
        left = walk(low, level - 1)
        if middle >= high:
            return joined([left])
        right = walk(middle, level - 1)
        for i in range(low, middle):
            siblings[i].append(right)
        for i in range(middle, high):
            siblings[i].append(left)
        return joined([left, right])

    return walk(0, height), siblings


def folded(digest: bytes, place: int, size: int, siblings: list[bytes]) -> bytes:
    """The root that a node at `place` of `size` nodes has with these siblings, of which the first are used."""
    rest = iter(siblings)
    while size > 1:
        if place ^ 1 < size:
            other = next(rest)
            digest = joined([other, digest] if place & 1 else [digest, other])
        else:
            digest = joined([digest])
        place, size = place >> 1, size + 1 >> 1
    return digest


def _climbed(size: int, height: int) -> int:
    return min(height, (size - 1).bit_length())


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with `place` (0 first, in the given order within `tree`, ties in any order) and `size` of their tree.

    A range sort lays the trees out one after another, split wherever they are large; a task numbers its rows, and the
    counts of each task and tree, few rows, tell where it begins.
    """
    columns = nodes.columns
    sorted_ = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    told = sorted_.withColumn("task", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            tree = batch.column("tree").dictionary_encode()
            key = tree.indices.to_numpy(zero_copy_only=False)
            names = tree.dictionary.to_pylist()
            out = np.empty(len(key), np.int64)
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(edge, edge[1:]):
                if names[key[a]] != last:
                    last, at = names[key[a]], 0
                out[a:b] = np.arange(at, at + b - a)
                at += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "turn"])

    schema = T.StructType([*told.schema, T.StructField("turn", T.LongType())])
    numbered = written(told.mapInArrow(number, schema), "places")
    counts = numbered.groupBy("tree", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("tree", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return numbered.join(begins, ["tree", "task"]).select(*columns, (F.col("begin") + F.col("turn")).alias("place"), "size")


def walked(nodes: DataFrame, height: int) -> DataFrame:
    """nodes (tree, place, size, digest, ...) with `siblings` within their block, and in each block's first node its `top`."""
    own = nodes.columns

    def block(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("place").to_numpy(), kind="stable")))
        digests = t.column("digest").to_pylist()
        top, siblings = postorder(digests, _climbed(t.column("size")[0].as_py(), height))
        tops = pa.array([top, *[None] * (len(digests) - 1)], pa.binary())
        return t.select(own).append_column("siblings", pa.array([b"".join(s) for s in siblings], pa.binary())).append_column("top", tops)

    schema = T.StructType([*nodes.schema, T.StructField("siblings", T.BinaryType()), T.StructField("top", T.BinaryType())])
    return nodes.groupBy("tree", F.shiftright("place", height).alias("block")).applyInArrow(block, schema)


def proven(nodes: DataFrame, *order: str, height: int = HEIGHT) -> DataFrame:
    """nodes (tree, digest, ...) with `place`, `size`, `proof` (siblings from below, 32 bytes each) and `subroot`."""
    levels = [written(walked(placed(nodes, *order), height), "walked")]
    while True:
        tops = levels[-1].where("top IS NOT NULL").select("tree", F.shiftright("place", height).alias("place"), F.shiftright(F.col("size") + ((1 << height) - 1), height).alias("size"), F.col("top").alias("digest"))
        if tops.where("size > 1").isEmpty():
            break
        levels.append(written(walked(tops, height), "walked"))
    above = tops.select("tree", F.col("place").alias("block"), F.lit(b"").alias("more"), F.col("digest").alias("subroot"))
    for level in reversed(levels):
        held = level.withColumn("block", F.shiftright("place", height)).join(above, ["tree", "block"])
        proof = F.concat("siblings", "more")
        if level is levels[0]:
            return held.select(*nodes.columns, "place", "size", proof.alias("proof"), "subroot")
        above = held.select("tree", F.col("place").alias("block"), proof.alias("more"), "subroot")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", by: str = "lang", tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of every row: a tree for each value of `by`, and one over their roots.

    Leaves of a tree ascend by id (null first); rows of equal id by their digest, and rows equal in all fields have the
    same digest, so that any order of them gives the same trees. Trees ascend by `by`, null first, then bytewise. proof
    is the siblings from the leaf to the root, 32 bytes each. folded_root is what the siblings make of the row's leaf,
    or, where `tampered` is given (a column: another leaf as binary, null where the row is left alone), of that one;
    verified tells whether it is the root. Nulls and empty texts are told apart in the leaf. Other columns play no part;
    an empty table gives no rows.
    """
    own = leaf([F.col(f) for f in fields])
    nodes = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("tree"), F.col(id_col).cast("long").alias("id"), own.alias("digest"),
        (F.lit(None).cast("binary") if tampered is None else tampered).alias("changed"),
    )
    rows = written(proven(nodes, "id", "digest", height=height), "proven")
    trees = rows.where("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest"))
    tops = proven(trees, "name", height=height)
    top = tops.select(F.col("name").alias("tree"), F.col("place").alias("top_place"), F.col("size").alias("top_size"), F.col("proof").alias("top_proof"), F.col("subroot").alias("root"))
    #: One row a tree joins every row of it: dealt by place, so that no tree is one task's.
    deal = 64
    salted = rows.withColumn("deal", F.pmod("place", F.lit(deal))).join(top.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1)))), ["tree", "deal"])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("digest", "changed", "place", "size", "proof", "top_place", "top_size", "top_proof", "subroot", "root")
        for batch in batches:
            out = []
            for digest, changed, place, size, proof, top_place, top_size, top_proof, subroot, root in zip(*(batch.column(c).to_pylist() for c in names)):
                low, high = ([p[i : i + 32] for i in range(0, len(p), 32)] for p in (proof, top_proof))
                got = folded(folded(changed or digest, place, size, low), top_place, top_size, high)
                out.append((digest.hex(), subroot.hex(), root.hex(), proof + top_proof, got.hex(), got == root))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "leaf", "subroot", "root", "proof", "folded_root", "verified"])

    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.bool_())
    return salted.mapInArrow(prove, "id long, leaf string, subroot string, root string, proof binary, folded_root string, verified boolean")


def proof_text(proof: Column) -> Column:
    """The siblings as lowercase hexadecimal text, one after another."""
    return F.lower(F.hex(proof))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; one in seven is tampered with and must fail."""
    docs = table(spark, sf_dir, "documents")
    more = leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, more)
    found = manifest(docs, tampered=tampered)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def crc32_sql(number: str) -> str:
    """SQL for the unsigned crc32 of a number's decimal text."""
    step = "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(({number})::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), {byte}), 4294967295::BIGINT)"


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('n_chars')} AS leaf,
        CASE WHEN {crc32_sql('doc_id')} % {TAMPERED} = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS shown FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
lows AS (
    SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY tree
    UNION ALL SELECT tree, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM lows WHERE len(nodes) > 1
), subs AS (SELECT tree, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place FROM lows WHERE len(nodes) = 1),
highs AS (
    SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subs
    UNION ALL SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM highs WHERE len(nodes) > 1
), top AS (SELECT nodes[1] AS root, level AS height FROM highs WHERE len(nodes) = 1),
low AS (SELECT tree, level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS place FROM lows),
high AS (SELECT level, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS place FROM highs),
steps AS (
    SELECT p.tree, p.place, l.level, o.node AS other, ((p.place >> l.level) & 1) AS side
    FROM p JOIN (SELECT tree, level FROM lows WHERE len(nodes) > 1) l USING (tree) LEFT JOIN low o ON o.tree = p.tree AND o.level = l.level AND o.place = xor(p.place >> l.level, 1)
    UNION ALL
    SELECT p.tree, p.place, s.height + l.level, o.node, ((s.place >> l.level) & 1)
    FROM p JOIN subs s USING (tree) CROSS JOIN (SELECT level FROM highs WHERE len(nodes) > 1) l LEFT JOIN high o ON o.level = l.level AND o.place = xor(s.place >> l.level, 1)
), path AS (
    SELECT tree, place, list({{'other': other, 'side': side}} ORDER BY level) AS path, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY ALL
), fold AS (
    SELECT p.tree, p.place, p.shown AS digest, 1 AS i, coalesce(path, []) AS path FROM p LEFT JOIN path USING (tree, place)
    UNION ALL SELECT tree, place, sha256(CASE WHEN path[i].other IS NULL THEN digest WHEN path[i].side = 1 THEN path[i].other || digest ELSE digest || path[i].other END), i + 1, path FROM fold WHERE i <= len(path)
)
SELECT p.doc_id, p.leaf, subs.subroot, top.root, coalesce(path.proof_sha256, sha256('')) AS proof_sha256, fold.digest AS folded_root, fold.digest = top.root AS verified
FROM p JOIN subs USING (tree) CROSS JOIN top LEFT JOIN path ON path.tree = p.tree AND path.place = p.place
JOIN fold ON fold.tree = p.tree AND fold.place = p.place AND fold.i = len(fold.path) + 1
"""
