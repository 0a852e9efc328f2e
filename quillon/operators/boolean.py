"""Boolean questions, each with a tree of its own: the trees are rows, evaluated from the leaves up by set joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.identity import tokens
from quillon.operators import search
from quillon.operators.route import parse_boolean
from quillon.session import written

#: How deep parentheses may nest.
DEPTH = 3
_COLUMNS = (("query_id", None), ("node", pa.int32()), ("parent", pa.int32()), ("place", pa.int32()), ("level", pa.int32()), ("op", pa.string()), ("negated", pa.bool_()), ("term", pa.string()), ("wrong", pa.string()))


def _rows(text: str | None, depth: int) -> list[tuple]:
    """(node, parent, place, level, op, negated, term, wrong) of a question's tree, the root first, or one row that says what is wrong."""
    out: list[tuple] = []

    def add(tree, parent: int | None, place: int, level: int, negated: bool) -> None:
        node = len(out)
        if isinstance(tree, str):
            out.append((node, parent, place, level, "term", negated, tree, None))
            return
        op, *parts = tree
        if op == "not":
            raise ValueError("a negation needs an and with something positive beside it")
        out.append((node, parent, place, level, op, negated, None, None))
        denied = [isinstance(p, tuple) and p[0] == "not" for p in parts]
        if any(denied) and op == "or":
            raise ValueError("a negation cannot stand in an or")
        if all(denied):
            raise ValueError("nothing but negations")
        for i, (p, no) in enumerate(zip(parts, denied)):
            add(p[1] if no else p, node, i, level + 1, no)

    try:
        add(parse_boolean(text or "", depth), None, 0, 0, False)
    except ValueError as e:
        return [(0, None, 0, 0, "wrong", False, None, str(e))]
    return out


def compiled(questions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, node, parent, place, level, op, negated, term, wrong): the nodes of each question's (query_id, text) tree.

    Terms are bare words or quoted phrases; `not` binds closest, then `and`, then `or`; parentheses nest to `depth`. A
    question that cannot be read, or asks for a complement that has no bound (a negation on its own, under an `or` or
    under another), is one row with `wrong` saying why.
    """
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, *r) for q, t in zip(batch.column("query_id").to_pylist(), batch.column("text").to_pylist()) for r in _rows(t, depth)]
            types = [batch.schema.field("query_id").type, *[t for _, t in _COLUMNS[1:]]]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[n for n, _ in _COLUMNS])

    return questions.select("query_id", "text").mapInArrow(run, f"query_id {kind}, node int, parent int, place int, level int, op string, negated boolean, term string, wrong string")


def leaf_hits(trees: DataFrame, nodes: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, node, node_id, score) of all nodes that hold every word of a leaf; the score is how often its words stand there.

    A leaf's hits are whole: no best k of them, so that what is combined of them is right.
    """
    source = search.postings(nodes) if index is None else index
    leaves = trees.where("op = 'term'").select("query_id", "node", F.array_distinct(tokens(F.col("term"))).alias("words"))
    asked = leaves.select("query_id", "node", F.size("words").alias("need"), F.explode("words").alias("word"))
    held = source.select("node_id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("node_id", F.col("t.terms").alias("word"), F.col("t.counts").alias("n"))
    met = held.join(asked, "word").groupBy("query_id", "node", "need", "node_id").agg(F.count("*").alias("words"), F.sum("n").alias("score"))
    return met.where("words = need").select("query_id", "node", "node_id", F.col("score").cast("double").alias("score"))


def evaluated(trees: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, node_id, score, rank): what each question's tree makes of its leaves' hits (query_id, node, node_id, score).

    Level by level from the deepest, all questions at once: an `and` keeps what all its positive parts hold and no
    negated one, with the first positive part's score; an `or` keeps the best score of any part.
    """
    inner = trees.where("op IN ('and', 'or')")
    parts = trees.where("NOT negated AND parent IS NOT NULL").groupBy("query_id", F.col("parent").alias("node")).agg(F.count("*").alias("positive"))
    inner = inner.join(parts, ["query_id", "node"]).select("query_id", "node", F.col("op").alias("of"), "positive")
    known = trees.where("wrong IS NULL").select("query_id", "node", "parent", "place", "level", "negated")
    leaf = known.join(hits, ["query_id", "node"])
    above = None
    for level in range(trees.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = leaf.where(F.col("level") == level).select("query_id", "parent", "place", "negated", "node_id", "score")
        here = here if above is None else here.unionByName(above)
        told = here.groupBy("query_id", F.col("parent").alias("node"), "node_id").agg(
            F.count(F.when(~F.col("negated"), 1)).alias("held"), F.count(F.when(F.col("negated"), 1)).alias("denied"),
            F.min_by("score", F.when(~F.col("negated"), F.col("place"))).alias("first"), F.max("score").alias("best"),
        )
        kept = told.join(inner, ["query_id", "node"]).where("of = 'or' OR (held = positive AND denied = 0)")
        scored = kept.select("query_id", "node", "node_id", F.when(F.col("of") == "or", F.col("best")).otherwise(F.col("first")).alias("score"))
        above = written(scored.join(known, ["query_id", "node"]).select("query_id", "parent", "place", "negated", "node_id", "score"), "level")
    root = leaf.where("level = 0").select("query_id", "node_id", "score")
    root = root if above is None else root.union(above.select("query_id", "node_id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return root.withColumn("rank", F.row_number().over(order) - 1)


def outcomes(trees: DataFrame, result: DataFrame) -> DataFrame:
    """(query_id, outcome, note) of every question: 'hits', 'no hits', 'empty conjunction', or 'failed'.

    A root `and` that no node satisfies is an outcome of its own, never answered by what only some parts hold.
    """
    named = F.when(F.col("negated"), F.concat(F.lit("not "), F.coalesce("term", F.lit("(...)")))).otherwise(F.coalesce("term", F.lit("(...)")))
    said = trees.where("parent = 0").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", named.alias("said")))).alias("parts"))
    roots = trees.where("parent IS NULL").select("query_id", "op", "wrong").join(said, "query_id", "left").join(result.select("query_id").distinct().withColumn("any", F.lit(True)), "query_id", "left")
    outcome = F.when(F.col("wrong").isNotNull(), "failed").when(F.col("any"), "hits").when(F.col("op") == "and", "empty conjunction").otherwise("no hits")
    note = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(outcome == "empty conjunction", F.concat(F.lit("no node holds "), F.array_join(F.transform("parts", lambda p: p["said"]), " and ")))
    return roots.select("query_id", outcome.alias("outcome"), note.alias("note"))


def boolean_retrieval(questions: DataFrame, nodes: DataFrame, *, depth: int = DEPTH, on_empty: str = "report", index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, outcomes) of Boolean questions (query_id, text) over nodes (node_id, content).

    With on_empty="fail" an empty conjunction raises when the outcomes are read; else it is reported beside no hits.
    """
    trees = written(compiled(questions, depth), "trees")
    hits = written(evaluated(trees, leaf_hits(trees, nodes, index)), "combined")
    told = outcomes(trees, hits)
    if on_empty == "fail":
        told = told.withColumn("outcome", F.when(F.col("outcome") == "empty conjunction", F.raise_error(F.col("note"))).otherwise(F.col("outcome")))
    return hits, told
