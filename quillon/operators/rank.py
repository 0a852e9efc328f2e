"""From hits to passages: fusers, rerankers and packers over one long table of hits.

hits(query_id, list_idx, arm, node_id, score, rank): all questions, arms and ranks at once; rank counts from 0.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.identity import tokens


def arms(*lists: tuple[str, DataFrame]) -> DataFrame:
    """Ranked lists as one table of hits, in the order given."""
    out = None
    for i, (name, hits) in enumerate(lists):
        part = hits.select("query_id", F.lit(i).alias("list_idx"), F.lit(name).alias("arm"), "node_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(df: DataFrame, *order: Column, top_k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)
    return out.where(F.col("rank") < top_k) if top_k else out


def single_list(hits: DataFrame) -> DataFrame:
    """The one list of each question; more than one is refused."""
    many = hits.groupBy("query_id").agg(F.countDistinct("list_idx").alias("lists"))
    one = F.when(F.col("lists") > 1, F.raise_error(F.lit("more than one list to fuse")).cast("int")).otherwise(F.lit(1))
    return hits.join(many.select("query_id", one.alias("_one")), "query_id").where("_one = 1").drop("_one", "list_idx")


def _weight(weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("arm")], F.lit(1.0))


def reciprocal_rank(hits: DataFrame, k: int = 60, weights: Mapping[str, float] | None = None, top_k: int | None = None) -> DataFrame:
    """Sum of weight / (k + rank + 1); equal sums in the order in which nodes were first seen, by list, then rank."""
    fused = hits.groupBy("query_id", "node_id").agg(
        F.sum(_weight(weights) / (k + F.col("rank") + 1)).alias("score"),
        F.min(F.struct("list_idx", "rank")).alias("seen"),
        F.min(F.struct("rank", "list_idx", "arm"))["arm"].alias("arm"),
    )
    return _ranked(fused.withColumn("score", F.round("score", 9)), F.desc("score"), F.col("seen"), F.col("node_id"), top_k=top_k).drop("seen")


def evidence(hits: DataFrame) -> DataFrame:
    """(query_id, node_id, evidence): what each arm said of a node before fusion, as array<struct<list_idx,arm,score,rank>>
    in the order of the arms; arms are few, so the array is short."""
    said = F.struct("list_idx", "arm", "score", F.col("rank").cast("int").alias("rank"))
    return hits.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(said)).alias("evidence"))


def normalized_scores(hits: DataFrame, weights: Mapping[str, float] | None = None, top_k: int | None = None) -> DataFrame:
    """Sum of weighted scores scaled to 0..1 within each list; a list of equal scores scales to 1."""
    own = Window.partitionBy("query_id", "list_idx")
    low, high = F.min("score").over(own), F.max("score").over(own)
    refused = F.raise_error(F.lit("a score is not finite")).cast("double")
    scale = F.when(F.isnan("score") | (F.abs("score") == float("inf")), refused).when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    scaled = hits.withColumn("norm", scale)
    fused = scaled.groupBy("query_id", "node_id").agg(F.round(F.sum(_weight(weights) * F.col("norm")), 9).alias("score"), F.min(F.struct("list_idx", "rank")).alias("seen"))
    return _ranked(fused, F.desc("score"), F.col("seen"), F.col("node_id"), top_k=top_k).drop("seen")


def boolean_combine(hits: DataFrame, tree: tuple) -> DataFrame:
    """Evaluate ("and" | "or", parts...), ("not", part) or a list's number over the lists' nodes.

    `and` keeps what all its positive parts hold and no negated one, with the first positive part's score; `or`
    keeps the best score. A negation stands within an `and` beside a positive part, nowhere else.
    """

    def run(t) -> DataFrame:
        if isinstance(t, int):
            return hits.where(F.col("list_idx") == t).select("query_id", "node_id", "score")
        op, *parts = t
        if op == "or":
            if any(isinstance(p, tuple) and p[0] == "not" for p in parts):
                raise ValueError("a negation cannot stand in an or")
            out = run(parts[0])
            for p in parts[1:]:
                out = out.union(run(p))
            return out.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
        if op != "and":
            raise ValueError("a negation cannot stand alone")
        held = [p for p in parts if not (isinstance(p, tuple) and p[0] == "not")]
        if not held:
            raise ValueError("nothing but negations")
        out = run(held[0])
        for p in held[1:]:
            out = out.join(run(p), ["query_id", "node_id"], "left_semi")
        for p in parts:
            if p not in held:
                out = out.join(run(p[1]), ["query_id", "node_id"], "left_anti")
        return out

    return _ranked(run(tree), F.desc("score"), F.col("node_id"))


def shingle_resemblance(hits: DataFrame, threshold: float = 0.5, size: int = 10) -> DataFrame:
    """Drop hits that resemble a kept hit before them (Jaccard of word shingles); ranks anew, scores kept.

    hits has `content`. A question's list is bounded by its top k and handled in one group.
    """
    words = tokens(F.col("content"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))), lambda i: F.array_join(F.slice("words", i + 1, size), " "))
    listed = hits.withColumn("words", words).withColumn("shingles", F.array_distinct(cut)).drop("words", "content")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[set, int]] = []
        for i, s in zip(pdf.sort_values("rank").index, (set(x) for x in pdf.sort_values("rank")["shingles"])):
            if all(len(s & t) / max(1, len(s | t)) < threshold for t, _ in kept):
                kept.append((s, i))
        out = pdf.loc[[i for _, i in kept]].drop(columns="shingles")
        return out.assign(rank=np.arange(len(out), dtype="int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.drop("shingles").schema)
    return listed.groupBy("query_id").applyInPandas(keep, schema)


def mmr(hits: DataFrame, weight: float = 0.7, top_n: int | None = None) -> DataFrame:
    """Order by weight * cosine(question, node) - (1 - weight) * greatest cosine to a node chosen before.

    hits has `vector` and `asked`. Equal values go to the lower rank; the value replaces the score.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        v, q = np.stack(pdf["vector"]).astype(float), np.asarray(pdf["asked"][0], float)
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        near, alike = unit @ (q / max(np.linalg.norm(q), 1e-300)), unit @ unit.T
        left, order, values = list(range(len(pdf))), [], []
        while left and len(order) < (top_n or len(pdf)):
            value = [round(weight * near[i] - (1 - weight) * (max(alike[i][j] for j in order) if order else 0.0), 12) for i in left]
            best = int(np.argmax(value))
            values.append(value[best])
            order.append(left.pop(best))
        return pdf.loc[order, ["query_id", "node_id"]].assign(score=np.round(values, 9), rank=np.arange(len(order), dtype="int32"))

    return hits.groupBy("query_id").applyInPandas(choose, "query_id long, node_id long, score double, rank int")


def collapse(hits: DataFrame, aggregate: str = "max") -> DataFrame:
    """Hits that stand for their one parent count for it; then a hit whose parent or member is kept is dropped.

    hits has `parents` and `representation` (null for a direct hit). Score by max, sum or mean; order by score,
    then best rank.
    """
    own = (F.size("parents") == 1) & F.col("representation").isNotNull()
    score = {"max": F.max, "sum": F.sum, "mean": F.avg}[aggregate]("score")
    grouped = hits.withColumn("key", F.when(own, F.col("parents")[0]).otherwise(F.col("node_id"))).groupBy("query_id", "key").agg(
        score.alias("score"), F.min("rank").alias("best"), F.max(F.when(~own, F.col("parents"))).alias("parents")
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, ids, absorbed = [], set(), set()
        for r in pdf.sort_values(["score", "best"], ascending=[False, True]).itertuples():
            parents = set(r.parents) if r.parents is not None else set()
            if r.key in absorbed or ids & parents:
                continue
            kept.append((r.query_id, r.key, r.score, len(kept)))
            ids.add(r.key)
            absorbed |= parents
        return pd.DataFrame(kept, columns=["query_id", "node_id", "score", "rank"])

    return grouped.groupBy("query_id").applyInPandas(walk, "query_id long, node_id string, score double, rank int")


def adjacent(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Each hit with its neighbours of the same parent within `window` ordinals, in their order, each node once.

    An equi-join on the parent with a band on the ordinal; a neighbour takes the hit's score.
    """
    at = chunks.select("node_id", "parent", "ordinal")
    mine = hits.join(at, "node_id").select("query_id", F.col("rank").alias("hit"), "score", "parent", F.col("ordinal").alias("at"))
    beside = mine.join(at, "parent").where(F.abs(F.col("ordinal") - F.col("at")) <= window)
    first = Window.partitionBy("query_id", "node_id").orderBy("hit", "ordinal")
    once = beside.withColumn("n", F.row_number().over(first)).where("n = 1")
    return _ranked(once, F.col("hit"), F.col("ordinal")).select("query_id", "node_id", "score", "rank")


def _plain(x: Column) -> Column:
    """Words between single spaces, infix hyphens taken out, with a space at either end."""
    joined = F.regexp_replace(F.lower(x), r"(?U)(?<=\w)-(?=\w)", "")
    return F.concat(F.lit(" "), F.array_join(tokens(joined), " "), F.lit(" "))


def promote_anchors(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """Three points for each anchor whose words a hit holds in a row; stable order by the number held.

    hits has `content`; anchors: (query_id, anchors array).
    """
    told = hits.join(anchors, "query_id", "left").withColumn("plain", _plain(F.col("content")))
    held = F.size(F.filter(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: (F.length(F.trim(_plain(a))) > 0) & F.contains(F.col("plain"), _plain(a))))
    out = told.withColumn("held", held).withColumn("score", F.col("score") + 3 * F.col("held")).withColumnRenamed("rank", "was")
    return _ranked(out, F.desc("held"), F.col("was")).select("query_id", "node_id", "score", "rank", "held")


def repack(hits: DataFrame, budget: int | None = None, top_n: int | None = None, method: str = "reverse") -> DataFrame:
    """The longest prefix of a ranking whose words fit the budget, in order forward, reverse or sides; labels from 1.

    hits has `content`; a passage counts its words and one for its label. A first passage over budget is refused.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    cost = F.size(F.regexp_extract_all("content", F.lit(r"\S+"), F.lit(0))) + 1
    out = hits.withColumn("place", F.row_number().over(order) - 1).withColumn("spent", F.sum(cost).over(order))
    if top_n:
        out = out.where(F.col("place") < top_n)
    if budget:
        over = F.when((F.col("place") == 0) & (F.col("spent") > budget), F.raise_error(F.lit("the best passage alone is over budget")).cast("boolean")).otherwise(F.col("spent") <= budget)
        out = out.where(over)
    n = F.count("*").over(Window.partitionBy("query_id"))
    i = F.col("place")
    label = {"forward": i + 1, "reverse": n - i, "sides": F.when(i % 2 == 0, i / 2 + 1).otherwise(n - (i - 1) / 2)}[method]
    return out.withColumn("label", label.cast("int")).select("query_id", "node_id", "score", F.col("place").cast("int").alias("rank"), "label")
