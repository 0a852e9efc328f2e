"""Summary trees: leaves clustered by their vectors, clusters joined by new leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import written


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def auto_settings(vectors: np.ndarray, mean_size: float, max_cluster_chars: int = 8000) -> tuple[int, float]:
    """(cluster size, threshold): as many texts as fit, and the third quartile of all pairs' cosines."""
    near = _unit(vectors) @ _unit(vectors).T
    pairs = near[np.triu_indices(len(vectors), 1)]
    if np.median(pairs) <= 0:
        raise ValueError("vectors are not alike enough to cluster")
    return max(2, int(max_cluster_chars // max(mean_size, 1))), float(np.quantile(pairs, 0.75))


def greedy_clusters(ids: Sequence[str], vectors: np.ndarray, size: int, threshold: float) -> list[list[int]]:
    """Each vector, in the order of ids, joins the most alike running mean with room that it reaches the threshold of."""
    sums: list[np.ndarray] = []
    members: list[list[int]] = []
    for i in sorted(range(len(ids)), key=lambda k: ids[k]):
        best, at = threshold, -1
        for c, total in enumerate(sums):
            if len(members[c]) < size:
                x = float(_unit(total) @ _unit(vectors[i]))
                if x > best or (x == best and at < 0):
                    best, at = x, c
        if at < 0:
            sums.append(vectors[i].astype(float))
            members.append([i])
        else:
            sums[at] = sums[at] + vectors[i]
            members[at].append(i)
    return members


def cluster(leaves: DataFrame, size: int | None = None, threshold: float | None = None, max_leaves: int = 5000, least: int = 2) -> DataFrame:
    """(scope, cluster, node_id, threshold) of leaves (scope, node_id, vector, chars): one level of a tree.

    A scope (a document, a section) is one group, as each step depends on the last; more than `max_leaves` in it
    are refused, which bounds the group. Scopes are independent, so the exchange is by scope.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_leaves:
            raise ValueError(f"more than {max_leaves} leaves in a scope")
        v = np.stack(pdf["vector"]).astype(float)
        n, t = size, threshold
        if (n is None or t is None) and len(pdf) > 1:
            auto = auto_settings(v, float(pdf["chars"].mean()))
            n, t = n or auto[0], auto[1] if t is None else t
        ids = pdf["node_id"].tolist()
        rows = [(pdf["scope"].iloc[0], c, ids[i], t) for c, m in enumerate(greedy_clusters(ids, v, n or 2, 1.0 if t is None else t)) if len(m) >= least for i in m]
        return pd.DataFrame(rows, columns=["scope", "cluster", "node_id", "threshold"])

    return leaves.groupBy("scope").applyInPandas(run, "scope string, cluster int, node_id string, threshold double")


def centroids(members: DataFrame) -> DataFrame:
    """(cluster, vector, n): the mean of each cluster's vectors, place by place."""
    each = members.select("cluster", F.posexplode("vector").alias("i", "x"))
    means = each.groupBy("cluster", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"), F.max("n").alias("n"))


def join_clusters(new: DataFrame, made: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node_id, cluster or null): new leaves (scope, node_id, vector) to the nearest fixed centroid with room.

    Leaves are taken in the order of ids within a scope; made: (scope, cluster, vector, n).
    """

    def run(leaves: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        room = dict(zip(held["cluster"], size - held["n"]))
        at = {c: _unit(np.asarray(v, float)) for c, v in zip(held["cluster"], held["vector"])}
        rows = []
        for r in leaves.sort_values("node_id").itertuples():
            v = _unit(np.asarray(r.vector, float))
            best = max(((float(at[c] @ v), -c) for c in at if room[c] > 0), default=(-2.0, 0))
            chosen = -best[1] if best[0] >= threshold else None
            if chosen is not None:
                room[chosen] -= 1
            rows.append((r.node_id, chosen))
        return pd.DataFrame(rows, columns=["node_id", "cluster"])

    return new.groupBy("scope").cogroup(made.groupBy("scope")).applyInPandas(run, "node_id string, cluster int")


def _summary(summarise: Callable[[Sequence[str]], str], embed: Callable[[str], Sequence[float]], level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What makes the summary node of one cluster's nodes."""

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        parents = pdf["node_id"].tolist()
        text = summarise(pdf["content"].tolist())
        name = hashlib.sha256("\0".join([text, *parents]).encode()).hexdigest()
        return pd.DataFrame([(pdf["scope"].iloc[0], name, level, parents, text, [float(x) for x in embed(text)])], columns=["scope", "node_id", "level", "parents", "content", "vector"])

    return told


def build(leaves: DataFrame, summarise: Callable[[Sequence[str]], str], embed: Callable[[str], Sequence[float]], *, size: int | None = None, threshold: float | None = None, levels: int = 8, max_leaves: int = 5000) -> DataFrame:
    """(scope, node_id, level, parents, content, vector) of the summary nodes above leaves (scope, node_id, content, vector).

    Each level clusters the nodes of the level below and writes a summary of every cluster of two or more; a node's
    parents are what it summarises, its id is the digest of its text and parents, its level one above theirs. It ends
    at a level without clusters, or after `levels`. A leaf without a vector is refused. Summaries of a cluster depend
    on that cluster alone and are made where it lies.
    """
    spark = leaves.sparkSession
    schema = "scope string, node_id string, level int, parents array<string>, content string, vector array<double>"
    vector = F.when(F.col("vector").isNull(), F.raise_error(F.concat(F.lit("no vector: "), "node_id")).cast("array<double>")).otherwise(F.col("vector").cast("array<double>"))
    below = leaves.select("scope", "node_id", "content", vector.alias("vector"))
    out = spark.createDataFrame([], schema)
    for level in range(1, levels + 1):
        members = cluster(below.withColumn("chars", F.length("content")), size, threshold, max_leaves)
        made = written(members.join(below, ["scope", "node_id"]).groupBy("scope", "cluster").applyInPandas(_summary(summarise, embed, level), schema), "summaries")
        if made.isEmpty():
            break
        out = out.unionByName(made)
        below = made.select("scope", "node_id", "content", "vector")
    return out


def outdated(made: DataFrame, joined: DataFrame) -> DataFrame:
    """(node_id): the summaries (node_id, parents) that new members (node_id, cluster) leave outdated, up to the root.

    The clusters that were joined first, then level by level what summarises an outdated one.
    """
    up = made.select(F.col("node_id").alias("above"), F.explode("parents").alias("node_id"))
    found = written(joined.where("cluster is not null").select(F.col("cluster").alias("node_id")).distinct(), "outdated")
    out = found
    while not found.isEmpty():
        found = written(up.join(found, "node_id").select(F.col("above").alias("node_id")).distinct().join(out, "node_id", "left_anti"), "outdated")
        out = out.union(found)
    return out
