"""The entity graph as stored tables that follow their nodes: what a node states is added once, and retracted when it goes.

mentions (node_id, name, count) is what each node states. aliases (name, entity, mentions, nodes) and relations (source,
target, predicate, nodes) are sums over it, and keep how many nodes stand behind each row; a change adds what new nodes
state, subtracts what gone nodes stated, and drops the rows behind which nothing stands. A change reads the texts of the
new nodes and the mentions of the gone ones, never the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import graph
from quillon.session import written

_ALIAS, _RELATION = ("name",), ("source", "target", "predicate")


@dataclass
class Graph:
    """mentions, aliases and relations, as stored tables."""

    mentions: DataFrame
    aliases: DataFrame
    relations: DataFrame


def _sums(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, relations) that mentions add up to."""
    aliases = found.groupBy("name").agg(F.sum("count").alias("mentions"), F.count("*").alias("nodes"))
    return aliases, graph.cooccurrences(found).groupBy(*_RELATION).agg(F.count("*").alias("nodes"))


def _stored(found: DataFrame, aliases: DataFrame, relations: DataFrame) -> Graph:
    named = aliases.select("name", graph.entity_id(F.col("name")).alias("entity"), "mentions", "nodes")
    return Graph(written(found, "mentions"), written(named, "aliases"), written(relations.select(*_RELATION, "nodes"), "relations"))


def rebuilt(nodes: DataFrame) -> Graph:
    """The graph of all nodes (node_id, content); rows of one node_id are one node, null texts state nothing."""
    found = written(graph.mentions(nodes), "found")
    return _stored(found, *_sums(found))


def _followed(old: DataFrame, keys: tuple[str, ...], counts: tuple[str, ...], new: DataFrame, gone: DataFrame) -> DataFrame:
    """old with the counts of new added and those of gone taken away; rows without a node are dropped."""
    minus = gone.select(*keys, *[(-F.col(c)).alias(c) for c in counts])
    change = new.select(*keys, *counts).unionByName(minus).groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_change") for c in counts])
    both = old.select(*keys, *counts).join(change, list(keys), "full_outer")
    now = both.select(*keys, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_change", F.lit(0))).alias(c) for c in counts])
    return now.where("nodes > 0")


def changed(held: Graph, added: DataFrame, removed: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, touched): the graph after nodes (node_id, content) came and nodes (node_id) went, and the names whose row is another one.

    A node that is added and held already is replaced; one that is removed and added is there with its new text;
    removing what is not held changes nothing. The result is that of `rebuilt` on the nodes that are left.
    """
    new = written(graph.mentions(added), "new")
    out = removed.select("node_id").union(added.select("node_id")).distinct()
    gone = written(held.mentions.join(out, "node_id", "left_semi"), "gone")
    found = held.mentions.join(out, "node_id", "left_anti").unionByName(new)
    (more, closer), (less, farther) = _sums(new), _sums(gone)
    aliases = _followed(held.aliases, _ALIAS, ("mentions", "nodes"), more, less)
    relations = _followed(held.relations, _RELATION, ("nodes",), closer, farther)
    stated = lambda x, sign: x.select("name", (sign * F.col("mentions")).alias("mentions"), (sign * F.col("nodes")).alias("nodes"))
    touched = stated(more, 1).union(stated(less, -1)).groupBy("name").agg(F.sum("mentions").alias("m"), F.sum("nodes").alias("n")).where("m <> 0 OR n <> 0").select("name")
    return _stored(found, aliases, relations), touched


def near(held: Graph, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, entity, distance) of what stored relations lead to from seeds (entity: a name); no text is read."""
    return graph.neighbourhood(seeds, held.relations, hops)
