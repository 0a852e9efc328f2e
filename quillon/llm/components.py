"""Connected components of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import written

#: Links that one task of a round handles, about.
PER_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): the least node that can be reached.

    Each round takes the least label of a node's neighbours, then that label's own; a round's labels are written
    to the shared folder, so that lineage stays short. Rounds grow with the logarithm of the longest path. A round
    has a task for so many links, however many partitions the session shuffles into.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    parts = 1 + both.count() // PER_TASK
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = written(labels.coalesce(parts), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        own = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = lower.join(own, lower["label"] == own["at"], "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was")
        step = written(jumped.coalesce(parts), "labels")
        labels = step.select("node", "label")
        if step.where("label < was").isEmpty():
            return labels
