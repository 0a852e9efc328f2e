"""One object for the usual path: index documents, ask questions, delete sources, all as DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.identity import hash_embedding
from quillon.operators import clean, filters, models, nodes, rank, search, store


class Engine:
    """Chunks below a folder, with vectors and lineage; versions are switched by a pointer file.

    `root` is readable by all executors; `pointer` is a file of the driver's or of a mounted share.
    """

    def __init__(self, spark: SparkSession, root: str, pointer: str, *, size: int = 512, overlap: int = 50, dimension: int = 64, cleaners: tuple[str, ...] = ("hyphenation", "whitespace")) -> None:
        self.spark, self.size, self.overlap, self.dimension, self.cleaners = spark, size, overlap, dimension, cleaners
        self.targets = store.Targets(root, pointer)
        self.identity = {"plugin": "hash", "width": dimension}

    def prepare(self, documents: DataFrame) -> DataFrame:
        """Chunk nodes of documents (doc_id, text) with vectors; row-local, without a shuffle."""
        out = nodes.roots(documents)
        for name in self.cleaners:
            out = clean.clean(out, name)
        return nodes.fixed_size(out, self.size, self.overlap).withColumn("vector", hash_embedding(F.col("content"), self.dimension))

    def _switch(self, df: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        self.targets.write(name, df, self.identity)
        self.targets.promote(name)

    def index(self, documents: DataFrame) -> None:
        """Add documents. Equal chunks are one node with the sources of all; the last write's content stands."""
        new = self.prepare(documents)
        columns = new.columns
        new = new.withColumn("turn", F.lit(1))
        try:
            new = self.targets.read(self.spark).withColumn("turn", F.lit(0)).unionByName(new)
        except ValueError:
            pass
        self._switch(store.merged(new, "turn").select(columns))

    def delete(self, sources: DataFrame) -> None:
        """Remove sources (source): a node keeps its other sources and goes with its last."""
        held = self.targets.read(self.spark)
        each = held.select("id", F.explode("sources").alias("source")).join(sources, "source", "left_anti")
        left = each.groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
        self._switch(held.drop("sources").join(left, "id").select(held.columns))

    def retrieve(self, queries: DataFrame, k: int = 20, where: dict | None = None) -> DataFrame:
        """(query_id, node_id, score, rank): vector and text hits of questions (query_id, text), fused."""
        held = self.targets.read(self.spark)
        if where:
            held = filters.matching(held, where)
        asked = queries.select("query_id", hash_embedding(F.col("text"), self.dimension).alias("vector"))
        near = search.vector_top_k(asked, held.select(F.col("id").alias("node_id"), "vector"), k)
        text = search.bm25(queries, held.select(F.col("id").alias("node_id"), "content"), k)
        return rank.reciprocal_rank(rank.arms(("vector", near), ("text", text)), top_k=k)

    def ask(self, queries: DataFrame, model: models.Model, k: int = 20, budget: int = 2000) -> DataFrame:
        """(query_id, answer, stance, citations) from the best passages within the budget."""
        held = self.targets.read(self.spark).select(F.col("id").alias("node_id"), "content")
        packed = rank.repack(self.retrieve(queries, k).join(held, "node_id"), budget=budget, method="forward")
        return models.cited_answers(packed.join(held, "node_id"), queries, model)

    def coverage(self) -> DataFrame:
        """(source, chunks) of what is indexed."""
        return self.targets.read(self.spark).select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("chunks"))
