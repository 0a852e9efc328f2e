"""The node store: upserts, lineage-aware deletion, change detection, generations, targets on Parquet folders."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(stored: DataFrame, written: DataFrame) -> DataFrame:
    """Nodes (id, content, sources) after a write: content is replaced, sources become the union."""
    both = stored.select("id", "content", "sources", F.lit(0).alias("seq")).unionByName(written.select("id", "content", "sources", F.lit(1).alias("seq")))
    return merged(both, "seq").select("id", "content", "sources")


def merged(nodes: DataFrame, last: str) -> DataFrame:
    """Nodes of which several rows may have an id: the row with the greatest `last` stands, with the sources of all.

    Sources are made distinct in every task before they are exchanged, so a text of many copies costs a row a source
    and task.
    """
    rest = [c for c in nodes.columns if c not in ("id", "sources")]
    newest = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), last).alias("row"))
    each = nodes.select("id", F.explode("sources").alias("source")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    none = F.array().cast(nodes.schema["sources"].dataType)
    return newest.join(each, "id", "left").select("id", *[F.col("row")[c].alias(c) for c in rest], F.coalesce("sources", none).alias("sources"))


def productions(nodes: DataFrame) -> DataFrame:
    """(node_id, production, source): the exact source sets that writes carried."""
    keyed = nodes.select(F.col("id").alias("node_id"), F.array_sort("sources").alias("set")).distinct()
    return keyed.select("node_id", F.array_join("set", "|").alias("production"), F.explode("set").alias("source"))


def delete_sources(made: DataFrame, gone: DataFrame) -> DataFrame:
    """(node_id, sources, deleted): nodes after sources (source) go.

    A production that holds one is tainted. A node keeps the sources of its other productions, and is deleted
    where none is left. Only touched nodes are returned.
    """
    tainted = made.join(gone, "source", "left_semi").select("node_id", "production").distinct()
    touched = made.join(tainted.select("node_id").distinct(), "node_id", "left_semi")
    left = touched.join(tainted, ["node_id", "production"], "left_anti").groupBy("node_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    all_touched = touched.select("node_id").distinct()
    return all_touched.join(left, "node_id", "left").select("node_id", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.col("sources").isNull().alias("deleted"))


def changes(inventory: DataFrame, catalogue: DataFrame, pipeline: str) -> DataFrame:
    """(id, change): what each source of the inventory or the catalogue needs.

    inventory (id, content_hash); catalogue (id, content_hash, pipeline, status). A content change is reported
    before a pipeline change; failed sources are skipped until retried.
    """
    a, b = inventory.alias("a"), catalogue.alias("b")
    j = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    change = (
        F.when(F.col("b.id").isNull(), "new")
        .when(F.col("a.id").isNull(), "vanished")
        .when(F.col("b.status") == "failed", "failed")
        .when(F.col("b.status") == "indexing", "incomplete")
        .when(F.col("a.content_hash") != F.col("b.content_hash"), "content_changed")
        .when(F.col("b.pipeline") != pipeline, "pipeline_changed")
        .otherwise("unchanged")
    )
    return j.select(F.coalesce("a.id", "b.id").alias("id"), change.alias("change"))


def catalogue_put(catalogue: DataFrame, records: DataFrame) -> DataFrame:
    """The catalogue (id, ...) with records of the same columns put in, each in place of the one of its id."""
    return catalogue.join(records.select("id"), "id", "left_anti").select(records.columns).unionByName(records)


def release(made: DataFrame, catalogue: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched nodes as of `delete_sources`, the catalogue without them): what vanished or was reparsed lets its nodes go.

    found (id, change) is what `changes` told. Reparsed sources stay in the catalogue, as being indexed.
    """
    gone = found.where(F.col("change").isin("vanished", "content_changed", "pipeline_changed"))
    touched = delete_sources(made, gone.select(F.col("id").cast("string").alias("source")))
    kept = catalogue.join(gone.select("id", "change"), "id", "left").where(F.coalesce(F.col("change") != "vanished", F.lit(True)))
    status = F.when(F.col("change").isNotNull(), "indexing").otherwise(F.col("status"))
    return touched, kept.withColumn("status", status).select(catalogue.columns)


def corpus_profile(catalogue: DataFrame, context_tokens: int | None = None, *by: str) -> DataFrame:
    """One row that says what a corpus is, or one for each value of `by`, null included: documents, leaves, leaf_tokens, sources_pending, sources_failed, base_complete,
    fits_context. What is not known is null, never zero.

    catalogue (id, status, leaves, tokens, tokenizer). Leaves and tokens are known where every active source has them;
    tokens of several tokenizers are no sum.
    """
    active = F.col("status") == "active"
    known = lambda c: (F.count_if(active) > 0) & (F.count_if(active & F.col(c).isNull()) == 0)
    one = F.size(F.collect_set(F.when(active, F.col("tokenizer")))) == 1
    out = catalogue.groupBy(*by).agg(
        F.count_if(active).alias("documents"),
        F.when(known("leaves"), F.sum(F.when(active, F.col("leaves")))).alias("leaves"),
        F.when(known("tokens") & known("tokenizer") & one, F.sum(F.when(active, F.col("tokens")))).alias("leaf_tokens"),
        F.count_if(F.col("status") == "indexing").alias("sources_pending"),
        F.count_if(F.col("status") == "failed").alias("sources_failed"),
    )
    complete = (F.col("documents") > 0) & (F.col("sources_pending") == 0) & (F.col("sources_failed") == 0)
    return out.select("*", complete.alias("base_complete"), (F.col("leaf_tokens") <= F.lit(context_tokens).cast("long")).alias("fits_context"))


def coverage(catalogue: DataFrame) -> DataFrame:
    """(status, sources): how many sources stand where."""
    return catalogue.groupBy("status").agg(F.count("*").alias("sources"))


def newest_published(generations: DataFrame) -> DataFrame:
    """The one generation of each layer that readers see."""
    shown = generations.where("status = 'published'")
    return shown.groupBy("layer").agg(F.max_by("id", "published_at").alias("id"))


class Targets:
    """Blue and green versions of a table: folders, and a pointer file that one rename moves.

    The pointer's folder is local to the driver or a mounted share; versions are written by executors below `root`.
    """

    def __init__(self, root: str, pointer: str) -> None:
        self.root, self.pointer = root, pointer

    def _state(self) -> dict:
        try:
            with open(self.pointer) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"live": None, "previous": None, "targets": {}}

    def _save(self, state: dict) -> None:
        part = f"{self.pointer}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump(state, f)
        os.replace(part, self.pointer)

    def write(self, name: str, df: DataFrame, identity: dict) -> None:
        """Write a target; one that exists with another embedding identity is refused."""
        state = self._state()
        if state["targets"].get(name, identity) != identity:
            raise ValueError(f"target {name} holds vectors of another embedder")
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        state["targets"][name] = identity
        self._save(state)

    def promote(self, name: str) -> None:
        state = self._state()
        if name not in state["targets"]:
            raise ValueError(f"no target {name}")
        if state["live"] != name:
            state["live"], state["previous"] = name, state["live"]
        self._save(state)

    def rollback(self) -> None:
        state = self._state()
        if not state["previous"]:
            raise ValueError("no previous target")
        state["live"], state["previous"] = state["previous"], state["live"]
        self._save(state)

    def drop(self, name: str) -> None:
        state = self._state()
        if name in (state["live"], state["previous"]):
            raise ValueError("the live and the previous target stay")
        state["targets"].pop(name, None)
        self._save(state)

    def read(self, spark: SparkSession) -> DataFrame:
        state = self._state()
        if not state["live"]:
            raise ValueError("no live target")
        return spark.read.parquet(f"{self.root}/{state['live']}")


class WriterClaim:
    """One writer at a time: a lock file that a second writer finds and is refused by, until its lease has run out.

    A writer that works longer than its lease renews it; one that was killed blocks others for one lease.
    """

    def __init__(self, path: str, lease: float = 3600.0) -> None:
        self.path, self.lease, self.token = path, lease, uuid.uuid4().hex

    def _holder(self) -> str:
        try:
            with open(self.path) as f:
                return f.read()
        except FileNotFoundError:
            return ""

    def __enter__(self) -> WriterClaim:
        own = f"{self.path}.{self.token}"
        with open(own, "w") as f:
            f.write(self.token)
        try:
            os.link(own, self.path)
        except FileExistsError:
            if time.time() - os.path.getmtime(self.path) <= self.lease:
                raise RuntimeError(f"another writer holds {self.path}") from None
            os.replace(own, self.path)
        finally:
            if os.path.exists(own):
                os.unlink(own)
        if self._holder() != self.token:
            raise RuntimeError(f"another writer holds {self.path}")
        return self

    def renew(self) -> None:
        """Start the lease anew; refused where another writer has taken over."""
        if self._holder() != self.token:
            raise RuntimeError(f"another writer holds {self.path}")
        os.utime(self.path)

    def __exit__(self, *_) -> None:
        if self._holder() == self.token:
            os.unlink(self.path)


def one_width(vectors: Column) -> Column:
    """The width of a table's vectors; an aggregate that refuses more than one."""
    widths = F.collect_set(F.size(vectors))
    return F.when(F.size(widths) > 1, F.raise_error(F.lit("vectors of several widths")).cast("int")).otherwise(widths[0])


def supersede(stored: DataFrame, old_id: str, new: DataFrame) -> DataFrame:
    """Stored nodes with one replaced by another (one row of the same columns); fewer sources than before are refused.

    To replace again is to change nothing: the old node is gone and the new one is there.
    """
    checked = new.crossJoin(stored.where(F.col("id") == old_id).agg(F.collect_list("sources").alias("_old")))
    lost = F.exists("_old", lambda s: F.size(F.array_except(s, F.col("sources"))) > 0)
    checked = checked.withColumn("id", F.when(lost, F.raise_error(F.lit("the new node covers fewer sources"))).otherwise(F.col("id"))).drop("_old")
    return stored.where(F.col("id") != old_id).join(new.select("id"), "id", "left_anti").select(stored.columns).unionByName(checked.select(stored.columns))


def reconcile(made: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes left after unfinished deletions, report): sources still marked as deleting are deleted now."""
    gone = catalogue.where("status = 'deleting'").select(F.col("id").alias("source"))
    touched = delete_sources(made, gone)
    report = touched.agg(F.count("*").alias("examined"), F.count_if("deleted").alias("removed"), F.count_if(~F.col("deleted")).alias("narrowed"))
    return touched, report


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that stand for no other: without a representation and without a mark that makes them no leaf."""
    marks = [c for c in ("representation", "mention", "fact") if c in nodes.columns]
    out = nodes
    for c in marks:
        out = out.where(F.col(c).isNull())
    return out


def open_generation(generations: DataFrame, generation: str, layer: str) -> DataFrame:
    """The catalogue of generations with one that is being built."""
    row = generations.sparkSession.createDataFrame([(generation, layer, "building")], "id string, layer string, status string").withColumn("published_at", F.lit(None).cast("timestamp"))
    return generations.join(row.select("id"), "id", "left_anti").select("id", "layer", "status", "published_at").unionByName(row)


def set_generation(generations: DataFrame, generation: str, status: str) -> DataFrame:
    """The catalogue with one generation published (now) or withdrawn."""
    mine = F.col("id") == generation
    at = F.when(mine & F.lit(status == "published"), F.current_timestamp()).otherwise(F.col("published_at"))
    return generations.withColumn("published_at", at).withColumn("status", F.when(mine, status).otherwise(F.col("status")))


def bind(nodes: DataFrame, generation: str) -> DataFrame:
    """Nodes (generations, ...) as members of one more generation."""
    return nodes.withColumn("generations", F.array_sort(F.array_union("generations", F.array(F.lit(generation)))))


def carry_forward(nodes: DataFrame, old: str, new: str, changed: DataFrame) -> DataFrame:
    """Nodes of which those of the old generation whose sources (changed: source) have not changed join the new one."""
    touched = nodes.select("id", F.explode("sources").alias("source")).join(changed, "source", "left_semi").select("id").distinct().withColumn("touched", F.lit(True))
    marked = nodes.join(touched, "id", "left")
    joins = F.array_contains("generations", old) & F.col("touched").isNull()
    return marked.withColumn("generations", F.when(joins, F.array_sort(F.array_union("generations", F.array(F.lit(new))))).otherwise(F.col("generations"))).select(nodes.columns)


def retract(nodes: DataFrame, generation: str) -> DataFrame:
    """Nodes without a generation's membership; a node that was in no other goes."""
    was = F.array_contains("generations", generation)
    left = F.array_remove("generations", generation)
    return nodes.where(~(was & (F.size(left) == 0))).withColumn("generations", left)


def reclaim(nodes: DataFrame, generations: DataFrame) -> DataFrame:
    """Nodes that readers can still see: in no generation at all, or in the newest published one of some layer."""
    alive = newest_published(generations).select(F.col("id").alias("generation"))
    each = nodes.select("id", F.explode("generations").alias("generation")).join(alive, "generation", "left_semi").select("id").distinct().withColumn("seen", F.lit(True))
    return nodes.join(each, "id", "left").where(F.col("seen") | (F.size("generations") == 0)).select(nodes.columns)


def hidden_generations(generations: DataFrame) -> DataFrame:
    """(id): generations that readers do not see: all but the newest published of each layer."""
    return generations.join(newest_published(generations).select("id"), "id", "left_anti").select("id")


def blob_key(tenant: Column, source: Column, ordinal: Column, suffix: Column) -> Column:
    """Where a source's bytes lie: tenant, digest of the source, ordinal."""
    return F.concat(tenant, F.lit("/"), F.sha2(source, 256), F.lit("/"), ordinal.cast("string"), F.lit("."), suffix)
