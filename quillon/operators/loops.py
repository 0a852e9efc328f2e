"""Retrieval that judges what it found and goes on: all open questions of a round are one job.

A retriever is a function from questions (query_id, text) to hits (query_id, node_id, score, rank). A critic is a
function from (query_id, text, evidence) to (query_id, sufficient, missing array<string>, observed).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import models, rank
from quillon.session import written

Retriever = Callable[[DataFrame], DataFrame]


def multi_retriever(queries: DataFrame, retrievers: Sequence[tuple[str, Retriever]]) -> DataFrame:
    """The lists of two or more retrievers as one table of hits, labelled by their names."""
    if len(retrievers) < 2:
        raise ValueError("two retrievers or more")
    return rank.arms(*[(name, r(queries)) for name, r in retrievers])


def channelled(queries: DataFrame, channel: str, retriever: Retriever) -> DataFrame:
    """Hits of the questions that ask for a channel, or for none in particular; queries has `channels` (array or null)."""
    mine = queries.where(F.col("channels").isNull() | F.array_contains("channels", channel))
    return retriever(mine.drop("channels"))


def evidence(hits: DataFrame, contents: DataFrame, best: int = 8) -> DataFrame:
    """(query_id, evidence): the best hits' texts, each after its number."""
    told = hits.where(F.col("rank") < best).join(contents, "node_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return told.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("["), (x["rank"] + 1).cast("string"), F.lit("] "), x["content"])), "\n\n").alias("evidence"))


def model_critic(model: models.Model) -> Callable[[DataFrame], DataFrame]:
    """A critic that asks a model for {"sufficient", "missing"}; an answer that cannot be read counts as unobserved."""

    def critic(asked: DataFrame) -> DataFrame:
        told = models.ask(asked, F.concat(F.lit("Is the evidence sufficient? Answer as JSON with sufficient and missing.\nQuestion: "), "text", F.lit("\n"), F.coalesce("evidence", F.lit(""))), model)
        said = F.from_json("answer", "sufficient boolean, missing array<string>")
        return told.select("query_id", F.coalesce(said["sufficient"], F.lit(False)).alias("sufficient"), F.coalesce(said["missing"], F.array().cast("array<string>")).alias("missing"), said["sufficient"].isNotNull().alias("observed"))

    return critic


def iterative(queries: DataFrame, retriever: Retriever, contents: DataFrame, critic: Callable[[DataFrame], DataFrame], max_rounds: int = 3, min_rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(hits of all rounds, (query_id, rounds, reason)): retrieve, judge, ask for what is missing, until done.

    A question stops, in this order: its critic says nothing; (not before min_rounds) the evidence is sufficient;
    the rounds are used up; a round brought nothing new. Later rounds' hits rank after earlier ones'.
    """
    open_ = written(queries.select("query_id", "text", F.col("text").alias("asked")), "open")
    found: DataFrame | None = None
    stops: list[DataFrame] = []
    for turn in range(1, max_rounds + 1):
        hits = retriever(open_.select("query_id", F.col("asked").alias("text"))).withColumn("round", F.lit(turn))
        new = hits if found is None else hits.join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        new = written(new, "round")
        fresh = new.select("query_id").distinct().withColumn("fresh", F.lit(True))
        found = new if found is None else written(found.unionByName(new), "found")
        order = Window.partitionBy("query_id").orderBy("round", "rank", "node_id")
        so_far = found.withColumn("rank", F.row_number().over(order) - 1)
        judged = critic(open_.select("query_id", "text").join(evidence(so_far, contents), "query_id", "left"))
        told = open_.join(judged, "query_id").join(fresh, "query_id", "left")
        reason = (
            F.when(~F.col("observed"), "unobserved")
            .when(F.col("sufficient") & F.lit(turn >= min_rounds), "sufficient")
            .when(F.lit(turn == max_rounds), "max-rounds")
            .when(F.col("fresh").isNull(), "no-new-evidence")
        )
        told = written(told.withColumn("reason", reason), "judged")
        stops.append(told.where("reason is not null").select("query_id", F.lit(turn).alias("rounds"), "reason"))
        open_ = told.where("reason is null").select("query_id", "text", F.when(F.size("missing") > 0, F.array_join("missing", "; ")).otherwise(F.col("asked")).alias("asked"))
        if open_.isEmpty():
            break
    order = Window.partitionBy("query_id").orderBy("round", "rank", "node_id")
    out = stops[0]
    for s in stops[1:]:
        out = out.unionByName(s)
    return found.withColumn("rank", F.row_number().over(order) - 1), out


def graded(hits: DataFrame, contents: DataFrame, queries: DataFrame, model: models.Model, floor: float = 0.5, most: int = 20) -> DataFrame:
    """The first `most` hits of a question that a model grades at least `floor` (0 to 1), in their order."""
    told = models.ask(
        hits.where(F.col("rank") < most).join(contents, "node_id").join(queries, "query_id"),
        F.concat(F.lit("Grade the passage, 0 to 1.\nQuestion: "), "text", F.lit("\nPassage: "), "content"),
        model,
    )
    grade = F.try_to_number(F.trim("answer"), F.lit("9.999")).cast("double")
    kept = told.where(grade >= floor).withColumnRenamed("rank", "was")
    order = Window.partitionBy("query_id").orderBy("was")
    return kept.withColumn("rank", F.row_number().over(order) - 1).select("query_id", "node_id", "score", "rank")


def corrective(queries: DataFrame, primary: Retriever, other: Retriever, grader: Callable[[DataFrame], DataFrame], below: int = 3) -> DataFrame:
    """Hits of the primary retriever that a grader keeps; where it keeps fewer than `below`, those of another too."""
    kept = written(grader(primary(queries)), "kept")
    few = queries.join(kept.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= below).select("query_id"), "query_id", "left_anti")
    return rank.arms(("primary", kept), ("other", other(few)))


def step_back(queries: DataFrame, model: models.Model) -> DataFrame:
    """The questions and one broader question for each."""
    told = models.ask(queries, F.concat(F.lit("Ask a broader question.\n\n"), "text"), model)
    return told.select("query_id", F.posexplode(F.array_distinct(F.filter(F.array("text", F.trim("answer")), lambda x: x != ""))).alias("query_idx", "text"))


def rewritten(queries: DataFrame, history: DataFrame, model: models.Model) -> DataFrame:
    """Questions made to stand alone by their history (query_id, history); those without one stay as they are."""
    joined = queries.join(history, "query_id", "left")
    talk = models.ask(joined.where("history <> ''"), F.concat(F.lit("Rewrite to stand alone.\n\n"), "history", F.lit("\n\nQuestion: "), "text"), model)
    return talk.select("query_id", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.col("text")).alias("text")).unionByName(joined.where("history is null or history = ''").select("query_id", "text"))


def scored_queries(queries: DataFrame, model: models.Model, dimensions: Sequence[str]) -> DataFrame:
    """(query_id, one column a dimension): a model's scores from 0 to 1; what it leaves out is unknown, not 0."""
    told = models.ask(queries, F.concat(F.lit("Score from 0 to 1 as JSON: " + ", ".join(dimensions) + "\n\n"), "text"), model)
    said = F.from_json("answer", ", ".join(f"`{d}` double" for d in dimensions))
    return told.select("query_id", *[F.when(said[d].between(0, 1), said[d]).alias(d) for d in dimensions])


def summarised(hits: DataFrame, contents: DataFrame, queries: DataFrame, model: models.Model, size: int = 4) -> DataFrame:
    """(query_id, content, score): one passage a question, its hits summarised by groups of `size`, group by group."""
    level = hits.join(contents, "node_id").select("query_id", "rank", "score", "content")
    best = hits.groupBy("query_id").agg(F.max("score").alias("score"))
    for _ in range(3):
        groups = level.groupBy("query_id", (F.col("rank") / size).cast("int").alias("rank")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("block"), F.max("score").alias("score"))
        told = models.ask(groups.join(queries, "query_id"), F.concat(F.lit("Summarise for the question.\n\n"), "block", F.lit("\n\nQuestion: "), "text"), model)
        level = written(told.select("query_id", "rank", "score", F.col("answer").alias("content")), "summaries")
        if level.where("rank > 0").isEmpty():
            break
    one = level.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("content"))
    return one.join(best, "query_id")


def refined(queries: DataFrame, retriever: Retriever, contents: DataFrame, model: models.Model, critic: Callable[[DataFrame], DataFrame], max_rounds: int = 3) -> DataFrame:
    """(query_id, answer, rounds, reason): answers drafted from what iterative retrieval gathers for each question."""
    hits, stops = iterative(queries, retriever, contents, critic, max_rounds)
    told = models.ask(queries.join(evidence(hits, contents), "query_id", "left"), F.concat(F.lit("Answer.\n\n"), F.coalesce("evidence", F.lit("")), F.lit("\n\nQuestion: "), "text"), model)
    return told.select("query_id", "answer").join(stops, "query_id")


def contradicted(answers: DataFrame, passages: DataFrame, model: models.Model) -> DataFrame:
    """(query_id, answer, stance): 'contradicted' or 'supported' by a model's word on the passages, else 'undetermined'."""
    block = passages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "content"))), lambda x: x["content"]), "\n\n").alias("evidence"))
    told = models.ask(answers.withColumnRenamed("answer", "draft").join(block, "query_id", "left"), F.concat(F.lit("Do the passages contradict the answer? yes or no.\n\n"), F.coalesce("evidence", F.lit("")), F.lit("\n\nAnswer: "), F.coalesce("draft", F.lit(""))), model)
    word = F.lower(F.trim("answer"))
    return told.select("query_id", F.col("draft").alias("answer"), F.when(word.startswith("yes"), "contradicted").when(word.startswith("no"), "supported").otherwise("undetermined").alias("stance"))
