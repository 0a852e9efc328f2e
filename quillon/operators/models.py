"""What calls a model, as interfaces with scripted stand-ins: prompts go out in Arrow batches, answers are parsed here."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A model: a batch of prompts in, as many answers out. It must pickle; what holds a connection opens it in the call.
Model = Callable[[list[str]], list[str]]


class Scripted:
    """Answers by the first pattern that a prompt matches, else a default."""

    def __init__(self, script: list[tuple[str, str]], default: str = "") -> None:
        self.script, self.default = script, default

    def __call__(self, prompts: list[str]) -> list[str]:
        return [next((a for p, a in self.script if re.search(p, prompt)), self.default) for prompt in prompts]


def ask(df: DataFrame, prompt: Column, model: Model, out: str = "answer") -> DataFrame:
    """df with a model's answer to each row's prompt."""

    @F.pandas_udf(T.StringType())
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            answers = model(prompts.tolist())
            if len(answers) != len(prompts):
                raise ValueError("a model must answer every prompt")
            yield pd.Series(answers)

    return df.withColumn(out, call(prompt))


def question_lines(answer: Column, n: int = 3) -> Column:
    """The questions in an answer, one a line: bullets off, blanks collapsed, each once regardless of case, at most n."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""), r"\s+", " ")))
    lines = F.filter(lines, lambda x: x != "")
    once = F.filter(lines, lambda x, i: F.array_position(F.transform(lines, F.lower), F.lower(x)) == i + 1)
    return F.slice(once, 1, n)


def hypothetical_questions(chunks: DataFrame, model: Model, n: int = 3) -> DataFrame:
    """(parent, ordinal, content): questions that each chunk (id, content) answers."""
    told = ask(chunks, F.concat(F.lit(f"Write {n} questions that this text answers, one a line.\n\n"), "content"), model)
    return told.select(F.col("id").alias("parent"), F.posexplode(question_lines(F.col("answer"), n)).alias("ordinal", "content"))


def multi_query(queries: DataFrame, model: Model, n: int = 4) -> DataFrame:
    """The questions (query_id, text) and up to n rephrasings of each; equal ones once."""
    told = ask(queries, F.concat(F.lit(f"Rephrase in {n} ways, one a line.\n\n"), "text"), model)
    every = F.concat(F.array("text"), question_lines(F.col("answer"), n))
    return told.select("query_id", F.posexplode(F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1)).alias("query_idx", "text"))


def hyde(queries: DataFrame, model: Model) -> DataFrame:
    """The questions and a passage that might answer each."""
    told = ask(queries, F.concat(F.lit("Write a passage that answers this.\n\n"), "text"), model)
    return told.select("query_id", F.posexplode(F.filter(F.array("text", "answer"), lambda x: F.trim(x) != "")).alias("query_idx", "text"))


def rescue_json(text: str):
    """The first JSON value in a text: whole, within a code fence, or the first balanced braces or brackets."""
    for candidate in [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]:
        try:
            return json.loads(candidate)
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text[m.start() :])[0]
        except ValueError:
            pass
    return None


def looping(text: str, least: int = 3, longest: int = 200) -> bool:
    """Whether a text ends in the same piece, at most so long, at least so many times over."""
    for n in range(1, min(longest, len(text) // least) + 1):
        piece = text[-n:]
        if piece.strip() and text.endswith(piece * least) and (n >= 8 or text.endswith(piece * 12)):
            return True
    return False


def rerank_by_model(hits: DataFrame, model: Model, top_n: int = 20) -> DataFrame:
    """Hits (query_id, node_id, rank, text, content) in the order of a model's relevance, ties by rank.

    An answer that is no number is refused by name.
    """
    from pyspark.sql import Window

    told = ask(hits, F.concat(F.lit("How relevant, 0 to 1?\nQuestion: "), "text", F.lit("\nPassage: "), "content"), model)
    value = F.try_to_number(F.trim("answer"), F.lit("9.999")).cast("double")
    checked = F.when(value.isNull(), F.raise_error(F.concat(F.lit("no relevance in: "), "answer")).cast("double")).otherwise(value)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "was")
    out = told.withColumn("score", checked).withColumnRenamed("rank", "was").withColumn("rank", F.row_number().over(order) - 1)
    return out.where(F.col("rank") < top_n).select("query_id", "node_id", "score", "rank")


def cited_answers(passages: DataFrame, queries: DataFrame, model: Model, best: int = 8) -> DataFrame:
    """(query_id, answer, stance, citations): an answer from the best passages, and the labels that it cites.

    passages (query_id, node_id, label, content). Without a passage the stance is not-in-corpus and nothing is asked.
    """
    offered = passages.where(F.col("label") <= best)
    block = offered.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "content"))), lambda p: F.concat(F.lit("["), p["label"].cast("string"), F.lit("] "), p["content"])), "\n\n").alias("evidence"),
        F.array_sort(F.collect_list(F.struct("label", "node_id"))).alias("labels"),
    )
    joined = queries.join(block, "query_id", "left")
    kind = f"array<{passages.schema['node_id'].dataType.simpleString()}>"
    told = ask(joined.where("evidence is not null"), F.concat(F.lit("Answer from the evidence and cite labels.\n\n"), "evidence", F.lit("\n\nQuestion: "), "text"), model)
    cited = F.filter("labels", lambda x: F.contains(F.col("answer"), F.concat(F.lit("["), x["label"].cast("string"), F.lit("]"))))
    none = joined.where("evidence is null").select("query_id", F.lit(None).cast("string").alias("answer"), F.lit("not-in-corpus").alias("stance"), F.array().cast(kind).alias("citations"))
    return told.select("query_id", "answer", F.lit("answered").alias("stance"), F.transform(cited, lambda x: x["node_id"]).alias("citations")).unionByName(none)


def gated_facts(proposed: DataFrame, schema: DataFrame, limit: int = 12) -> DataFrame:
    """Proposed facts (node_id, position, source, source_type, predicate, target, target_type) with the reason each is
    dropped for, null if kept: incomplete, not atomic, off-schema, duplicate, over the limit, in this order."""
    from pyspark.sql import Window

    parts = ("source", "source_type", "predicate", "target", "target_type")
    blank = F.lit(False)
    for p in parts:
        blank = blank | F.coalesce(F.trim(p) == "", F.lit(True))
    compound = F.lit(False)
    for p in ("source", "target"):
        compound = compound | F.col(p).rlike(r"(?i)[,;/]|\band\b|\bor\b") | (F.size(F.split(p, r"\s+")) > 8)
    allowed = schema.select("source_type", "predicate", "target_type").distinct().withColumn("_in", F.lit(True))
    told = proposed.join(allowed, ["source_type", "predicate", "target_type"], "left")
    first = F.when(blank, "incomplete").when(compound, "not-atomic").when(F.col("_in").isNull(), "off-schema")
    told = told.withColumn("reason", first).drop("_in")
    same = Window.partitionBy("node_id", F.col("reason").isNull(), *[F.lower(p) for p in ("source", "predicate", "target")]).orderBy("position")
    told = told.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("reason")))
    kept = Window.partitionBy("node_id", F.col("reason").isNull()).orderBy("position")
    return told.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(kept) > limit), "over-limit").otherwise(F.col("reason")))
