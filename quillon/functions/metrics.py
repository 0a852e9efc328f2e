"""Scores of rankings and answers, and what is said about them."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import mmap
import os
import tempfile
import threading
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.identity import tokens
from quillon.session import written


def ranking_scores(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """precision, recall, average precision, ndcg and reciprocal rank at k of each question that has relevant nodes.

    hits (query_id, node_id, rank from 0); relevant (query_id, node_id). One join, one aggregation by question.
    """
    many = relevant.groupBy("query_id").agg(F.countDistinct("node_id").alias("n"))
    good = hits.where(F.col("rank") < k).join(relevant.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi")
    return counted_scores(good, many, k)


def counted_scores(good: DataFrame, many: DataFrame, k: int) -> DataFrame:
    """The scores of `ranking_scores` of relevant hits (query_id, rank), and how many nodes are relevant to each question (query_id, n).

    For questions to which so many nodes are relevant that these are better counted than listed.
    """
    ranks = good.where(F.col("rank") < k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("rank") + 1)).alias("at"))
    each = many.join(ranks, "query_id", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    gain = F.aggregate(F.transform("at", lambda r: 1 / F.log2(r + 1.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), lambda r: 1 / F.log2(r + 1.0)), F.lit(0.0), lambda a, x: a + x)
    precise = F.aggregate(F.transform("at", lambda r, i: (i + 1) / r), F.lit(0.0), lambda a, x: a + x)
    first = F.when(F.size("at") > 0, 1 / F.try_element_at("at", F.lit(1))).otherwise(F.lit(0.0))
    return each.select(
        "query_id",
        (F.size("at") / F.lit(k)).alias("precision"),
        (F.size("at") / F.col("n")).alias("recall"),
        F.round(precise / F.col("n"), 9).alias("average_precision"),
        F.round(gain / ideal, 9).alias("ndcg"),
        F.round(first, 9).alias("reciprocal_rank"),
    )


def squeezed(x: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def exact_match(answer: Column, reference: Column) -> Column:
    return (squeezed(answer) == squeezed(reference)).cast("double")


def accuracy(answer: Column, reference: Column) -> Column:
    """Whether the reference stands in the answer."""
    return F.contains(squeezed(answer), squeezed(reference)).cast("double")


def _numbered(words: Column) -> Column:
    """Words with the number of their occurrence, so that lists that repeat words intersect as sets; linear in the sorted words."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (F.try_element_at(s, F.greatest(i, F.lit(1))) != w), i)), lambda i: i.isNotNull())
        size = lambda f, i, j: F.coalesce(F.try_element_at(f, j + 2), F.size(s)) - i
        return F.transform(F.array(first), lambda f: F.transform(f, lambda i, j: F.transform(F.sequence(F.lit(1), size(f, i, j)), lambda k: F.concat(s[i], F.lit("\u0001"), k.cast("string")))))[0]

    return F.flatten(F.transform(F.array(F.sort_array(words)), runs)[0])


def _common(a: Column, b: Column) -> Column:
    """How many words two lists share, repeats counted."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def token_f1(answer: Column, reference: Column) -> Column:
    """F1 of the words of two texts, repeats counted."""
    a, b = F.split(squeezed(answer), " "), F.split(squeezed(reference), " ")
    same = _common(a, b)
    return F.when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (F.size(a) + F.size(b)))


def token_recall(answer: Column, reference: Column) -> Column:
    """Share of the reference's distinct words that the answer holds."""
    a, b = F.array_distinct(tokens(answer)), F.array_distinct(tokens(reference))
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(F.lit(0.0))


def token_overlap(answer: Column, reference: Column) -> Column:
    """Jaccard similarity of the distinct words of two texts."""
    a, b = F.array_distinct(tokens(answer)), F.array_distinct(tokens(reference))
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def rouge_n(answer: Column, reference: Column, n: int) -> Column:
    """F-measure of the n-grams of two texts, repeats counted."""

    def cut(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    def grams(x: Column) -> Column:
        # The words are bound once; named within the inner function they would be cut out anew for every n-gram.
        return F.transform(F.array(tokens(x)), cut)[0]

    a, b = grams(answer), grams(reference)
    same = _common(a, b)
    return F.when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (F.size(a) + F.size(b)))


@F.pandas_udf(T.DoubleType())
def rouge_l(answer: pd.Series, reference: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of the words (lower case) of two texts."""
    import re

    def one(x: str, y: str) -> float:
        a, b = (re.findall(r"[^\W]+", t.lower()) for t in (x or "", y or ""))
        row = [0] * (len(b) + 1)
        for w in a:
            last = 0
            for j, v in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0

    return pd.Series([one(x, y) for x, y in zip(answer, reference)])


def aggregate(scores: DataFrame, *by: str) -> DataFrame:
    """(by, mean, n, stdev, failed, nothing) of scores (status, value); stdev needs two values."""
    good = F.when(F.col("status") == "produced", F.col("value"))
    n = F.count(good)
    return scores.groupBy(*by).agg(F.round(F.avg(good), 9).alias("mean"), n.alias("n"), F.round(F.when(n >= 2, F.stddev_samp(good)), 9).alias("stdev"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "nothing").alias("nothing"))


def slices(scores: DataFrame, metric: str, *axes: str) -> DataFrame:
    """Means by metric, and by metric and each axis alone, in one pass over grouping sets; rows without an axis' value are left out of it."""
    sets = [[F.col(metric)], *[[F.col(metric), F.col(a)] for a in axes]]
    out = scores.groupingSets(sets, metric, *axes).agg(F.round(F.avg("value"), 9).alias("mean"), F.count("value").alias("n"), F.grouping_id().alias("g"))
    whole = 2 ** len(axes) - 1
    keep = F.col("g") == whole
    for i, a in enumerate(axes):
        keep = keep | ((F.col("g") == whole - 2 ** (len(axes) - 1 - i)) & F.col(a).isNotNull())
    return out.where(keep).drop("g")


def nearest_rank(values: DataFrame, q: float, *by: str) -> DataFrame:
    """The value at place ceil(q * n) of each group; null where that is the last, which says nothing of a tail.

    A range sort splits a group over as many tasks as it needs; their counts tell which task holds the place, and only
    its rows are ranked. No group's values come together.
    """
    group = F.struct(F.lit(0).alias("of"), *[F.col(c) for c in by])
    known = values.where(F.col("value").isNotNull()).select(F.to_json(group, {"ignoreNullFields": "false"}).alias("group"), *by, "value")
    laid = written(known.repartitionByRange("group", "value", F.rand(0)).withColumn("task", F.spark_partition_id()), "laid")
    own, so_far = Window.partitionBy("group"), Window.partitionBy("group").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = laid.groupBy("group", "task").agg(F.count("*").alias("c"))
    held = held.select("group", "task", "c", F.sum("c").over(own).alias("n"), F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias("before"))
    at = F.ceil(q * F.col("n")) - F.col("before")
    there = held.withColumn("at", at).where("at between 1 and c")
    ranked = laid.join(there, ["group", "task"]).withColumn("place", F.row_number().over(Window.partitionBy("group", "task").orderBy("value")))
    last = F.ceil(q * F.col("n")) >= F.col("n")
    found = ranked.where("place = at").select(*by, "n", F.when(~last, F.col("value")).alias("value"))
    nothing = values.groupBy(*by).agg(F.count("value").alias("n")).where("n = 0").select(*by, "n", F.lit(None).cast(values.schema["value"].dataType).alias("value"))
    return found.union(nothing)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, n, mean, differing) of b - a over the questions that both answered; (metric, question_id, value)."""
    both = a.select("metric", "question_id", F.col("value").alias("x")).join(b.select("metric", "question_id", F.col("value").alias("y")), ["metric", "question_id"])
    return both.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y") - F.col("x")), 9).alias("mean"), F.count_if(F.col("x") != F.col("y")).alias("differing"))


#: Draws that are read from the stream at once, about; bytes of it that are held, longer ones go by way of a file.
DRAWS, HELD = 1 << 20, 1 << 26


def _laid(data: bytes, length: int, f: BinaryIO) -> bool:
    """Lay SHAKE-256 of data in an empty file; False where there is no room, or not OpenSSL's own function, which writes where it is told.

    hashlib gives the bytes only as one object. The file is mapped, and what is written of it is let go meanwhile.
    """
    try:
        lib = ctypes.CDLL(ctypes.util.find_library("crypto"))
        calls = [getattr(lib, f"EVP_{n}") for n in ("MD_CTX_new", "shake256", "DigestInit_ex", "DigestUpdate", "DigestFinalXOF", "MD_CTX_free")]
        os.posix_fallocate(f.fileno(), 0, length)
    except (OSError, AttributeError, TypeError):
        return False
    p, size = ctypes.c_void_p, ctypes.c_size_t
    for call, gives, takes in zip(calls, (p, p, ctypes.c_int, ctypes.c_int, ctypes.c_int, None), ([], [], [p, p, p], [p, ctypes.c_char_p, size], [p, p, size], [p])):
        call.restype, call.argtypes = gives, takes
    new, shake, begin, update, final, free = calls
    done = threading.Event()

    def let_go() -> None:
        while not done.wait(0.01):
            room.madvise(mmap.MADV_DONTNEED)

    with mmap.mmap(f.fileno(), length) as room:
        at = (ctypes.c_char * length).from_buffer(room)
        context, letting = new(), threading.Thread(target=let_go)
        letting.start()
        try:
            return bool(context) and begin(context, shake(), None) == 1 and update(context, data, len(data)) == 1 and final(context, ctypes.addressof(at), length) == 1
        finally:
            done.set()
            letting.join()
            free(context)
            del at


def _stream(data: bytes, length: int, part: int) -> Iterator[bytes]:
    """So many bytes of SHAKE-256 of data, a part at a time."""
    if length > HELD:
        with tempfile.TemporaryFile() as f:
            if _laid(data, length, f):
                f.seek(0)
                yield from iter(lambda: f.read(part), b"")
                return
    raw = memoryview(hashlib.shake_256(data).digest(length))
    for a in range(0, length, part):
        yield raw[a : a + part]


def _resamples(data: str, n: int, resamples: int) -> Iterator[np.ndarray]:
    """Places drawn for the resamples of n values, some resamples (rows) at a time."""
    room = (1 << 32) // n * n
    rest = np.empty(0, np.int64)
    for part in _stream(data.encode(), resamples * n * 5, 4 * max(DRAWS, n)):
        some = np.frombuffer(part, ">u4").astype(np.int64)
        rest = np.concatenate((rest, some[some < room] % n))
        rows = min(len(rest) // n, resamples)
        if rows:
            yield rest[: rows * n].reshape(rows, n)
        rest, resamples = rest[rows * n :], resamples - rows
        if not resamples:
            return


def bootstrap_interval(differences: list[float], resamples: int = 2000) -> tuple[float, float] | None:
    """The middle 95 % of resampled means; draws come from SHAKE-256 of the data, so equal data give equal bounds."""
    n = len(differences)
    if n < 2:
        return None
    values = np.asarray(differences, float)
    means = np.sort(np.concatenate([values[picks].mean(axis=1) for picks in _resamples(",".join(repr(float(x)) for x in differences), n, resamples)]))
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


def intervals(differences: DataFrame, resamples: int = 2000) -> DataFrame:
    """(metric, low, high) of differences (metric, question_id, value), one group a metric."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = bootstrap_interval(pdf.sort_values("question_id")["value"].tolist(), resamples)
        return pd.DataFrame([(pdf["metric"].iloc[0], *(found or (None, None)))], columns=["metric", "low", "high"])

    return differences.groupBy("metric").applyInPandas(run, "metric string, low double, high double")


def verdict(low: Column, high: Column, mean: Column, margin: float) -> Column:
    """What an interval says of an effect."""
    return (
        F.when(high < 0, "harm")
        .when(high < margin, "benefit-ruled-out")
        .when((low > 0) & (mean >= margin), "worthwhile")
        .when(low > 0, "positive-below-margin")
        .otherwise("inconclusive")
    )


def spread(scores: DataFrame) -> DataFrame:
    """(metric, low, high) of the repetitions' means; a metric that a repetition lacks has none."""
    reps = scores.select("rep").distinct().count()
    means = scores.groupBy("metric", "rep").agg(F.avg("value").alias("mean"))
    return means.groupBy("metric").agg(F.round(F.min("mean"), 9).alias("low"), F.round(F.max("mean"), 9).alias("high"), F.count("*").alias("reps")).where((F.col("reps") == reps) & (F.col("reps") >= 2)).drop("reps")


def oracle(scores: DataFrame) -> DataFrame:
    """(metric, best_arm, best_mean, oracle): the best arm's mean and the mean of each question's best arm."""
    arms = scores.groupBy("metric", "arm").agg(F.round(F.avg("value"), 9).alias("mean")).groupBy("metric").agg(F.min(F.struct((-F.col("mean")).alias("m"), "arm")).alias("b"))
    top = scores.groupBy("metric", "question_id").agg(F.max("value").alias("v")).groupBy("metric").agg(F.round(F.avg("v"), 9).alias("oracle"))
    return arms.select("metric", F.col("b.arm").alias("best_arm"), (-F.col("b.m")).alias("best_mean")).join(top, "metric")


def pairwise(judged: DataFrame) -> DataFrame:
    """(n, wins, losses, ties, rate) of pairs judged in both orders (forward, backward: 'a', 'b' or 'tie').

    Both orders must agree, else it is a tie.
    """
    verdict_ = F.when(F.col("forward") == F.col("backward"), F.col("forward")).otherwise("tie")
    v = judged.select(verdict_.alias("v"))
    wins, losses, n = F.count_if(F.col("v") == "b"), F.count_if(F.col("v") == "a"), F.count("*")
    return v.agg(n.alias("n"), wins.alias("wins"), losses.alias("losses"), (n - wins - losses).alias("ties"), F.round((wins + 0.5 * (n - wins - losses)) / n, 9).alias("rate"))


def overlap_at(answer: Column, reference: Column, threshold: float) -> Column:
    """1 where at least that share of the reference's distinct blank-separated words stands in the answer, else 0."""
    a, b = F.array_distinct(F.split(squeezed(answer), " ")), F.array_distinct(F.split(squeezed(reference), " "))
    return (F.size(F.array_intersect(a, b)) / F.size(b) >= threshold).cast("double")


def key_term_precision(answer: Column, reference: Column, stopwords: list[str]) -> Column:
    """Share of the answer's distinct words, stopwords aside, that the reference holds."""
    drop = F.array(*map(F.lit, stopwords))
    a, b = F.array_except(tokens(answer), drop), F.array_distinct(tokens(reference))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def judged_ratio(verdicts: DataFrame, *by: str) -> DataFrame:
    """Share of a judge's verdicts (good boolean) that hold: faithfulness, context recall and relevance, completeness."""
    return verdicts.groupBy(*by).agg(F.round(F.avg(F.col("good").cast("double")), 9).alias("score"), F.count("*").alias("verdicts"))


def answer_correctness(verdicts: DataFrame, similarity: DataFrame, weight: float = 0.75) -> DataFrame:
    """(question_id, score): weight * F1 of facts judged tp, fp or fn, and the rest by the answers' similarity."""
    n = lambda k: F.count_if(F.col("verdict") == k)
    facts = verdicts.groupBy("question_id").agg((2 * n("tp") / F.greatest(2 * n("tp") + n("fp") + n("fn"), F.lit(1))).alias("f1"))
    return facts.join(similarity, "question_id").select("question_id", F.round(weight * F.col("f1") + (1 - weight) * F.col("similarity"), 9).alias("score"))


def first_by_document(hits: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, rank): each document's best hit, up to k documents, named by the document.

    documents: (node_id, document).
    """
    from pyspark.sql import Window

    best = hits.join(documents, "node_id").groupBy("query_id", "document").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "document")
    return best.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", F.col("document").alias("node_id"), "rank")


def pooled_interval(sums: list[float], counts: list[int], resamples: int = 2000) -> tuple[float, float] | None:
    """The middle 95 % of resampled ratios of summed differences to summed counts, whole questions drawn."""
    n = len(sums)
    if n < 2 or not sum(counts):
        return None
    x, y = np.asarray(sums, float), np.asarray(counts, float)
    drawn = [(x[picks].sum(axis=1), y[picks].sum(axis=1)) for picks in _resamples(",".join(f"{float(s)!r}/{c}" for s, c in zip(sums, counts)), n, resamples)]
    top, low = (np.concatenate(part) for part in zip(*drawn))
    ratios = np.sort(top[low > 0] / low[low > 0])
    return float(np.quantile(ratios, 0.025)), float(np.quantile(ratios, 0.975))


def judge_differences(differences: DataFrame, spreads: DataFrame) -> DataFrame:
    """(metric, judgement): whether a difference is outside the spread of repetitions, within it, or unjudgeable."""
    both = differences.join(spreads.select("metric", (F.col("high") - F.col("low")).alias("width")), "metric", "full_outer")
    said = F.when(F.col("mean").isNull() | F.col("width").isNull(), "unjudgeable").when(F.abs("mean") > F.col("width"), "outside").otherwise("within")
    return both.select("metric", said.alias("judgement"))


def in_tiers(questions: DataFrame, documents: DataFrame, tiers: list[str]) -> DataFrame:
    """Questions (question_id, documents array) all of whose documents (document, tier) are in an allowed tier."""
    each = questions.select("question_id", F.explode("documents").alias("document")).join(documents.where(F.col("tier").isin(tiers)), "document", "left_anti")
    return questions.join(each.select("question_id").distinct(), "question_id", "left_anti")


def resolve_labels(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(label, document, matches): the one document whose path ends in the label's parts; null where none or several do.

    Labels and paths meet on their last part, then on the whole suffix.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    a, b = labels.select("label", last("label").alias("name")), documents.select("document", last("document").alias("name"))
    fits = a.join(b, "name").where((F.col("document") == F.col("label")) | F.col("document").endswith(F.concat(F.lit("/"), "label")))
    found = fits.groupBy("label").agg(F.count("*").alias("n"), F.min("document").alias("one"))
    return labels.select("label").join(found, "label", "left").select("label", F.when(F.col("n") == 1, F.col("one")).alias("document"), F.coalesce("n", F.lit(0)).alias("matches"))


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(role, model, tokens in and out, cost) of calls (role, model, prompt, completion) at prices a million tokens."""
    sums = calls.groupBy("role", "model").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    cost = (F.col("prompt") * F.col("price_in") + F.col("completion") * F.col("price_out")) / 1_000_000
    return sums.join(prices, "model", "left").select("role", "model", "prompt", "completion", F.round(cost, 9).alias("cost"))


#: Bytes of a vector's component by precision.
BYTES = {"float32": 4.0, "float16": 2.0, "int8": 1.0, "binary": 0.125}


def storage_projection(documents: int, chunks_per_document: float, width: int, precision: str = "float32") -> int:
    """Bytes of the vectors that so many documents will have."""
    return round(documents * chunks_per_document * width * BYTES[precision])


def set_digest(rows: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows or columns: sums of four parts of each row's
    SHA-256 and the number of rows, which Spark adds up; one row reaches the driver."""
    names = sorted(rows.columns)
    each = rows.select(F.sha2(F.to_json(F.struct(*names)), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    said = ",".join(str(x) for x in each.agg(F.count("*"), *parts).first())
    return hashlib.sha256(f"{','.join(names)}\n{said}".encode()).hexdigest()


def implies(rule: dict[str, tuple[float, float]], claim: dict[str, tuple[float, float]]) -> bool:
    """Whether every case that a rule's intervals let in is one that a claim's intervals cover."""
    return all(f in rule and low <= rule[f][0] and rule[f][1] <= high for f, (low, high) in claim.items())
