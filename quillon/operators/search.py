"""Ranking scans: exact and quantised vector search, BM25, term matching.

Searches take all questions at once. Question sets are taken in blocks whose rows and bytes are counted as they are
read; a block goes to all tasks, each task scores its nodes by matrix products and keeps its k best of every question,
and only these are exchanged. A node is never shuffled, and a frequent term costs no more than a rare one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.identity import tokens
from quillon.session import written

#: Questions that are scored together, at most, and numbers (or terms times questions) that a block of them holds.
BLOCK, CELLS = 4096, 1 << 23
#: Scores that a task holds at once, about, and bytes of text that it takes apart at once, or one longer text.
SCORES, TEXT = 1 << 22, 1 << 20


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each question, ties by id; rank from 0. Spark keeps k a task before the exchange."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


class _Best:
    """The k best nodes of each question that a task has seen; equal scores go by id."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.least = np.full(questions, -np.inf)
        self.query, self.score, self.node = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, nodes: np.ndarray) -> None:
        """scores: nodes by questions; what is -infinity is no hit."""
        if len(scores) > self.k:
            kth = np.partition(scores, -self.k, axis=0)[-self.k]
            self.least = np.maximum(self.least, kth)
        at, query = np.nonzero((scores >= self.least) & (scores > -np.inf))
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, scores[at, query]))
        node = nodes[at] if self.node is None else np.concatenate((self.node, nodes[at]))
        order = np.lexsort((node, -score, query))
        query = query[order]
        begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        keep = order[place < self.k]
        self.query, self.score, self.node = query[place < self.k], score[keep], node[keep]
        full = place == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[order[full]])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of at most so many rows and, where they hold texts (lowered), of about TEXT bytes."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("lowered")).to_numpy(zero_copy_only=False)) if "lowered" in batch.schema.names else np.zeros(batch.num_rows)
        a = 0
        while a < batch.num_rows:
            full = int(np.searchsorted(size, (size[a - 1] if a else 0) + TEXT, "right"))
            b = min(max(full, a + 1), a + (rows or batch.num_rows))
            yield batch.slice(a, b - a)
            a = b


def _hits(nodes: DataFrame, queries: DataFrame, blocks: Iterator[tuple[list, object]], score: Callable, k: int) -> DataFrame:
    """The hits (query_id, node_id, score, rank) of all blocks (ids, what `score` needs of them).

    score(what, batch) gives scores by node and question. A block's hits are written, so that a later use asks
    nothing again.
    """
    spark = nodes.sparkSession
    node_type = nodes.schema["node_id"].dataType
    types = T.StructType([T.StructField("query", T.LongType()), T.StructField("node_id", node_type), T.StructField("score", T.DoubleType())])
    asked_type = queries.schema["query_id"].dataType
    out = None
    for ids, what in blocks:
        sent = spark.sparkContext.broadcast(what)
        n = len(ids)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, n=n) -> Iterator[pa.RecordBatch]:
            best, kind = _Best(n, k), None
            step = max(1, SCORES // max(1, n))
            for some in _pieces(batches, step):
                kind = some.schema.field("node_id").type
                best.add(score(sent.value, some), np.array(some.column("node_id").to_pylist()))
            if best.node is not None:
                for a in range(0, len(best.query), 10_000):
                    rows = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(best.query[rows]), pa.array(best.node[rows].tolist(), kind), pa.array(best.score[rows])], names=types.names)

        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", asked_type)]))
        found = nodes.mapInArrow(scan, types).join(F.broadcast(names), "query").select("query_id", "node_id", "score")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", asked_type), T.StructField("node_id", node_type), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return written(_top(out, k), "hits")


def _vector_blocks(queries: DataFrame, signs: bool = False) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix of unit vectors, or of signs) of the questions; a zero vector stays zero, repeated ids stay apart."""
    ids: list = []
    rows: list[np.ndarray] = []
    for r in queries.select("query_id", "vector").toLocalIterator():
        if rows and (len(ids) == BLOCK or (len(ids) + 1) * len(r["vector"]) > CELLS or len(r["vector"]) != len(rows[0])):
            yield ids, _signs(np.array(rows)) if signs else _unit(np.array(rows))
            ids, rows = [], []
        ids.append(r["query_id"])
        rows.append(np.array(r["vector"], float))
    if ids:
        yield ids, _signs(np.array(rows)) if signs else _unit(np.array(rows))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _signs(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, 1.0, -1.0)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors as rows; another width than the questions' is refused."""
    column = batch.column("vector")
    if not pc.all(pc.equal(pc.list_value_length(column), width)).as_py() and batch.num_rows:
        raise ValueError("vector width differs from the question's")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def vector_top_k(queries: DataFrame, nodes: DataFrame, k: int = 20, where=None) -> DataFrame:
    """(query_id, node_id, score, rank) by cosine similarity; nodes without a vector are left out.

    queries: (query_id, vector); nodes: (node_id, vector) and what `where`, a predicate that is pushed into the
    scan, needs. Vectors of another width than the question's are refused.
    """
    nodes = nodes.where(F.col("vector").isNotNull())
    if where is not None:
        nodes = nodes.where(where)

    def score(asked: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        return np.round(_unit(_matrix(batch, asked.shape[1])) @ asked.T, 9)

    return _hits(nodes.select("node_id", "vector"), queries, _vector_blocks(queries), score, k)


def quantised_top_k(queries: DataFrame, nodes: DataFrame, k: int = 20, oversampling: int = 4) -> DataFrame:
    """The k best by cosine of the `oversampling` * k candidates that share most signs with the question.

    Signs are all that the scan compares; the vectors of the candidates alone are joined back and scored exactly.
    """
    nodes = nodes.where(F.col("vector").isNotNull()).select("node_id", "vector")

    def same(asked: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        return (_signs(_matrix(batch, asked.shape[1])) @ asked.T + asked.shape[1]) / 2

    near = _hits(nodes, queries, _vector_blocks(queries, signs=True), same, oversampling * k).select("query_id", "node_id")
    full = near.join(nodes, "node_id").join(queries.select("query_id", F.col("vector").alias("asked")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, -1) for c in ("vector", "asked"))
            cosine = np.round((_unit(x) * _unit(y)).sum(axis=1), 9)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node_id"), pa.array(cosine)], names=["query_id", "node_id", "score"])

    schema = T.StructType([near.schema["query_id"], near.schema["node_id"], T.StructField("score", T.DoubleType())])
    return _top(full.select("query_id", "node_id", "vector", "asked").mapInArrow(exact, schema), k)


_POSTINGS = ("node_id", "length", "terms", "counts")


#: The words of `tokens` in lower-cased text.
_WORD = re.compile(r"\w+")


def _lowered(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.lower(F.coalesce("content", F.lit(""))).alias("lowered"))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(node_id, length, terms, counts) of a batch (node_id, lowered); a batch of postings as it is."""
    if "lowered" not in batch.schema.names:
        return batch
    words = [_WORD.findall(x.as_py()) for x in batch.column("lowered")]
    length = np.fromiter(map(len, words), np.int64, len(words))
    every = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
    size = max(1, len(every.dictionary))
    at, n = np.unique(np.repeat(np.arange(len(length)), length) * size + every.indices.to_numpy(zero_copy_only=False), return_counts=True)
    offsets = pa.array(np.searchsorted(at, np.arange(len(length) + 1) * size).astype(np.int32))
    terms = pa.ListArray.from_arrays(offsets, every.dictionary.take(pa.array(at % size)))
    return pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(length), terms, pa.ListArray.from_arrays(offsets, pa.array(n))], names=list(_POSTINGS))


def postings(nodes: DataFrame) -> DataFrame:
    """(node_id, length, terms, counts): a row a node (node_id, content), its distinct terms and how often each stands.

    Row-local; where many blocks of questions are asked, store it, and searches read it instead of the texts.
    """
    schema = T.StructType([nodes.schema["node_id"], T.StructField("length", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    return _lowered(nodes).mapInArrow(lambda batches: map(_counted, _pieces(batches)), schema)


def _term_blocks(queries: DataFrame) -> Iterator[tuple[list, list[set[str]]]]:
    """(ids, distinct terms) of the questions, so many together that terms times questions stay within CELLS."""
    ids: list = []
    sets: list[set[str]] = []
    seen: set[str] = set()
    for r in queries.select("query_id", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("terms")).toLocalIterator():
        if ids and (len(ids) == BLOCK or (len(ids) + 1) * len(seen.union(r["terms"])) > CELLS):
            yield ids, sets
            ids, sets, seen = [], [], set()
        ids.append(r["query_id"])
        sets.append(set(r["terms"]))
        seen |= sets[-1]
    if ids:
        yield ids, sets


def _found(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, term, how often) of the batch's postings of the given terms."""
    column = batch.column("terms")
    at = pc.index_in(column.flatten(), value_set=terms)
    node = np.repeat(np.arange(batch.num_rows), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    there = at.is_valid().to_numpy(zero_copy_only=False)
    tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
    return node[there], at.filter(pa.array(there)).to_numpy(zero_copy_only=False).astype(np.int64), tf[there].astype(float)


def _product(node: np.ndarray, term: np.ndarray, part: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Scores by node and question: postings as a matrix, some nodes at a time, times the terms' weights."""
    out = np.zeros((n, weights.shape[1]))
    step = max(1, SCORES // max(1, len(weights)))
    for a in range(0, n, step):
        i, j = np.searchsorted(node, (a, a + step))
        held = np.zeros((min(step, n - a), len(weights)))
        held[node[i:j] - a, term[i:j]] = part[i:j]
        out[a : a + step] = held @ weights
    return out


def _asked(sets: list[set[str]]) -> tuple[list[str], np.ndarray]:
    """(terms, 1 where a question has a term, by term and question)."""
    terms = sorted(set().union(*sets))
    place = {t: i for i, t in enumerate(terms)}
    has = np.zeros((len(terms), len(sets)))
    for q, s in enumerate(sets):
        has[[place[t] for t in s], q] = 1
    return terms, has


def _statistics(source: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """(nodes, their words, how many nodes hold each term): counted in the tasks, added up by term."""
    sent = source.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.string())
        df = np.zeros(len(wanted) + 2, np.int64)
        for batch in map(_counted, _pieces(batches)):
            df[2:] += np.bincount(_found(batch, wanted)[1], minlength=len(wanted))
            df[:2] += batch.num_rows, batch.column("length").to_numpy(zero_copy_only=False).sum()
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    df = np.zeros(len(terms) + 2)
    for r in source.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    return int(df[0]), int(df[1]), df[2:]


def bm25(queries: DataFrame, nodes: DataFrame, k: int = 20, *, k1: float = 1.2, b: float = 0.75, index: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, score, rank) by BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); positive scores only.

    N and the mean length are measured over all nodes; each distinct term of a question has weight 1. A block of
    questions takes one scan that counts and one that scores, of `index` (a stored result of `postings`) or, for a
    single block, of the texts; for more blocks postings are stored first, so that texts are read once.
    """
    asked = _term_blocks(queries)
    begun = list(islice(asked, 2))
    source = index if index is not None else _lowered(nodes) if len(begun) < 2 else written(postings(nodes), "postings")

    def blocks() -> Iterator[tuple[list, object]]:
        for ids, sets in chain(begun, asked):
            terms, has = _asked(sets)
            n, total, df = _statistics(source, terms)
            yield ids, (terms, has * np.log(1 + (n - df + 0.5) / (df + 0.5))[:, None], total / n if total else 1.0)

    def score(what: tuple, batch: pa.RecordBatch) -> np.ndarray:
        terms, weights, mean = what
        batch = _counted(batch)
        node, term, tf = _found(batch, pa.array(terms, pa.string()))
        length = batch.column("length").to_numpy(zero_copy_only=False)[node]
        scores = np.round(_product(node, term, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), weights, batch.num_rows), 6)
        return np.where(scores > 0, scores, -np.inf)

    return _hits(source, queries, blocks(), score, k)


def term_match(queries: DataFrame, nodes: DataFrame, every: bool = False, k: int = 20, *, index: DataFrame | None = None) -> DataFrame:
    """Nodes that hold any, or every, distinct term of a question, the most matched terms first."""
    source = _lowered(nodes) if index is None else index

    def score(what: tuple, batch: pa.RecordBatch) -> np.ndarray:
        terms, has = what
        batch = _counted(batch)
        node, term, tf = _found(batch, pa.array(terms, pa.string()))
        scores = np.round(_product(node, term, np.ones(len(tf)), has, batch.num_rows))
        return np.where((scores > 0) & (scores >= (has.sum(axis=0) if every else 1)), scores, -np.inf)

    return _hits(source, queries, ((ids, _asked(sets)) for ids, sets in _term_blocks(queries)), score, k)


def text_rank(queries: DataFrame, nodes: DataFrame, k: int = 20, *, normalization: int = 0, index: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, score, rank): nodes that hold any term of a question, by frequency rank.

    A term that stands n times counts 0.1 * (1 + 1/4 + ... + 1/n**2) * 6 / pi**2, and the sum is divided by the
    question's terms. normalization, a sum of: 1 divides by log2(length + 1), 2 by the length, 8 by the distinct terms,
    16 by log2(distinct terms + 1), 32 by itself plus one, in this order.
    """
    if normalization & ~59:
        raise ValueError("normalization is a sum of 1, 2, 8, 16 and 32")
    source = _lowered(nodes) if index is None else index

    def score(what: tuple, batch: pa.RecordBatch) -> np.ndarray:
        terms, has = what
        batch = _counted(batch)
        node, term, tf = _found(batch, pa.array(terms, pa.string()))
        squares = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, int(tf.max(initial=0)) + 1) ** 2)))
        scores = _product(node, term, 0.1 * squares[tf.astype(int)] / 1.64493406685, has / np.maximum(has.sum(axis=0), 1), batch.num_rows)
        length, distinct = (np.maximum(x.to_numpy(zero_copy_only=False), 1)[:, None] for x in (batch.column("length"), pc.list_value_length(batch.column("terms"))))
        for bit, by in ((1, np.log2(length + 1)), (2, length), (8, distinct), (16, np.log2(distinct + 1))):
            if normalization & bit:
                scores = scores / by
        if normalization & 32:
            scores = scores / (scores + 1)
        scores = np.round(scores, 9)
        return np.where(scores > 0, scores, -np.inf)

    return _hits(source, queries, ((ids, _asked(sets)) for ids, sets in _term_blocks(queries)), score, k)
